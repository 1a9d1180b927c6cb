"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, saved

#: Bits of virtual time that one counting pass looks at.
PROBE_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), budget: float = 1.0, most_repeats: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from one (source, source_size) row a source.

    Sources by code point, null last, weigh ``weights`` in turn. They share ``budget``
    times all sizes; no target passes ``most_repeats`` times its source's size, and what
    it would have had beyond goes to the others by weight. The level of the fair queue is
    closed form: with sources in the order they fill up, it is the largest
    (budget - what the earlier hold) / (weights of the rest) that its source still bears.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn(
        "most", (F.col("source_size") * most_repeats).cast("double"),
    ).withColumn("full_at", F.col("most") / F.col("weight"))
    earlier = Window.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    held, used = (F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) for c in ("most", "weight"))
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * F.lit(budget) - held) / (F.sum("weight").over(whole) - used))
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole)
    return rows.select(
        "source", "source_size", "weight",
        F.least("most", F.coalesce(F.col("weight") * level, F.col("most"))).alias("target"),
    )


def cut_level(packets: DataFrame, budget: int, ticks: int) -> tuple[int, int, int]:
    """The virtual time at which the queue has sent ``budget`` words: (t, p, q) for t + p / q.

    packets: (begin, finish, rate), integers of virtual time at which a document's words
    begin and end, ``rate`` words in ``ticks``. Words sent are summed exactly in ranges of
    virtual time: a packet adds to each range that it overlaps, and as one source has one packet at any
    time, those over a boundary are no more than the sources. Prefix sums over the ranges
    find the one where the budget ends, which is parted anew until it is one tick long. A
    pass returns 2**PROBE_BITS rows at most, whatever the data. Beyond the last word: the end.
    """
    end = packets.agg(F.max("finish")).first()[0] or 0
    low, shift, sent = 0, max(end.bit_length(), 1), 0
    while shift:
        step = min(PROBE_BITS, shift)
        shift -= step
        high = low + (1 << (shift + step))
        inside = packets.where((F.col("finish") > low) & (F.col("begin") < high)).select(
            F.greatest("begin", F.lit(low)).alias("b"), F.least("finish", F.lit(high)).alias("f"), "rate",
        )
        cell = F.explode(F.sequence(F.shiftright(F.col("b") - low, shift), F.shiftright(F.col("f") - low - 1, shift)))
        inside = inside.select("b", "f", "rate", cell.alias("cell"))
        start = F.lit(low) + F.shiftleft("cell", shift)
        words = (F.least("f", start + (1 << shift)) - F.greatest("b", start)) * F.col("rate")
        found = dict(inside.groupBy("cell").agg(F.sum(words.cast("decimal(38,0)")).alias("words")).collect())
        for cell_ in range(1 << step):
            more = int(found.get(cell_, 0))  # in words times ticks
            if sent + more > budget * ticks:
                low += cell_ << shift
                break
            sent += more
        else:
            return end, 0, 1
    return low, budget * ticks - sent, more


def fair_queue(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), budget: float = 1.0, most_repeats: int = 3,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """Every document in the mix's order: doc_id, source, size, source_size, target, finish, taken, copies.

    Documents of a source stand in an order shuffled by a digest of doc_id, or of the text
    where that is null (ties: size). A document's virtual finish time is its source's
    cumulative words, itself included, divided by the source's weight; in later rounds
    through the source (``most_repeats`` in all) its size per round is added. The queue of
    all rounds of all sources is cut where its words reach the budget (see ``cut_level``):
    what finishes before counts whole, what begins before and ends after counts in part.
    So each source gets its target to the word. ``copies`` rounds ``taken`` to whole
    documents (an empty document has one copy). Rows come range-sorted by ``finish``.

    Cumulative sums run over buckets of the digest (about ``bucket_rows`` rows each), with
    the buckets' totals summed first, so no source is ever in one task. Null source is a
    source; null text has size 0; rows alike in doc_id and size are told apart arbitrarily
    but get the same total; further columns are ignored; no rows give none.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))
    rows = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(ident.cast("binary")).alias("digest")))
    number, digits = rows.count(), 1
    while 16**digits * bucket_rows < number and digits < 15:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("digest", 1, digits))
    sums = saved(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    plan = saved(targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, budget, most_repeats))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    offsets = offsets.withColumnRenamed("source", "of").join(
        plan.withColumnRenamed("source", "of_"), F.col("of").eqNullSafe(F.col("of_")),
    ).drop("of_").withColumnRenamed("bucket", "in_bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, rows["source"].eqNullSafe(offsets["of"]) & (rows["bucket"] == offsets["in_bucket"]))
    rate = F.col("weight").cast("long")
    rows = rows.withColumn("start", F.col("before") + F.col("inside")).withColumn(
        "finish", (F.col("start") + F.col("size")) / F.col("weight"),
    )
    rows = saved(rows.select("doc_id", "source", "size", "source_size", "weight", "target", "finish", "start"))
    of_round = rows.where("size > 0").select(
        "start", "size", "source_size", rate.alias("rate"),
        F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("round"),
    )
    first = F.col("start") + F.col("round") * F.col("source_size")
    ticks = math.lcm(*weights)  # of virtual time, in which a source of weight 1 sends a word
    each = (F.lit(ticks) / F.col("rate")).cast("long")
    packets = of_round.select((first * each).alias("begin"), ((first + F.col("size")) * each).alias("finish"), "rate")
    total = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    low, p, q = cut_level(packets, int(total * budget), ticks)
    # Words that a source of each weight has sent by then.
    sent = F.element_at(
        F.create_map(*[F.lit(x) for w in sorted(set(weights)) for x in (w, (low * q + p) * w // (ticks * q))]),
        F.col("weight").cast("int"),
    ).cast("long")
    part = lambda k: F.greatest(F.lit(0), F.least("size", sent - F.lit(k) * F.col("source_size") - F.col("start")))
    taken = part(0)
    for k in range(1, most_repeats):
        taken = taken + part(k)
    rows = rows.withColumn("taken", taken.cast("long"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    mixed = rows.select("doc_id", "source", "size", "source_size", "target", "finish", "taken", copies.alias("copies"))
    return mixed.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")
