"""Sharding by histogram sort: equal bytes per shard, found by counting, moved by one exchange."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

#: Bits of the key that one counting pass looks at, so a pass returns at most 2**PROBE_BITS rows a splitter.
PROBE_BITS = 10
KEY_BITS = 60
#: Of these the low ones, which come from the identifier.
IDENT_BITS = 32


def shard_key(text: Column, ident: Column) -> Column:
    """A 60-bit key: 28 bits of the text's digest, then 32 of the identifier's and text's.

    Equal texts lie side by side, and a group of copies of any size can still be cut
    between two of its identifiers.
    """
    value = F.coalesce(text, F.lit(""))
    part = lambda c, n: F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, n), 16, 10).cast("long")
    return part(value, 7) * F.lit(1 << 32) + part(F.concat_ws(":", ident.cast("string"), F.length(value).cast("string")), 8)


def find_splitters(keys: DataFrame, pieces: int, tolerance: float = 0.0) -> list[int]:
    """The ``pieces - 1`` keys that cut (key, size) rows into near-equal sums of size.

    Every pass counts the exact bytes below the candidate boundaries of each open
    splitter in one aggregate, and narrows the splitter's interval to the piece between
    two of them. A splitter is closed when its interval holds one key only, or no more
    bytes than ``tolerance`` of a piece. With tolerance 0 a row's piece is
    floor(bytes below its key * pieces / all bytes). No rows: no splitters.
    """
    low, shift = {0: 0}, KEY_BITS
    total, found, open_at = None, {}, {0: list(range(1, pieces))}
    while open_at:
        shift -= PROBE_BITS
        probe = F.shiftright("key", shift)
        parent = F.shiftright("key", shift + PROBE_BITS)
        rows = keys if total is None else keys.where(parent.isin(list(open_at)))
        counted = rows.groupBy(parent.alias("parent"), probe.alias("probe")).agg(
            F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"),
        ).collect()
        by_parent: dict[int, list] = {}
        for row in counted:
            by_parent.setdefault(row["parent"], []).append(row)
        if total is None:
            total = sum(r["bytes"] for r in counted)
            if not total:
                return []
        now_open: dict[int, list[int]] = {}
        now_low: dict[int, int] = {}
        for group, cuts in open_at.items():
            below = low[group]
            cuts = list(cuts)
            for row in sorted(by_parent[group], key=lambda r: r["probe"]):
                above = below + row["bytes"]
                while cuts and above * pieces >= cuts[0] * total:
                    cut = cuts.pop(0)
                    if row["first"] == row["last"] or not shift or row["bytes"] * pieces <= tolerance * total:
                        found[cut] = row["last"] + 1
                    else:
                        now_open.setdefault(row["probe"], []).append(cut)
                        now_low[row["probe"]] = below
                below = above
        open_at, low = now_open, now_low
    return [found[i] for i in range(1, pieces)]


def place(column: Column, splitters: list[int]) -> Column:
    """How many of the ascending splitters are at or below the column, by nested comparison."""
    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(splitters[mid]), between(mid + 1, hi)).otherwise(between(lo, mid))

    return between(0, len(splitters))


def _pieces(keys: DataFrame, rows: int) -> DataFrame:
    """``keys`` with ``piece``: the key without its low bits, so that pieces are ranges of about ``rows`` rows.

    As many leading bits are kept as there would be pieces of evenly spread keys, of the
    text's digest at most. A piece that holds many more (the copies of a text) keeps more
    bits, of the identifier's digest; these few are a table that the keys are joined with.
    """
    number = keys.count()
    bits = min(KEY_BITS - IDENT_BITS, max(0, math.ceil(math.log2(max(1, number / rows)))))
    cell = F.shiftright("key", KEY_BITS - bits)
    heavy = keys.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > 4 * rows)
    deep = F.least(F.ceil(F.log2(F.col("n") / rows)), F.lit(IDENT_BITS)).cast("int")
    heavy = saved(heavy.select(F.col("cell").alias("of_cell"), deep.alias("deep")))
    cut = lambda low: F.call_function("shiftleft", F.call_function("shiftright", F.col("key"), low), low)
    low = F.when(F.col("deep").isNull(), F.lit(KEY_BITS - bits)).otherwise(F.lit(IDENT_BITS) - F.col("deep"))
    return keys.join(heavy, cell == F.col("of_cell"), "left").withColumn("piece", cut(low)).drop("of_cell", "deep")


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.0, piece_rows: int = 50_000) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) of every row.

    ``size`` is the text's UTF-8 bytes plus 8. Only the ``shards`` - 1 splitters are found
    with the driver's help. The one exchange moves ranges of keys of about ``piece_rows``
    rows, not shards, and the slot inside a shard is the rows of its earlier ranges plus
    the place in the range; both are counted in the cluster. A null text counts as empty
    (size 8, crc 0); null doc_ids are told apart by their rows' places in the input; rows
    equal in doc_id and text length stay in one shard, further columns are ignored, no
    rows give none.
    """
    text = F.coalesce("text", F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    keys = saved(
        docs.select(
            "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), shard_key(F.col("text"), ident).alias("key"),
        )
    )
    splitters = find_splitters(keys.select("key", "size"), shards, tolerance)
    placed = _pieces(keys, piece_rows).withColumn("shard", place(F.col("key"), splitters).cast("int"))
    counts = saved(placed.groupBy("shard", "piece").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "piece").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = placed.withColumn("place", F.row_number().over(order))
    return ranked.join(starts, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", "key", "shard", (F.col("start") + F.col("place") - 1).alias("slot"),
    )
