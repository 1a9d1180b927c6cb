"""The algebra of sorted runs: flush, winners, three merges, selection, sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.crc32c import crc32c_column
from tidemark.functions.keys import expired, in_range
from tidemark.operators.intervals import Best, locate
from tidemark.operators.state import KEY, RECORD

NAME = r"^(segments/([0-9a-f]{16})-([0-9a-f]{16})\.oseg|values/([0-9a-f]{16})-([0-9a-f]{16})\.oval)$"
GRACE_MILLIS, SKEW_MILLIS = 3_600_000, 300_000
FULL_FLUSHES, TIMER_FLUSHES, INPUT_BYTES = 4, 120, 32 << 20


def flush(memory: DataFrame, path: str, partitions: int | None = None) -> None:
    """A memtable's newest records as sorted runs: one range exchange, files in key order, so row groups prune."""
    ranged = memory.repartitionByRange(partitions, *KEY) if partitions else memory.repartitionByRange(*KEY)
    ranged.sortWithinPartitions(*KEY).write.parquet(path)


def segment_stats(records: DataFrame, by: list[str]) -> DataFrame:
    size = F.lit(40) + F.octet_length("key") + F.col("value_bytes")
    return records.groupBy(*by).agg(
        (F.lit(96) + F.sum(size)).cast("long").alias("bytes"), F.count("*").alias("record_count"),
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("lamport").alias("min_lamport"),
        F.max("lamport").alias("max_lamport"),
    )


def winners(records: DataFrame) -> DataFrame:
    """The newest record of each key over several runs."""
    newest = F.max_by(F.struct("sequence", *RECORD), "lamport").alias("r")
    return records.groupBy(*KEY).agg(F.max("lamport").alias("lamport"), newest).select(*KEY, "lamport", "r.*")


def duplicate_lamports(records: DataFrame) -> DataFrame:
    """Two records of a key with one lamport are corruption, whoever wins."""
    return records.groupBy(*KEY, "lamport").agg(F.count("*").alias("copies")).where("copies > 1")


def _bounds(runs: DataFrame, *columns: Column) -> DataFrame:
    """Runs as half-open ranges of keys: the key after the last is that with a zero byte behind it."""
    return runs.select("keyspace_id", "min_key", F.concat("max_key", F.lit("\0")), *columns)


def candidate_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """``keys`` with how many runs' key bounds hold each (``candidates``) and the name of the newest of these."""

    def combine(before: tuple, now: tuple | None) -> tuple:
        count, order, name = now or (0, None, None)
        if order is None or (before[1] is not None and before[1] <= order):
            order, name = before[1:]
        return before[0] + count, order, name

    ranges = _bounds(runs, -F.col("max_lamport"), F.col("name"))
    return locate(keys, ranges, Best, "candidates long, order_ long, newest string", combine, (0, None, None)).drop("order_")


def _covered(won: DataFrame, retained: DataFrame) -> DataFrame:
    """``won`` with ``covered``: a run that stays may hold an older record of the key, as the least lamport of those around it tells."""

    def combine(before: tuple, now: tuple | None) -> tuple:
        found = [x for x in (before[0], now[1] if now else None) if x is not None]
        return (min(found, default=None),)

    ranges = _bounds(retained, F.col("min_lamport"), F.lit(None).cast("string"))
    rows = locate(won, ranges, Best, "oldest_ long", combine, (None,))
    return rows.withColumn("covered", F.coalesce(F.col("oldest_") < F.col("lamport"), F.lit(False))).drop("oldest_")


def merge_partial(records: DataFrame, retained: DataFrame, now: Column | int) -> DataFrame:
    """Drops what has expired, and tombstones that hide nothing that stays."""
    rows = _covered(winners(records), retained)
    return rows.where(~expired(F.col("expires_at_millis"), now) & (~F.col("deleted") | F.col("covered"))).drop("covered")


def merge_bounded(records: DataFrame, retained: DataFrame, now: Column | int) -> DataFrame:
    """Drops only what has expired and hides nothing that stays."""
    rows = _covered(winners(records), retained)
    return rows.where(~expired(F.col("expires_at_millis"), now) | F.col("covered")).drop("covered")


def prune_merged(merged: DataFrame, index: DataFrame, ranges: DataFrame) -> DataFrame:
    """Of merged records those that the exact index (every key's winner over all runs) still holds, inside the partition's own range.

    What a run that stays supersedes goes, and so do the neighbour's keys of a shared run.
    """
    own = ranges.select("keyspace_id", "start_key", "end_key")
    kept = merged.join(index.select(*KEY, "lamport"), [*KEY, "lamport"], "left_semi")
    return kept.join(own, "keyspace_id").where(in_range(F.col("key"), F.col("start_key"), F.col("end_key"))).select(*merged.columns)


def adopt(offered: DataFrame, held: DataFrame, memory: DataFrame) -> DataFrame:
    """(keyspace_id, adopted, epoch, committed, kept, reclaimed): manifests (keyspace_id, epoch, committed) offered to holders.

    An epoch only rises: an older manifest changes nothing. One that is adopted replaces the
    flushed state, and the memtable (keyspace_id, lamport) keeps what is above its horizon.
    """
    rows = held.join(
        offered.select("keyspace_id", F.col("epoch").alias("new_epoch"), F.col("committed").alias("new_committed")),
        "keyspace_id", "left",
    )
    rows = rows.withColumn("adopted", F.coalesce(F.col("new_epoch") >= F.col("epoch"), F.lit(False)))
    rows = rows.select(
        "keyspace_id", "adopted",
        F.when(F.col("adopted"), F.col("new_epoch")).otherwise(F.col("epoch")).alias("epoch"),
        F.when(F.col("adopted"), F.col("new_committed")).otherwise(F.col("committed")).alias("committed"),
    )
    counts = memory.join(rows.select("keyspace_id", "committed", "adopted"), "keyspace_id").groupBy("keyspace_id").agg(
        F.count_if(F.col("adopted") & (F.col("lamport") <= F.col("committed"))).alias("reclaimed"),
        F.count("*").alias("all"),
    )
    return rows.join(counts, "keyspace_id", "left").select(
        "keyspace_id", "adopted", "epoch", "committed",
        (F.coalesce("all", F.lit(0)) - F.coalesce("reclaimed", F.lit(0))).alias("kept"),
        F.coalesce("reclaimed", F.lit(0)).alias("reclaimed"),
    )


def external_values(records: DataFrame, objects: DataFrame) -> DataFrame:
    """``records`` (name, length, crc32c, ...) with ``status``: ok, missing, length or checksum, from the value objects (name, body) they name."""
    found = objects.select("name", F.length("body").alias("size_"), crc32c_column(F.col("body")).alias("crc_"))
    status = F.when(F.col("size_").isNull(), "missing").when(F.col("size_") != F.col("length"), "length").when(F.col("crc_") != F.col("crc32c"), "checksum").otherwise("ok")
    return records.join(found, "name", "left").withColumn("status", status).drop("size_", "crc_")


def merge_full(records: DataFrame, now: Column | int) -> DataFrame:
    """Nothing stays behind: drops what has expired, keeps tombstones until then."""
    return winners(records).where(~expired(F.col("expires_at_millis"), now))


def candidates(records: DataFrame, segments: DataFrame, input_bytes: int = INPUT_BYTES) -> DataFrame:
    """Runs with records that lost, or shared ones, in order, up to the input budget; the first always goes in."""
    won = winners(records).groupBy("keyspace_id", "sequence").agg(F.count("*").alias("winners"))
    order = Window.partitionBy("keyspace_id").orderBy("sequence")
    rows = segments.join(won, ["keyspace_id", "sequence"], "left").withColumn("winners", F.coalesce("winners", F.lit(0)))
    rows = rows.where((F.col("winners") < F.col("record_count")) | F.col("source").isNotNull())
    return rows.withColumn("place", F.row_number().over(order)).withColumn("input", F.sum("bytes").over(order)).where((F.col("place") == 1) | (F.col("input") <= input_bytes)).select(
        "keyspace_id", "sequence", "winners", "record_count", "input",
    )


def parsed_name(name: Column) -> Column:
    """(kind, epoch, sequence) of an object's name; null for what the format does not produce."""
    part = lambda i: F.nullif(F.regexp_extract(name, NAME, i), F.lit(""))
    number = lambda a, b: F.conv(F.coalesce(part(a), part(b)), 16, 10).cast("decimal(20,0)")
    return F.when(
        name.rlike(NAME),
        F.struct(
            F.when(name.startswith("segments/"), "segment").otherwise("value").alias("kind"),
            number(2, 4).alias("epoch"), number(3, 5).alias("sequence"),
        ),
    )


def orphans(objects: DataFrame, referenced: DataFrame) -> DataFrame:
    """Objects of well-formed names that nothing refers to."""
    return objects.where(F.col("name").rlike(NAME)).join(referenced.select("keyspace_id", "name"), ["keyspace_id", "name"], "left_anti")


def sweep(
    objects: DataFrame, referenced: DataFrame, manifests: DataFrame, now: int, grace: int = GRACE_MILLIS,
    skew: int = SKEW_MILLIS,
) -> DataFrame:
    """What a sweep does with each orphan: it goes only if its manifest and it are both older than grace and skew; an unknown time is never old."""
    old = lambda c: F.coalesce(F.greatest(F.lit(now) - F.col(c), F.lit(0)) > grace + skew, F.lit(False))
    settled = manifests.select("keyspace_id", old("modified_millis").alias("settled"))
    return orphans(objects, referenced).join(settled, "keyspace_id").select(
        "keyspace_id", "name",
        F.when(F.col("settled") & old("modified_millis"), "delete").otherwise("retain").alias("verdict"),
    )
