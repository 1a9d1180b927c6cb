"""Manifests: JSON with a closed schema, read as a table; committed by an atomic, guarded swap."""

from __future__ import annotations

import base64
import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
# The fields of the format. Numbers are unsigned 64-bit, so they are read as decimals and narrowed only where they fit.
NUMBER = "decimal(20,0)"
SEGMENT = (
    f"name string, source_partition_id {NUMBER}, bytes {NUMBER}, record_count {NUMBER}, min_key string, "
    f"max_key string, min_lamport {NUMBER}, max_lamport {NUMBER}"
)
SCHEMA = (
    f"format_version {NUMBER}, keyspace_id {NUMBER}, partition_id {NUMBER}, epoch {NUMBER}, "
    f"committed_lamport {NUMBER}, range struct<start string, end string>, segments array<struct<{SEGMENT}>>"
)

FIELDS = ("format_version", "keyspace_id", "partition_id", "epoch", "committed_lamport", "range", "segments")
SEGMENT_FIELDS = tuple(f.split()[0] for f in SEGMENT.split(", "))
#: Seconds after which the lock of a writer that died is taken away.
LOCK_SECONDS = 60.0


class Deposed(RuntimeError):
    """A newer owner has committed; what this writer wrote is for the sweep."""


class Conflict(RuntimeError):
    """Others kept committing in between."""


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row a manifest under a path of any store; a file that is no such JSON, or has a field beyond the schema's, fails the query."""
    files = spark.read.text(path, wholetext=True)
    inside = lambda at: F.json_object_keys(F.get_json_object("value", at))
    listed = F.flatten(
        F.transform(F.from_json(F.get_json_object("value", "$.segments"), "array<map<string,string>>"), lambda s: F.map_keys(s))
    )
    beyond = lambda names, known: F.array_except(
        F.coalesce(names, F.array().cast("array<string>")), F.array(*map(F.lit, known)),
    )
    unknown = F.concat(
        beyond(F.json_object_keys("value"), FIELDS), beyond(inside("$.range"), ("start", "end")),
        beyond(listed, SEGMENT_FIELDS),
    )
    parsed = F.from_json("value", SCHEMA, {"mode": "FAILFAST"})
    return files.select(
        F.when(
            F.size(unknown) > 0,
            F.raise_error(F.concat(F.lit("unknown fields in a manifest: "), F.array_join(unknown, ", "))).cast("void"),
        ).otherwise(F.lit(None)).alias("refused"),
        parsed.alias("m"),
    ).where("refused IS NULL").select("m.*")


def segments_of(manifests: DataFrame) -> DataFrame:
    """A row a listed segment, keys decoded: the statistics table that prunes reads."""
    rows = manifests.select(
        "keyspace_id", "partition_id", "epoch", "committed_lamport", F.unbase64("range.start").alias("start"),
        F.unbase64("range.end").alias("end"), F.inline("segments"),
    )
    return rows.withColumn("min_key", F.unbase64("min_key")).withColumn("max_key", F.unbase64("max_key"))


def encode(keyspace: int, partition: int, epoch: int, committed: int, start: bytes, end: bytes | None, segments: list[dict]) -> str:
    """The file's text; segments carry name, bytes, record_count, min_key, max_key (bytes), min_lamport, max_lamport and maybe source_partition_id."""
    text = lambda b: base64.b64encode(b).decode()
    listed = [{k: text(v) if isinstance(v, bytes) else v for k, v in s.items() if v is not None} for s in segments]
    return json.dumps(
        {
            "format_version": VERSION, "keyspace_id": keyspace, "partition_id": partition, "epoch": epoch,
            "committed_lamport": committed,
            "range": {"start": text(start), "end": None if end is None else text(end)}, "segments": listed,
        },
        indent=2,
    )


def commit(path: str, epoch: int, build: Callable[[dict | None], str], attempts: int = 5) -> dict:
    """Replace the manifest at a local path by what ``build`` makes of the one there, or raise.

    The epoch is checked before every write, and the new manifest must carry the writer's
    own. The swap is a link-or-rename guarded by a lock file, the file system's stand-in
    for a conditional write.
    """
    for _ in range(attempts):
        seen = _read(path)
        if seen and seen["epoch"] > epoch:
            raise Deposed(f"epoch {seen['epoch']} has committed")
        text = build(seen)
        if json.loads(text)["epoch"] != epoch:
            raise ValueError("a writer stamps its own epoch only")
        try:
            lock = os.open(path + ".lock", os.O_CREAT | os.O_EXCL)
        except FileExistsError:
            _abandoned(path + ".lock")
            continue
        try:
            if _read(path) != seen:
                continue
            handle, new = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
            with os.fdopen(handle, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.replace(new, path)
            return json.loads(text)
        finally:
            os.close(lock)
            os.unlink(path + ".lock")
    raise Conflict(path)


def _abandoned(lock: str) -> None:
    """Take away a lock older than LOCK_SECONDS: its writer was killed. The swap itself checks what is there again."""
    try:
        if time.time() - os.stat(lock).st_mtime > LOCK_SECONDS:
            os.unlink(lock)
    except FileNotFoundError:
        pass


def _read(path: str) -> dict | None:
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return None
