"""Shared pieces of the corpus operators: saved tables, components, word pattern."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables that ``saved`` wrote, by application, in order.
_written: dict[str, list[str]] = {}


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and a lost
    executor costs only the reading of files, never the work before them.

    The tables of an application lie in a folder of its own. They live until ``released``
    or deleted with that folder, since results that are not computed yet may read them.
    """
    spark = df.sparkSession
    own = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/tables/{own}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(own, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many tables ``saved`` has written for this application so far."""
    return len(_written.get(spark.sparkContext.applicationId, ()))


def released(spark: SparkSession, since: int, until: int) -> None:
    """Delete the tables from the ``since``-th to before the ``until``-th, once nothing reads them any more."""
    own = _written.get(spark.sparkContext.applicationId, [])
    for place in range(since, until):
        if own[place]:
            path = spark._jvm.org.apache.hadoop.fs.Path(own[place])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            own[place] = ""


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, label), label the smallest node.

    Each round maps every node to the smallest of itself and its neighbours, follows that
    map once more, and contracts the edges; the maps are composed at the end. Only
    min-aggregates (combined before the exchange) and joins against one row per node are
    used, so a hub with a third of all edges is split by the skew join. Nodes without an
    edge to another node do not appear; no edges give no rows.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = saved(edges.where("a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
        onward = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = saved(step.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        maps.append(step)
        of_a = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = saved(edges.join(of_a, "a").join(of_b, "b").where("la <> lb").select(*ordered(F.col("la"), F.col("lb"))).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[0]
    for step in maps[1:]:
        onward = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return labels


def text_bytes(column: pa.Array | pa.ChunkedArray):
    """(bytes as uint8 array, offsets) of a string column, null as empty, without a copy per row."""
    import numpy as np
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
