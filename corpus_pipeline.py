"""From raw documents to a sharded training mix: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, quality, sharding, simhash
from tidemark.llm.common import released, saved, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Decisions meet their documents by a merge join at every size: one exchange of the texts, which grows in
# proportion and needs no side in memory, rather than a broadcast that ends at some size.


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject; without labels all.

    Null and empty texts are scored like any other, alike; rows without a doc_id are
    scored but never trained on; repeated rows stay or go together; further columns are dropped;
    no rows give none.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs.select(*COLUMNS)
    return quality.scored(docs.select(*COLUMNS), model).where(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Rows without a doc_id take part, and one is kept where its whole group has none. Rows
    alike in doc_id are told apart by their fingerprint, then by their text, lang, source
    and n_chars, of which the least is kept; so are rows without one. Null and empty texts are one
    group. Further columns are dropped; no rows give none.
    """
    groups = saved(simhash.near_groups(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    heads = groups.groupBy("label").agg(F.min(order).alias("head")).select(
        F.col("head.doc_id").alias("of_id"), F.col("head.fp").alias("of_fp"),
    )
    again = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    heads = saved(
        heads.join(again.withColumn("again", F.lit(True)), F.col("of_id") == F.col("doc_id"), "left").select(
            "of_id", "of_fp", (F.col("of_id").isNull() | F.coalesce("again", F.lit(False))).alias("odd"),
        )
    )
    rows = docs.select(*COLUMNS)
    clear = rows.join(heads.where("NOT odd").select("of_id").hint("merge"), F.col("doc_id") == F.col("of_id"), "left_semi")
    odd = heads.where("odd").select("of_id", "of_fp")
    if odd.isEmpty():
        return clear
    # An identifier that is repeated or missing does not tell the row: its fingerprint does.
    alike = rows.join(odd.select("of_id").distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")), "left_semi")
    prints = simhash.fingerprints(alike, keep=tuple(COLUMNS))
    kept = prints.join(odd.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("fp") == F.col("of_fp")), "left_semi")
    return clear.union(
        kept.groupBy("doc_id", "fp").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*").select(*COLUMNS)
    )


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item.

    Null and empty texts contain none; rows without a doc_id and repeated rows are each
    judged by their text; further columns are dropped; no rows give none.
    """
    return decontam.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    A null source is a source; null and empty texts are taken once. Rows alike in doc_id,
    source and size, null doc_ids among them, get the copies of the one of them that gets most.
    Further columns are dropped; no rows give none.
    """
    mixed = saved(mixing.fair_queue(docs).select("doc_id", "source", "size", "copies"))
    most = saved(mixed.groupBy("doc_id", "source").agg(F.min("copies").alias("least"), F.max("copies").alias("copies")))
    same = lambda own, of: F.col(own).eqNullSafe(F.col(of))
    meet = same("doc_id", "of") & same("source", "from_")
    named = most.withColumnsRenamed({"doc_id": "of", "source": "from_"})
    rows = docs.select(*COLUMNS)
    each = F.explode(F.sequence(F.lit(1), "copies"))
    clear = rows.join(named.where("least = copies AND copies > 0").hint("merge"), meet).withColumn("copy", each).select(*COLUMNS)
    if most.where("least < copies").isEmpty():
        return clear
    # Rows alike in doc_id and source but not in copies are told apart by their size.
    odd = named.where("least < copies").select("of", "from_")
    sizes = mixed.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    sizes = sizes.withColumnsRenamed({"doc_id": "of", "source": "from_"})
    own = rows.join(odd.hint("merge"), meet, "left_semi").withColumn("words_", mixing.word_count(F.col("text")))
    told = own.join(sizes.hint("merge"), meet & (F.col("words_") == F.col("size"))).withColumn("copy", each).select(*COLUMNS)
    return clear.union(told)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of the mix.

    A null text has size 8 and crc 0; repeated rows and rows without a doc_id each have
    their slot; further columns are ignored; no rows give none.
    """
    return sharding.histogram_shards(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality", keep_quality), ("near_copies", keep_one_of_near_copies), ("benchmark", drop_benchmark),
    ("mix", mix_sources), ("shards", place_in_shards),
]
#: The classifier and the fingerprints have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again.

    When a stage is written, the tables it worked with, its predecessor's among them, are deleted.
    """
    docs, begun = table(spark, sf_dir, "documents"), written(spark)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
            done = written(spark) - 1
            released(spark, begun, done)
            begun = done
    return docs
