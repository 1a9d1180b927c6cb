from collections import Counter

import corpus_pipeline as c
from tests.llm import test_decontam, test_simhash
from tidemark.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rejected = {r["doc_id"] for r in queries.op5_quality(spark, small).collect() if not r["predicted"]}
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in c.STAGES[:3]:
        before = dict(rows)
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), SCHEMA)
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(rows)
        if name == "quality":
            want = set(before) - rejected
        elif name == "near_copies":
            want = {i for i, _, group in test_simhash.slow_groups(list(before.items())) if i == group}
        else:
            want = set(before) - {i for i, *_ in test_decontam.slow(list(before.items()), bench)}
        assert set(rows) == want
    mixed = Counter(r["doc_id"] for r in c.mix_sources(spark, docs, small).collect())
    assert set(mixed) <= set(rows) and max(mixed.values()) <= 3
    placed = c.run(spark, small).collect()
    assert Counter(r["doc_id"] for r in placed) == mixed and {r["shard"] for r in placed} <= set(range(24))


LONG = " ".join(f"w{i}" for i in range(300))
OTHER = " ".join(f"v{i}" for i in range(300))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1) for i, t, lang, source in rows], SCHEMA)


def near(spark, small, rows):
    got = c.keep_one_of_near_copies(spark, frame(spark, [(i, t, "en", "s") for i, t in rows]), small)
    assert got.columns == c.COLUMNS
    return Counter((r["doc_id"], r["text"]) for r in got.collect())


def test_near_copies_of_odd_rows(spark, small):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "f g h i j k l"), (None, "f g h i j k l"), (3, None), (4, "")]
    assert near(spark, small, rows) == {(1, "a b c d e"): 1, (None, "f g h i j k l"): 1, (3, None): 1}
    # A copy whose doc_id heads another group.
    assert near(spark, small, [(3, LONG), (5, OTHER), (5, LONG)]) == {(3, LONG): 1, (5, OTHER): 1}
    # One group without a doc_id, its texts not alike to the letter.
    got = near(spark, small, [(None, LONG), (None, LONG.upper()), (None, LONG.replace(" ", "  "))])
    assert sum(got.values()) == 1 and all(i is None for i, _ in got)
    # A doc_id of two groups keeps a row in each.
    assert near(spark, small, [(7, LONG), (7, OTHER), (7, LONG), (8, OTHER)]) == {(7, LONG): 1, (7, OTHER): 1}


ODD = [(None, None, None, None), (None, "", "en", "s"), (1, "one two " * 40_000, "en", "s"), (1, "one two " * 40_000, "en", "s"), (2, "plain words in a row. " * 9, None, None), (2, "other words here", "de", "t"), (3, None, "en", "s"), (None, "no name but text", "en", "t")]


def test_every_stage_takes_odd_rows(spark, small):
    wide = frame(spark, ODD).selectExpr("*", "1 as size", "'x' as fp", "2 as quality_score", "3 as copies", "4 as label", "5 as key", "6 as shard")
    rows = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in wide.collect())
    for name, stage in c.STAGES[:-1]:
        got = stage(spark, wide, small)
        assert got.columns == c.COLUMNS
        own = Counter(map(tuple, got.collect()))
        assert set(own) <= set(rows)
        if name == "benchmark":
            assert own == rows
        if name == "near_copies":
            assert sum(own.values()) == 5 and own[(3, None, "en", "s", 1)] == 1
        if name == "mix":
            assert all(n <= 3 * rows[r] for r, n in own.items()) and {r for r in rows if not (r[1] or "").split()} <= set(own)
    placed = c.place_in_shards(spark, wide, small).collect()
    assert len(placed) == len(ODD) and {r["size"] for r in placed if r["text_crc32"] == 0} == {8}
    empty = wide.limit(0)
    assert all(stage(spark, empty, small).collect() == [] for _, stage in c.STAGES)


def test_mix_of_repeated_identifiers(spark, small):
    """One source takes twice the words it has: of rows alike in doc_id and source each gets the copies of its size."""
    rows = [(i, "one two three " * 20, "en", "b") for i in range(40)] + [(1, "w " * 7, "en", "b"), (None, "a b c", "en", "b"), (None, "d " * 300, "en", "b"), (5, "word " * 400, "en", "a")]
    docs = frame(spark, rows)
    want = {}
    for r in c.mixing.fair_queue(docs).collect():
        key = (r["doc_id"], r["source"], r["size"])
        want[key] = max(want.get(key, 0), r["copies"])
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in c.mix_sources(spark, docs, small).collect())
    assert got == {k: n for k, n in want.items() if n}


def test_run_over_odd_rows(spark, small, tmp_path):
    frame(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    placed = c.run(spark, str(tmp_path)).collect()
    assert all(0 <= r["shard"] < 24 and r["size"] >= 8 for r in placed) and {r["doc_id"] for r in placed} <= {None, 1, 2, 3}
    frame(spark, ODD).limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).collect() == []
