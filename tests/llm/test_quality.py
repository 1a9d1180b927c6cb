import bisect
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import quality, queries


def test_features_by_hand():
    texts = ["The cat, the CAT!\nfoo foo\n", "", None, "é|# 12"]
    rows = [dict(zip(quality.FEATURES, r)) for r in quality.features(pa.array(texts))]
    for text, row in zip(texts, rows):
        text = text or ""
        raw, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x]
        assert row["upper_share"] == pytest.approx(sum(65 <= b <= 90 for b in raw) / max(1, len(raw)))
        assert row["log_words"] == pytest.approx(np.log1p(len(words)))
        assert row["word_bytes"] == pytest.approx(np.mean([len(w.encode()) for w in words]) if words else 0)
        assert row["distinct_words"] == pytest.approx(len(set(words)) / max(1, len(words)))
        assert row["distinct_lines"] == pytest.approx(len(set(lines)) / max(1, len(lines)))
        assert row["capital_words"] == pytest.approx(sum(bool(re.match("[A-Z]", w)) for w in words) / max(1, len(words)))
        two = list(zip(words, words[1:]))
        assert row["distinct_pairs"] == pytest.approx(len(set(two)) / max(1, len(two)))


CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".!?", b",;:'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b"\n\r")


def slow_features(text):
    """All features of one text, by plain loops."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in re.split(b"[\n\r]", raw) if x]
    share = lambda n, of: n / max(1, of)
    sizes = [len(w) for w in words]
    mean = share(sum(sizes), len(sizes))
    pairs = list(zip(words, words[1:]))
    return [
        *(share(sum(b in own for b in raw), len(raw)) for own in CLASSES), share(sum(b >= 128 for b in raw), len(raw)),
        math.log1p(len(raw)), math.log1p(len(words)), mean, math.sqrt(max(0, share(sum(n * n for n in sizes), len(sizes)) - mean * mean)),
        share(sum(n > 12 for n in sizes), len(sizes)), share(sum(n <= 3 for n in sizes), len(sizes)), math.log1p(len(lines)), share(len(words), len(lines)),
        share(len(set(words)), len(words)), share(len(set(lines)), len(lines)), share(sum(w[0] in CLASSES[0] for w in words), len(words)),
        share(sum(w[-1] in CLASSES[5] for w in words), len(words)), share(sum(w[-1] in CLASSES[3] for w in words), len(words)), share(len(set(pairs)), len(pairs)),
    ]


def test_query_against_plain_loops(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.op5_quality(spark, small).collect()}
    for r in docs.collect():
        x = slow_features(r["text"])
        assert quality.features(pa.array([r["text"]]))[0] == pytest.approx(x)
        at = [bisect.bisect_right(list(edges), v) for edges, v in zip(model.edges, quality.features(pa.array([r["text"]]))[0])]
        total = model.base + sum(t[k] for t, k in zip(model.tables, at)) + sum(g[at[i]][at[j]] for (i, j), g in zip(model.pairs, model.grids))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-total)))


def test_trees_against_every_cut():
    rng = np.random.default_rng(4)
    for _ in range(30):
        g, h = rng.normal(size=12), rng.random(12) + 0.1
        leaf = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0)  # noqa: E731, B023
        cuts = [0, 12]
        for _ in range(2):  # the best cut, then the best further one, if they gain anything
            gained, at = max((leaf(a, c) + leaf(c, b) - leaf(a, b), c) for a, b in zip(cuts, cuts[1:]) for c in range(a + 1, b))
            cuts = sorted({*cuts, at}) if gained > 1e-9 else cuts
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 2.0)) for a, b in zip(cuts, cuts[1:])])
        assert quality._stump(g, h, 2.0) == pytest.approx(want)
        g2, h2 = rng.normal(size=(5, 4)), rng.random((5, 4)) + 0.1
        parts = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
        gain = lambda i, j: sum(g2[p].sum() ** 2 / (h2[p].sum() + 2.0) for p in parts(i, j))  # noqa: E731, B023
        best = max(((gain(i, j), i, j) for i in range(1, 5) for j in range(1, 4)))
        found, step = quality._quadrants(g2, h2, 2.0)
        assert found == pytest.approx(best[0])
        for p in parts(*best[1:]):
            assert step[p] == pytest.approx(np.full(step[p].shape, g2[p].sum() / (h2[p].sum() + 2.0)))


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([("a", f"text {i} of one name") for i in range(500)] + [(f"n{i}", f"words {i % 7} here") for i in range(60)], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1)] + [(f"n{i}", i % 2) for i in range(60)], "doc_id string, quality int")
    got = quality.classify(docs, labels, most=20).collect()
    assert len(got) == 560 and all(0 <= r["score"] <= 1 for r in got)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95 and (1, 0) in model.pairs


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3, 1), (1, None, 3, 1), (None, "", 3, 1), (2, "plain words here", 3, 0), (3, "y " * 200_000, 3, 0)], "doc_id long, text string, quality_score int, quality int")
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (2, 1, 0, "x"), (None, 1, 0, "x"), (3, None, 1, "x"), (9, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, None)}) == 1
    assert {tuple(r)[2:] for r in quality.classify(docs, labels.limit(0)).collect()} == {(0.5, 0)}
    assert quality.classify(docs.limit(0), labels).collect() == []
