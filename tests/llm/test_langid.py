import math
import zlib

import numpy as np
import pytest

from tidemark.llm import langid, queries


def slow_chance(word, pieces, chance, alone):
    """Sum over every segmentation, by recursion from the left."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = chance.get(word[:n], 0) or (alone if n == 1 else 0)
        if p:
            total += p * slow_chance(word[n:], pieces, chance, alone)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "abc", "ca", "bca", "▁a", "é"]
    rng = np.random.default_rng(2)
    lattice = langid.Lattice.of(pieces)
    chance = np.vstack([rng.random((8, 2)) / 8, np.zeros((1, 2))])
    model = langid.Model(["x", "y"], lattice, chance, 1e-4)
    words = ["▁abca", "▁abcabcab", "▁", "▁zé", "▁" + "abc" * 4, "▁é"]
    got = model.log_chances(words)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(math.log(slow_chance(w, pieces, dict(zip(pieces, chance[:, k])), 1e-4)))
    long = ["▁" + "ab" * 23, "▁" + "abca" * 50, "▁" + "abcé" * 1500, "▁" + "z" * 20_000]
    got = model.log_chances(long)
    for i, w in enumerate(long):
        for k in range(2):
            assert got[i, k] == pytest.approx(slow_log(w, dict(zip(pieces, chance[:, k])), 1e-4))


def slow_log(word, chance, alone):
    """The same sum by a dictionary of pieces, place after place."""
    ahead, log, longest = [1.0], 0.0, max(map(len, chance))
    for end in range(1, len(word) + 1):
        ahead.append(sum(ahead[-n] * (chance.get(word[end - n : end], 0) or (alone if n == 1 else 0)) for n in range(1, min(longest, end) + 1)))
        if ahead[-1] < 1e-200:
            ahead, log = [a * 1e200 for a in ahead], log - 200 * math.log(10)
        ahead = ahead[-longest:]
    return log + math.log(ahead[-1])


def test_training_counts_all_segmentations():
    pieces = ["a", "ab", "b", "▁a", "▁"]
    parts, counts = ["▁ab", "▁aab"], np.array([[3.0], [1.0]])
    model = langid.fit(langid.Lattice.of(pieces), ["x"], parts, counts, rounds=2, smooth=0.5)
    chance, alone = dict.fromkeys(pieces, 1 / 6), 1 / 6 / 16

    def cuts(word):
        return [[]] if not word else [[word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in chance for rest in cuts(word[n:])]

    for _ in range(2):
        expected = dict.fromkeys(pieces, 0.5)
        for part, n in zip(parts, counts[:, 0]):
            weights = [math.prod(chance[p] for p in cut) for cut in cuts(part)]
            for cut, w in zip(cuts(part), weights):
                for p in cut:
                    expected[p] += n * w / sum(weights)
        total = sum(expected.values())
        chance = {p: v / total for p, v in expected.items()}
    assert [model.chance[k, 0] for k in range(5)] == pytest.approx([chance[p] for p in pieces]) and alone


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs)
    pieces = langid.pieces_of()
    chance = [dict(zip(pieces, model.chance[:, k])) for k in range(len(model.languages))]
    got = {r["doc_id"]: r for r in queries.op10_language(spark, small).collect()}
    seen = {}
    for r in docs.where("length(text) < 1500").limit(40).collect():
        words = langid.words_of(r["text"])
        logs = [sum(seen.setdefault((w, k), slow_log("▁" + w, c, model.alone)) for w in words) for k, c in enumerate(chance)]
        best = max(range(len(logs)), key=lambda k: logs[k])
        assert got[r["doc_id"]]["lang_pred"] == (model.languages[best] if words else "und")
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs) if words else 0.0)


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op10_language(spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "p"), (2, "le chat et le chien", "fr", "p"), (4, "the end of the day", "en", "p"), (6, None, "fr", "p"), (7, "12 34 ...", None, "p"), (None, "the " * 90_000, None, "p"), (8, "x" * 250_000, None, "p"), (8, "", "en", "p"), (8, "²³", "en", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs)
    got = {}
    for r in langid.predicted(docs, model).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got[6] == got[7] == [("und", 0.0)] and got[8].count(("und", 0.0)) == 2 and got[None][0][0] == "en"
    assert sum(map(len, got.values())) == len(rows) and all(0 <= s <= 1 for v in got.values() for _, s in v)
    assert langid.train(docs.limit(0)) is None and langid.predicted(docs.limit(0), model).collect() == []
    assert {r["lang_pred"] for r in langid.predicted(docs, None).collect()} == {"und"}
