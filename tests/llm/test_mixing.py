import re

import pytest

from tidemark.llm import mixing, queries


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = set(), sum(sizes.values())
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and free and rest * weight[s] / free > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else rest * weight[s] / free for s in names}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 20, None: 500}, {"a": 0, "b": 7}, {"a": 0}, {str(i): (i * 37) % 101 for i in range(40)}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(filled(sizes))


def test_query(spark, small):
    docs = {r[0]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op1_mix(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    taken, size = {}, {}
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
        size[source] = size.get(source, 0) + r["size"]
    for source, target in filled(size).items():
        assert abs(taken[source] - target) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op1_mix(spark, small).collect()))


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_cut_against_a_queue_of_words(spark, monkeypatch, bits):
    """Words one by one in order of their virtual finish times, cut at the budget."""
    monkeypatch.setattr(mixing, "PROBE_BITS", bits)
    sizes = {"a": ([5, 1, 9, 30], 1), "b": ([4, 4, 100], 2), "c": ([7], 3)}
    packets, words = [], []
    for docs, weight in sizes.values():
        at = 0
        for size in docs * 3:
            packets.append((at * 6 // weight, (at + size) * 6 // weight, weight))
            at += size
        words += [(k + 1) * 6 / weight for k in range(at)]
    frame = spark.createDataFrame(packets, "begin long, finish long, rate long")
    words.sort()
    for budget in (1, 17, 50, 160, 479):
        low, p, q = mixing.cut_level(frame, budget, 6)
        sent = sum(min(3 * sum(docs), (low + p / q) * weight / 6) for docs, weight in sizes.values())
        assert sent == pytest.approx(budget)
        assert sum(w <= low + p / q for w in words) <= budget <= sum(w <= low + p / q for w in words) + 3
    assert mixing.cut_level(frame, 480, 6)[0] == max(f for _, f, _ in packets)
    assert mixing.cut_level(frame.limit(0), 0, 6) == (0, 0, 1)


def test_odd_rows(spark):
    rows = [(1, "a b c", "x", "k"), (1, "a b c", "x", "k"), (None, "d " * 50_000, None, "k"), (2, None, "y", "k"), (3, "", "y", "k"), (4, "e f", None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")
    got = mixing.fair_queue(docs, bucket_rows=1).collect()
    assert len(got) == 6
    assert {(r["size"], r["taken"], r["copies"]) for r in got if r["source"] == "y"} == {(0, 0, 1)}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    target = {r["source"]: r["target"] for r in got}
    for s in target:
        assert sum(r["taken"] for r in got if r["source"] == s) == int(target[s])
    assert [r["finish"] for r in got] == sorted(r["finish"] for r in got)
    assert mixing.fair_queue(docs.limit(0)).collect() == []
