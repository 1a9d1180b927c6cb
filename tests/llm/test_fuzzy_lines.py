import random

import numpy as np
import pyarrow as pa

from tidemark.llm import fuzzy_lines, queries


def cut(line):
    """Five characters from every place, or the whole of a shorter line."""
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def slow(docs, least=0.8):
    """{(doc_id, line_no): first of its group}, by comparing all pairs."""
    lines = [(i is None, i or 0, n, x.strip(" ").lower()) for i, t in docs for n, x in enumerate((t or "").split("\n")) if x.strip()]
    distinct = sorted({x[3] for x in lines})
    sets = [cut(x) for x in distinct]
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    has = {}
    for k, s in enumerate(sets):
        for x in s:
            has.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for j in {j for x in s for j in has[x] if j < k}:
            if len(s & sets[j]) >= least * len(s | sets[j]):
                parent[find(k)] = find(j)
    group = {x: find(k) for k, x in enumerate(distinct)}
    head = {}
    for none, i, n, x in lines:
        head[group[x]] = min(head.get(group[x], (none, i, n)), (none, i, n))
    return {(none, i, n): head[group[x]] for none, i, n, x in lines}


def as_map(rows):
    none = lambda i: (i is None, i or 0)
    return {(*none(r["doc_id"]), r["line_no"]): (*none(r["group_doc_id"]), r["group_line_no"]) for r in rows}


def test_query_against_all_pairs(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op6_fuzzy_lines(spark, small).collect()
    want = slow(docs)
    got = as_map(rows)
    assert set(got) == set(want) and sum(r["kept"] for r in rows) == len(set(got.values()))
    assert sum(got[k] != want[k] for k in want) <= 0.003 * len(want)


def test_edited_lines_meet(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    docs = []
    for i in range(60):
        line = rng.choices(words, k=40)
        for k in range(5):
            own = list(line)
            for _ in range(k % 3):
                own[rng.randrange(40)] = rng.choice(words)
            docs.append((i * 5 + k, " ".join(own) + "\n\n" + " ".join(rng.choices(words, k=12))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = slow(docs)
    for rounds, exact in ((2, True), (0, True), (2, False)):
        got = as_map(fuzzy_lines.line_groups(frame, rounds=rounds, exact=exact).collect())
        assert sum(got[k] != want[k] for k in want) <= (2 if exact else 12) and len(set(want.values())) < len(want)


def links(lines, least=0.8):
    sets = [cut(x) for x in lines]
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def test_recall_on_large_groups(spark):
    """Groups of hundreds of near copies, edited in up to four places: links of all pairs that end up in one component."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    lines = []
    for _ in range(3):
        base = rng.choices(letters, k=150)
        for _ in range(250):
            own = list(base)
            for _ in range(rng.randrange(1, 5)):
                own[rng.randrange(150)] = rng.choice(letters)
            lines.append("".join(own).strip())
    lines = sorted(set(lines))
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    pairs = links(lines)
    for exact, least in ((True, 0.997), (False, 0.95)):
        group = {r["doc_id"]: r["group_doc_id"] for r in fuzzy_lines.line_groups(frame, exact=exact).collect()}
        assert sum(group[i] == group[j] for i, j in pairs) >= least * len(pairs) and len(pairs) > 10_000


def test_minima_agree_as_often_as_shingles():
    rng = random.Random(9)
    for length in (9, 30, 120, 600):
        pairs = []
        while len(pairs) < 400:
            a = "".join(rng.choices("abcdefghij klmno", k=length))
            at = rng.randrange(length)
            pairs.append((a, a[:at] + "#" + a[at + 1 :]))
        (left, _), (right, _) = (fuzzy_lines.minima(pa.array([p[k] for p in pairs])) for k in (0, 1))
        want = np.mean([len(cut(a) & cut(b)) / len(cut(a) | cut(b)) for a, b in pairs])
        assert abs((left == right).mean() - want) < 0.02


def test_shingles_over_blocks(monkeypatch):
    lines = ["abc", "", "one line of text", "日本語のテキストです", "x" * 5, "é" * 40, "a" * 4]
    whole = [sorted(zip(h.tolist(), of.tolist())) for h, of in [map(np.concatenate, zip(*fuzzy_lines.shingles(pa.array(lines))))]][0]
    assert [sum(of == k for _, of in whole) for k in range(len(lines))] == [1, 0, 12, 6, 1, 36, 1]
    monkeypatch.setattr(fuzzy_lines, "_BLOCK", 7)
    parts = [sorted(zip(h.tolist(), of.tolist())) for h, of in [map(np.concatenate, zip(*fuzzy_lines.shingles(pa.array(lines))))]][0]
    assert parts == whole


def test_odd_rows(spark):
    rows = [(None, "Same line here", "x"), (3, " same line here ", "x"), (3, "same line here\n\n \t\nother", "x"), (4, None, "x"), (5, "", "x"), (6, "y" * 200_000 + "\nY" + "y" * 199_999, "x"), (7, "other", "x"), (7, "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line_no string")
    got = fuzzy_lines.line_groups(docs).collect()
    assert as_map(got) == slow([r[:2] for r in rows]) and len(got) == 8
    assert sum(r["kept"] for r in got) == 3
    assert fuzzy_lines.line_groups(docs.limit(0)).collect() == []
    unique = docs.where("doc_id in (4, 5, 6)")
    kept = {r["doc_id"]: r["kept_lines"] for r in fuzzy_lines.without_repeats(unique, fuzzy_lines.line_groups(unique)).collect()}
    assert kept == {4: [0], 5: [0], 6: [0]}
