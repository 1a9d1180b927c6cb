import random
import re

from tidemark.llm import decontam, queries


def slow(docs, items, threshold=0.8, width=5):
    words = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").lower().encode())
    cut = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for ident, text in docs:
        own = words(text)
        for item, body in items:
            w = words(body)
            n = min(width, len(w))
            want = cut(w, n) if n else set()
            shared = len(want & cut(own, n)) if n else 0
            if n and shared >= threshold * len(want) - 1e-9:
                out.append((ident, item, shared, len(want)))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark, small):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(*c).collect()]
    got = sorted((tuple(r)[:4] for r in queries.op4_decontaminate(spark, small).collect()), key=repr)
    assert got == slow(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")) and got


def test_partial_passages_blocks_and_odd_rows(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)] + ["Été", "naïve"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 20, 40])))) for i in range(30)] + [(30, None), (31, "..."), (32, "")]
    docs = []
    for i in range(80):
        words = rng.choices(vocabulary, k=rng.choice([0, 2, 30, 300]))
        passage = rng.choice(items)[1] or ""
        passage = passage.split()[: rng.choice([None, -1, -4, -8])]
        at = rng.randrange(len(words) + 1)
        docs.append((i, rng.choice([" ", "*** ", "\n"]).join(words[:at] + passage + words[at:])))
    docs += [(80, None), (81, ""), (None, items[6][1]), (82, "x" * 400_000), (83, items[5][1] * 2), (83, items[5][1] * 2)]
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    for block in (10**6, 30):
        assert sorted((tuple(r)[:4] for r in decontam.leaks(frame, bench, block=block).collect()), key=repr) == want
    bad = {w[0] for w in want}
    kept = decontam.without_leaks(frame, bench)
    assert kept.columns == frame.columns and sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted((d for d in docs if d[0] not in bad), key=repr)
    assert decontam.leaks(frame, bench.limit(0)).collect() == [] == decontam.leaks(frame.limit(0), bench).collect()


def test_one_common_shingle_makes_no_candidates():
    import pyarrow as pa

    rng = random.Random(8)
    common = "this line stands in every item"
    items = [(f"i{k}", common + " " + " ".join(rng.choices([f"w{i}" for i in range(500)], k=60))) for k in range(200)]
    found = decontam.Items(items, 0.8, 5)
    assert {w for w in found.tables} == {5} and sum(len(t) for t in found.tables.values()) == len({len(s).bit_length() for s in found.shingles})
    texts = pa.array([" ".join([common] * 50), items[3][1], items[3][1][:-36], None])
    assert len(found.candidates(texts)) <= 3
    assert {(place, found.ids[k]) for place, k, _ in found.found(texts)} == {(1, "i3"), (2, "i3")}


def test_identifiers_of_any_type(spark):
    docs = spark.createDataFrame([("d", "one two three four five six seven"), (None, "x")], "doc_id string, text string")
    bench = spark.createDataFrame([("item", "two three four five six")], "item_id string, text string")
    assert [tuple(r)[:2] for r in decontam.leaks(docs, bench).collect()] == [("d", "item")]
