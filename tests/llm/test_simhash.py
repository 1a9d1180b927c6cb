import numpy as np
import xxhash

from tidemark.llm import queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, label int"


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    step = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + step]), 42) for i in range(len(words) - step + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, radius=4):
    prints = [slow_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return [(ident, f"{p:016x}", least.get(find(i))) for i, ((ident, _), p) in enumerate(zip(rows, prints))]


def test_query_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op9_simhash(spark, small).collect())) == sorted(slow_groups(rows))


def test_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, None), (4, ""), (3, " \t\n"), (None, base), (9, base), (8, base.upper()), (7, base + " more"), (7, base + " more"), (2, "one two"), (1, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, "clash", 1) for i, t in rows], SCHEMA)
    got = [tuple(r) for r in simhash.near_groups(docs, tile=2).collect()]
    want = slow_groups(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((i, f"{f % 2**64:016x}", c) for i, f, _, c in got), key=key) == sorted(want, key=key)
    assert simhash.near_groups(docs.limit(0)).collect() == []


def test_tiles_unite_what_pairs_unite():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (40, 30), dtype=np.uint64)
    values = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel()]))
    labels = simhash.join_close(values, values, 4, True)
    assert len(labels) == len(values)
    for i in range(len(values)):
        assert (labels[np.bitwise_count(values ^ values[i]) <= 4] == labels[i]).all()
    left, right = values[::2], values[1::2]
    labels = simhash.join_close(left, right, 4, False)
    assert len(labels) == len(values)
    for i in range(len(left)):
        assert (labels[len(left) :][np.bitwise_count(right ^ left[i]) <= 4] == labels[i]).all()
