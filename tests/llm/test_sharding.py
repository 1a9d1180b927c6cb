import zlib

from tidemark.llm import queries, sharding


def test_query(spark, small):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op7_shards(spark, small).collect()
    assert len(rows) == len(docs)
    total = sum(r["size"] for r in rows)
    most = max(r["size"] for r in rows)
    for shard in range(24):
        own = [r for r in rows if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 24) <= most
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)


def test_splitters_are_exact(spark):
    keys = [(i * i * 7919 % (1 << 40) * 1000 + 5, i % 13 + 1) for i in range(3000)] + [(123456, 50)] * 4
    frame = spark.createDataFrame(keys, "key long, size long")
    got = sharding.find_splitters(frame, 10)
    total = sum(s for _, s in keys)
    for key in {k for k, _ in keys}:
        below = sum(s for k, s in keys if k < key)
        assert sum(key >= g for g in got) == below * 10 // total


def test_odd_rows(spark):
    rows = [(i, "same text", "clash") for i in range(600)] + [(None, None, ""), (1, "", ""), (1, "", ""), (2, "é" * 100, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = sharding.histogram_shards(docs, 6).collect()
    assert len(got) == len(rows)
    per = {s: [r for r in got if r["shard"] == s] for s in range(6)}
    assert max(len(v) for v in per.values()) < 130 and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in per.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None} == {(8, 0)}
    assert sharding.histogram_shards(docs.limit(0)).collect() == []


def test_a_copied_text_fills_shards_evenly(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(4800)], "doc_id long, text string")
    sizes = [r["count"] for r in sharding.histogram_shards(docs).groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2


def test_nameless_copies_are_cut_and_heavy_ranges_go_deeper(spark):
    docs = spark.createDataFrame([(None, "same text") for _ in range(2400)] + [(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    rows = sharding.histogram_shards(docs, piece_rows=20).collect()
    per = {}
    for r in rows:
        per.setdefault(r["shard"], []).append(r)
    assert len(rows) == 2700 and len(per) == 24
    for own in per.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        by_slot = [r["key"] for r in sorted(own, key=lambda r: r["slot"])]
        assert by_slot == sorted(by_slot)
    total = sum(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in own) - total / 24) <= 40 for own in per.values())
    one = {(r["doc_id"], r["text_crc32"], r["key"]): (r["shard"], r["slot"]) for r in sharding.histogram_shards(docs.where("doc_id IS NOT NULL"), piece_rows=7).collect()}
    assert one == {(r["doc_id"], r["text_crc32"], r["key"]): (r["shard"], r["slot"]) for r in sharding.histogram_shards(docs.where("doc_id IS NOT NULL"), piece_rows=1000).collect()}
