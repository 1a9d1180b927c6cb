"""Folds against plain models, streams against batches, checkers against corruption."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions.crc32c import crc32c
from tidemark.operators import admission as A
from tidemark.operators import ranges as R
from tidemark.operators import state as S
from tidemark.operators import verify as V
from tidemark.operators import writes as W
from tidemark.sources import segment as G

REQUEST = "keyspace_id long, key string, lamport long, op string, cond string, expected long, expires_at_millis long, now_millis long"


def requests(seed, n):
    """Puts and deletes on a few keys, short lives, a clock that steps."""
    rng, now, lamport, out, versions = random.Random(seed), 1000, 0, [], [0, 1]
    for _ in range(n):
        now += rng.randrange(20)
        lamport += rng.randrange(1, 4)
        key = f"g{rng.randrange(3)}/k{rng.randrange(6)}"
        op = rng.choice(["put", "put", "delete"])
        cond = rng.choice(["none", "if_not_present", "if_version", "if_version"])
        expected = rng.choice(versions[-8:]) if cond == "if_version" else None
        expires = now + rng.randrange(40) if op == "put" and rng.random() < 1 / 3 else None
        out.append((1, key, lamport, op, cond, expected, expires, now))
        versions.append(lamport)
    return out


def model(rows, layer="server"):
    """Outcome by lamport, from a plain dict of records (version, deleted, until)."""
    held, out = {}, {}
    for _, key, lamport, op, cond, expected, expires, now in rows:
        version, deleted, until = held.get(key, (0, False, None))
        lapsed = until is not None and now >= until
        found = version if version and not deleted and not lapsed else 0
        if (cond == "if_not_present" and found) or (cond == "if_version" and found != expected):
            out[lamport] = (False, found, 0)
        elif op == "put":
            held[key] = (lamport, False, expires)
            out[lamport] = (True, found, lamport)
        elif layer == "server" and not found:
            out[lamport] = (True, 0, 0)
        elif layer == "storage" and deleted and not lapsed:
            out[lamport] = (True, version, 0)
        else:
            held[key] = (lamport, True, now + W.TOMBSTONE_MILLIS)
            out[lamport] = (True, found, lamport)
    return out


def outcomes(df):
    return {r["lamport"]: (r["applied"], r["found_version"], r["new_version"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_folds_equal_the_model(spark, seed):
    rows = requests(seed, 600)
    frame = spark.createDataFrame(rows, REQUEST)
    for layer in ("server", "storage"):
        assert outcomes(W.cas(frame, layer)) == model(rows, layer)


def test_folds_keep_long_integers(spark):
    most = 2**63 - 1
    rows = [(1, "k", 2**53 + 1, "put", "none", None, most, 5), (1, "k", 2**53 + 3, "put", "if_version", 2**53 + 1, None, most - 1), (1, "k", 2**53 + 5, "put", "if_version", 2**53 + 2, None, most)]
    assert outcomes(W.cas(spark.createDataFrame(rows, REQUEST))) == {2**53 + 1: (True, 0, 2**53 + 1), 2**53 + 3: (True, 2**53 + 1, 2**53 + 3), 2**53 + 5: (False, 2**53 + 3, 0)}
    assert W.cas(spark.createDataFrame(rows[:0], REQUEST)).collect() == []


def test_a_changed_rate_fills_a_new_bucket(spark):
    asks = [("b", 1, 0, 1), ("b", 2, 0, 1), ("b", 3, 0, 2), ("b", 4, 0, 2), ("b", 5, 0, 2), ("b", 6, 0, None), ("b", 7, 0, 1), ("b", 8, 10**15, 2**40)]
    got = {r["place"]: r["admitted"] for r in A.token_buckets(spark.createDataFrame(asks, "bucket string, place long, at_micros long, rate long")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True, 8: True}


def test_storage_layer_delete():
    cell = W.Cell(layer="storage")
    assert cell.apply(1, "delete", "none", None, None, 10) == (True, 0, 1)
    assert cell.apply(2, "delete", "none", None, None, 11) == (True, 1, 0)
    assert cell.apply(3, "delete", "none", None, None, 10 + W.TOMBSTONE_MILLIS) == (True, 0, 3)


def test_cursors_and_prefixes():
    assert K.prefix_upper_bound(b"a") == b"b" and K.prefix_upper_bound(b"a\xff\xff") == b"b" and K.prefix_upper_bound(b"\xff") is None is K.prefix_upper_bound(b"")
    assert K.fnv1a(b"") == 0xCBF29CE484222325 and K.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert K.decode_cursor(b"p/", K.encode_cursor(b"p/", b"p/x")) == b"p/x"
    for bad in (b"", b"\x02" + b"0" * 9, K.encode_cursor(b"q/", b"x")):
        with pytest.raises(ValueError):
            K.decode_cursor(b"p/", bad)
    assert K.decode_route(K.encode_route(b"in", b"route")) == (b"in", b"route")
    assert K.scan_start(b"b", b"a", b"m", None) == b"b" and K.scan_start(b"b", b"a", b"m", b"bz") == b"bz\x00" and K.scan_start(b"b", b"a", b"m", b"m") is None
    assert K.next_range_start(b"b", b"m") is None and K.next_range_start(b"b", b"bb") == b"bb" and K.next_range_start(b"", None) is None


def test_pages_concatenate_to_the_listing(spark):
    rows = spark.createDataFrame([(1, f"item/{i:04}", i * 37 % 90) for i in range(120)] + [(2, "other", 10**6)], "keyspace_id long, key string, value_bytes long")
    for limit, most in ((1, 10**9), (7, 10**9), (50, 300), (1000, 64)):
        got = S.pages_by_bytes(rows, most, limit, ["keyspace_id"], F.octet_length("key") + F.col("value_bytes")).orderBy("keyspace_id", "key").collect()
        page, held, n, last = -1, 0, 0, None
        for r in got:
            size = len(r["key"]) + r["value_bytes"]
            if r["keyspace_id"] != last or held + size > most or n >= limit:
                page, held, n = (0 if r["keyspace_id"] != last else page + 1), 0, 0
            held, n, last = held + size, n + 1, r["keyspace_id"]
            assert r["page"] == page
        assert len(got) == 121


def test_token_bucket(spark):
    asks = [("b", 1, 0, 2), ("b", 2, 0, 2), ("b", 3, 0, 2), ("b", 4, 500_000, 2), ("b", 5, 500_000, 2), ("z", 1, 0, 0), ("z", 2, 10**9, 0), ("n", 1, 0, None), *[("p", i, i * 1000, 3) for i in range(4000)]]
    got = {(r["bucket"], r["place"]): r["admitted"] for r in A.token_buckets(spark.createDataFrame(asks, "bucket string, place long, at_micros long, rate long")).collect()}
    assert [got["b", i] for i in range(1, 6)] == [True, True, False, True, False]
    assert not got["z", 1] and not got["z", 2] and got["n", 1]
    assert 14 <= sum(v for (b, _), v in got.items() if b == "p") <= 15


def test_routing(spark):
    parts = spark.createDataFrame([(1, 1, "", "g"), (1, 2, "g", "p"), (1, 3, "q", None), (2, 4, "", None)], "keyspace_id long, partition_id long, start_key string, end_key string")
    keys = spark.createDataFrame([(1, k) for k in ("a", "g", "o", "p", "pz", "q", "z")] + [(2, "x"), (3, "x")], "keyspace_id long, key string")
    want = {(1, "a", 1), (1, "g", 2), (1, "o", 2), (1, "q", 3), (1, "z", 3), (2, "x", 4)}
    for block in (1, 100):
        assert {(r["keyspace_id"], r["key"], r["partition_id"]) for r in R.route(keys, parts, block).collect()} == want


def test_coverage_names_each_kind(spark):
    rows = [("good", 1, "", "m"), ("good", 2, "m", None), ("gap", 3, "", "m"), ("gap", 4, "q", None), ("overlap", 5, "", "q"), ("overlap", 6, "m", None), ("end", 7, "", "m"), ("start", 8, "b", None)]
    got = {(r["keyspace_id"], r["error"], r["at"]) for r in R.coverage_errors(spark.createDataFrame(rows, "keyspace_id string, partition_id long, start_key string, end_key string")).collect()}
    assert got == {("gap", "gap", "m"), ("overlap", "overlap", "m"), ("end", "gap_at_end", "m"), ("start", "gap_at_start", "")}


# Fixed values below: the published example of the segment format.
def test_segment_golden_size_and_corruption(spark, tmp_path):
    value = crc32c([b"123456789"])[0]
    assert value == 0xE3069283
    records = [G.Record(b"alpha", 1, None, b"first"), G.Record(b"bravo", 2, 1_700_000_000_000, b"second"), G.Record(b"charlie", 3, 1_700_086_400_000), G.Record(b"delta", 4, None, None, ("values/0000000000000006-0000000000000001.oval", 13, int(value)))]
    raw = G.encode(records, 1, 7, 6)
    assert len(raw) == 416 and G.decode(raw) == (1, 7, records)
    rng = random.Random(0)
    for _ in range(300):
        broken = bytearray(raw)
        broken[rng.randrange(len(raw))] ^= 1 << rng.randrange(8)
        if bytes(broken[10:32]) == raw[10:32]:  # the header's identifiers carry no checksum
            with pytest.raises(G.Corrupt):
                G.decode(bytes(broken))
        with pytest.raises(G.Corrupt):
            G.decode(raw[: rng.randrange(len(raw))])
    with pytest.raises(ValueError):
        G.encode(records[::-1], 1, 7, 6)
    (tmp_path / "a.oseg").write_bytes(raw)
    spark.dataSource.register(G.SegmentSource)
    for frame in (spark.read.format("segment").load(str(tmp_path)), G.read_segments(spark, str(tmp_path))):
        got = {bytes(r["key"]): r for r in frame.collect()}
        assert len(got) == 4 and got[b"charlie"]["deleted"] and got[b"delta"]["external_length"] == 13 and bytes(got[b"bravo"]["value"]) == b"second"


W1, R1 = ("w", "write"), ("r", "read")
# Known histories and their verdicts.
HISTORIES = [
    ([(1, "write", 1, None, 0, 10), (2, "read", None, 1, 20, 30)], V.LINEARIZABLE),
    ([(1, "write", 1, None, 0, 10), (2, "read", None, None, 20, 30)], V.VIOLATION),
    ([(1, "write", 1, None, 0, 10), (2, "read", None, None, 5, 30)], V.LINEARIZABLE),
    ([(1, "write", 1, None, 0, None), (2, "read", None, 1, 20, 30), (3, "read", None, None, 40, 50)], V.VIOLATION),
    ([(1, "write", 1, None, 0, None), (2, "read", None, None, 20, 30), (3, "read", None, 1, 40, 50)], V.LINEARIZABLE),
    ([(1, "write", 1, None, 0, None), (2, "read", None, None, 20, 30)], V.LINEARIZABLE),
    ([(1, "write", 1, None, 0, 50), (2, "write", 2, None, 0, 50), (3, "read", None, 1, 60, 70), (4, "read", None, 2, 80, 90)], V.VIOLATION),
    ([(1, "cas", (None, 1), True, 0, 10), (2, "cas", (None, 2), True, 20, 30)], V.VIOLATION),
    ([(1, "cas", (None, 1), True, 0, 10), (2, "cas", (None, 2), False, 5, 30)], V.LINEARIZABLE),
    ([], V.LINEARIZABLE),
]


@pytest.mark.parametrize("history,verdict", HISTORIES)
def test_linearizability(history, verdict):
    assert V.linearize(history)[0] == verdict


def test_linearizability_budget_and_map():
    many = [(i, "write", i, None, 0, 1000) for i in range(14)] + [(99, "read", None, 77, 0, 1000)]
    assert V.linearize(many, budget=50)[0] == V.INCONCLUSIVE
    good = [(1, "put", ("a", 1), None, 0, 1), (2, "put", ("b", 2), None, 2, 3), (3, "get", "a", 1, 4, 5), (4, "delete", "a", None, 6, 7), (5, "get", "a", None, 8, 9), (6, "get", "b", 2, 8, 9)]
    assert V.linearize(good, V.KeyValue) == (V.LINEARIZABLE, [1, 2, 3, 4, 5, 6])
    assert V.linearize([*good[:5], (6, "get", "b", 1, 8, 9)], V.KeyValue)[0] == V.VIOLATION


def test_linearizable_by_key(spark):
    rows = [(1, 1, "write", 5, 0, 10), (1, 2, "read", 5, 20, 30), (2, 3, "write", 5, 0, 10), (2, 4, "read", 4, 20, 30), (3, 5, "write", 1, 0, 5), (3, 6, "write", 2, 6, 8), (3, 7, "read", 2, 9, 10), (3, 8, "write", 9, 11, None), (3, 9, "read", 9, 12, 20)]
    got = {r["key"]: r["verdict"] for r in V.linearizable(spark.createDataFrame(rows, "key long, op_id long, kind string, value long, invoked long, returned long")).collect()}
    assert got == {1: V.LINEARIZABLE, 2: V.VIOLATION, 3: V.LINEARIZABLE}
