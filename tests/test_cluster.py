"""The command log's fold, range lookups and the cache, against plain versions."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cache, lsm
from tidemark.operators import ranges as R
from tidemark.operators.cluster import Cluster, Refused
from tidemark.operators.intervals import Best, Held, Ranges


def cluster(version=(0, 1)):
    c = Cluster()
    for n in range(1, 6):
        c.apply("register_node", node=n, role="worker", speaks=((0, 0), (0, 2)))
    if version:
        c.apply("set_cluster_version", version=version, expect=(0, 0))
    c.apply("create_keyspace", keyspace=1, name="one", partition=1, owner=1, replicas=[2, 3])
    return c


def refused(c, kind, why, **fields):
    with pytest.raises(Refused) as e:
        c.apply(kind, **fields)
    assert e.value.kind == why


def test_a_prepared_split_and_merge():
    c = cluster()
    refused(c, "split_partition", "unavailable", partition=1, at="m", lower=2, upper=3, epoch=1)
    refused(c, "begin_split", "stale_epoch", partition=1, at="m", lower=2, upper=3, epoch=2)
    refused(c, "begin_split", "invalid", partition=1, at="", lower=2, upper=3, epoch=1)
    refused(c, "begin_split", "invalid", partition=1, at="m", lower=1, upper=3, epoch=1)
    c.apply("begin_split", partition=1, at="m", lower=2, upper=3, epoch=1)
    refused(c, "begin_split", "invalid", partition=1, at="m", lower=4, upper=5, epoch=1)
    c.apply("mark_split_prepared", partition=1, node=1, epoch=1)
    refused(c, "mark_split_prepared", "invalid", partition=1, node=4, epoch=1)
    refused(c, "complete_split", "unavailable", partition=1, epoch=1)
    for n in (2, 3):
        c.apply("mark_split_prepared", partition=1, node=n, epoch=1)
    c.apply("complete_split", partition=1, epoch=1)
    low, high = c.partitions[2], c.partitions[3]
    assert (low.start, low.end, high.start, high.end, low.epoch, high.epoch) == ("", "m", "m", None, 2, 2)
    # With the parent gone all own nothing and the smallest id is first; then it owns one.
    assert (low.owner, high.owner) == (1, 2)
    assert sorted(low.holders()) == sorted(high.holders()) == [1, 2, 3]
    refused(c, "begin_merge", "invalid", lower=2, upper=3, merged=9, epochs=(2, 2))
    c.apply("transfer_ownership", partition=3, source=high.owner, target=low.owner, replicas=low.replicas, epoch=2)
    c.apply("begin_merge", lower=2, upper=3, merged=9, epochs=(2, 3))
    refused(c, "begin_split", "invalid", partition=2, at="c", lower=20, upper=21, epoch=2)
    refused(c, "complete_merge", "unavailable", lower=2, upper=3, merged=9, epochs=(2, 3))
    for n in (1, 2, 3):
        c.apply("mark_merge_prepared", lower=2, upper=3, merged=9, epochs=(2, 3), node=n)
    c.apply("complete_merge", lower=2, upper=3, merged=9, epochs=(2, 3))
    assert list(c.partitions) == [9] and c.partitions[9].epoch == 4 and (c.partitions[9].start, c.partitions[9].end) == ("", None)
    refused(c, "create_keyspace", "invalid", keyspace=2, name="two", partition=3)


def test_aborts_raise_epochs_and_fences_drop_what_is_pending():
    c = cluster()
    c.apply("begin_split", partition=1, at="m", lower=2, upper=3, epoch=1)
    c.apply("abort_split", partition=1, epoch=1)
    refused(c, "complete_split", "stale_epoch", partition=1, epoch=1)
    c.apply("begin_split", partition=1, at="m", lower=4, upper=5, epoch=2)
    c.apply("fence_partition", partition=1, epoch=2)
    p = c.partitions[1]
    assert (p.owner, p.epoch, p.phase, p.replicas, c.splits) == (None, 3, "fenced", [2, 3, 1], {})
    c.apply("complete_fence_drain", partition=1, epoch=3)
    refused(c, "assign_owner", "invalid", partition=1, owner=2, replicas=[2], epoch=3)
    c.apply("set_health", node=2, health="dead")
    refused(c, "assign_owner", "invalid", partition=1, owner=2, replicas=[3], epoch=3)
    c.apply("assign_owner", partition=1, owner=3, replicas=[2, 1], epoch=3)
    assert p.phase == "serving"
    refused(c, "set_replicas", "invalid", partition=1, replicas=[3], epoch=3)
    refused(c, "forget_node", "invalid", node=1)
    c.apply("forget_node", node=5)
    c.apply("begin_split", partition=1, at="m", lower=6, upper=7, epoch=3)
    c.apply("set_replicas", partition=1, replicas=[1], epoch=3)
    assert c.partitions[1].epoch == 4 and not c.splits


def test_keyspaces_credentials_and_versions():
    c = cluster(None)
    refused(c, "begin_split", "unavailable", partition=1, at="m", lower=2, upper=3, epoch=1)
    c.apply("split_partition", partition=1, at="m", lower=2, upper=3, epoch=1)
    assert sorted(c.partitions) == [2, 3]
    refused(c, "create_keyspace", "exists", keyspace=2, name="one", partition=8)
    refused(c, "create_keyspace", "invalid", keyspace=1, name="two", partition=8)
    refused(c, "delete_keyspace", "not_found", keyspace=7)
    refused(c, "update_keyspace", "not_found", keyspace=7)
    c.apply("update_keyspace", keyspace=1)
    refused(c, "create_credential", "invalid", credential="a", keyspaces=[])
    c.apply("create_credential", credential="a", keyspaces=[1])
    refused(c, "create_credential", "exists", credential="a", keyspaces=[1])
    c.apply("revoke_credential", credential="a")
    refused(c, "revoke_credential", "not_found", credential="a")
    refused(c, "set_cluster_version", "invalid", version=(0, 2), expect=(0, 1))
    c.apply("set_cluster_version", version=(0, 2), expect=(0, 0))
    refused(c, "set_cluster_version", "invalid", version=(0, 1), expect=(0, 2))
    refused(c, "register_node", "invalid", node=9, role="worker", speaks=((0, 0), (0, 1)))
    refused(c, "no_such_command", "invalid")
    refused(c, "set_health", "invalid", node=1, color="red")
    version = c.map_version
    c.apply("delete_keyspace", keyspace=1)
    assert not c.partitions and not c.keyspaces and c.map_version == version + 1


def test_lookups_against_every_range():
    rng = random.Random(3)
    keys = [f"k{rng.randrange(40):02}" for _ in range(200)] + ["", "z"]
    rows = []
    for i in range(60):
        low, high = sorted((rng.choice(keys), rng.choice(keys)))
        rows.append((i % 2, low, None if i % 11 == 0 else high, rng.randrange(100), f"r{i}"))
    held = Ranges([(g, low, high, name) for g, low, high, _, name in rows], Held)
    best = Ranges(rows, Best)
    for group in (0, 1):
        for key in keys:
            over = [(order, i, name) for i, (g, low, high, order, name) in enumerate(rows) if g == group and low <= key and (high is None or key < high)]
            assert sorted(held.at(group, key) or ()) == sorted(x[2] for x in over)
            least = min(over, default=(None, None, None))
            assert (best.at(group, key) or (0, None, None)) == (len(over), least[0], least[2])
    assert held.at(7, "k") is None and held.at(0, None) is None


def test_blocks_of_ranges_add_up(spark):
    keys = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcdefgxyz")] + [(2, "a", 99), (None, "a", 98), (1, None, 97)], "keyspace_id long, key string, place int")
    parts = spark.createDataFrame([(1, 1, "", "c"), (1, 2, "c", "f"), (1, 3, "e", "h"), (1, 4, "y", None)], "keyspace_id long, partition_id long, start_key string, end_key string")
    want = {("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 2), ("e", 3), ("f", 3), ("g", 3), ("y", 4), ("z", 4)}
    for block in (1, 2, 100):
        assert {(r["key"], r["partition_id"]) for r in R.route(keys, parts, block).collect()} == want
    assert R.route(keys, parts.limit(0)).collect() == [] == R.route(keys.limit(0), parts).collect()
    runs = spark.createDataFrame([(1, "one", "a", "d", 10), (1, "two", "c", "c", 30)], "keyspace_id long, name string, min_key string, max_key string, max_lamport long")
    got = {r["key"]: (r["candidates"], r["newest"]) for r in lsm.candidate_runs(keys.where("keyspace_id = 1 AND key IS NOT NULL"), runs).collect()}
    assert got["a"] == (1, "one") and got["c"] == (2, "two") and got["d"] == (1, "one") and got["e"] == (0, None)


def test_cache_against_a_list(spark):
    rng = random.Random(4)
    reads = [(rng.randrange(2), i, f"k{rng.randrange(12)}", rng.randrange(2), rng.choice([1, 20, 60, 200])) for i in range(800)]
    got = {r["place"]: (r["hit"], r["evicted"]) for r in cache.lru(spark.createDataFrame(reads, "node_id long, place long, key string, version long, size long"), 150).collect()}
    held = {0: OrderedDict(), 1: OrderedDict()}
    for node, place, key, version, size in reads:
        own = held[node]
        if own.get(key, (None,))[0] == version:
            own.move_to_end(key)
            want = (True, 0)
        else:
            own.pop(key, None)
            out = 0
            if size <= 150:
                own[key] = (version, size)
                while sum(s for _, s in own.values()) > 150:
                    own.popitem(last=False)
                    out += 1
            want = (False, out)
        assert got[place] == want


def test_pages_of_bytes_need_no_join(spark):
    from tidemark.operators import state as S

    rows = spark.createDataFrame([(1, f"{i:04}", 10) for i in range(30)], "keyspace_id long, key string, value_bytes long")
    plan = S.pages_by_bytes(rows, 60, 4, ["keyspace_id"], F.col("value_bytes"))
    assert "Join" not in plan._jdf.queryExecution().toString()
    assert sorted(r["page"] for r in plan.collect()) == sorted(i // 4 for i in range(30))


def test_what_comes_before(spark):
    from tidemark.operators import ordered as O

    rng = random.Random(6)
    rows = [(g, i, rng.choice([None, rng.randrange(50)])) for g in (1, 2, 3) for i in rng.sample(range(5000), 700 if g < 3 else 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g long, at long, v long")
    got = {(r["g"], r["at"]): (r["n"], r["top"], r["last"]) for r in O.before(frame, ["g"], ["at"], {"n": (O.COUNT, None), "top": (O.MAX, "v"), "last": (O.LAST, "v")}).collect()}
    for g in (1, 2, 3):
        seen = []
        for _, at, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert got[g, at] == (len(seen), max((x for x in seen if x is not None), default=None), seen[-1] if seen else None)
            seen.append(v)
    assert O.before(frame.limit(0), ["g"], ["at"], {"n": (O.COUNT, None)}).collect() == []
