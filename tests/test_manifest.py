import os
import time

import pytest

from tidemark.sources import manifest as M

# The published example of the format.
SEGMENT = {"name": "segments/0000000000000006-0000000000000000.oseg", "bytes": 416, "record_count": 4, "min_key": b"alpha", "max_key": b"delta", "min_lamport": 1, "max_lamport": 4}


def text(epoch, committed=9, segments=(SEGMENT,)):
    return M.encode(1, 7, epoch, committed, b"", b"m", list(segments))


def test_read_as_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text(text(6))
    (tmp_path / "b.json").write_text(text(7, 2**64 - 1, [SEGMENT | {"source_partition_id": 3}]))
    frame = M.read_manifests(spark, str(tmp_path / "*.json"))
    assert sorted((int(r["epoch"]), int(r["committed_lamport"])) for r in frame.collect()) == [(6, 9), (7, 2**64 - 1)]
    rows = M.segments_of(frame).orderBy("epoch").collect()
    assert [bytes(r["min_key"]) for r in rows] == [b"alpha"] * 2 and [r["source_partition_id"] and int(r["source_partition_id"]) for r in rows] == [None, 3]
    for old, new in (('"epoch"', '"mood": 1, "epoch"'), ('"start"', '"middle": "", "start"'), ('"min_key"', '"min_kay": "", "min_key"')):
        (tmp_path / "a.json").write_text(text(6).replace(old, new, 1))
        with pytest.raises(Exception, match="unknown fields"):
            M.read_manifests(spark, str(tmp_path / "a.json")).collect()
    (tmp_path / "a.json").write_text(text(6, segments=()))
    assert M.read_manifests(spark, str(tmp_path / "a.json")).first()["segments"] == []
    (tmp_path / "a.json").write_text("{broken")
    with pytest.raises(Exception):
        M.read_manifests(spark, str(tmp_path / "a.json")).collect()


def test_commit_is_guarded(tmp_path):
    path = str(tmp_path / "manifest.json")
    assert M.commit(path, 6, lambda old: text(6))["epoch"] == 6
    assert M.commit(path, 7, lambda old: text(7, old["committed_lamport"] + 1))["committed_lamport"] == 10
    with pytest.raises(M.Deposed):
        M.commit(path, 6, lambda old: text(6))
    with pytest.raises(ValueError):
        M.commit(path, 8, lambda old: text(9))

    def racing(old):
        if old["committed_lamport"] == 10:
            M.commit(path, 8, lambda now: text(8, 20))
        return text(8, old["committed_lamport"] + 1)

    assert M.commit(path, 8, racing)["committed_lamport"] == 21
    (tmp_path / "manifest.json.lock").touch()
    with pytest.raises(M.Conflict):
        M.commit(path, 8, lambda old: text(8))
    old = time.time() - 2 * M.LOCK_SECONDS
    os.utime(path + ".lock", (old, old))
    assert M.commit(path, 8, lambda old: text(8))["epoch"] == 8
