"""SimHash near-duplicates: 64-bit fingerprints, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, saved

WIDTH = 4  # words in a shingle
SEED = 42
RADIUS = 4
TILE = 8192
#: Rows of a tile that are compared at once, which bounds a comparison's memory to ROWS * TILE * 9 bytes.
ROWS = 64


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, unsigned. No words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    step = min(width, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - step + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        pairs = zip(starts[at:stop].tolist(), (starts[at + step : stop + step] - 1).tolist())
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.dtype(">u8"), stop - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and fp long of every row; a text that is not kept goes no further than the scan."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, width, seed) for t in batch], np.uint64).view(np.int64))

    return docs.select(*keep, of("text").alias("fp"))


def join_close(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Labels of the positions of a, then of b, after uniting all within ``radius`` bits of each other; of a alone if ``same`` says that b is a.

    Only labels are kept, never the pairs, so a tile full of near copies stays small.
    """
    shift = 0 if same else len(a)
    labels = np.arange(shift + len(b))
    for at in range(0, len(a), ROWS):
        close = np.bitwise_count(a[at : at + ROWS, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(close)
        i, j = i + at, j + shift
        keep = i != j
        i, j = i[keep], j[keep]
        while len(i):
            x, y = labels[i], labels[j]
            low = np.minimum(x, y)
            if (x == y).all():
                break
            np.minimum.at(labels, x, low)
            np.minimum.at(labels, y, low)
            while (labels[labels] != labels).any():
                labels = labels[labels]
    return labels


def close_pairs(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``prints`` (fp, one row each) within ``radius`` bits.

    A tile holds prints with the same bit counts in both halves; pairs of tiles whose
    counts differ beyond the radius are skipped, all others are compared whole. Of a
    compared pair only a spanning forest is returned.
    """
    spark = prints.sparkSession
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    cells = prints.withColumn("cell", F.bit_count(F.shiftrightunsigned("fp", 32)) * 33 + low)
    buckets = {r["cell"]: -(-r["count"] // tile) for r in cells.groupBy("cell").count().collect()}  # 33 * 33 rows at most
    apart = lambda x, y: abs(x // 33 - y // 33) + abs(x % 33 - y % 33)
    near = [(x, y, n) for x in buckets for y, n in buckets.items() if x <= y and apart(x, y) <= radius]
    many = spark.createDataFrame(list(buckets.items()), "cell int, buckets long")
    near = spark.createDataFrame(near, "cell int, other_cell int, others long")
    at = lambda cell, bucket: F.col(cell) * F.lit(1 << 40) + F.col(bucket)
    tiles = cells.join(F.broadcast(many), "cell").withColumn("bucket", F.pmod(F.xxhash64("fp"), "buckets"))
    tiles = saved(tiles.groupBy("cell", "bucket").agg(F.collect_list("fp").alias("own")).withColumn("tile", at("cell", "bucket")))
    # At most 1089 cells, each with at most 41 others in reach.
    reach = tiles.join(F.broadcast(near), "cell").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    reach = reach.withColumn("other", at("other_cell", "other")).where("tile <= other").select("tile", "own", "other")
    pairs = reach.join(tiles.select(F.col("tile").alias("other"), F.col("own").alias("theirs")), "other").select(
        (F.col("tile") == F.col("other")).alias("same"), "own",
        F.when(F.col("tile") != F.col("other"), F.col("theirs")).alias("theirs"),
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, own, theirs in zip(batch["same"], batch["own"], batch["theirs"]):
                a = np.asarray(own, np.int64)
                b = a if same else np.asarray(theirs, np.int64)
                labels = join_close(a.view(np.uint64), b.view(np.uint64), radius, same)
                both = a if same else np.concatenate([a, b])
                linked = np.nonzero(labels != np.arange(len(labels)))[0]
                if len(linked):
                    yield pd.DataFrame({"a": both[linked], "b": both[labels[linked]]})

    return pairs.mapInPandas(compare, "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, label, component_id) of every row, component_id the smallest doc_id reachable over links, label one of the component's prints.

    Equal fingerprints are one node, so copies are never compared with each other. Null
    and empty texts have fingerprint zero and link like any other; a null doc_id takes
    part but is never a smallest one (all null: null); repeated rows stay; further
    columns are ignored; no rows give none.
    """
    prints = saved(fingerprints(docs, width, seed))
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = saved(components(close_pairs(nodes.select("fp"), radius, tile)).select(F.col("node").alias("fp"), "label"))
    # Written tables on both sides of a join: a component or a print of very many rows can then be dealt to several tasks.
    nodes = saved(nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    best = saved(nodes.groupBy("label").agg(F.min("least").alias("component_id")))
    nodes = saved(nodes.join(best, "label").select("fp", "label", "component_id"))
    return prints.join(nodes, "fp").select("doc_id", "fp", "label", "component_id")
