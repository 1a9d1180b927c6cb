"""Benchmark decontamination: containment of short items in long documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import text_bytes
from tidemark.llm.textvec import chunks, shingle_hashes, span_hashes, spans

WIDTH = 5
THRESHOLD = 0.8
#: Shingles of one block of items, which bounds what is broadcast to about 100 MB; more items make more blocks.
BLOCK_SHINGLES = 500_000
#: Letters, digits and everything beyond ASCII make words, in lower case.
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TABLE_BITS = 20


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(pc.utf8_lower(pa.scalar(text)).as_py().encode())


def shingles_of(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _hashed(texts: pa.Array, widths: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(width, first document, hash, document) for chunk after chunk."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    for first, last in chunks(offsets):
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, docs = spans(_IN_WORD[part], own)
        hashes = span_hashes(part, starts, ends)
        for width in widths:
            found, place = shingle_hashes(hashes, docs, width)
            yield width, first, found, docs[place]


class Items:
    """A block of items: their shingles, and a table of sketches for each partition of them by size.

    A partition holds items of one shingle width whose numbers of shingles have the same
    number of binary digits. A document that holds at least ``threshold`` of an item's n
    shingles misses at most m = n - ceil(threshold n) of them. So of the item's sketch,
    its 2 m + 1 least hashes (or all n), it misses no more than m: the documents that hold
    the others, m + 1 mostly, are the candidates, and none can escape.
    """

    def __init__(self, rows: list[tuple[object, str]], threshold: float, width: int) -> None:
        self.threshold, self.ids, self.shingles, self.widths = threshold, [], [], []
        for ident, text in rows:
            words = words_of(text or "")
            if words:
                self.ids.append(ident)
                self.widths.append(min(width, len(words)))
                self.shingles.append(shingles_of(words, self.widths[-1]))
        parts: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        self.wanted = np.zeros(len(self.ids), np.int64)
        for k, w in enumerate(self.widths):
            hashed = self._hashes(k, w)
            missing = len(hashed) - self.need(len(hashed))
            sketch = np.sort(hashed)[: 2 * missing + 1]
            self.wanted[k] = len(sketch) - missing
            parts.setdefault((w, len(hashed).bit_length()), []).append((k, sketch))
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for (w, _), own in sorted(parts.items(), key=lambda x: x[0]):
            key, owner = np.concatenate([s for _, s in own]), np.concatenate([np.full(len(s), k) for k, s in own])
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << _TABLE_BITS, bool)
            seen[key >> np.uint64(64 - _TABLE_BITS)] = True
            self.tables.setdefault(w, []).append((key[order], owner[order], seen))

    def need(self, n: int) -> int:
        return int(np.ceil(self.threshold * n - 1e-9))

    def _hashes(self, k: int, width: int) -> np.ndarray:
        texts = pa.array([s.decode("utf-8", "surrogateescape") for s in self.shingles[k]])
        return np.unique(np.concatenate([h for _, _, h, _ in _hashed(texts, [width])]))

    def candidates(self, texts: pa.Array) -> np.ndarray:
        """Sorted numbers place * items + item of the documents that hold enough of an item's sketch."""
        out = [np.zeros(0, np.int64)]
        for width, first, hashes, docs in _hashed(texts, list(self.tables)):
            for key, owner, seen in self.tables[width]:
                maybe = np.flatnonzero(seen[hashes >> np.uint64(64 - _TABLE_BITS)])
                low, high = np.searchsorted(key, hashes[maybe], "left"), np.searchsorted(key, hashes[maybe], "right")
                times = high - low
                held = np.repeat(docs[maybe], times)
                at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(held))
                # A shingle that a document repeats counts once.
                held, at = np.divmod(np.unique(held * len(key) + at), len(key))
                pair, shared = np.unique((first + held) * len(self.ids) + owner[at], return_counts=True)
                out.append(pair[shared >= self.wanted[pair % len(self.ids)]])
        return np.sort(np.concatenate(out))

    def found(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(place in texts, place of the item, shingles shared) of every contained item."""
        out, last, of = [], None, {}
        for place, k in zip(*(x.tolist() for x in np.divmod(self.candidates(texts), max(1, len(self.ids))))):
            if place != last:
                last, of, words = place, {}, words_of(texts[place].as_py())
            width = self.widths[k]
            of[width] = of.get(width) or shingles_of(words, width)
            shared = len(self.shingles[k] & of[width])
            if shared >= self.need(len(self.shingles[k])):
                out.append((place, k, shared))
        return out


def blocks(benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, most: int = BLOCK_SHINGLES) -> Iterator[Items]:
    """The items in blocks of a bounded number of shingles, streamed to the driver."""
    rows, held = [], 0
    for ident, text in benchmark.select("item_id", "text").toLocalIterator():
        size = (text or "").count(" ") + 1
        if rows and held + size > most:
            yield Items(rows, threshold, width)
            rows, held = [], 0
        rows.append((ident, text))
        held += size
    if rows:
        yield Items(rows, threshold, width)


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH,
    block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment) of every item contained in a document.

    Words are lower-cased runs of letters and digits, shingles have ``width`` of them; an
    item of fewer words is one shingle, its whole sequence. Every document is read once
    per block of items and nothing is shuffled. Null and empty texts contain nothing and
    items without words are in nothing; a repeated document or item gives repeated rows;
    null identifiers pass through; identifiers may be of any type; further columns are
    ignored.
    """
    spark, out = docs.sparkSession, None
    doc_kind, item_kind = (d.schema[c].dataType for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    item_type = to_arrow_type(item_kind)
    kinds = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, shared long, shingles long, containment double"
    for items in blocks(benchmark, threshold, width, block):
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                items = shared.value
                hits = items.found(batch.column("text"))
                places = pa.array([h[0] for h in hits], pa.int64())
                sizes = [len(items.shingles[k]) for _, k, _ in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(places),
                        pa.array([items.ids[k] for _, k, _ in hits], item_type),
                        pa.array([h[2] for h in hits], pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array([h[2] / n for h, n in zip(hits, sizes)], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "shared", "shingles", "containment"],
                )

        part = docs.select("doc_id", "text").mapInArrow(search, kinds)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], kinds)
    return out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH,
    block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item (see ``leaks``).

    Null and empty texts stay; repeated rows stay or go together; null doc_ids stay like
    any other; without items all rows stay; no rows give none.
    """
    for items in blocks(benchmark, threshold, width, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in shared.value.found(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
