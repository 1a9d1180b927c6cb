"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_bytes
from tidemark.llm.textvec import chunks, mixed, span_hashes, spans

#: Most labelled rows that training takes; of more, those with the smallest crc32 of doc_id.
SAMPLE = 20_000
THRESHOLD = 0.7
BINS = 48

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".!?",
    "comma": b",;:'\"()-",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "break": b"\n\r",
}
_CODE = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_CLASSES.values(), 1):
    _CODE[list(_bytes)] = _k
_CODE[128:] = len(_CLASSES) + 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True

FEATURES = (
    *(f"{c}_share" for c in (*_CLASSES, "beyond")), "log_bytes", "log_words", "word_bytes", "word_spread", "long_words", "short_words", "log_lines", "words_a_line", "distinct_words", "distinct_lines",
    "capital_words", "symbol_words", "stop_words", "distinct_pairs",
)


def _per_doc(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, weights=values, minlength=n)


def _distinct(hashes: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    keys = hashes ^ mixed(docs.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount(docs[order[first]], minlength=n).astype(float)


def features(texts: pa.Array) -> np.ndarray:
    """(rows, FEATURES) of whole texts, from their bytes alone; a null text counts as empty."""
    data, offsets = text_bytes(texts)
    out = [np.zeros((0, len(FEATURES)))]
    for first, last in chunks(offsets):
        part, own, n = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], last - first
        size = np.diff(own).astype(float)
        code = _CODE[part]
        doc = np.repeat(np.arange(n), np.diff(own))
        counts = np.bincount(doc * 9 + code, minlength=n * 9).reshape(n, 9) if len(part) else np.zeros((n, 9))
        columns = [counts[:, k] / np.maximum(size, 1) for k in range(1, 9)]
        starts, ends, of = spans(~_SPACE[part], own)
        length = (ends - starts).astype(float)
        words = np.bincount(of, minlength=n).astype(float)
        a_word = lambda v: _per_doc(v, of, n) / np.maximum(words, 1)
        mean = a_word(length)
        hashes = span_hashes(part, starts, ends)
        line_starts, line_ends, line_of = spans(~_LINE[part], own)
        lines = np.bincount(line_of, minlength=n).astype(float)
        pair = of[:-1] == of[1:]
        pairs = np.bincount(of[:-1][pair], minlength=n).astype(float)
        pair_hashes = mixed(hashes[:-1][pair] * np.uint64(3) + hashes[1:][pair])
        head, tail = (code[starts], code[ends - 1]) if len(starts) else (np.zeros(0, np.uint8),) * 2
        columns += [
            np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(a_word(length**2) - mean**2, 0)), a_word(length > 12), a_word(length <= 3), np.log1p(lines), words / np.maximum(lines, 1),
            _distinct(hashes, of, n) / np.maximum(words, 1), _distinct(span_hashes(part, line_starts, line_ends), line_of, n) / np.maximum(lines, 1),
            a_word(head == 1), a_word(tail == 6), a_word(tail == 4), _distinct(pair_hashes, of[:-1][pair], n) / np.maximum(pairs, 1),
        ]
        out.append(np.stack(columns, axis=1))
    return np.concatenate(out)


@dataclass
class Additive:
    """A sum of looked-up numbers: one table a feature, one for each chosen pair of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1,
        ) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.grids):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _stump(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    """The step that a tree of up to three leaves over one feature's bins takes."""
    step = np.zeros(len(g))

    def best(lo: int, hi: int) -> tuple[float, int]:
        left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(left_g):
            return 0.0, lo
        all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
        gain = left_g**2 / (left_h + smooth) + (all_g - left_g) ** 2 / (all_h - left_h + smooth) - all_g**2 / (all_h + smooth)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    cuts = [0, len(g)]
    for _ in range(2):
        gain, cut = max(best(a, b) for a, b in zip(cuts, cuts[1:]))
        if gain > 1e-9:
            cuts = sorted({*cuts, cut})
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + smooth)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """(gain, step) of the tree with one cut on either feature of a pair."""
    cg, ch = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h))
    gain, parts = 0.0, []
    for tall, wide in ((False, False), (False, True), (True, False), (True, True)):
        def corner(c: np.ndarray) -> np.ndarray:
            top = c[-1:, :-1] - c[:-1, :-1] if tall else c[:-1, :-1]
            full = c[-1:, -1:] - c[:-1, -1:] if tall else c[:-1, -1:]
            return full - top if wide else top

        a, b = corner(cg), corner(ch)
        parts.append((a, b))
        gain = gain + a**2 / (b + smooth)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.zeros(g.shape)
    for (a, b), rows, cols in zip(parts, (slice(0, i + 1),) * 2 + (slice(i + 1, None),) * 2, (slice(0, j + 1), slice(j + 1, None)) * 2):
        step[rows, cols] = a[i, j] / (b[i, j] + smooth)
    return float(gain[i, j]), step


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 400, pairs: int = 6, rate: float = 0.1, smooth: float = 5.0,
    patience: int = 40,
) -> Additive:
    """Boost one small tree a feature, in turn, then one a chosen pair; rounds end when a fifth kept aside gets no better."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(f)]
    rate0 = (y.sum() + 1) / (n + 2)
    model = Additive(float(np.log(rate0 / (1 - rate0))), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    b = model.bins(x)
    aside = np.arange(n) % 5 == 4
    learn = ~aside
    total = np.full(n, model.base)

    def loss() -> float:
        z = total[aside] if aside.any() else total
        t = y[aside] if aside.any() else y
        return float(np.mean(np.logaddexp(0, z) - t * z))

    def pull() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        return np.where(learn, y - p, 0.0), np.where(learn, p * (1 - p), 0.0)

    def boost(tables: list[np.ndarray], index: list[np.ndarray], step_of) -> None:
        nonlocal total
        least, waited, kept = loss(), 0, [t.copy() for t in tables]
        for _ in range(rounds):
            for k, own in enumerate(index):
                g, h = pull()
                shape = tables[k].shape
                step = rate * step_of(
                    np.bincount(own, g, tables[k].size).reshape(shape),
                    np.bincount(own, h, tables[k].size).reshape(shape),
                )
                tables[k] += step
                total = total + step.ravel()[own]
            now = loss()
            if now < least - 1e-6:
                least, waited, kept = now, 0, [t.copy() for t in tables]
            else:
                waited += 1
                if waited >= patience:
                    break
        for t, best in zip(tables, kept):
            t[...] = best
        total = model.base + sum(t.ravel()[i] for t, i in zip(
            [*model.tables, *model.grids],
            [*(b[:, k] for k in range(f)), *(b[:, i] * model.grids[m].shape[1] + b[:, j] for m, (i, j) in enumerate(model.pairs))],
        ))

    boost(model.tables, [b[:, k] for k in range(f)], lambda g, h: _stump(g, h, smooth))
    g, h = pull()
    gains = []
    for i in range(f):
        for j in range(i):
            shape = (len(edges[i]) + 1, len(edges[j]) + 1)
            if min(shape) > 1:
                own = b[:, i] * shape[1] + b[:, j]
                grid = lambda v: np.bincount(own, v, shape[0] * shape[1]).reshape(shape)  # noqa: E731, B023
                gains.append((_quadrants(grid(g), grid(h), smooth)[0], i, j))
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        model.pairs.append((i, j))
        model.grids.append(np.zeros((len(edges[i]) + 1, len(edges[j]) + 1)))
    if model.pairs:
        boost(
            model.grids, [b[:, i] * t.shape[1] + b[:, j] for (i, j), t in zip(model.pairs, model.grids)],
            lambda g, h: _quadrants(g, h, smooth)[1],
        )
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Additive | None:
    """Fit on at most ``most`` labelled rows that are not held out. No such rows: no model."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("double").alias("label_"))
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = chosen.distinct().orderBy(order, "doc_id", "label_").limit(most)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label_"), *(pa.array(x[:, k]) for k in range(x.shape[1]))],
                names=["doc_id", "label_", *FEATURES],
            )

    # ``most`` identifiers bound what is broadcast, and one row of each what comes back, however often a document is repeated.
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = own.mapInArrow(rows, f"doc_id {kind}, label_ double, " + ", ".join(f"{c} double" for c in FEATURES))
    got = each.groupBy("doc_id").agg(F.min(F.struct("label_", *FEATURES)).alias("r")).select("doc_id", "r.*").toPandas()
    if not len(got):
        return None
    order = np.array([zlib.crc32(str(i).encode()) for i in got["doc_id"]], np.uint64)
    got = got.assign(order_=mixed(order)).sort_values(["order_", "doc_id"], kind="stable")
    return fit(got[list(FEATURES)].to_numpy(), got["label_"].to_numpy())


def scored(docs: DataFrame, model: Additive | None) -> DataFrame:
    """``docs`` with a column ``quality_score`` (a same-named one is replaced); without a model 0.5 for all."""
    docs = docs.drop("quality_score")
    if model is None:
        return docs.withColumn("quality_score", F.lit(0.5))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(features(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "quality_score"])

    schema = docs.schema.fromJson(docs.schema.jsonValue()).add("quality_score", "double")
    return docs.mapInArrow(add, schema)


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Features are of the text's bytes only; null and empty texts share one feature vector
    and are scored by it. Null doc_ids are never trained on and not held out; repeated
    rows are each scored; a doc_id labelled both ways is learnt once; further columns
    (labels' or documents') are ignored; no labels give score 0.5, predicted 0.
    """
    scores = scored(docs.select("doc_id", "text"), train(docs, labels, most))
    return scores.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
