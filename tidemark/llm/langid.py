"""Language identification by unigram piece models, summed over all segmentations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved
from tidemark.llm.textvec import BASE, INVERSE, _powers, mixed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Most documents of a language that training reads: those with the smallest crc32 of doc_id.
SAMPLE = 500
#: Letters of the longest word that training reads; prediction reads words of any length.
TRAINED = 256
ROUNDS = 3
#: Letters from which a word's sum is taken by products of matrices, BESIDE places at once.
LONG, BESIDE = 64, 2048
#: Words a worker remembers between batches, and characters it splits at once.
MEMORY, BLOCK = 400_000, 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"


def pieces_of(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of letters, lower-cased, once each."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in found if p and _WORD.fullmatch(p.removeprefix(_START) or "a")})


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return words if any(any(map(str.isalpha, w)) for w in words) else []


@dataclass
class Lattice:
    """Which piece, if any, each short run of letters is."""

    keys: np.ndarray
    places: np.ndarray
    longest: int

    @staticmethod
    def of(pieces: list[str]) -> Lattice:
        keys = np.array([Lattice.hashed(np.array([list(map(ord, p))], np.uint64))[0, -1] for p in pieces], np.uint64)
        order = np.argsort(keys)
        return Lattice(keys[order], order, max(map(len, pieces)))

    def pieces(self, runs: np.ndarray) -> np.ndarray:
        """The piece that each row of code points is, or the number of pieces."""
        key = self.hashed(runs)[:, 0]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.places[at], len(self.keys))

    @staticmethod
    def hashed(codes: np.ndarray) -> np.ndarray:
        """The hash of each whole row, in one column."""
        sums = np.cumsum((codes + np.uint64(1)) * _powers(BASE, codes.shape[1]), axis=1)
        return mixed(sums[:, -1:] + np.uint64(codes.shape[1]))

    def runs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, piece or the number of pieces) of every run that may be a piece, ends ascending."""
        rows, n = codes.shape
        sums = np.zeros((rows, n + 1), np.uint64)
        np.cumsum((codes + np.uint64(1)) * _powers(BASE, n), axis=1, out=sums[:, 1:])
        down = _powers(INVERSE, n)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                key = mixed((sums[:, end] - sums[:, start]) * down[start] + np.uint64(end - start))
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                yield start, end, np.where(self.keys[at] == key, self.places[at], len(self.keys))


def by_length(parts: list[str], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of parts of one length after another, at most ``most`` letters at once."""
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(length, kind="stable")
    for n in np.unique(length):
        own = order[np.searchsorted(length[order], n) : np.searchsorted(length[order], n, "right")]
        for at in range(0, len(own), max(1, most // n)):
            some = own[at : at + max(1, most // n)]
            yield some, np.frombuffer(
                "".join(parts[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32,
            ).reshape(len(some), n).astype(np.uint64)


@dataclass
class Model:
    languages: list[str]
    lattice: Lattice
    #: (pieces + 1, languages): probabilities of pieces, then zeros for what is no piece.
    chance: np.ndarray
    #: Probability of a letter taken alone where no piece is: the floor of every segmentation.
    alone: float

    def log_chances(self, parts: list[str]) -> np.ndarray:
        """log of the sum over all segmentations of each part, a column a language (the forward algorithm)."""
        out = np.zeros((len(parts), len(self.languages)))
        for places, codes in by_length(parts):
            rows, n = codes.shape
            if n > LONG:
                for row, place in zip(codes, places):
                    out[place] = self._long(row)
                continue
            ahead = np.zeros((n + 1, rows, len(self.languages)))
            ahead[0] = 1
            scale = np.zeros((rows, len(self.languages)))
            for start, end, piece in self.lattice.runs(codes):
                p = self.chance[piece]
                if end - start == 1:
                    p = np.where(p > 0, p, self.alone)
                ahead[end] += ahead[start] * p
                if start == end - 1 and end % 8 == 0 and end < n:  # keep numbers in range
                    top = ahead[end].copy()
                    scale += np.log(top)
                    ahead[max(0, end - self.lattice.longest + 1) : end + 1] /= top
            out[places] = scale + np.log(ahead[n])
        return out

    def _long(self, codes: np.ndarray) -> np.ndarray:
        """The same of one part of any length: each place is a matrix that maps the sums at the places
        before it to those at and before it; they are multiplied in pairs, then pairs of pairs."""
        deep, n = self.lattice.longest, len(codes)
        sums, log = np.zeros((len(self.languages), deep)), np.zeros(len(self.languages))
        sums[:, 0] = 1
        for at in range(0, n, BESIDE):
            stop, first = min(n, at + BESIDE), max(0, at - deep + 1)
            step = np.zeros((stop - at, len(self.languages), deep, deep))
            step[:, :, np.arange(1, deep), np.arange(deep - 1)] = 1
            near = codes[first:stop]
            for length in range(1, min(deep, len(near)) + 1):
                windows = np.lib.stride_tricks.sliding_window_view(near, length)
                ends = np.arange(first + length - 1, stop)
                own = ends >= at
                p = self.chance[self.lattice.pieces(windows[own])]
                step[ends[own] - at, :, 0, length - 1] = np.where(p > 0, p, self.alone) if length == 1 else p
            scale = np.zeros((stop - at, len(self.languages)))
            while len(step) > 1:
                odd, odd_scale = (step[-1:], scale[-1:]) if len(step) % 2 else (step[:0], scale[:0])
                step, scale = step[1::2] @ step[: len(step) - 1 : 2], scale[1::2] + scale[: len(scale) - 1 : 2]
                top = step.max(axis=(2, 3))
                step, scale = np.concatenate([step / top[:, :, None, None], odd]), np.concatenate([scale + np.log(top), odd_scale])
            sums = (step[0] @ sums[:, :, None])[:, :, 0]
            top = sums.max(axis=1)
            sums, log = sums / top[:, None], log + scale[0] + np.log(top)
        return log + np.log(sums[:, 0])


def fit(lattice: Lattice, languages: list[str], parts: list[str], counts: np.ndarray, rounds: int = ROUNDS, smooth: float = 0.5) -> Model:
    """Expectation maximisation: each round counts the pieces expected over all segmentations of the counted parts.

    ``counts`` is (parts, languages). The first round takes every matching run as equally likely.
    """
    n = len(lattice.keys)
    chance = np.full((n + 1, len(languages)), 1.0 / (n + 1))
    chance[n] = 0
    model = Model(languages, lattice, chance, 1.0 / (n + 1) / 16)
    for _ in range(rounds):
        expected = np.full((n + 1, len(languages)), smooth)
        for places, codes in by_length(parts, 1 << 16):
            rows, length = codes.shape
            runs = list(lattice.runs(codes))
            probability = lambda start, end, piece: np.where(
                model.chance[piece] > 0, model.chance[piece], model.alone if end - start == 1 else 0,
            )  # noqa: E731, B023
            ahead = np.zeros((length + 1, rows, len(languages)), np.longdouble)
            behind = np.zeros_like(ahead)
            ahead[0], behind[length] = 1, 1
            for start, end, piece in runs:
                ahead[end] += ahead[start] * probability(start, end, piece)
            for start, end, piece in reversed(runs):
                behind[start] += behind[end] * probability(start, end, piece)
            weight = counts[places] / ahead[length]
            for start, end, piece in runs:
                seen = np.flatnonzero(piece < n)
                share = (ahead[start] * behind[end] * probability(start, end, piece) * weight)[seen].astype(float)
                np.add.at(expected, piece[seen], share)
        expected[n] = 0
        chance = expected / expected.sum(axis=0)
        model = Model(languages, lattice, chance, float(chance[:n].min()) / 16)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """Learn from at most ``most`` documents of each lang, none held out, with words of up to TRAINED letters.

    The sample is a bound on training alone: of each language the documents with the
    smallest crc32 of doc_id, a repeated doc_id once. No such document: no model.
    """
    known = docs.where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", "lang", "text")
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    number = known.groupBy("lang").agg(F.count("*").alias("n"))
    # Twice the share that is wanted passes by its crc32; the cut comes after. A row a language is sent, a millionth of the model.
    some = known.withColumn("order", order).join(F.broadcast(number), "lang").where((F.col("order") * F.col("n") <= F.lit(2.0 * most * 2**32)) | (F.col("n") <= 2 * most))
    some = saved(some.groupBy("lang", "doc_id", "order").agg(F.min("text").alias("text")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    chosen = some.select("lang", "doc_id", "order").withColumn("place", place).where(F.col("place") <= most).drop("place")
    sample = some.join(chosen, ["lang", "doc_id", "order"]).select("lang", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                words = pd.Series([_START + w for w in words_of(text) if len(w) <= TRAINED], dtype=object).value_counts()
                yield pd.DataFrame({"lang": lang, "part": words.index.astype(object), "n": words.to_numpy()})

    # The distinct words of ``most`` documents a language come back.
    table = sample.mapInPandas(counted, "lang string, part string, n long").groupBy("lang", "part").agg(F.sum("n").alias("n")).toPandas()
    if not len(table):
        return None
    table = table.sort_values(["lang", "part"])
    languages, parts = sorted(set(table["lang"])), sorted(set(table["part"]))
    counts = np.zeros((len(parts), len(languages)))
    counts[
        np.searchsorted(np.array(parts, object), table["part"]),
        np.searchsorted(np.array(languages, object), table["lang"]),
    ] = table["n"]
    return fit(Lattice.of(pieces_of(vocabulary)), languages, parts, counts, rounds)


class Memory:
    """The log-probabilities of words seen lately; it starts anew when MEMORY words are reached."""

    def __init__(self, model: Model) -> None:
        self.model, self.places, self.rows = model, {}, np.zeros((0, len(model.languages)))

    def of(self, words: np.ndarray) -> np.ndarray:
        new = [w for w in words if w not in self.places]
        if len(self.places) + len(new) > MEMORY:
            self.places, self.rows, new = {}, self.rows[:0], list(words)
        if new:
            chances = self.model.log_chances([_START + w for w in new])
            self.places.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, chances])
        return self.rows[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]


def _predicted(texts: list[str | None], memory: Memory) -> Iterator[tuple[str, float]]:
    """Of texts of about BLOCK characters together."""
    model = memory.model
    words = [words_of(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes, distinct = pd.factorize(np.array([w for own in words for w in own] or [""], object))
    of = memory.of(distinct)[codes]
    starts = np.cumsum(sizes) - sizes
    for n, at in zip(sizes, starts):
        if not n:
            yield "und", 0.0
        else:
            total = of[at : at + n].sum(axis=0)
            share = np.exp(total - total.max())
            best = int(share.argmax())
            yield model.languages[best], float(share[best] / share.sum())


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    ``score`` is the language's share of the likelihoods of the whole text, each language
    beforehand as likely. Null texts and texts without a letter are ``und``, score 0, and
    so is everything without a model; a tie goes to the first language by code point;
    repeated rows are each scored; further columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary times the languages

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory = Memory(shared.value)
        for batch in texts:
            out: list[tuple[str, float]] = []
            some: list[str | None] = []
            held = 0
            for text in batch:
                some.append(text)
                held += len(text or "")
                if held > BLOCK:
                    out += _predicted(some, memory)
                    some, held = [], 0
            out += _predicted(some, memory) if some else []
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    guess = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")) if model is None else predict("text")
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), guess.alias("p"),
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")
