"""Fuzzy line dedup by MinHash: character-shingle signatures, bands, exact Jaccard, components.

Signatures and the exact comparison are numpy over Arrow batches, everything else DataFrame
operations: with DataFrame functions alone the signatures by themselves took most of the
CPU time that the whole operator may take (figures in the README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, saved, text_bytes
from tidemark.llm.textvec import chunks, mixed

SIMILARITY = 0.8
#: Characters of a shingle. One starts at every character that has so many left; a shorter line is one shingle.
WIDTH = 5
#: Bands and minimum hashes in one: two lines of similarity s share a band with chance 1 - (1 - s**ROWS)**BANDS, 0.997 at 0.8.
BANDS, ROWS = 15, 5
BINS = BANDS * ROWS
#: Minima whose low four bits make a line's sketch, by which pairs far below the similarity are told apart:
#: what agrees in ``BELOW`` standard deviations less than expected is not compared (1 in 700 at the similarity itself).
SKETCH, BELOW = 64, 3.0
#: Bits of a line's print, by which pairs of a bucket are told apart without loss (lines of some hundred characters; longer ones fill it).
PRINT = 2048
#: Lines of a bucket whose pairs, at most half as many a line, are told apart by sketches alone; larger ones take prints.
LIGHT = 32
#: Rounds of comparing with one centre a bucket before the rest is compared across components.
ROUNDS = 2
#: Characters handled at once.
_BLOCK = 1 << 15
_BLANK = " \t\x0b\f\r"
_FACTORS = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PAD = np.uint64(0x7FFFFFFF)
_NONE = np.uint64(0xFFFFFFFF)
#: Keys that one task gathers, 20 bytes each; more keys make more tasks.
GATHERED = 1 << 19
#: Of HINT further minima that travel with a key, by their low four bits, so many must agree (lines of
#: SIMILARITY that share the band fail in 1 of 1000 bands, and share several).
HINT, HINTED = 8, 3
_KEYED = np.dtype([("key", "<u8"), ("id", "<i8"), ("hint", "<u4")])
_STAR = np.dtype([("key", "<u8"), ("id", "<i8"), ("centre", "<i8")])
_SKETCHES = [f"k{i}" for i in range(SKETCH // 16)]
_PRINTS = [f"p{i}" for i in range(PRINT // 64)]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, id): the lines of every text, lower-cased and trimmed. Blank lines are left out.

    ``id`` is a 64-bit hash of the line, the same wherever the line stands; of 10**9
    distinct lines two share one with a chance of 3 in 100 and would be taken for alike.
    """
    rows = docs.select(
        "doc_id", F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("line_no", "raw"),
    ).where(F.ltrim("raw", F.lit(_BLANK)) != "")  # from one end only: trimming a set from the right reads the whole line
    return rows.select("doc_id", "line_no", F.trim("raw").alias("line")).withColumn("id", F.xxhash64("line"))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of every run of WIDTH code points."""
    codes = codes.astype(np.uint64)
    n = len(codes) - WIDTH + 1
    out = codes[:n] * _FACTORS[0]
    for k in range(1, WIDTH):
        out += codes[k : n + k] * _FACTORS[k]
    out = mixed(out)
    return out ^ (out >> np.uint64(32))


def _windows(lines: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, line, whole) of every run of WIDTH characters, block after block; not whole are those that reach into the next line."""
    data, offsets = text_bytes(lines)
    for first, last in chunks(offsets, 1 << 22):
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        codes = part
        if len(part) and part.max() >= 128:
            text = part.tobytes().decode("utf-8", "surrogatepass")
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            own = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int32)])[own]
        length = np.diff(own)
        of = np.repeat(np.arange(first, last, dtype=np.int32), length)
        for at in range(0, len(codes) - WIDTH + 1, _BLOCK):
            line = of[at : at + _BLOCK + WIDTH - 1]
            begin = line[: 1 - WIDTH]
            yield _hashes(codes[at : at + _BLOCK + WIDTH - 1]), begin, begin == line[WIDTH - 1 :]
        short = np.flatnonzero((length > 0) & (length < WIDTH))
        if len(short):
            padded = np.full((len(short), WIDTH), _PAD, np.uint64)
            for row, k in enumerate(short):
                padded[row, : length[k]] = codes[own[k] : own[k + 1]]
            yield _hashes(padded.ravel())[::WIDTH], (short + first).astype(np.int32), np.ones(len(short), bool)


def shingles(lines: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, line) of all character shingles, repeats included, block after block. Empty lines have none."""
    for hashes, line, whole in _windows(lines):
        yield hashes[whole], line[whole].astype(np.int64)


def minima(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((lines, BINS) minimum hashes, how many bins had a shingle of their own), by one permutation.

    Each shingle falls into one bin and each bin keeps its least hash. An empty bin takes
    that of the first bin that is not, in an order of its own: then two lines agree in a
    bin with a chance of their similarity, however short they are.
    """
    n = len(lines)
    out = np.full(n * BINS, _NONE, np.uint64)
    for hashes, line, whole in _windows(lines):
        place = hashes & _NONE
        place *= np.uint64(BINS)
        place >>= np.uint64(32)
        place = place.view(np.int64)
        place += np.multiply(line, BINS, dtype=np.int64)
        hashes >>= np.uint64(32)
        hashes[~whole] = _NONE  # changes no minimum
        np.minimum.at(out, place, hashes)
    out = out.reshape(n, BINS)
    filled = out != _NONE
    count = filled.sum(axis=1)
    lacking = np.flatnonzero((count < BINS) & (count > 0))
    if len(lacking):
        own, has = out[lacking].copy(), filled[lacking]
        for k in range(BINS):
            rows = np.flatnonzero(~has[:, k])
            if len(rows):
                order = np.argsort(mixed(np.arange(BINS, dtype=np.uint64) + np.uint64(BINS * (k + 1))))
                out[lacking[rows], k] = own[rows, order[has[rows][:, order].argmax(axis=1)]]
    return out, count


def bands(least: np.ndarray) -> np.ndarray:
    """(lines, BANDS) keys; lines that agree in a key share all minima of its band."""
    parts = mixed(least + np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, BANDS, ROWS)
    key = parts[:, :, 0]
    for k in range(1, ROWS):
        key = mixed(key * np.uint64(3) + parts[:, :, k])
    return key


def _sketches(least: np.ndarray) -> np.ndarray:
    """(lines, SKETCH / 16) numbers, each of the low four bits of sixteen minima."""
    low = (least[:, :SKETCH] & np.uint64(15)).reshape(len(least), -1, 16)
    return np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def _hints(least: np.ndarray) -> np.ndarray:
    """(lines, BANDS) numbers, for each band of the low four bits of HINT minima of others."""
    places = (np.arange(BANDS)[:, None] * ROWS + ROWS + np.arange(HINT) * 7) % BINS
    low = (least & np.uint64(15))[:, places]
    return np.bitwise_or.reduce(low << (np.arange(HINT, dtype=np.uint64) * np.uint64(4)), axis=2).astype(np.uint32)


def stars(key: np.ndarray, ident: np.ndarray, hint: np.ndarray) -> np.ndarray:
    """For each (key, id, hint) the id of its centre: its own where no other line of its bucket is near by the hints.

    The first line of a bucket, in an order that all buckets share, is the centre of those
    near it; of the others the first again, until none is left.
    """
    centre = ident.copy()
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    crowded = np.zeros(len(key), bool)
    crowded[1:] |= same
    crowded[:-1] |= same
    left = order[crowded]
    left = left[np.lexsort((mixed(ident[left].view(np.uint64)), key[left]))]
    while len(left):
        first = np.concatenate([[True], key[left][1:] != key[left][:-1]])
        head = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
        apart = hint[left] ^ hint[head]
        apart |= apart >> np.uint32(2)
        apart |= apart >> np.uint32(1)
        near = HINT - np.bitwise_count(apart & np.uint32(0x11111111)) >= HINTED
        centre[left[near]] = ident[head[near]]
        left = left[~near]
    return centre


def members_of(lines: DataFrame, groups: int) -> DataFrame:
    """(key, id, centre): the lines (id, line) of every bucket of two or more that are near another by their hints.

    Rows may repeat. Keys are gathered by ranges of their hash, packed, in ``groups``
    groups. Distinct lines of one batch are brought into stars before, and only centres
    are gathered, so that a bucket of any size is combined before its exchange.
    """

    def listed(group: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(group, kind="stable")
        group, rows = group[order], rows[order]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        ends = np.append(start[1:], len(group))
        return pa.RecordBatch.from_arrays(
            [pa.array(group[start], pa.int64()), pa.array([rows[i:j].tobytes() for i, j in zip(start, ends)], pa.binary())],
            names=["g", "packed"],
        )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, once = np.unique(batch.column("id").to_numpy(), return_index=True)
            if not len(once):
                continue
            least, _ = minima(batch.column("line").take(pa.array(once)))
            rows = np.zeros(len(once) * BANDS, _KEYED)
            rows["key"], rows["id"], rows["hint"] = bands(least).ravel(), np.repeat(batch.column("id").to_numpy()[once], BANDS), _hints(least).ravel()
            centre = stars(rows["key"], rows["id"], rows["hint"])
            around = centre != rows["id"]
            yield listed((rows["key"][~around] % np.uint64(groups)).astype(np.int64), rows[~around])
            found = np.zeros(int(around.sum()), _STAR)
            found["key"], found["id"], found["centre"] = rows["key"][around], rows["id"][around], centre[around]
            yield listed(-1 - (found["id"].view(np.uint64) % np.uint64(groups)).astype(np.int64), found)

    def gather(batch: pa.Table) -> pa.Table:
        data = b"".join(x.as_py() for x in batch.column("packed"))
        if batch.column("g")[0].as_py() < 0:
            found = np.frombuffer(data, _STAR)
        else:
            rows = np.frombuffer(data, _KEYED)
            centre = stars(rows["key"], rows["id"], rows["hint"])
            around = centre != rows["id"]
            found = np.zeros(int(around.sum()), _STAR)
            found["key"], found["id"], found["centre"] = rows["key"][around], rows["id"][around], centre[around]
        return pa.table(
            {
                "key": np.ascontiguousarray(found["key"]).view(np.int64),
                "id": np.ascontiguousarray(found["id"]), "centre": np.ascontiguousarray(found["centre"]),
            }
        )

    return lines.select("id", "line").mapInArrow(sign, "g long, packed binary").groupBy("g").applyInArrow(gather, "key long, id long, centre long")


def with_sketches(lines: DataFrame) -> DataFrame:
    """(id, line, filled, sketch) of lines (id, line)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, filled = minima(batch.column("line"))
            own = [pa.array(s.view(np.int64)) for s in np.ascontiguousarray(_sketches(least).T)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("line"), pa.array(filled.astype(np.int32)), *own],
                names=["id", "line", "filled", *_SKETCHES],
            )

    return lines.select("id", "line").mapInArrow(sketch, "id long, line string, filled int, " + ", ".join(f"{c} long" for c in _SKETCHES))


def prints(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((lines, PRINT / 64) numbers, how many distinct shingles): each distinct shingle flips one of PRINT bits.

    Shingles of both lines cancel out, so two prints differ in no more bits than there are
    shingles of only one of the lines.
    """
    _, offsets = text_bytes(lines)
    bits, count = np.zeros((len(lines), PRINT // 64), "<u8"), np.zeros(len(lines), np.int64)
    for first, last in chunks(offsets, 1 << 20):
        for at in range(first, last, 1 << 9):
            n = min(last, at + (1 << 9)) - at
            # Nine bits of a number tell the line, the others the shingle.
            cut = [(of.astype(np.uint64) << np.uint64(55)) | (h >> np.uint64(9)) for h, of in shingles(lines.slice(at, n))]
            found = np.unique(np.concatenate(cut)) if cut else np.zeros(0, np.uint64)
            of = (found >> np.uint64(55)).astype(np.int64)
            flips = np.bincount(of * PRINT + (found % np.uint64(PRINT)).astype(np.int64), minlength=n * PRINT)
            bits[at : at + n] = np.packbits((flips & 1).astype(np.uint8), bitorder="little").view("<u8").reshape(n, -1)
            count[at : at + n] = np.bincount(of, minlength=n)
    return bits, count


def with_prints(lines: DataFrame) -> DataFrame:
    """(id, size, print) of lines (id, line)."""

    def imprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, count = prints(batch.column("line"))
            own = [pa.array(b.view(np.int64)) for b in np.ascontiguousarray(bits.T)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count), *own], names=["id", "size", *_PRINTS])

    return lines.select("id", "line").mapInArrow(imprint, "id long, size long, " + ", ".join(f"{c} long" for c in _PRINTS))


def _may_link(a: str, b: str, least: float) -> Column:
    """Whether the prints of two rows allow a Jaccard similarity of ``least``. No such pair is denied.

    Of x and y shingles x + y - 2 s are in one line only, s those in both; s >= least * (x + y - s)
    bounds that by (x + y) * (1 - least) / (1 + least), and the bits that differ are no more.
    """
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    differing = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _PRINTS), F.lit(0))
    return (F.least(x, y) >= F.greatest(x, y) * least - 1e-6) & (differing <= (x + y) * ((1 - least) / (1 + least)) + 1e-6)


def _near(other: str) -> Column:
    """Whether a row's sketch agrees with the one whose columns begin with ``other`` as lines of SIMILARITY do, or nearly."""

    def differing(x: Column) -> Column:
        for by in (2, 1):  # gather each four bits in the lowest of them
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    agree = F.lit(SKETCH)
    for c in _SKETCHES:
        agree = agree - differing(F.col(c).bitwiseXOR(F.col(other + c)))
    deviation = F.sqrt(F.lit(SIMILARITY * (1 - SIMILARITY)) / F.least(F.col("filled"), F.col(f"{other}filled"), F.lit(SKETCH)))
    return agree >= (F.lit(SIMILARITY) - BELOW * deviation) * SKETCH


def _checked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) of line ids whose shingle sets have that Jaccard similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("line_a"), batch.column("line_b")
            offsets = np.concatenate([[0], np.cumsum(np.diff(text_bytes(left)[1]) + np.diff(text_bytes(right)[1]))])
            close = np.zeros(batch.num_rows, bool)
            for first, last in chunks(offsets, 1 << 20):
                for at in range(first, last, 1 << 12):
                    stop = min(last, at + (1 << 12))
                    # Twelve bits of a number tell the pair, the last one the side, those between the shingle.
                    cut = [(of.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(13) << np.uint64(1)) | np.uint64(k) for k, side in enumerate((left, right)) for h, of in shingles(side.slice(at, stop - at))]
                    found = np.sort(np.concatenate(cut)) if cut else np.zeros(0, np.uint64)
                    found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
                    count = lambda keys: np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=stop - at)  # noqa: E731, B023
                    shared = count(found[:-1][found[1:] ^ found[:-1] == np.uint64(1)])
                    close[at:stop] = shared >= least * (count(found) - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(close))

    side = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "line_a", "line_b")
    return both.mapInArrow(compare, "a long, b long")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, label, sketch, lines) of the buckets that hold more than one component, and how many lines they hold."""
    now = members.join(labels.select("id", "label"), "id")
    found = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("lines"))
    return members.join(found.where("lo <> hi").select("key", "lines"), "key").join(labels, "id")


def _to_centres(now: DataFrame, turn: int) -> DataFrame:
    """(a, b): each member of a bucket with its buckets' centres of this turn, where sketches allow it.

    A bucket's centre is its first line in an order that all buckets share, so the buckets
    of one group mostly agree on it and a member is compared once.
    """
    order = F.xxhash64("id", F.lit(turn))
    centres = now.groupBy("key").agg(*[F.min_by(c, order).alias(f"c_{c}") for c in ("id", "label", "filled", *_SKETCHES)])
    both = now.join(centres, "key").where((F.col("label") != F.col("c_label")) & _near("c_"))
    return both.select(F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b")).distinct()


def _across(now: DataFrame) -> DataFrame:
    """(a, b): the pairs of lines in one bucket, of different components, where sketches allow it."""
    other = now.select("key", *[F.col(c).alias(f"o_{c}") for c in ("id", "label", "filled", *_SKETCHES)])
    both = now.join(other, "key").where((F.col("id") < F.col("o_id")) & (F.col("label") != F.col("o_label")) & _near("o_"))
    return both.select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct()


def _across_by_prints(now: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of ``_across`` whose prints allow a link too; of these no link is missing.

    Prints come first and only the pairs left meet their sketches: as one condition both
    are many times slower.
    """
    own = saved(with_prints(lines.join(now.select("id").distinct(), "id")))
    rows = now.select("key", "id", "label").join(own, "id")
    bucket = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label"))
    both = rows.alias("x").join(rows.alias("y"), bucket & _may_link("x", "y", least))
    return _paired(both.select(F.col("x.id").alias("id"), F.col("y.id").alias("centre")), lines)


def _first_of_each(now: DataFrame, turn: int) -> DataFrame:
    """One row a component of each bucket, the first in this turn's order."""
    order = F.xxhash64("id", F.lit(turn))
    return now.groupBy("key", "label").agg(*[F.min_by(c, order).alias(c) for c in ("id", "filled", *_SKETCHES)])


def _paired(stars: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b): the lines of each star, or other pairs, with their centre, where sketches allow it."""
    of = lambda c, by: lines.select(F.col("id").alias(c), *[F.col(x).alias(by + x) for x in ("filled", *_SKETCHES)])
    both = stars.select("id", "centre").distinct().join(of("id", ""), "id").join(of("centre", "c_"), "centre").where(_near("c_"))
    return both.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def labelled(stars: DataFrame, lines: DataFrame, least: float, rounds: int = ROUNDS, exact: bool = True) -> DataFrame:
    """(id, label): components of the links of at least ``least`` between lines that share a bucket.

    stars: (key, id, centre). lines: (id, line, filled, sketch) of all that occur there.
    """
    texts, labels = lines.select("id", "line"), lines.drop("line").withColumn("label", F.col("id"))
    members = None
    for turn in range(rounds + (1 if exact else 2)):
        if not turn:
            pairs = saved(_paired(stars, lines))
        else:
            if members is None:
                members = saved(stars.select("key", "id").union(stars.select("key", "centre")).distinct())
            now = saved(_mixed(members, labels))
            if now.isEmpty():
                break
            members = now.select("key", "id")  # the other buckets are of one component for good
            if turn < rounds:
                pairs = saved(_to_centres(now, turn))
            elif exact:
                heavy = _across_by_prints(now.where(F.col("lines") > LIGHT), lines, least)
                pairs = saved(_across(now.where(F.col("lines") <= LIGHT)).union(heavy).distinct())
            else:
                pairs = saved(_across(_first_of_each(now, turn)))
        of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
        links = _checked(pairs, texts, least).join(of("a"), "a").join(of("b"), "b")
        united = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        united = united.select(F.col("node").alias("label"), F.col("label").alias("now"))
        labels = saved(labels.join(united, "label", "left").select("id", "filled", *_SKETCHES, F.coalesce("now", "label").alias("label")))
    return labels.select("id", "label")


def line_groups(
    docs: DataFrame, least: float = SIMILARITY, rounds: int = ROUNDS, exact: bool = True,
    gathered: int = GATHERED,
) -> DataFrame:
    """(doc_id, line_no, group_doc_id, group_line_no, kept) of every line that is not blank.

    Lines alike after trimming and lower-casing are one. Of these, lines whose shingle sets
    have a Jaccard similarity of ``least`` (SIMILARITY or more) are linked if they share a
    band of minimum hashes, and a group is a component of the links. Its first line by
    (doc_id, line_no), null doc_ids last, names the group and is the one that is kept.

    In each bucket all lines are first compared with one centre, which unites large groups
    of near copies without listing their pairs. After ``rounds`` such rounds with different
    centres, what still is of different components in a bucket is compared: every pair of
    lines with ``exact``, else one line a component, twice, with other lines.
    Null texts have no lines; lines of repeated rows are told apart, so one is kept;
    further columns are ignored; no rows give none.
    """
    lines = lines_of(docs)
    seen = saved(lines.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "line_no", "id"))
    groups = 1 + seen.count() * BANDS // gathered
    found = saved(members_of(lines, groups))
    own = found.select("id").union(found.select("centre")).distinct()
    wanted = saved(with_sketches(lines.groupBy("id").agg(F.first("line").alias("line")).join(own, "id")))
    labels = labelled(found, wanted, least, rounds, exact)
    known = labels.join(labels.where("id <> label").select("label").distinct(), "label").select("id", "label")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "uid")).alias("first")
    firsts = saved(seen.groupBy("id").agg(first).join(known, "id", "left"))
    heads = saved(firsts.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("head")))
    of_group = firsts.where("label IS NOT NULL").select("id", "label").join(heads, "label").select("id", "head")
    head = saved(firsts.where("label IS NULL").select("id", F.col("first").alias("head")).union(of_group))
    return seen.join(head, "id").select(
        "doc_id", "line_no", F.col("head.doc_id").alias("group_doc_id"),
        F.col("head.line_no").alias("group_line_no"), (F.col("uid") == F.col("head.uid")).alias("kept"),
    )


def without_repeats(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with a column ``kept_lines``: the numbers of the lines of its text that stay (blank ones do).

    For unique doc_ids; null and empty texts have one blank line; a null doc_id loses
    nothing; a column of that name is replaced; no rows give none.
    """
    gone = groups.where(~F.col("kept")).groupBy(F.col("doc_id").alias("of_")).agg(F.collect_set("line_no").alias("gone_"))
    everything = F.sequence(F.lit(0), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)) - 1)
    rest = F.when(F.col("gone_").isNull(), everything).otherwise(F.array_except(everything, "gone_"))
    return docs.join(gone, F.col("doc_id") == F.col("of_"), "left").withColumn("kept_lines", rest).drop("gone_", "of_")
