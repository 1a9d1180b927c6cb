"""Media columns: Matroska files in a binary column, parsed into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element identifiers of the public EBML and Matroska specifications.
EBML, DOC_TYPE, VOID, CRC = 0x1A45DFA3, 0x4282, 0xEC, 0xBF
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, TYPE, CODEC, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, BITS = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
XIPH, FIXED, SIZED = 1, 2, 3

FRAME = 576  # samples, and bytes, of a packet
HERTZ = 48_000
NANOS = FRAME * 1_000_000_000 // HERTZ
LACED, PER_CLUSTER = 8, 64
ROWS = 1 << 16  # packets of a batch
SLICE = 2 << 20  # bytes of texts or files that a worker turns over at once
_INTEGERS = {
    TIMESTAMP_SCALE, NUMBER, UID, TYPE, DEFAULT_DURATION, CHANNELS, BITS, CLUSTER_TIME, CUE_TIME, CUE_TRACK,
    CUE_CLUSTER, REFERENCE,
}
DEEPEST = 16  # elements in each other; the format has six
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE, CUE_PLACE}


def number(value: int, width: int = 0) -> bytes:
    """An EBML variable-length integer, in the fewest bytes unless a width is given."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, *parts: bytes | int | float | str) -> bytes:
    body = b"".join(
        p if isinstance(p, bytes) else p.encode() if isinstance(p, str) else struct.pack(">d", p) if isinstance(p, float) else p.to_bytes(max(1, (p.bit_length() + 7) // 8), "big") for p in parts
    )
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + number(len(body)) + body


def block(track: int, time: int, frames: list[bytes], lacing: int) -> bytes:
    """The content of a (Simple)Block: track, time in its cluster, flags, lace sizes, frames."""
    head = number(track) + struct.pack(">h", time) + bytes([0x80 | (lacing << 1 if len(frames) > 1 else 0)])
    if len(frames) > 1:
        sizes = list(map(len, frames))
        head += bytes([len(frames) - 1])
        if lacing == XIPH:
            head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        elif lacing == SIZED:
            head += number(sizes[0])
            for a, b in zip(sizes, sizes[1:-1]):
                width = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
                head += number(b - a + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """8-bit mono sound as a Matroska file: a packet every FRAME bytes, laced in each of the three ways in turn, a cue a cluster."""
    view = memoryview(payload)
    frames = [bytes(view[i : i + FRAME]) for i in range(0, len(payload), FRAME)]
    millis = lambda k: k * NANOS // 1_000_000
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000), element(DURATION, float(millis(len(frames)))))
    track = element(
        TRACKS,
        element(
            TRACK, element(NUMBER, 1), element(UID, 1), element(TYPE, 2), element(DEFAULT_DURATION, NANOS),
            element(CODEC, "A_PCM/INT/LIT"),
            element(AUDIO, element(RATE, float(HERTZ)), element(CHANNELS, 1), element(BITS, 8)),
        ),
    )
    body, cues = [info, track], []
    place = len(info) + len(track)
    for at in range(0, len(frames), PER_CLUSTER):
        own = [element(CLUSTER_TIME, millis(at))]
        for k in range(at, min(at + PER_CLUSTER, len(frames)), LACED):
            own.append(
                element(
                    SIMPLE_BLOCK,
                    block(1, millis(k) - millis(at), frames[k : min(k + LACED, at + PER_CLUSTER)], (XIPH, FIXED, SIZED)[k // LACED % 3]),
                )
            )
        body.append(element(CLUSTER, *own))
        cues.append(element(CUE, element(CUE_TIME, millis(at)), element(CUE_PLACE, element(CUE_TRACK, 1), element(CUE_CLUSTER, place))))
        place += len(body[-1])
    return element(EBML, element(DOC_TYPE, "matroska")) + element(SEGMENT, *body, element(CUES, *cues))


@dataclass
class Media:
    """What a file holds. packets: (track, nanoseconds, offset, size, keyframe, place in its lace)."""

    tracks: dict[int, dict[int, object]] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    duration: float | None = None
    error: str | None = None


def _number(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int | None, int]:
    """(value, next place) of a variable-length integer; all ones is None, the unknown size. keep: with its marker, for identifiers."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, at + width
    value -= 1 << 7 * width
    return None if value == (1 << 7 * width) - 1 else value, at + width


def _laces(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError(f"uneven fixed lace at {at}")
        return [(end - at) // count] * count, at
    for k in range(count - 1):
        if lacing == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            size, at = _number(data, at, end)
            if size is None:
                size = (1 << 7 * (at - start)) - 1
            if k:
                size += sizes[-1] - (1 << (7 * (at - start) - 1)) + 1
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace beyond its block at {at}")
    return sizes, at


def parse(data: bytes | None) -> Media:
    """Walk all elements; unknown ones are skipped, unknown sizes end with the parent (a cluster: at the next cluster or cues).

    What is malformed or cut off ends the walk: what came before stays, ``error`` says where.
    """
    media = Media()
    data = data or b""
    scale, segment, cluster_time = 1_000_000, 0, 0

    def blocks(at: int, end: int, key: bool | None) -> None:
        track, at = _number(data, at, end)
        if at + 3 > end:
            raise ValueError(f"cut off at {at}")
        time, flags = struct.unpack_from(">hB", data, at)
        at, lacing = at + 3, flags >> 1 & 3
        sizes, at = _laces(data, at, end, lacing) if lacing else ([end - at], at)
        step = media.tracks.get(track, {}).get(DEFAULT_DURATION, 0)
        for k, size in enumerate(sizes):
            media.packets.append((track, (cluster_time + time) * scale + k * step, at, size, bool(flags & 0x80) if key is None else key, k))
            at += size

    def closed(ident: int, own: dict, found: dict) -> None:
        """A master element is over: what it held goes to the file's tables or to its parent."""
        if ident == TRACK:
            media.tracks[own.get(NUMBER, 0)] = own
        elif ident == AUDIO:
            found.update(own)
        elif ident == CUE_PLACE:
            found.setdefault("places", []).append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, 0)))
        elif ident == CUE:
            media.cues.extend((own.get(CUE_TIME, 0) * scale, t, segment + c) for t, c in own.get("places", []))
        elif ident == BLOCK_GROUP and "block" in own:
            blocks(*own["block"], REFERENCE not in own)

    def simple(ident: int, at: int, stop: int, found: dict) -> None:
        nonlocal scale, cluster_time
        if ident == SIMPLE_BLOCK:
            blocks(at, stop, None)
        elif ident == BLOCK:
            found["block"] = (at, stop)
        elif ident in (RATE, DURATION):
            found[ident] = struct.unpack(">d" if stop - at == 8 else ">f", data[at:stop])[0] if stop - at in (4, 8) else 0.0
            if ident == DURATION:
                media.duration = found[ident]
        elif ident == CODEC:
            found[ident] = data[at:stop].decode("utf-8", "replace")
        elif ident in _INTEGERS:
            found[ident] = int.from_bytes(data[at:stop], "big")
            if ident == TIMESTAMP_SCALE:
                scale = found[ident]
            elif ident == CLUSTER_TIME:
                cluster_time = found[ident]

    def walk() -> None:
        nonlocal segment
        at = 0
        open_: list[tuple[int, int, dict]] = [(0, len(data), {})]  # identifier, end and content of the elements that are open
        while True:
            inside, end, found = open_[-1]
            if at >= end:
                open_.pop()
                if not open_:
                    return
                closed(inside, found, open_[-1][2])
                continue
            begin = at
            ident, at = _number(data, at, end, True)
            if inside == CLUSTER and ident in (CLUSTER, CUES, INFO, TRACKS):  # a cluster of unknown size ends here
                open_[-1] = (inside, begin, found)
                at = begin
                continue
            size, at = _number(data, at, end)
            stop = end if size is None else at + size
            if stop > end:
                raise ValueError(f"element {ident:x} at {begin} goes beyond its parent")
            if ident in _MASTERS:
                if len(open_) > DEEPEST:
                    raise ValueError(f"more than {DEEPEST} elements in each other at {begin}")
                if ident == SEGMENT:
                    segment = at
                elif ident == CLUSTER:
                    media.clusters += 1
                open_.append((ident, stop, {}))
            else:
                simple(ident, at, stop, found)
                at = stop

    try:
        if data[:4] != EBML.to_bytes(4, "big"):
            raise ValueError("no EBML header")
        walk()
    except (ValueError, IndexError, struct.error) as error:
        media.error = str(error)
    return media


def packets(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A row a packet of every file in ``column``: the key columns, track, nanos, offset, size, keyframe, lace, cued.

    ``offset`` and ``size`` are the packet's byte range in the file; ``cued`` says that a
    cue names its cluster's first time and track. Null, empty or malformed files give the
    packets before the fault, maybe none; a null key passes through as it is (no detour over
    floats); repeated rows each have their packets; no rows give none.
    """
    kinds = pa.schema(
        [
            ("track", pa.int64()), ("nanos", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()),
            ("keyframe", pa.bool_()), ("lace", pa.int32()), ("cued", pa.bool_()),
        ]
    )
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", track long, nanos long, offset long, size long, keyframe boolean, lace int, cued boolean"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, data in enumerate(batch.column(batch.num_columns - 1)):
                media = parse(data.as_py())
                cued = {(t, n) for n, t, _ in media.cues}
                for at in range(0, len(media.packets), ROWS):
                    some = media.packets[at : at + ROWS]
                    own = [batch.column(k).take(pa.array([place] * len(some))) for k in range(len(keys))]
                    columns = [*zip(*some), [(p[0], p[1]) in cued for p in some]]
                    yield pa.RecordBatch.from_arrays(
                        [*own, *(pa.array(c, f.type) for c, f in zip(columns, kinds))],
                        names=[*keys, *kinds.names],
                    )

    return df.select(*keys, column).mapInArrow(rows, schema)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about SLICE bytes in ``column``, so that several copies of one fit in a worker."""
    rows = max(1, batch.num_rows * SLICE // max(1, batch.column(column).nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's bytes, padded by 255 to full packets, as the samples of a Matroska file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                texts = part.column("text").to_pylist()
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def summary(data: bytes | None) -> tuple[int, str, int, int, str, str]:
    """(payload bytes, payload sha256, crc32 of its last 32, file bytes, file sha256, feature), the payload read back by packets."""
    media = parse(data)
    view = memoryview(data or b"")
    payload = b"".join(view[p[2] : p[2] + p[3]] for p in media.packets)
    samples = np.frombuffer(payload, np.uint8)
    cued = {n for n, _, _ in media.cues}
    crossing = int(np.count_nonzero(np.diff(samples >= 128))) if len(samples) else 0
    feature = ";".join(
        f"{k}={v}"
        for k, v in (
            ("packets", len(media.packets)), ("clusters", media.clusters), ("cues", len(media.cues)), ("cued", sum(p[1] in cued for p in media.packets)), ("millis", int(media.duration or 0)),
            ("sum", int(samples.sum(dtype=np.int64))), ("squares", int((samples.astype(np.int64) ** 2).sum())), ("crossings", crossing), ("error", media.error or ""),
        )
    )
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(), feature


def digest(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of ``with_media``'s rows.

    A null text counts as empty (one packet of 255s); equal texts give equal values;
    repeated rows and null doc_ids pass through; a malformed file has an error in its feature.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "media"):
                rows = [summary(x.as_py()) for x in part.column("media")]
                columns = [pa.array([r[k] for r in rows], pa.string() if k in (1, 4, 5) else pa.int64()) for k in range(6)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), *columns],
                    names=["doc_id", "n_bytes", *names],
                )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, (
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        f"media_sha256 string, feature string"
    ))
