"""Matroska columns: files in binary columns to tables of packets, and byte payloads to audio files and back.

The reader follows RFC 8794 (EBML) and RFC 9559 (Matroska): variable-length element ids and sizes, unknown sizes of
segments and clusters, SimpleBlock and BlockGroup, the three lacings, and cues. Files are read one at a time within a
batch, so memory is bounded by a batch of files.

Null files give no packets; an empty or damaged file gives one row with `error` set and no packet; repeated rows give
repeated packets; other columns than the key and the file are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the two RFCs.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BITS = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")
#: Elements that end a segment's or cluster's child of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
UNKNOWN = -1

#: The payload's unit: 192 samples of 8 bits, 24 ms at 8 kHz.
UNIT, SAMPLE_RATE = 192, 8000
#: Units of successive frames, and frames of successive blocks with their lacing.
FRAME_UNITS = (3, 1, 4, 2)
BLOCKS = ((4, "ebml"), (1, "none"), (3, "xiph"), (4, "fixed"))
BLOCKS_PER_CLUSTER = 16


def size_bytes(n: int, least: int = 1) -> bytes:
    """n as a variable-length size of at least so many bytes."""
    k = least
    while n >= (1 << 7 * k) - 1:
        k += 1
    return ((1 << 7 * k) | n).to_bytes(k, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_size(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length size and the place after it; UNKNOWN if all its bits are set."""
    first = data[at]
    k = 9 - first.bit_length()
    if k > 8 or at + k > len(data):
        raise ValueError(f"no variable-length size at byte {at}")
    n = int.from_bytes(data[at : at + k], "big") ^ (1 << 7 * k)
    return (UNKNOWN if n == (1 << 7 * k) - 1 else n), at + k


def read_element(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Id, start and end of the body of the element at a place; the end is UNKNOWN if the size is."""
    k = 9 - data[at].bit_length()
    if k > 4:
        raise ValueError(f"no element id at byte {at}")
    ident = int.from_bytes(data[at : at + k], "big")
    size, start = read_size(data, at + k)
    if size != UNKNOWN and start + size > end:
        raise ValueError(f"the element at byte {at} passes its parent's end")
    return ident, start, UNKNOWN if size == UNKNOWN else start + size


def children(data: bytes, at: int, end: int, stop: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """Id, place, body start and body end of the elements between two places. An element of unknown size, which only
    segments and clusters may have, reaches to the parent's end, a cluster to the next top-level element."""
    while at < end:
        ident, start, stop_at = read_element(data, at, end)
        if stop_at == UNKNOWN:
            if ident not in (SEGMENT, CLUSTER):
                raise ValueError(f"the element at byte {at} has no size")
            stop_at = end
            if ident == CLUSTER:
                inner = start
                while inner < end:
                    kind, _, after = read_element(data, inner, end)
                    if kind in TOP:
                        stop_at = inner
                        break
                    inner = end if after == UNKNOWN else after
        yield ident, at, start, stop_at
        at = stop_at


def unsigned(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def frames(data: bytes, at: int, end: int) -> tuple[int, int, str, list[tuple[int, int]]]:
    """Track, time within the cluster, lacing, and byte ranges of the frames of a block."""
    track, at = read_size(data, at)
    if at + 3 > end:
        raise ValueError("a block ends within its header")
    time = int.from_bytes(data[at : at + 2], "big", signed=True)
    lacing = LACINGS[data[at + 2] >> 1 & 3]
    at += 3
    if lacing == "none":
        return track, time, lacing, [(at, end)]
    if at >= end:
        raise ValueError("a laced block ends before its frame count")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == "fixed":
        sizes = [(end - at) // n] * (n - 1)
        if (end - at) % n:
            raise ValueError("a fixed lace isn't a multiple of its frames")
    elif lacing == "xiph":
        for _ in range(n - 1):
            size = 0
            while True:
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            was = at
            size, at = read_size(data, at)
            if i:  # signed difference to the size before: shifted by half the range
                size += sizes[-1] - ((1 << 7 * (at - was) - 1) - 1)
            sizes.append(size)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > end or any(x < 0 for x in sizes):
        raise ValueError("a lace passes its block's end")
    return track, time, lacing, [*out, (at, end)]


@dataclass
class Media:
    """What a file holds: packets are (track, time in ms, cluster, lacing, first byte, byte after the last)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, float, int, str, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    duration_ms: float = 0.0


def parse(data: bytes) -> Media:
    """The tables of a Matroska file; ValueError if it isn't one or is damaged."""
    try:
        return _parse(data)
    except IndexError as e:
        raise ValueError("the file ends within an element") from e


def _parse(data: bytes) -> Media:
    found, scale, raw_duration = Media(), 1_000_000, 0.0
    tops = list(children(data, 0, len(data)))
    if len(tops) < 2 or tops[0][0] != EBML or tops[1][0] != SEGMENT:
        raise ValueError("not an EBML header and a segment")
    _, _, base, end = tops[1]
    for ident, at, start, stop in children(data, base, end):
        if ident == INFO:
            for kind, _, a, b in children(data, start, stop):
                if kind == SCALE:
                    scale = unsigned(data, a, b)
                elif kind == DURATION:
                    raw_duration = float(np.frombuffer(data[a:b], ">f8" if b - a == 8 else ">f4")[0])
        elif ident == TRACKS:
            for _, _, a, b in children(data, start, stop):
                track: dict = {}
                for kind, _, x, y in children(data, a, b):
                    if kind in (TRACK_NUMBER, TRACK_TYPE):
                        track["number" if kind == TRACK_NUMBER else "type"] = unsigned(data, x, y)
                    elif kind == CODEC:
                        track["codec"] = data[x:y].decode("ascii", "replace")
                found.tracks[track.get("number", 0)] = track
        elif ident == CLUSTER:
            time, blocks = 0, []
            for kind, _, a, b in children(data, start, stop):
                if kind == CLUSTER_TIME:
                    time = unsigned(data, a, b)
                elif kind == SIMPLE_BLOCK:
                    blocks.append((a, b))
                elif kind == BLOCK_GROUP:
                    blocks += [(x, y) for inner, _, x, y in children(data, a, b) if inner == BLOCK]
            for a, b in blocks:
                track_number, offset, lacing, ranges = frames(data, a, b)
                t = (time + offset) * scale / 1e6
                found.packets += [(track_number, t, len(found.clusters), lacing, x, y) for x, y in ranges]
            found.clusters.append(at - base)
        elif ident == CUES:
            for _, _, a, b in children(data, start, stop):
                time = 0
                for kind, _, x, y in children(data, a, b):
                    if kind == CUE_TIME:
                        time = unsigned(data, x, y)
                    elif kind == CUE_PLACES:
                        place = {inner: unsigned(data, p, q) for inner, _, p, q in children(data, x, y)}
                        found.cues.append((time, place.get(CUE_TRACK, 0), place.get(CUE_CLUSTER, 0)))
    found.duration_ms = raw_duration * scale / 1e6
    return found


def block(track: int, time: int, lacing: str, parts: list[bytes]) -> bytes:
    """A SimpleBlock's body."""
    head = size_bytes(track) + time.to_bytes(2, "big", signed=True) + bytes([0x80 | LACINGS.index(lacing) << 1])
    if lacing == "none":
        return head + parts[0]
    head += bytes([len(parts) - 1])
    sizes = [len(x) for x in parts]
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        head += size_bytes(sizes[0])
        for was, n in zip(sizes, sizes[1:-1], strict=False):
            k = 1
            while not -((1 << 7 * k - 1) - 1) < n - was < (1 << 7 * k - 1) - 1:
                k += 1
            head += size_bytes(n - was + (1 << 7 * k - 1) - 1, k)
    return head + b"".join(parts)


HEAD = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
TRACK_LIST = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, np.array(SAMPLE_RATE, ">f8").tobytes()) + number(CHANNELS, 1) + number(BITS, 8))))


def build(payload: bytes) -> bytes:
    """A Matroska file with the payload, whole units of UNIT bytes, as one track of 8-bit samples."""
    ms = UNIT * 1000 // SAMPLE_RATE
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, np.array(len(payload) * 1000 / SAMPLE_RATE, ">f8").tobytes()))
    parts, at, units, turn, clock = [info, TRACK_LIST], 0, 0, 0, 0
    place, cues = len(info) + len(TRACK_LIST), []
    while at < len(payload):
        start, body = clock, [number(CLUSTER_TIME, clock)]
        for _ in range(BLOCKS_PER_CLUSTER):
            n, lacing = BLOCKS[turn % len(BLOCKS)]
            turn += 1
            laced: list[bytes] = []
            began = clock
            while len(laced) < n and at < len(payload):
                size = UNIT * (FRAME_UNITS[0] if lacing == "fixed" else FRAME_UNITS[units % len(FRAME_UNITS)])
                units += 1
                laced.append(payload[at : at + size])
                clock += len(laced[-1]) // UNIT * ms
                at += size
            if lacing == "fixed" and len({len(x) for x in laced}) > 1:
                lacing = "xiph"
            body.append(element(SIMPLE_BLOCK, block(1, began - start, "none" if len(laced) == 1 else lacing, laced)))
            if at >= len(payload):
                break
        cues.append(element(CUE, number(CUE_TIME, start) + element(CUE_PLACES, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        parts.append(element(CLUSTER, b"".join(body)))
        place += len(parts[-1])
    return HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


PACKETS = "track int, time_ms double, cluster int, lacing string, first_byte long, n_bytes long, codec string, cue boolean, error string"


def packets(files: DataFrame, key: str, content: str) -> DataFrame:
    """A row per packet of each file, with the key: track, time, cluster, lacing, byte range, codec, and whether a cue
    points to its cluster. A file that can't be read has one row, with the error."""
    kind = files.schema[key].dataType.simpleString()
    schema = pa.schema([("track", pa.int32()), ("time_ms", pa.float64()), ("cluster", pa.int32()), ("lacing", pa.string()), ("first_byte", pa.int64()), ("n_bytes", pa.int64()), ("codec", pa.string()), ("cue", pa.bool_()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                try:
                    m = parse(data := b.column(1)[i].as_py())
                    cued = {c for _, _, c in m.cues}
                    rows = [(k, t, c, lacing, x, y - x, m.tracks.get(k, {}).get("codec"), m.clusters[c] in cued, None) for k, t, c, lacing, x, y in m.packets]
                    del data
                except ValueError as e:
                    rows = [(None,) * 8 + (str(e),)]
                if rows:
                    cols = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)]
                    ids = b.column(0).take(pa.array(np.full(len(rows), i)))
                    yield pa.RecordBatch.from_arrays([ids, *cols], names=[key, *schema.names])

    return files.where(F.col(content).isNotNull()).select(key, content).mapInArrow(read, f"`{key}` {kind}, {PACKETS}")


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of UNIT bytes."""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def features(m: Media, samples: bytes) -> str:
    """Counts of the container, and of the samples read back: mean, standard deviation and crossings of the middle."""
    laced = {x: 0 for x in LACINGS}
    for p in m.packets:
        laced[p[3]] += 1
    x = np.frombuffer(samples, np.uint8)
    mean = int(x.sum(dtype=np.int64)) / len(x)
    deviation = (int((x.astype(np.int64) ** 2).sum()) / len(x) - mean * mean) ** 0.5
    high = x >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    counts = ",".join(f"{k}:{v}" for k, v in laced.items())
    return f"packets={len(m.packets)};clusters={len(m.clusters)};cues={len(m.cues)};ms={m.duration_ms:.0f};{counts};mean={mean:.4f};sd={deviation:.4f};crossings={crossings}"


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's bytes (null: none) stored as a Matroska file, read back, and digests and features of what was read.

    Equal texts give equal values; a file is made, read and dropped one at a time.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value in b.column(1):
                raw = value.as_buffer()
                data = raw.to_pybytes() if raw is not None else b""
                media = build(pad(data))
                m = parse(media)
                back = b"".join([media[p[4] : p[5]] for p in m.packets])
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(m, back)))
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, *names])

    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(key, text).mapInArrow(convert, schema)
