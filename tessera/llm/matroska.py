"""Media columns: Matroska. Writing samples as a Matroska file and parsing such files into packet tables.

The parser reads variable-length EBML elements of known and unknown size, tracks, clusters, block
groups and simple blocks under all four kinds of lacing, and cues; a packet has its track, timestamp
in nanoseconds, byte range and the kind of lacing that held it. The writer makes one audio track of
unsigned 8-bit PCM in fixed-size frames, laced into simple blocks, with cues to every cluster.

Defined results: a null payload text is empty; bytes that end within an element raise ValueError, as do
laced sizes beyond their block; unknown elements are skipped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common as c

# Element ids of the Matroska format, and its kinds of lacing.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME = 576
RATE = 8000
FRAME_NS = FRAME * 1_000_000_000 // RATE
#: Frames of a block, and blocks of a cluster, whose relative timestamps have 16 bits.
LACED = 8
BLOCKS = 56
PAD = 255
_TOP = {SEGMENT, CLUSTER, CUES, TRACKS, INFO, EBML}


def vint(n: int, width: int = 0) -> bytes:
    """n as a data size of the least width, or the given one."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(i: int, body: bytes) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> bytes:
    """The body of a block after its flags: the lace's head and its frames."""
    if kind == "none":
        if len(frames) != 1:
            raise ValueError("a block without lacing has one frame")
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == "ebml":
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            w = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * w - 1) - 1, w)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed-size lacing needs frames of one size")
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], kind: str) -> bytes:
    return vint(track) + struct.pack(">hB", relative, 0x80 | LACINGS.index(kind) << 1) + lace(frames, kind)


_HEAD = element(EBML, b"".join((unsigned(EBML_VERSION, 1), unsigned(EBML_READ_VERSION, 1), unsigned(EBML_MAX_ID, 4), unsigned(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), unsigned(DOC_VERSION, 4), unsigned(DOC_READ_VERSION, 2))))
_INFO = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"tessera") + element(WRITING_APP, b"tessera"))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, b"".join((
    unsigned(TRACK_NUMBER, 1), unsigned(TRACK_UID, 1), unsigned(TRACK_TYPE, 2), unsigned(FLAG_LACING, 1), unsigned(DEFAULT_DURATION, FRAME_NS), element(CODEC_ID, b"A_PCM/INT/LIT"),
    element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8)),
))))


def write_pcm(samples: bytes, lacing: str = "fixed", laced: int = LACED, blocks: int = BLOCKS) -> bytes:
    """A Matroska file of 8-bit samples, a positive multiple of FRAME."""
    if not samples or len(samples) % FRAME:
        raise ValueError(f"{len(samples)} samples are no positive multiple of {FRAME}")
    ms, body, cues, at = FRAME_NS // 1_000_000, [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    per_cluster = FRAME * laced * blocks
    for s in range(0, len(samples), per_cluster):
        time, inside = s // FRAME * ms, []
        for p in range(s, min(s + per_cluster, len(samples)), FRAME * laced):
            frames = [samples[q : q + FRAME] for q in range(p, min(p + FRAME * laced, s + per_cluster, len(samples)), FRAME)]
            inside.append(element(SIMPLE_BLOCK, block(1, (p - s) // FRAME * ms, frames, lacing if len(frames) > 1 else "none")))
        body.append(element(CLUSTER, unsigned(TIMESTAMP, time) + b"".join(inside)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        at += len(body[-1])
    return _HEAD + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """What a file holds. tracks: number to codec, type, default duration in ns, sampling frequency, channels, bit depth; cues: (time in ns, track, file offset of the cluster)."""

    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, str, bool]] = field(default_factory=list)  # track, timestamp ns, start, end, cluster, lacing, keyframe
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def _vint(b: bytes, p: int, keep: bool = False) -> tuple[int, int]:
    """(value, next place) of a variable-length integer; -1 for the unknown size. keep: with its marker, as ids are."""
    if p >= len(b) or not b[p]:
        raise ValueError(f"no variable-length integer at byte {p}")
    w = 9 - b[p].bit_length()
    if p + w > len(b):
        raise ValueError(f"the integer at byte {p} is cut off")
    n = int.from_bytes(b[p : p + w], "big")
    if not keep:
        n &= (1 << 7 * w) - 1
        if n == (1 << 7 * w) - 1:
            n = -1
    return n, p + w


def _elements(b: bytes, p: int, end: int, ends: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body, end) of each element of [p, end). One of unknown size runs to ``end`` or the next element of ``ends``."""
    while p < end:
        start = p
        i, q = _vint(b, p, True)
        size, q = _vint(b, q)
        if size < 0:
            stop = end
            if i == CLUSTER:
                stop = next((s for k, s, _, _ in _elements(b, q, end) if k in ends), end)
        else:
            stop = q + size
        if stop > end:
            raise ValueError(f"the element at byte {start} is cut off")
        yield i, start, q, stop
        p = stop


def _frames(b: bytes, p: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(p, end)]
    if p >= end:
        raise ValueError("a laced block has no frame count")
    n, p = b[p] + 1, p + 1
    if lacing == 2:
        each, rest = divmod(end - p, n)
        if rest:
            raise ValueError("fixed-size lacing doesn't fill its block")
        return [(p + k * each, p + (k + 1) * each) for k in range(n)]
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == 1:
            s = 0
            while True:
                if p >= end:
                    raise ValueError("laced sizes are cut off")
                s, p, last = s + b[p], p + 1, b[p]
                if last < 255:
                    break
        elif not k:
            s, p = _vint(b, p)
        else:
            q = p
            d, p = _vint(b, p)
            w = p - q
            s = sizes[-1] + (d if d >= 0 else (1 << 7 * w) - 1) - ((1 << 7 * w - 1) - 1)
        sizes.append(s)
    sizes.append(end - p - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed their block")
    edge = [p]
    for s in sizes:
        edge.append(edge[-1] + s)
    return list(zip(edge[:-1], edge[1:], strict=True))


def parse(b: bytes) -> Media:
    out = Media()
    number = lambda s, e: int.from_bytes(b[s:e], "big")
    for i, _, p, end in _elements(b, 0, len(b)):
        if i != SEGMENT:
            continue
        base, clusters = p, 0
        for j, start, q, stop in _elements(b, p, end, _TOP):
            if j == INFO:
                out.scale = next((number(x, y) for k, _, x, y in _elements(b, q, stop) if k == TIMESTAMP_SCALE), out.scale)
            elif j == TRACKS:
                for k, _, x, y in _elements(b, q, stop):
                    if k == TRACK_ENTRY:
                        _track(b, x, y, out)
            elif j == CLUSTER:
                _cluster(b, q, stop, clusters, out)
                clusters += 1
            elif j == CUES:
                for k, _, x, y in _elements(b, q, stop):
                    if k == CUE_POINT:
                        time, places = 0, []
                        for m, _, u, v in _elements(b, x, y):
                            if m == CUE_TIME:
                                time = number(u, v)
                            elif m == CUE_TRACK_POSITIONS:
                                places.append({z: number(g, h) for z, _, g, h in _elements(b, u, v)})
                        out.cues += [(time * out.scale, d.get(CUE_TRACK, 0), base + d.get(CUE_CLUSTER_POSITION, 0)) for d in places]
    return out


def _track(b: bytes, p: int, end: int, out: Media) -> None:
    number = lambda s, e: int.from_bytes(b[s:e], "big")
    got: dict = {"codec": "", "type": 0, "duration": 0, "rate": 8000.0, "channels": 1, "depth": 0}
    n = 0
    for k, _, x, y in _elements(b, p, end):
        if k == TRACK_NUMBER:
            n = number(x, y)
        elif k == CODEC_ID:
            got["codec"] = b[x:y].decode("ascii", "replace")
        elif k == TRACK_TYPE:
            got["type"] = number(x, y)
        elif k == DEFAULT_DURATION:
            got["duration"] = number(x, y)
        elif k == AUDIO:
            for m, _, u, v in _elements(b, x, y):
                if m == SAMPLING_FREQUENCY:
                    got["rate"] = struct.unpack(">d" if v - u == 8 else ">f", b[u:v])[0]
                elif m == CHANNELS:
                    got["channels"] = number(u, v)
                elif m == BIT_DEPTH:
                    got["depth"] = number(u, v)
    out.tracks[n] = got


def _cluster(b: bytes, p: int, end: int, at: int, out: Media) -> None:
    time = 0
    for k, _, x, y in _elements(b, p, end):
        if k == TIMESTAMP:
            time = int.from_bytes(b[x:y], "big")
        elif k == SIMPLE_BLOCK:
            _block(b, x, y, time, at, out, None)
        elif k == BLOCK_GROUP:
            inside = list(_elements(b, x, y))
            refers = any(m == 0xFB for m, *_ in inside)  # a reference to another block
            for m, _, u, v in inside:
                if m == BLOCK:
                    _block(b, u, v, time, at, out, not refers)


def _block(b: bytes, p: int, end: int, time: int, at: int, out: Media, key: bool | None) -> None:
    track, p = _vint(b, p)
    if p + 3 > end:
        raise ValueError("a block's head is cut off")
    relative, flags = struct.unpack_from(">hB", b, p)
    kind = flags >> 1 & 3
    each = out.tracks.get(track, {}).get("duration", 0)
    key = bool(flags & 0x80) if key is None else key
    start = (time + relative) * out.scale
    out.packets += [(track, start + n * each, s, e, at, LACINGS[kind], key) for n, (s, e) in enumerate(_frames(b, p + 3, end, kind))]


def payload(text: bytes, unit: int = FRAME, pad: int = PAD) -> bytes:
    """The text and pad bytes up to a positive multiple of unit."""
    return text + bytes([pad]) * ((-len(text)) % unit if text else unit)


def read_back(media: bytes) -> tuple[Media, bytes]:
    got = parse(media)
    view = memoryview(media)
    return got, b"".join([view[s:e] for _, _, s, e, *_ in got.packets])


def feature(got: Media, samples: bytes) -> str:
    """Packets, duration in ms, crossings of the middle, peak-to-peak, and sum of squares about the middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    last = got.packets[-1]
    duration = (last[1] + got.tracks[last[0]]["duration"]) // 1_000_000
    above = x >= 0
    return f"packets={len(got.packets)} ms={duration} crossings={int((above[1:] != above[:-1]).sum())} range={int(x.max() - x.min())} energy={int((x * x).sum(dtype=np.int64))}"


_ROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def encode_column(docs: DataFrame, lacing: str = "fixed") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a Matroska file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = c.as_bytes(c.column(b, "text")), c.column(b, "doc_id")
            for i, j in c.blocks(texts, 8 << 20):
                yield c.record_batch(schema, ids.slice(i, j - i), [len(t) for t in texts[i:j]], [write_pcm(payload(t), lacing) for t in texts[i:j]])

    return docs.select("doc_id", "text").mapInArrow(c.tidied(run), "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, packet, track, timestamp_ns, start, length, cluster, lacing, keyframe) of each packet of each file in the column ``media``; null files have none."""
    kinds = "packet int, track long, timestamp_ns long, start long, length long, cluster int, lacing string, keyframe boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in zip(c.column(b, key).to_pylist(), c.column(b, "media").to_pylist(), strict=True):
                if m is None:
                    continue
                p = parse(m).packets
                yield pa.RecordBatch.from_pydict({
                    key: pa.array([k] * len(p), b.schema.field(key).type), "packet": pa.array(range(len(p)), pa.int32()), "track": pa.array([x[0] for x in p], pa.int64()), "timestamp_ns": pa.array([x[1] for x in p], pa.int64()),
                    "start": pa.array([x[2] for x in p], pa.int64()), "length": pa.array([x[3] - x[2] for x in p], pa.int64()), "cluster": pa.array([x[4] for x in p], pa.int32()), "lacing": pa.array([x[5] for x in p], pa.string()), "keyframe": pa.array([x[6] for x in p], pa.bool_()),
                })

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, "media").mapInArrow(c.tidied(run), f"{key} {kind}, {kinds}")


def media_features(docs: DataFrame, lacing: str = "fixed") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all but n_bytes from the stored form as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, media in zip(*(c.column(b, x).to_pylist() for x in ("doc_id", "n_bytes", "media")), strict=True):
                got, samples = read_back(media)
                rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(got, samples)))
            yield c.record_batch(_ROW, *(zip(*rows, strict=True) if rows else [[]] * 8))

    return encode_column(docs, lacing).mapInArrow(c.tidied(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
