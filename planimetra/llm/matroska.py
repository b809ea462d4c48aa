"""Media columns: Matroska files and their packet tables.

`encode` stores bytes as an audio track of 8-bit samples: an EBML header, a segment with
info, one track, cues and clusters of blocks whose frames are laced. `packets` parses such a
column: it walks the variable-length elements, reads the time scale, the tracks and the cues,
opens the clusters' blocks, undoes all four lacings (none, Xiph, fixed, EBML) and gives a row
for each frame with its track, codec, timestamp, byte range and whether a cue points at its
cluster. Only packet rows and digests leave the tasks; files stay in the column that holds them.

Timestamps are nanoseconds: cluster and block give the first frame of a block, the track's
default duration or the block's own gives those laced behind it; without either they share
the first one's.

Defined cases: a null text counts as empty and gives one padded unit; repeated rows and equal
bytes give equal files, as nothing in them depends on time or place; a very long text is one
file, made and read in one task; a null file, an empty one and other bytes have no packets;
elements of unknown ids are passed over; an unknown size ends at the next element that can't
be inside, or with the parent; of a segment, cluster or group that is cut short the whole
elements count, of other elements nothing; a block that is empty, cut short or whose laced
sizes don't add up has no packets; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads are padded with spaces to a positive multiple of UNIT bytes.
UNIT = 192
#: Samples in a second; a millisecond, the unit of timestamps, has RATE // 1000 of them.
RATE = 8000
#: Bytes in a frame, frames in a block, blocks in a cluster.
FRAME, LACED, BLOCKS = 960, 8, 16

# Element ids of Matroska.
EBML, SEGMENT, INFO, TRACKS, CUES, CLUSTER = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1C53BB6B, 0x1F43B675
EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: Nanoseconds in a unit of time where a file gives none.
SCALE = 1_000_000
#: What can't be inside a segment, and what can't be inside a cluster: these end an unknown size.
_TOP = frozenset((EBML, SEGMENT))
_ENDS = {SEGMENT: _TOP, CLUSTER: _TOP | {INFO, TRACKS, CUES, CLUSTER, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}}
#: Of these, a part is worth reading.
_PARTIAL = (SEGMENT, CLUSTER, BLOCK_GROUP)


def _size(n: int, width: int = 0) -> bytes:
    """A size as a variable-length number, of `width` bytes if given."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(id: int, body: bytes, width: int = 0) -> bytes:
    return id.to_bytes((id.bit_length() + 7) // 8, "big") + _size(len(body), width) + body


def _number(id: int, n: int, width: int = 0) -> bytes:
    return _element(id, n.to_bytes(width or max(1, (n.bit_length() + 7) // 8), "big"))


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


def _block(frames: list[memoryview | bytes], offset_ms: int, lacing: int) -> bytes:
    """A simple block of track 1, all frames of which are key frames."""
    head = b"\x81" + offset_ms.to_bytes(2, "big", signed=True)
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        lacing = NO_LACING
    laced = b""
    if lacing != NO_LACING:
        laced = bytes([len(frames) - 1])
    if lacing == XIPH:
        laced += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        laced += _size(sizes[0])
        for was, n in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(n - was) < 1 << 7 * w - 1)
            laced += _size(n - was + (1 << 7 * width - 1) - 1, width)
    return _element(SIMPLE_BLOCK, head + bytes([0x80 | lacing << 1]) + laced + b"".join(frames))


def encode(payload: bytes) -> bytes:
    """A Matroska file whose only track holds the payload as unsigned 8-bit samples."""
    view, frames = memoryview(payload), range(0, len(payload), FRAME)
    info = _element(INFO, _number(TIMESTAMP_SCALE, SCALE) + _element(MUXING_APP, b"planimetra") + _element(WRITING_APP, b"planimetra"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(FLAG_LACING, 1) + _number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    clusters, times = [], []
    for c in range(0, len(frames), LACED * BLOCKS):
        start_ms = frames[c] * 1000 // RATE
        blocks = []
        for b in range(c, min(len(frames), c + LACED * BLOCKS), LACED):
            own = [view[at : at + FRAME] for at in frames[b : b + LACED]]
            # a last, shorter frame can't be laced as one of a fixed size
            kind = (XIPH, FIXED, EBML_LACING)[b // LACED % 3]
            kind = EBML_LACING if kind == FIXED and len(own[-1]) != FRAME else kind
            blocks.append(_block(own, frames[b] * 1000 // RATE - start_ms, kind))
        times.append(start_ms)
        clusters.append(_element(CLUSTER, _number(CLUSTER_TIMESTAMP, start_ms) + b"".join(blocks), 8))
    # cues come before the clusters; their numbers have fixed widths, so their own size is known
    point = lambda t, at: _element(CUE_POINT, _number(CUE_TIME, t, 8) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, at, 8)))
    before = len(info) + len(tracks)
    before += len(_element(CUES, b"".join(point(0, 0) for _ in clusters)))
    points = []
    for t, cluster in zip(times, clusters, strict=True):
        points.append(point(t, before))
        before += len(cluster)
    head = _number(EBML_VERSION, 1) + _number(EBML_READ_VERSION, 1) + _number(MAX_ID_LENGTH, 4) + _number(MAX_SIZE_LENGTH, 8) + _element(DOC_TYPE, b"matroska") + _number(DOC_TYPE_VERSION, 4) + _number(DOC_TYPE_READ_VERSION, 2)
    return _element(EBML, head) + _element(SEGMENT, b"".join((info, tracks, _element(CUES, b"".join(points)), *clusters)), 8)


def _variable(data: memoryview, at: int, keep_mark: bool = False) -> tuple[int, int]:
    """The variable-length number at `at` and its width; -1 for an unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise IndexError
    n = int.from_bytes(data[at : at + width], "big")
    if keep_mark:
        return n, width
    n ^= 1 << 7 * width
    return (-1 if n == (1 << 7 * width) - 1 else n), width


def _head(data: memoryview, at: int) -> tuple[int, int, int]:
    """id, start of the body and size (-1: unknown) of the element at `at`."""
    id, w = _variable(data, at, keep_mark=True)
    size, v = _variable(data, at + w)
    return id, at + w + v, size


def _end(data: memoryview, id: int, body: int, stop: int) -> int:
    """Where an element of unknown size ends: at the first that can't be inside it, else at stop."""
    at, ends = body, _ENDS.get(id, frozenset())
    while at < stop and ends:
        try:
            inner, start, size = _head(data, at)
        except IndexError:
            return stop
        if inner in ends:
            return at
        at = _end(data, inner, start, stop) if size < 0 else start + size
    return stop


def elements(data: memoryview, start: int, stop: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, start of the body, end) of each element from start to stop."""
    while start < stop:
        try:
            id, body, size = _head(data, start)
        except IndexError:
            return
        end = _end(data, id, body, stop) if size < 0 else body + size
        if end > stop and id not in _PARTIAL or body > stop:
            return
        yield id, start, body, min(end, stop)
        start = end


def _numbers(data: memoryview, start: int, stop: int) -> dict[int, int]:
    """The elements from start to stop of at most eight bytes as unsigned numbers, the first of each id."""
    found: dict[int, int] = {}
    for id, _, a, b in elements(data, start, stop):
        if b - a <= 8:
            found.setdefault(id, int.from_bytes(data[a:b], "big"))
    return found


def _frames(data: memoryview, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]] | None:
    """track, offset in time, flags and the (start, length) of each frame of a block's body; None if it isn't whole."""
    try:
        track, w = _variable(data[:end], at)
        if at + w + 3 > end:
            return None
        offset, flags = int.from_bytes(data[at + w : at + w + 2], "big", signed=True), data[at + w + 2]
        at += w + 3
        lacing = flags >> 1 & 3
        if lacing == NO_LACING:
            return track, offset, flags, [(at, end - at)]
        body, count, sizes = data[:end], data[:end][at] + 1, []
        at += 1
        if lacing == XIPH:
            for _ in range(count - 1):
                n = 0
                while body[at] == 255:
                    n, at = n + 255, at + 1
                sizes.append(n + body[at])
                at += 1
        elif lacing == EBML_LACING:
            for k in range(count - 1):
                n, w = _variable(body, at)
                sizes.append(n if k == 0 else sizes[-1] + n - (1 << 7 * w - 1) + 1)
                at += w
    except IndexError:
        return None
    left = end - at - sum(sizes)
    if lacing == FIXED:
        if left % count:
            return None
        sizes = [left // count] * count
    else:
        sizes.append(left)
    if min(sizes) < 0:
        return None
    starts = [at]
    for n in sizes[:-1]:
        starts.append(starts[-1] + n)
    return track, offset, flags, list(zip(starts, sizes, strict=True))


class Packet(NamedTuple):
    track: int
    codec: str | None
    timestamp_ns: int
    start: int
    length: int
    key_frame: bool
    lacing: int
    cued: bool


def parse(file: bytes | None) -> list[Packet]:
    """The packets of a file, in file order."""
    data, out = memoryview(file or b""), []
    for id, _, start, stop in elements(data, 0, len(data)):
        if id == SEGMENT:
            out += _segment(data, start, stop)
    return out


def _segment(data: memoryview, start: int, stop: int) -> Iterator[Packet]:
    scale, tracks, cued, clusters = SCALE, {}, set(), []
    for id, at, a, b in elements(data, start, stop):
        if id == INFO:
            scale = _numbers(data, a, b).get(TIMESTAMP_SCALE, SCALE)
        elif id == TRACKS:
            for kind, _, c, d in elements(data, a, b):
                if kind == TRACK_ENTRY:
                    entry = _numbers(data, c, d)
                    codec = next((bytes(data[e:f]).decode("latin-1") for k, _, e, f in elements(data, c, d) if k == CODEC_ID), None)
                    tracks[entry.get(TRACK_NUMBER)] = codec, entry.get(DEFAULT_DURATION)
        elif id == CUES:
            for _, _, c, d in elements(data, a, b):
                for kind, _, e, f in elements(data, c, d):
                    if kind == CUE_TRACK_POSITIONS:
                        cue = _numbers(data, e, f)
                        cued.add((cue.get(CUE_TRACK), cue.get(CUE_CLUSTER_POSITION)))
        elif id == CLUSTER:
            clusters.append((at - start, a, b))
    for place, a, b in clusters:
        base = _numbers(data, a, b).get(CLUSTER_TIMESTAMP, 0)
        for kind, _, c, d in elements(data, a, b):
            duration, key, body = None, True, (c, d) if kind == SIMPLE_BLOCK else None
            if kind == BLOCK_GROUP:
                group = _numbers(data, c, d)
                duration, key = group.get(BLOCK_DURATION), REFERENCE_BLOCK not in group
                body = next(((e, f) for k, _, e, f in elements(data, c, d) if k == BLOCK), None)
            block = body and _frames(data, *body)
            if not block:
                continue
            track, offset, flags, frames = block
            codec, each = tracks.get(track, (None, None))
            step = each if each else duration * scale / len(frames) if duration else 0
            key = key if kind == BLOCK_GROUP else bool(flags & 0x80)
            for k, (at, n) in enumerate(frames):
                yield Packet(track, codec, (base + offset) * scale + int(k * step), at, n, key, flags >> 1 & 3, (track, place) in cued)


def media_column(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """carry, n_bytes, media: each text, padded, as a Matroska file."""
    kind = docs.schema[carry].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few rows at a time, as texts may be long
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode(padded(x)) for x in texts], pa.binary())], [carry, "n_bytes", "media"])

    return docs.select(carry, "text").mapInArrow(write, f"`{carry}` {kind}, n_bytes long, media binary")


def packets(media: DataFrame, carry: str = "doc_id") -> DataFrame:
    """A row for each packet of the column media: carry, packet, track, codec, timestamp_ns,
    start, length, key_frame, lacing, cued, crc32. A number beyond 64 bits is null."""
    kind = media.schema[carry].dataType.simpleString()
    names = ["packet", *Packet._fields, "crc32"]
    types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file = batch.column(1)[k].as_py()
                rows = [(i, *p, zlib.crc32(memoryview(file)[p.start : p.start + p.length])) for i, p in enumerate(parse(file))]
                # a foreign file may name times and tracks that no long holds; such a number is null
                rows = [tuple(None if type(x) is int and abs(x) >> 63 else x for x in r) for r in rows]
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                ids = batch.column(0).take(pa.array([k] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [carry, *names])

    return media.select(carry, "media").mapInArrow(read, f"`{carry}` {kind}, packet long, track long, codec string, timestamp_ns long, start long, length long, key_frame boolean, lacing long, cued boolean, crc32 long")


def digests(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature; everything about the payload comes from the packets
    read back from the file. Writing and reading are two steps of the same task."""
    media = media_column(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(2):
                data = memoryview(file.as_py())
                found = sorted(parse(data), key=lambda p: p.start)
                sha, tail, size = hashlib.sha256(), b"", 0
                for p in found:
                    frame = data[p.start : p.start + p.length]
                    sha.update(frame)
                    size += len(frame)
                    tail = (tail + bytes(frame[-16:]))[-16:]
                lacings = "/".join(str(sum(p.lacing == k for p in found)) for k in range(4))
                span = found[-1].timestamp_ns - found[0].timestamp_ns if found else 0
                feature = f"packets={len(found)};lacings={lacings};cued={sum(p.cued for p in found)};ns={span};tracks={len({p.track for p in found})}"
                rows.append((size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", *names])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(read, schema)
