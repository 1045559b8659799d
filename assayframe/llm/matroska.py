"""Media columns: Matroska files in a binary column, and their packet tables.

``parse`` reads a file's variable-length EBML elements (known and unknown sizes,
Void and CRC-32 elements among them), its tracks, clusters, SimpleBlocks and
BlockGroups with every kind of lacing, and its cues, and returns packets with
track, timestamp and byte range.  ``audio_file`` writes the format: 8-bit PCM
samples in laced blocks.  Both work on one file at a time, so memory is bounded
by the largest file in a batch.

Defined results: a null or empty text is one packet of blanks; a null file has
no packets; a file that is cut off, at whatever byte, gives the packets that are
whole (a number, name or lacing head that is cut counts as absent, and of a block
group that is cut no packet is a keyframe); bytes that are not EBML, or break its
rules, raise ``ValueError``.  Equal texts give equal files.  Repeated rows are
stored each for itself; only the named columns are read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: element IDs, with their marker bits.
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0x00, 0x02, 0x04, 0x06

#: Of the audio that texts are stored as: samples a frame, frames a block, blocks a cluster, samples a second.
FRAME, LACED, BLOCKS, RATE = 192, 8, 32, 8000
#: Bytes of payload whose rows go on together.
FLUSH_BYTES = 8_000_000


class Packet(NamedTuple):
    track: int
    timestamp: int  # in units of the file's timestamp scale
    offset: int
    size: int
    keyframe: bool


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte offset of the cluster
    blocks: int = 0


# ---- writing -------------------------------------------------------------


def number(value: int, width: int = 0) -> bytes:
    """A variable-length number, as short as may be; the all-ones value of a width means "unknown" and is left out."""
    while not width or value >= (1 << 7 * width) - 1:
        width += 1
        if value < (1 << 7 * width) - 1:
            break
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + number(len(body)) + body


def uint(code: int, value: int) -> bytes:
    return element(code, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(code: int, value: float) -> bytes:
    import struct

    return element(code, struct.pack(">d", value))


def laced(frames: list[bytes], how: int) -> bytes:
    """A block's lacing head and frames."""
    if how == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if how == XIPH_LACING:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif how == EBML_LACING:
        head += number(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d, width = b - a, 1
            while abs(d) > (1 << 7 * width - 1) - 1:
                width += 1
            head += number(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def audio_file(payload: bytes) -> bytes:
    """A Matroska file whose one track holds the payload as 8-bit samples, 192 a frame."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ms = FRAME * 1000 // RATE
    track = element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, real(SAMPLING, float(RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    )
    info = uint(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, float(len(frames) * ms)) + element(MUXING_APP, b"assayframe") + element(WRITING_APP, b"assayframe")
    parts = [element(INFO, info), element(TRACKS, track)]
    at, points = sum(map(len, parts)), []
    per = LACED * BLOCKS
    ways = (XIPH_LACING, EBML_LACING, FIXED_LACING)
    for first in range(0, len(frames), per):
        body = [uint(TIMESTAMP, first * ms)]
        for i in range(first, min(first + per, len(frames)), LACED):
            own = frames[i : min(i + LACED, first + per)]
            even = len(own[0]) == len(own[-1])
            how = NO_LACING if len(own) == 1 else ways[i // LACED % 3] if even else EBML_LACING
            body.append(element(SIMPLE_BLOCK, b"\x81" + ((i - first) * ms).to_bytes(2, "big") + bytes([0x80 | how]) + laced(own, how)))
        points.append(element(CUE_POINT, uint(CUE_TIME, first * ms) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(points)))
    head = uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(MAX_ID_LENGTH, 4) + uint(MAX_SIZE_LENGTH, 8)
    # simple blocks are of version 2, the rest of version 1
    head += element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 2) + uint(DOC_TYPE_READ_VERSION, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(parts))


# ---- reading -------------------------------------------------------------


def read_number(data: bytes, at: int, end: int | None = None) -> tuple[int, int, int]:
    """Value without marker, width, and value with marker of the variable-length number at a place; EOFError if it is cut."""
    end = len(data) if end is None else end
    if at >= end:
        raise EOFError
    width = 9 - data[at].bit_length()
    if width > 8:
        raise ValueError(f"no variable-length number at byte {at}")
    if at + width > end:
        raise EOFError
    whole = int.from_bytes(data[at : at + width], "big")
    return whole & (1 << 7 * width) - 1, width, whole


class Element(NamedTuple):
    code: int
    start: int
    body: int
    end: int  # of what is there
    stop: int  # of what its size announces

    @property
    def whole(self) -> bool:
        return self.end == self.stop


def elements(data: bytes, at: int, end: int) -> Iterator[Element]:
    """The elements in a range, the last of which may be cut.

    One of unknown size reaches to the end of the range, or to the next cluster or
    other top element if it is a cluster.
    """
    while at < end:
        try:
            _, n, code = read_number(data, at, end)
            size, m, _ = read_number(data, at + n, end)
        except EOFError:
            return
        body = at + n + m
        stop = body + size
        if size == (1 << 7 * m) - 1:
            stop = end if code != CLUSTER else _cluster_end(data, body, end)
        yield Element(code, at, body, min(stop, end), stop)
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    top = {CLUSTER, CUES, INFO, TRACKS, EBML, SEGMENT}
    while at < end:
        try:
            _, n, code = read_number(data, at, end)
            if code in top:
                return at
            size, m, _ = read_number(data, at + n, end)
        except EOFError:
            break
        at += n + m + size
    return end


def frame_sizes(data: bytes, at: int, end: int, stop: int, how: int) -> tuple[int, list[int]]:
    """Where a block's frames begin, and their sizes; the block ends at ``stop``, what is there of it at ``end``."""
    if how == NO_LACING:
        return at, [stop - at]

    def byte(k: int) -> int:
        if k >= end:
            raise EOFError
        return data[k]

    count, at = byte(at) + 1, at + 1
    if how == FIXED_LACING:
        return at, [(stop - at) // count] * count
    sizes: list[int] = []
    if how == XIPH_LACING:
        for _ in range(count - 1):
            n = 0
            while byte(at) == 255:
                n, at = n + 255, at + 1
            sizes.append(n + byte(at))
            at += 1
    elif count > 1:
        n, width, _ = read_number(data, at, end)
        sizes, at = [n], at + width
        for _ in range(count - 2):
            d, width, _ = read_number(data, at, end)
            sizes.append(sizes[-1] + d - ((1 << 7 * width - 1) - 1))
            at += width
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing beyond its block at byte {at}")
    return at, sizes


def parse(data: bytes) -> Media:
    """Tracks, packets in file order, and cues."""
    out, magic = Media(), EBML.to_bytes(4, "big")
    if data[:4] != magic[: len(data)]:
        raise ValueError("not an EBML file")
    for top in elements(data, 0, len(data)):
        if top.code != SEGMENT:
            continue
        for e in elements(data, top.body, top.end):
            if e.code == INFO:
                told = _values(data, e)
                out.scale = _whole(told.get(TIMESTAMP_SCALE)) or out.scale
                out.duration = _real(told.get(DURATION, b""))
            elif e.code == TRACKS:
                for entry in elements(data, e.body, e.end):
                    if entry.code == TRACK_ENTRY:
                        track = _track(data, entry)
                        out.tracks[track.get("number", 0)] = track
            elif e.code == CLUSTER:
                out.clusters.append(e.start)
                _cluster(data, e, out)
            elif e.code == CUES:
                for point in elements(data, e.body, e.end):
                    if point.code == CUE_POINT and point.whole:
                        out.cues += _cue(data, point, top.body)
    return out


def _values(data: bytes, parent: Element) -> dict[int, bytes]:
    """The bytes of an element's whole children, by code; of repeated ones the last."""
    return {e.code: data[e.body : e.end] for e in elements(data, parent.body, parent.end) if e.whole}


def _whole(raw: bytes | None) -> int:
    return int.from_bytes(raw or b"", "big")


def _real(raw: bytes) -> float:
    import struct

    return struct.unpack({4: ">f", 8: ">d"}[len(raw)], raw)[0] if len(raw) in (4, 8) else 0.0


def _track(data: bytes, entry: Element) -> dict:
    names = {TRACK_NUMBER: "number", TRACK_UID: "uid", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "frame_ns"}
    out: dict = {}
    for e in elements(data, entry.body, entry.end):
        raw = data[e.body : e.end]
        if e.code == AUDIO:
            out |= _track(data, e)
        elif not e.whole:
            continue
        elif e.code == CODEC_ID:
            out["codec"] = raw.rstrip(b"\0").decode("utf-8", "replace")
        elif e.code == SAMPLING:
            out["rate"] = _real(raw)
        elif e.code in names:
            out[names[e.code]] = _whole(raw)
    return out


def _cue(data: bytes, point: Element, base: int) -> list[tuple[int, int, int]]:
    time = _whole(_values(data, point).get(CUE_TIME))
    places = [_values(data, e) for e in elements(data, point.body, point.end) if e.code == CUE_POSITIONS]
    return [(time, _whole(p.get(CUE_TRACK)), base + _whole(p.get(CUE_CLUSTER))) for p in places]


def _cluster(data: bytes, cluster: Element, out: Media) -> None:
    time = 0
    for e in elements(data, cluster.body, cluster.end):
        if e.code == TIMESTAMP and e.whole:
            time = _whole(data[e.body : e.end])
        elif e.code == SIMPLE_BLOCK:
            _block(data, e, time, 0, None, out)
        elif e.code == BLOCK_GROUP:
            told = _values(data, e)
            # a block without a reference stands for itself; of a cut group it isn't known
            key = e.whole and REFERENCE_BLOCK not in told
            for inner in elements(data, e.body, e.end):
                if inner.code == BLOCK:
                    _block(data, inner, time, _whole(told.get(BLOCK_DURATION)), key, out)


def _block(data: bytes, block: Element, time: int, duration: int, key: bool | None, out: Media) -> None:
    """Adds a block's whole packets; ``key`` is None where the block's own flag tells of keyframes."""
    try:
        track, width, _ = read_number(data, block.body, block.end)
        head = block.body + width
        if head + 3 > block.end:
            return
        time += int.from_bytes(data[head : head + 2], "big", signed=True)
        flags = data[head + 2]
        start, sizes = frame_sizes(data, head + 3, block.end, block.stop, flags & 0x06)
    except EOFError:
        return
    # Frames of one block share its time; a known duration of frames, or a sample rate, sets those after the first.
    about = out.tracks.get(track, {})
    wide = max(1, about.get("bits", 0) // 8) * max(1, about.get("channels", 1))
    done = 0
    for i, n in enumerate(sizes):
        if start + n > block.end:
            return
        if duration:
            own = time + i * duration // len(sizes)
        elif about.get("frame_ns"):
            own = time + i * about["frame_ns"] // out.scale
        elif about.get("rate") and about.get("bits"):
            own = time + int(done // wide * 1_000_000_000 // int(about["rate"]) // out.scale)
        else:
            own = time
        out.packets.append(Packet(track, own, start, n, bool(flags & 0x80) if key is None else key))
        start, done = start + n, done + n
    out.blocks += 1


# ---- on tables -----------------------------------------------------------


def payload_of(text: str | bytes | None) -> bytes:
    """A text's UTF-8 bytes with blanks up to a positive multiple of a frame."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw + b" " * ((-len(raw)) % FRAME if raw else FRAME)


def _in_pieces(batch: pa.RecordBatch, size_of: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of rows whose column ``size_of`` comes to about FLUSH_BYTES."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(size_of)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        upto = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + FLUSH_BYTES, "right"))
        stop = max(start + 1, upto)
        yield batch.slice(start, stop - start)
        start = stop


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_bytes (of the text, without padding) and media, a row for each row of ``docs``."""

    def run(batches):
        for whole in batches:
            for batch in _in_pieces(whole, 1):
                raw = [x or b"" for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([audio_file(payload_of(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Returns id, packet (its number), track, timestamp_ns, offset, size, keyframe: a row for each packet."""

    def run(batches):
        for whole in batches:
            for batch in _in_pieces(whole, 1):
                rows = []
                for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if data is not None:
                        found = parse(data)
                        rows += [(key, i, p.track, p.timestamp * found.scale, p.offset, p.size, p.keyframe) for i, p in enumerate(found.packets)]
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "packet", "track", "timestamp_ns", "offset", "size", "keyframe"])

    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, "id long, packet int, track int, timestamp_ns long, offset long, size long, keyframe boolean").withColumnRenamed("id", id_col)


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Parses stored files and returns id, n_bytes, the payload's size, SHA-256 and tail checksum, the file's own, and a feature string."""

    def run(batches):
        import numpy as np

        for whole in batches:
            for batch in _in_pieces(whole, 2):
                rows = []
                for data in batch.column(2).to_pylist():
                    found = parse(data)
                    payload = b"".join([data[p.offset : p.offset + p.size] for p in found.packets])
                    level = np.frombuffer(payload, np.uint8).astype(np.int64).sum() * 1000 // max(1, len(payload))
                    about = found.tracks[1]
                    said = f"{about['codec']};{about['rate']:.0f}Hz;packets={len(found.packets)};blocks={found.blocks};clusters={len(found.clusters)};cues={len(found.cues)};ms={found.duration:.0f};level={level}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), said))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names)

    rows = media.select(F.col(id_col).cast("long").alias("id"), "n_bytes", "media")
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
