"""Matroska media columns: texts as 8-bit PCM in EBML, and packet tables read back from the stored bytes.

The writer makes a header, segment information, one audio track, tags, clusters of laced blocks and cues. The parser
knows variable-length element ids and sizes (unknown sizes too), the three lacings and block groups, and gives each
packet's track, time, byte range and cluster.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, table, text_udf, tune

# Element ids of the Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TAGS, TAG, TARGETS, SIMPLE_TAG, TAG_NAME, TAG_STRING = 0x1254C367, 0x7373, 0x63C0, 0x67C8, 0x45A3, 0x4487
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, TAGS, TAG, SIMPLE_TAG, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, TAGS, CLUSTER, CUES}

#: Samples a second; with 64 samples to a unit a unit lasts 8 ms.
RATE, UNIT = 8000, 64
#: Bytes of a frame, frames of a block and blocks of a cluster.
FRAME, FRAMES, BLOCKS = 512, 8, 15
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


# --- writing


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if x < (1 << 7 * w) - 1)
    return (x | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return _id(kind) + vint(len(data)) + data


def _uint(kind: int, x: int) -> bytes:
    return element(kind, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The body of a block behind its flags."""
    if lacing == NO_LACING:
        return frames[0]
    out = [bytes([len(frames) - 1])]
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        out += [b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1]]
    elif lacing == EBML_LACING:
        out.append(vint(sizes[0]))
        for before, s in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(s - before) < (1 << (7 * w - 1)))
            out.append(vint(s - before + (1 << (7 * width - 1)) - 1, width))
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return b"".join(out + frames)


def block(track: int, relative: int, frames: list[bytes], lacing: int | None = None) -> bytes:
    if lacing is None:
        lacing = NO_LACING if len(frames) == 1 else FIXED if len({len(f) for f in frames}) == 1 else EBML_LACING
    return vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1) + laced(frames, lacing)


def mux(data: bytes) -> bytes:
    """data as a Matroska file: padded with zero bytes to a positive multiple of UNIT, as 8-bit samples; its length is a tag."""
    payload = data + bytes(-len(data) % UNIT if data else UNIT)
    header = element(EBML, _uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(MAX_ID_LENGTH, 4), _uint(MAX_SIZE_LENGTH, 8), element(DOC_TYPE, b"matroska"), _uint(DOC_TYPE_VERSION, 4), _uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000), element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)), element(MUXING_APP, b"spanloom"), element(WRITING_APP, b"spanloom"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))), _uint(CHANNELS, 1), _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(FLAG_LACING, 1), element(CODEC_ID, b"A_PCM/INT/LIT"), audio))
    tags = element(TAGS, element(TAG, element(TARGETS), element(SIMPLE_TAG, element(TAG_NAME, b"UNPADDED_BYTES"), element(TAG_STRING, str(len(data)).encode()))))
    parts, cues, at = [info, tracks, tags], [], len(info) + len(tracks) + len(tags)
    per_block, per_cluster = FRAME * FRAMES, FRAME * FRAMES * BLOCKS
    for a in range(0, len(payload), per_cluster):
        begin = a * 1000 // RATE
        body = [_uint(TIMESTAMP, begin)]
        for b in range(a, min(a + per_cluster, len(payload)), per_block):
            last = min(b + per_block, len(payload))
            body.append(element(SIMPLE_BLOCK, block(1, b * 1000 // RATE - begin, [payload[c : min(c + FRAME, last)] for c in range(b, last, FRAME)])))
        cluster = element(CLUSTER, *body)
        cues.append(element(CUE_POINT, _uint(CUE_TIME, begin), element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1), _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return header + element(SEGMENT, *parts, element(CUES, *cues))


# --- reading


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """Value and next place; -1 for a size that is all ones."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length integer at {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    if keep_marker:
        return raw, at + width
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """Kind, first byte and end of the elements there. An unknown size ends with the parent, a cluster's before the next top-level element."""
    while at < end:
        kind, body = read_vint(data, at, keep_marker=True)
        if inside == CLUSTER and kind in TOP_LEVEL:
            return
        size, body = read_vint(data, body)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError(f"element {kind:x} at {at} runs past its parent")
        if size < 0 and kind == CLUSTER:
            stop = body
            for _, _, stop in elements(data, body, end, CLUSTER):
                pass
        yield kind, body, stop
        at = stop


@dataclass
class Packet:
    track: int
    timestamp: int
    begin: int
    end: int
    cluster: int
    keyframe: bool
    lacing: int


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: list[dict] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def frame_bounds(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """The byte ranges of a block's frames; at is behind the flags."""
    if lacing == NO_LACING:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes = []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError("fixed lacing doesn't divide the block")
        sizes = [(end - at) // count] * (count - 1)
    elif lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif count > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(count - 2):
            width = 9 - data[at].bit_length()
            raw = _number(data, at, at + width) & ((1 << 7 * width) - 1)
            sizes.append(sizes[-1] + raw - ((1 << (7 * width - 1)) - 1))
            at += width
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > end or any(s < 0 for s in sizes):
        raise ValueError("lacing runs past its block")
    return [*out, (at, end)]


def parse(data: bytes) -> Media:
    """The packet table of a Matroska file, with tracks, cues and tags. Raises ValueError if it is broken."""
    out = Media()
    for kind, a, b in elements(data, 0, len(data)):
        if kind == SEGMENT:
            for part, c, d in elements(data, a, b):
                if part == CLUSTER:
                    out.clusters.append(c)
                    _cluster(data, c, d, out)
                elif part == INFO:
                    out.scale = next((_number(data, e, f) for k, e, f in elements(data, c, d) if k == TIMESTAMP_SCALE), out.scale)
                elif part in (TRACKS, CUES, TAGS):
                    for _, e, f in elements(data, c, d):
                        _described(data, part, e, f, a, out)
    return out


def _described(data: bytes, part: int, a: int, b: int, segment: int, out: Media) -> None:
    if part == TRACKS:
        track = {}
        for kind, c, d in elements(data, a, b):
            if kind in (TRACK_NUMBER, TRACK_TYPE):
                track["number" if kind == TRACK_NUMBER else "type"] = _number(data, c, d)
            elif kind == CODEC_ID:
                track["codec"] = data[c:d].decode()
            elif kind == AUDIO:
                for k, e, f in elements(data, c, d):
                    if k == SAMPLING_FREQUENCY:
                        track["rate"] = struct.unpack(">d" if f - e == 8 else ">f", data[e:f])[0]
                    elif k in (CHANNELS, BIT_DEPTH):
                        track["channels" if k == CHANNELS else "bits"] = _number(data, e, f)
        out.tracks.append(track)
    elif part == CUES:
        time, found = 0, []
        for kind, c, d in elements(data, a, b):
            if kind == CUE_TIME:
                time = _number(data, c, d)
            elif kind == CUE_TRACK_POSITIONS:
                at = {k: _number(data, e, f) for k, e, f in elements(data, c, d)}
                found.append((at.get(CUE_TRACK, 0), segment + at.get(CUE_CLUSTER_POSITION, 0)))
        out.cues += [(time, track, at) for track, at in found]
    else:
        for kind, c, d in elements(data, a, b):
            if kind == SIMPLE_TAG:
                tag = {k: data[e:f].decode("utf-8", "replace") for k, e, f in elements(data, c, d)}
                out.tags[tag.get(TAG_NAME, "")] = tag.get(TAG_STRING, "")


def _cluster(data: bytes, a: int, b: int, out: Media) -> None:
    base = 0
    for kind, c, d in elements(data, a, b):
        if kind == TIMESTAMP:
            base = _number(data, c, d)
        elif kind == SIMPLE_BLOCK:
            _block(data, c, d, base, out, None)
        elif kind == BLOCK_GROUP:
            parts = {k: (e, f) for k, e, f in elements(data, c, d)}
            if BLOCK in parts:
                _block(data, *parts[BLOCK], base, out, 0xFB not in parts)


def _block(data: bytes, a: int, b: int, base: int, out: Media, keyframe: bool | None) -> None:
    track, at = read_vint(data, a)
    relative, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    for begin, end in frame_bounds(data, at + 3, b, lacing):
        out.packets.append(Packet(track, base + relative, begin, end, len(out.clusters) - 1, bool(flags & 0x80) if keyframe is None else keyframe, lacing))


def payload_of(data: bytes, media: Media) -> bytes:
    return b"".join([data[p.begin : p.end] for p in media.packets])


def features(data: bytes) -> dict:
    """What op8 returns of a stored file, all from its bytes."""
    media = parse(data)
    payload = payload_of(data, media)
    samples = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(samples, minlength=256)
    total = int((counts * np.arange(256)).sum())
    swing = sum(int(np.abs(np.diff(samples[a : a + (1 << 20) + 1].astype(np.int16))).sum(dtype=np.int64)) for a in range(0, len(samples), 1 << 20))
    seekable = len(media.cues) == len(media.clusters) and all(_points_at(data, cue[2], begin) for cue, begin in zip(media.cues, media.clusters, strict=False))
    last = media.packets[-1] if media.packets else None
    text = f"packets={len(media.packets)};clusters={len(media.clusters)};last_ms={last.timestamp if last else 0};laced={sum(p.lacing != NO_LACING for p in media.packets)};values={int((counts > 0).sum())};sum={total};swing={swing};seekable={int(seekable)}"
    return {
        "n_bytes": int(media.tags["UNPADDED_BYTES"]), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": text,
    }


def _points_at(data: bytes, at: int, begin: int) -> bool:
    kind, body = read_vint(data, at, keep_marker=True)
    return kind == CLUSTER and read_vint(data, body)[1] == begin


_ROW = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_ROW_DDL = "struct<n_bytes: long, payload_bytes: long, payload_sha256: string, tail_crc32: long, media_bytes: long, media_sha256: string, feature: string>"


def muxer():
    """Column function: text to binary, a Matroska file. A null text is empty."""
    return text_udf(lambda: lambda texts: [mux((t or "").encode()) for t in texts], "binary", pa.binary())


def featurer():
    """Column function: Matroska file to struct of its features."""
    return text_udf(lambda: lambda files: [None if f is None else features(f) for f in files], _ROW_DDL, _ROW)


def packet_table(media: DataFrame, name: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each packet of each file: name, packet, track, timestamp_ms, begin_byte, end_byte, cluster, keyframe, lacing."""
    kind = pa.list_(pa.struct([("packet", pa.int64()), ("track", pa.int64()), ("timestamp_ms", pa.int64()), ("begin_byte", pa.int64()), ("end_byte", pa.int64()), ("cluster", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int64())]))

    def rows(data: bytes | None) -> list | None:
        if data is None:
            return None
        found = parse(data)
        return [{"packet": i, "track": p.track, "timestamp_ms": p.timestamp * found.scale // 1_000_000, "begin_byte": p.begin, "end_byte": p.end, "cluster": p.cluster, "keyframe": p.keyframe, "lacing": p.lacing} for i, p in enumerate(found.packets)]

    udf = text_udf(lambda: lambda files: [rows(f) for f in files], "array<struct<packet: long, track: long, timestamp_ms: long, begin_byte: long, end_byte: long, cluster: long, keyframe: boolean, lacing: long>>", kind)
    return media.select(F.col(name).alias("name"), F.explode(udf(F.col(column))).alias("p")).select(F.col("name").alias(name), "p.*")


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and media, the Matroska file of the text, for each row of docs."""
    tune(docs.sparkSession)
    return docs.select("doc_id", muxer()(F.col("text")).alias("media"))


def stored_features(media: DataFrame) -> DataFrame:
    """doc_id and the features of each file of media (doc_id, media); null for a null file."""
    return media.select("doc_id", featurer()(F.col("media")).alias("f")).select("doc_id", "f.*")


def media_features(docs: DataFrame) -> DataFrame:
    """Writes the media column of docs to the shared folder and gives doc_id and the features of each file read back; equal texts have equal values.

    Null and empty texts are a unit of zero bytes; repeated rows each have their row; a null doc_id stays null; an empty
    table gives no rows. Only doc_id and text are read, so other columns may have any name.
    """
    return stored_features(materialize(media_column(docs), "media"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
