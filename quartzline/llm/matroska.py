"""Media columns: Matroska files in binary columns, written from texts and parsed into packet tables.

A file is a tree of EBML elements: an id and a size, both variable-length integers, then data or more elements. Clusters hold
blocks of one or several laced frames; cues point to clusters. The parser goes down into the elements it knows, each within the bounds of
its parent, and skips the rest by size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.llm.arrow import map_rows

# Fixed values of the format: element ids.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, TYPE, CODEC, LACING, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EVERY, BLOCK_LASTS, REFERENCE, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x23E383, 0x9B, 0xFB, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
#: Elements whose size may be unknown, and those that end them.
UNSIZED = {SEGMENT: frozenset({EBML, SEGMENT}), CLUSTER: frozenset({EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS})}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: 8-bit samples at 8 kHz, frames of 576 samples (72 ms), up to 8 frames a block and 48 blocks a cluster.
FRAME, FRAME_MS, PER_BLOCK, PER_CLUSTER, SAMPLE_RATE = 576, 72, 8, 48, 8000
#: Bytes at the end of the payload that the checksum covers.
TAIL = 32


def vint(value: int) -> bytes:
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


HEADER = element(EBML, number(VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOCTYPE, b"matroska") + number(DOCTYPE_VERSION, 4) + number(DOCTYPE_READ, 2))
ABOUT = element(INFO, number(SCALE, 1_000_000) + element(MUXER, b"quartzline") + element(WRITER, b"quartzline"))
ONE_TRACK = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(LACING, 1) + number(EVERY, FRAME_MS * 1_000_000) + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))))


def write(payload: bytes) -> bytes:
    """A file of one 8-bit PCM track that holds the payload, whose length is a multiple of FRAME."""
    frames = len(payload) // FRAME
    body, cues = [ABOUT, ONE_TRACK], []
    at = len(ABOUT) + len(ONE_TRACK)
    for first in range(0, frames, PER_BLOCK * PER_CLUSTER):
        blocks = [number(TIMESTAMP, first * FRAME_MS)]
        for f in range(first, min(frames, first + PER_BLOCK * PER_CLUSTER), PER_BLOCK):
            n = min(PER_BLOCK, frames - f)
            head = vint(1) + struct.pack(">hB", (f - first) * FRAME_MS, 0x80 | (FIXED << 1 if n > 1 else 0)) + (bytes([n - 1]) if n > 1 else b"")
            blocks.append(element(SIMPLE_BLOCK, head + payload[f * FRAME : (f + n) * FRAME]))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * FRAME_MS) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    return HEADER + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


@dataclass
class Media:
    """What a file holds: ns a tick, tracks (number, type, codec, ns a frame or None), packets and cues, see packets()."""

    scale: int = 1_000_000
    tracks: list[tuple[int, int, str, int | None]] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def read_vint(data: bytes, at: int, end: int, keep_mark: bool = False) -> tuple[int, int]:
    """The value and the position behind it; -1 stands for an unknown size."""
    n = 9 - data[at].bit_length() if at < end else 9
    if n > 8 or at + n > end:
        raise ValueError("broken variable-length integer")
    raw = int.from_bytes(data[at : at + n], "big")
    if keep_mark:
        return raw, at + n
    value = raw & (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def children(data: bytes, at: int, end: int, stops: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """id, start, start of data and end of data of each element between at and end, up to the first of stops."""
    while at < end:
        start = at
        ident, at = read_vint(data, at, end, keep_mark=True)
        if ident in stops:
            return
        size, at = read_vint(data, at, end)
        stop = at + size if size >= 0 else unsized_end(data, ident, at, end)
        if stop > end:
            raise ValueError("an element ends beyond its parent")
        yield ident, start, at, stop
        at = stop


def unsized_end(data: bytes, ident: int, at: int, end: int) -> int:
    """Where an element of unknown size ends: at the first element that can't stand in it, or with its parent."""
    if ident not in UNSIZED:
        raise ValueError("an element that needs a size has none")
    for _, _, _, at in children(data, at, end, UNSIZED[ident]):
        pass
    return at


def numbers(data: bytes, at: int, end: int) -> dict[int, bytes]:
    """The last value of each element between at and end, by id."""
    return {ident: data[body:stop] for ident, _, body, stop in children(data, at, end)}


def whole(raw: bytes | None, default=None):
    return default if raw is None else int.from_bytes(raw, "big")


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if kind == NO_LACING:
        return [end - at], at
    if at >= end:
        raise ValueError("a lace has no frame count")
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("frames of a fixed lace differ in size")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(n - 1):
            begin = at
            value, at = read_vint(data, at, end)
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - begin) - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or any(s < 0 for s in sizes):
        raise ValueError("a lace is longer than its block")
    return [*sizes, last], at


def parse(data: bytes) -> Media:
    """All tracks, packets and cues of a file, in file order; elements of other kinds are skipped by size."""
    media, found = Media(), False
    for ident, _, at, end in children(data, 0, len(data)):
        if ident == SEGMENT:
            found = True
            read_segment(data, at, end, media)
    if not found:
        raise ValueError("no segment")
    return media


def read_segment(data: bytes, base: int, end: int, media: Media) -> None:
    every: dict[int, int | None] = {}
    for ident, _, at, stop in children(data, base, end):
        if ident == INFO:
            media.scale = whole(numbers(data, at, stop).get(SCALE), media.scale)
        elif ident == TRACKS:
            for kind, _, body, close in children(data, at, stop):
                if kind == TRACK:
                    t = numbers(data, body, close)
                    track = (whole(t.get(NUMBER), 0), whole(t.get(TYPE), 0), t.get(CODEC, b"").decode("utf-8", "replace"), whole(t.get(EVERY)))
                    media.tracks.append(track)
                    every[track[0]] = track[3]
        elif ident == CLUSTER:
            read_cluster(data, at, stop, every, media)
        elif ident == CUES:
            for kind, _, body, close in children(data, at, stop):
                point = list(children(data, body, close)) if kind == CUE_POINT else []
                time = next((whole(data[b:c]) for k, _, b, c in point if k == CUE_TIME), 0)
                for k, _, b, c in point:
                    if k == CUE_POSITIONS:
                        where = numbers(data, b, c)
                        media.cues.append((time, whole(where.get(CUE_TRACK), 0), base + whole(where.get(CUE_CLUSTER), 0)))


def read_cluster(data: bytes, at: int, end: int, every: dict[int, int | None], media: Media) -> None:
    clock = 0
    for ident, _, body, stop in children(data, at, end):
        if ident == TIMESTAMP:
            clock = whole(data[body:stop])
        elif ident == SIMPLE_BLOCK:
            read_block(data, body, stop, clock, None, None, every, media)
        elif ident == BLOCK_GROUP:
            group = list(children(data, body, stop))
            lasts = next((whole(data[b:c]) for k, _, b, c in group if k == BLOCK_LASTS), None)
            key = all(k != REFERENCE for k, _, _, _ in group)
            for k, _, b, c in group:
                if k == BLOCK:
                    read_block(data, b, c, clock, key, lasts, every, media)


def read_block(data: bytes, at: int, end: int, clock: int, key: bool | None, lasts: int | None, every: dict[int, int | None], media: Media) -> None:
    """key: whether a block in a group refers to no other; None for a simple block, whose flags say it. lasts: ticks of all its frames."""
    track, at = read_vint(data, at, end)
    if at + 3 > end:
        raise ValueError("a block has no head")
    relative, flags = struct.unpack_from(">hB", data, at)
    sizes, at = lace_sizes(data, at + 3, end, kind := flags >> 1 & 3)
    apart = lasts * media.scale / len(sizes) if lasts is not None else every.get(track) or 0
    for k, size in enumerate(sizes):
        media.packets.append((track, clock + relative + round(k * apart / media.scale), at, size, bool(flags & 0x80) if key is None else key, kind))
        at += size


def packets(data: bytes) -> tuple[list[tuple[int, int, int, int, bool, int]], list[tuple[int, int, int]]]:
    """Packets (track, timestamp in ticks, first byte, bytes, keyframe, lacing) in file order, and cues (time, track, byte of the cluster).

    The frames of a lace follow each other by the block's or the track's duration; without either all have the block's time.
    """
    media = parse(data)
    return media.packets, media.cues


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


def report(media: bytes) -> tuple[bytes, str, int, str]:
    """Of the first track, from the stored bytes: payload, SHA-256, checksum of the last TAIL bytes, and features."""
    found, cues = packets(media)
    if not all(int.from_bytes(media[c[2] : c[2] + 4], "big") == CLUSTER for c in cues):
        raise ValueError("a cue points to no cluster")
    payload = b"".join([media[at : at + size] for track, _, at, size, _, _ in found if track == 1])
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    last = max((p[1] for p in found), default=0)
    loud, cross = (float(np.sqrt(np.mean(x * x))), int(np.count_nonzero(np.diff(np.signbit(x))))) if len(x) else (0.0, 0)
    features = f"packets={len(found)};cues={len(cues)};last_tick={last};mean={float(x.mean()) if len(x) else 0:.3f};rms={loud:.3f};crossings={cross}"
    return payload, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), features


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text as a Matroska file. Null text is empty; other columns are ignored; repeated rows repeat."""

    def one(ident, t):
        n, payload = padded(t)
        yield ident, n, write(payload)

    return map_rows(docs.select(F.col(key).cast("long"), text), one, f"{key} long, n_bytes long, media binary")


def media_rows(files: DataFrame, key: str, media: str, columns: str, rows) -> DataFrame:
    """One row for each of rows(parsed file), with the key, and one of nulls with the reason in error for a null or broken file."""
    width = columns.count(",") + 1

    def one(ident, data):
        try:
            if data is None:
                raise ValueError("no file")
            found = rows(parse(data))
        except (ValueError, IndexError, struct.error) as e:
            yield (ident, *[None] * width, str(e))
            return
        for row in found:
            yield (ident, *row, None)

    return map_rows(files.select(F.col(key).cast("long"), media), one, f"{key} long, {columns}, error string")


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per packet: key, packet number, track, timestamp, first byte, bytes, keyframe, lacing and the file's cue count.

    A null or broken file gives one row with a null packet and the reason in error; a file without packets gives none. Repeated rows
    repeat, other columns are ignored, an empty table gives an empty result. A packet of a block group is a keyframe where the group refers to no other block.
    """
    columns = "packet long, track long, ticks long, at long, bytes long, keyframe boolean, lacing int, cues int"
    return media_rows(files, key, media, columns, lambda m: [(k, *p, len(m.cues)) for k, p in enumerate(m.packets)])


def track_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per track: number, type, codec, ns a frame (null where not stated) and ns a tick. Null and broken files as in packet_table()."""
    return media_rows(files, key, media, "track long, type long, codec string, frame_ns long, tick_ns long", lambda m: [(*t, m.scale) for t in m.tracks])


def cue_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per cue: number, ticks, track and the first byte of the cluster it points to. Null and broken files as in packet_table()."""
    return media_rows(files, key, media, "cue long, ticks long, track long, at long", lambda m: [(k, *c) for k, c in enumerate(m.cues)])


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests and features of every text's media form, each read back from the stored bytes; one pass over the texts.

    Null text is empty (one padded frame). Equal texts give equal values. Repeated rows repeat; other columns are ignored.
    """

    def one(ident, t):
        n, payload = padded(t)
        media = write(payload)
        got, digest, tail, features = report(media)
        yield ident, n, len(got), digest, tail, len(media), hashlib.sha256(media).hexdigest(), features

    schema = f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(docs.select(F.col(key).cast("long"), text), one, schema)
