"""MPEG audio as a binary column: resynchronised frames, tags, variable-bitrate tables, checksums, seek offsets.

`index` reads any MPEG 1, 2 or 2.5 stream of layers I to III. It skips tags, finds a frame header whose
length leads to another one (or to the end of the audio), goes on from frame to frame, and searches
again where a header is broken or of another version, layer or rate. Frames of the free format are as long as the way to the next
such header. Durations stay exact, as samples and a sampling rate (of frames with several rates: of their least common multiple).

`store` writes bytes as a valid layer III stream: silent frames (all side information zero) that carry
the bytes as ancillary data, behind a two-byte length; long inputs take large frames and the rest small
ones, so the bitrate varies and the stream starts with a table of it. A frame without bytes comes last, so
that no payload stands where players and `parse` look for tags, 128 and 32 bytes before the end.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import quoted, results, shape, slices

#: Kilobits a second by (MPEG 1 or later, layer) and header index; 0 is the free format, whose length the header does not tell (fixed values of the standard).
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44100, 48000, 32000]

#: Layer II: (subbands, bits of each one's allocation) of the standard's tables (fixed values of the standard).
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}
#: No frame of the free format is longer.
FREE = 1 << 13

#: Bytes that a payload is padded to a multiple of, and those in a large frame.
BLOCK, LARGE = 192, 768
#: Kilobits a second of the last frame, which then has 144 bytes: an ID3v1 tag would take 128.
LAST = 48


@lru_cache(4096)
def header(four: bytes) -> tuple[int, int, int, int, int, int, int, bool] | None:
    """(length, samples, rate, kbit/s, version, layer, channels, has a checksum) of a frame header, or None.

    In the free format kbit/s is 0, and length the padding alone.
    """
    a, b, c, d = four
    if a != 0xFF or b & 0xE0 != 0xE0:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get(b >> 3 & 3), 4 - (b >> 1 & 3)
    if version is None or layer == 4 or c >> 4 == 15 or c >> 2 & 3 == 3 or d & 3 == 2:
        return None
    kbits = BITRATES[1 if version == 1 else 2, layer][c >> 4]
    rate = RATES[c >> 2 & 3] // {1: 1, 2: 2, 25: 4}[version]
    padding = c >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (12000 * kbits // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // rate + padding
    return length, samples, rate, kbits, version, layer, 1 if d >> 6 == 3 else 2, not b & 1


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The frame checksum of the first `bits` bits (None: all): polynomial 0x8005, all ones at the start."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        taken = min(8, left)
        crc ^= (byte >> 8 - taken << 8 - taken) << 8
        for _ in range(taken):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        left -= taken
        if not left:
            break
    return crc


def _side(version: int, channels: int) -> int:
    """Bytes of side information of a layer III frame."""
    return (17 if channels == 1 else 32) if version == 1 else (9 if channels == 1 else 17)


def _allocation(kbits: int, rate: int, version: int, channels: int) -> list[int]:
    """Bits of the allocation of every subband of a layer II frame."""
    each = kbits // channels
    if version != 1:
        table = "low"
    elif kbits and each <= 48:
        table = "d" if rate == 32000 else "c"
    else:
        table = "b" if rate != 48000 and (not kbits or each >= 96) else "a"
    return [bits for count, bits in ALLOCATIONS[table] for _ in range(count)]


def _protected(body: bytes, info: tuple, mode: int) -> int:
    """Bits behind header and checksum that the checksum covers; `mode` is the header's last byte."""
    _, _, rate, kbits, version, layer, channels, _ = info
    if layer == 3:
        return 8 * _side(version, channels)
    joint = 4 * ((mode >> 4 & 3) + 1) if mode >> 6 == 1 else 32  # subbands from here on have one allocation for both channels
    widths = [4] * 32 if layer == 1 else _allocation(kbits, rate, version, channels)
    entries = [(bits, 1 if sb < joint else channels) for sb, bits in enumerate(widths) for _ in range(channels if sb < joint else 1)]
    if layer == 1:
        return sum(bits for bits, _ in entries)
    number, at, selections = int.from_bytes(body, "big"), 8 * len(body), 0
    for bits, shared in entries:
        at -= bits
        if at < 0:
            return 8 * len(body)  # the frame ends within its allocation
        selections += 2 * shared * (number >> at & (1 << bits) - 1 != 0)
    return 8 * len(body) - at + selections


def _passes(data: bytes, at: int, length: int, info: tuple) -> bool:
    """Whether the checksum of the frame at `at` is right."""
    body = data[at + 6 : at + min(length, 6 + 64)]  # allocation and selections have 48 bytes at most
    bits = 16 + _protected(body, info, data[at + 3])
    return 8 * (2 + len(body)) >= bits and crc16(data[at + 2 : at + 4] + body[: (bits - 9) // 8], bits) == int.from_bytes(data[at + 4 : at + 6], "big")


def _like(info: tuple, other: tuple | None) -> bool:
    """Whether two headers can belong to one stream: of one version, layer and rate, and both or none of the free format."""
    return other is not None and other[2] == info[2] and other[4:6] == info[4:6] and (not other[3]) == (not info[3])


def _free(data: bytes, at: int, end: int, info: tuple) -> int:
    """The length without padding of a free-format frame at `at`: the way to the next header that a third one or the end confirms; 0 if there is none."""
    slot = 4 if info[5] == 1 else 1
    own, k = info[0], at + 24
    while 0 <= (k := data.find(data[at : at + 2], k, min(end, at + FREE))):
        following = header(data[k : k + 4]) if k + 4 <= end else None
        bare = k - at - own
        if _like(info, following) and bare % slot == 0:
            third = k + bare + following[0]
            if third == end or third + 4 <= end and _like(info, header(data[third : third + 4])):
                return bare
        k += 1
    return 0


def _text(raw: bytes) -> str:
    if not raw:
        return ""
    body = raw[1:]
    coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0])
    return (body.decode(coding, "replace") if coding else raw.decode("latin-1")).replace("\x00", " ").strip()


def _front_tag(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """The end of an ID3v2 tag at `at`, and its text frames."""
    major, flags = data[at + 3], data[at + 5]
    s = data[at + 6 : at + 10]
    size = s[0] << 21 | s[1] << 14 | s[2] << 7 | s[3]
    end, found, k = min(len(data), at + 10 + size), {}, at + 10
    if flags & 0x40 and k + 4 <= end:  # an extended header
        n = int.from_bytes(data[k : k + 4], "big")
        k += 4 + n if major == 3 else max(n, 4)
    head = 6 if major == 2 else 10
    while k + head <= end and data[k]:
        name = data[k : k + (3 if major == 2 else 4)].decode("latin-1")
        if major == 2:
            n = int.from_bytes(data[k + 3 : k + 6], "big")
        elif major == 4:
            n = data[k + 4] << 21 | data[k + 5] << 14 | data[k + 6] << 7 | data[k + 7]
        else:
            n = int.from_bytes(data[k + 4 : k + 8], "big")
        if n <= 0 or k + head + n > end:
            break
        if name.startswith("T"):
            found[name] = _text(data[k + head : k + head + n])
        k += head + n
    return end + (10 if major == 4 and flags & 0x10 else 0), found


def _variable(data: bytes, at: int, info: tuple, length: int) -> dict | None:
    """A Xing, Info or VBRI table in the frame at `at`."""
    _, _, _, _, version, layer, channels, checked = info
    if layer != 3:
        return None
    frame = data[at : at + length]
    for k in {4 + _side(version, channels), 4 + 2 * checked + _side(version, channels)}:
        if frame[k : k + 4] in (b"Xing", b"Info"):
            out, flags, k = {"kind": frame[k : k + 4].decode(), "frames": None, "bytes": None, "toc": None}, int.from_bytes(frame[k + 4 : k + 8], "big"), k + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[k : k + 4], "big")
                    k += 4
            if flags & 4 and len(frame) >= k + 100:
                out["toc"] = list(frame[k : k + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        total, frames, entries, scale, width, step = struct.unpack(">IIHHHH", frame[46:62])
        toc = [int.from_bytes(frame[62 + width * k : 62 + width * (k + 1)], "big") * scale for k in range(entries)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": total, "toc": toc, "step": step}
    return None


def parse(data: bytes) -> dict:
    """All that `index` tells of a stream, and `frames`: (offset, length, header length with checksum and side information) of each audio frame."""
    at, end, tags, names = 0, len(data), [], {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        at, found = _front_tag(data, at)
        tags.append("ID3v2")
        names.update(found)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.append("ID3v1")
        for name, low, high in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if value := data[end + low : end + high].split(b"\x00")[0].decode("latin-1").strip():
                names.setdefault(name, value)
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, _, flags = struct.unpack("<III", data[end - 20 : end - 8])
        end = max(at, end - size - (32 if flags & 0x80000000 else 0))
        tags.append("APE")
    frames, kbits, skipped, resyncs, checked, failed, rates, table = [], {}, 0, 0, 0, 0, {}, None
    last, free = None, 0  # the header of the frame before, while in sync, and the length of a free-format frame
    while at + 4 <= end:
        info = header(data[at : at + 4])
        in_sync = last is not None and _like(last, info)
        length = 0 if info is None else info[0]
        if info is not None and not info[3]:
            free = free if in_sync else _free(data, at, end, info)
            length += free if free else end - at + 1
        if info is not None and at + length <= end:
            after = at + length
            if in_sync or after + 4 > end or _like(info, header(data[after : after + 4])):
                _, n, rate, k, version, layer, channels, has_crc = info
                side = _side(version, channels) if layer == 3 else 0
                if has_crc:
                    checked += 1
                    failed += not _passes(data, at, length, info)
                last = info
                if not frames and table is None and (table := _variable(data, at, info, length)) is not None:
                    at = after
                    continue
                frames.append((at, length, 4 + 2 * has_crc + side))
                kbits[k] = kbits.get(k, 0) + 1
                rates[rate] = rates.get(rate, 0) + n
                at = after
                continue
        resyncs += last is not None or not frames and not skipped
        last = None
        found = data.find(b"\xff", at + 1, end)
        found = end if found < 0 else found
        skipped += found - at
        at = found
    skipped += end - at
    rate = math.lcm(*rates) if rates else 0
    samples = sum(n * (rate // r) for r, n in rates.items())
    return {"frames": frames, "samples": samples, "rate": rate, "rates": len(rates), "kbits": kbits, "tags": tags, "names": names, "table": table, "checked": checked, "failed": failed, "resyncs": resyncs, "skipped": skipped}


def _head(kbits: int) -> bytes:
    """The header of a checked mono layer III frame at 48 kHz."""
    return bytes((0xFF, 0xFA, BITRATES[1, 3].index(kbits) << 4 | 1 << 2, 0xC0))


@lru_cache(8)
def _frame(kbits: int) -> tuple[bytes, int]:
    """Header, checksum and silent side information, and the frame's length."""
    head = _head(kbits)
    side = bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, header(head)[0]


def padded(text: bytes) -> bytes:
    return text + b" " * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def write(payload: bytes) -> bytes:
    """A stream that holds a payload, of a positive multiple of BLOCK bytes, without loss."""
    large, small = len(payload) // LARGE, len(payload) % LARGE // BLOCK
    parts, at = [], 0
    for kbits, size, count in ((320, LARGE, large), (80, BLOCK, small)):
        start, length = _frame(kbits)
        start += size.to_bytes(2, "big")
        rest = bytes(length - len(start) - size)
        for _ in range(count):
            parts += (start, payload[at : at + size], rest)
            at += size
    start, length = _frame(LAST)
    parts += (start, bytes(length - len(start)))
    audio = b"".join(parts)
    start, length = _frame(128)
    total, count = length + len(audio), large + small + 1
    big, little = _frame(320)[1], _frame(80)[1]
    toc = bytes(min(255, (length + min(k * count // 100, large) * big + max(0, k * count // 100 - large) * little) * 256 // total) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, count, total) + toc
    tool = b"\x03helixframe"
    tag = b"TSSE" + len(tool).to_bytes(4, "big") + b"\x00\x00" + tool
    front = b"ID3\x03\x00\x00" + bytes((0, 0, len(tag) >> 7, len(tag) & 127)) + tag
    return front + start + table + bytes(length - len(start) - len(table)) + audio


def read(data: bytes, found: dict) -> bytes:
    """The payload of a stream that `write` made."""
    parts = []
    for at, _, skip in found["frames"]:
        a = at + skip
        n = data[a] << 8 | data[a + 1]
        parts.append(data[a + 2 : a + 2 + n])
    return b"".join(parts)


def feature(found: dict) -> str:
    """A line with what was found: frames, exact duration, bitrates, checksums, tags, table and a checksum of the seek offsets."""
    offsets = np.array([f[0] for f in found["frames"]], "<u8")
    table = found["table"]
    told = "none" if table is None else f"{table['kind']}:{table['frames']}:{table['bytes']}:{zlib.crc32(bytes(table['toc'] or b''))}" if table["kind"] != "VBRI" else f"VBRI:{table['frames']}:{table['bytes']}"
    kbits = ",".join(f"{k}x{n}" for k, n in sorted(found["kbits"].items()))
    return f"frames={len(offsets)};duration={found['samples']}/{found['rate']};kbits={kbits};crc={found['checked'] - found['failed']}/{found['checked']};tags={'+'.join(found['tags'])};vbr={told};seek={zlib.crc32(offsets.tobytes())};resyncs={found['resyncs']};skipped={found['skipped']}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, padded with spaces, as an audio stream.

    A null text counts as empty. Repeated rows are stored as often as they occur, equal texts as equal bytes; a null
    doc_id stays null; no other column of `docs` is read. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            media = pa.array([write(padded(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(wrap, shape(doc_id=kind, n_bytes="long", media="binary"))


_INDEX = "frames long, samples long, rate int, checked long, failed long, resyncs long, skipped long, tags array<string>, names map<string,string>, table_kind string, table_frames long, table_bytes long, seek array<long>"


def index(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns, and a struct `audio`: frames, samples and rate (the exact duration), checksums checked and failed,
    resyncs, bytes skipped, tags and their texts, the bitrate table, and `seek`, the offset of every frame.

    Null media give a null struct; bytes without a frame give zero frames and rate 0. Where a column `audio` is there,
    the struct is `audio_2`.
    """
    kept = tuple(media.columns)
    given = media.select(F.struct(*[F.col(quoted(c)).alias(c) for c in kept]).alias("row"), F.col(quoted(column)).alias("text"))
    kind = given.schema["row"].dataType
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def one(data: bytes | None) -> dict | None:
        if data is None:
            return None
        p = parse(data)
        table = p["table"] or {}
        values = (len(p["frames"]), p["samples"], p["rate"], p["checked"], p["failed"], p["resyncs"], p["skipped"], p["tags"], list(p["names"].items()), table.get("kind"), table.get("frames"), table.get("bytes"), [f[0] for f in p["frames"]])
        return dict(zip(names, values, strict=True))

    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    kinds = pa.struct([(x.split()[0], arrow[x.split()[1]]) for x in _INDEX.split(", ")])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in slices(batches):
            audio = pa.array([one(x) for x in batch.column("text").to_pylist()], kinds)
            yield pa.RecordBatch.from_arrays([batch.column("row"), audio], names=["row", "audio"])

    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in _INDEX.split(", "))
    return given.mapInArrow(look, shape(row=kind, audio=f"struct<{fields}>")).select(*[F.col(f"row.{quoted(c)}").alias(c) for c in kept], *results(("audio",), kept))


def digests(media: DataFrame) -> DataFrame:
    """Of stored texts (doc_id, n_bytes, media): the payload read back, its digests, those of the stream, and what was found in it.

    Null media count as streams of no bytes: no payload and no frames. Repeated rows stay repeated, null ids and
    sizes stay null, and no other column is read. An empty table gives an empty result.
    """
    kind = media.schema["doc_id"].dataType
    made = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, streams in slices(batches, "media"):
            rows = []
            for data in streams:
                found = parse(data)
                payload = read(data, found)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(found)))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *made])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(look, shape(doc_id=kind, n_bytes="long", **{n: "long" if t == pa.int64() else "string" for n, t in made.items()}))
