"""Media columns: MPEG audio.

:func:`parse` reads a stream as players must: it skips tags, resynchronises on frame headers (a
header counts only if the next frame's header follows it, or the stream ends there), reads the
variable-bitrate table, verifies the frames' checksums, and adds up the exact number of samples and
the byte offset of every frame.

:func:`store` keeps a payload of bytes in such a stream without loss: MPEG-1 layer III frames of
silence whose ancillary data are the payload, 192 bytes a frame, behind an ID3v2 tag and a frame
with the frame count, the byte count and a seek table.

Defined results: a null text is an empty text and is stored as 192 spaces; a null or damaged stream
gives zero frames or the frames that can be read; repeated rows give repeated rows; a text of any length
is one stream; extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnstore.llm.common import staged, text_or_empty

UNIT = 192
# Fixed values of the format: kbit/s by index, for (MPEG-1?, layer), and Hz by index for MPEG-1.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: MPEG-1 layer III with checksum, 48 kbit/s, 32 kHz, mono: 216 bytes a frame.
HEADER = bytes([0xFF, 0xFA, 0x38, 0xC0])
FRAME, SIDE, BODY = 216, 17, 23


@dataclass
class Header:
    mpeg1: bool
    layer: int
    checked: bool
    rate: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information, which the checksum covers (layer III)."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.mpeg1 else (9 if self.mono else 17)


def header(data: bytes, at: int) -> Header | None:
    """The frame header at ``at``, or None if there is none that gives a length."""
    if at < 0 or at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    bitrate, rate, padding = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1
    if version == 1 or layer == 4 or rate == 3 or bitrate in (0, 15):
        return None
    mpeg1 = version == 3
    hz = RATES[rate] // (1 if mpeg1 else 2 if version == 2 else 4)
    bits = BITRATES[mpeg1, layer][bitrate] * 1000
    if layer == 1:
        samples, length = 384, (12 * bits // hz + padding) * 4
    else:
        samples = 576 if layer == 3 and not mpeg1 else 1152
        length = samples // 8 * bits // hz + padding
    return Header(mpeg1, layer, not data[at + 1] & 1, hz, data[at + 3] >> 6 == 3, length, samples)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint16) << np.uint16(8)
    for _ in range(8):
        table = np.where(table & np.uint16(0x8000), (table << np.uint16(1)) ^ np.uint16(0x8005), table << np.uint16(1))
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)) ^ column]
    return crc


@dataclass
class Stream:
    """What a stream holds.  ``offsets`` are the bytes at which its audio frames start."""

    rate: int = 0
    layer: int = 0
    samples: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    bad_checksums: int = 0
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: tuple | None = None

    @property
    def milliseconds(self) -> float:
        return self.samples * 1000 / self.rate if self.rate else 0.0

    def seek(self, sample: int) -> int:
        """The byte offset of the frame that holds ``sample``."""
        each = self.samples // max(1, len(self.offsets))
        return int(self.offsets[min(sample // each, len(self.offsets) - 1)]) if len(self.offsets) and each else 0


def parse(data: bytes | None) -> Stream:
    data = data or b""
    out, at = Stream(), 0
    out.tags, at = _tags(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) >= at + 128 else len(data)
    offsets, lengths, lost, kind = [], [], False, None
    raw = np.frombuffer(data, np.uint8)
    while at < end:
        h = header(data, at)
        if h is not None and not lost and at + h.length == len(data):
            end = len(data)  # a frame covers what looked like an ID3v1 tag
        known = h is not None and not lost and kind == (data[at + 1], data[at + 2] & 0x0C)
        if h is None or at + h.length > end or not (known or at + h.length == end or header(data, at + h.length)):
            at = data.find(b"\xff", at + 1, end)
            out.resyncs += not lost
            lost = True
            if at < 0:
                break
            continue
        lost, kind = False, (data[at + 1], data[at + 2] & 0x0C)
        if not offsets and out.table is None and (table := _table(data, at, h)):
            out.table, at = table, at + h.length
            continue
        out.rate, out.layer = out.rate or h.rate, out.layer or h.layer
        # Frames with the same four bytes at the same distance are read together.
        n = (end - at) // h.length
        rows = raw[at : at + n * h.length].reshape(n, h.length)
        same = (rows[:, :4] == rows[0, :4]).all(axis=1)
        n = n if same.all() else int(np.argmin(same))
        rows = rows[:n]
        if h.checked and h.side:
            wanted = rows[:, 4].astype(np.uint16) << np.uint16(8) | rows[:, 5]
            out.bad_checksums += int((crc16(np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + h.side]], axis=1)) != wanted).sum())
        offsets.append(at + h.length * np.arange(n))
        lengths.append(np.full(n, h.length))
        out.samples += n * h.samples
        at += n * h.length
    if offsets:
        out.offsets, out.lengths = np.concatenate(offsets), np.concatenate(lengths)
    return out


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of the ID3v2 tag, and where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    tags, at, end = {}, 10, min(10 + size, len(data))
    while at + 10 <= end and data[at]:
        (n,) = struct.unpack(">I", data[at + 4 : at + 8])
        if data[at : at + 1] == b"T":
            tags[data[at : at + 4].decode("latin-1")] = data[at + 11 : min(at + 10 + n, end)].decode("latin-1")
        at += 10 + n
    return tags, end


def _table(data: bytes, at: int, h: Header) -> tuple | None:
    """(kind, frames, bytes, seek table) of the variable-bitrate frame, if it is one."""
    for kind, place in ((b"Xing", at + 4 + h.side), (b"Info", at + 4 + h.side), (b"VBRI", at + 36)):
        if data[place : place + 4] != kind:
            continue
        if kind == b"VBRI":
            size, frames = struct.unpack(">II", data[place + 10 : place + 18])
            return "VBRI", frames, size, b""
        (flags,) = struct.unpack(">I", data[place + 4 : place + 8])
        place, values = place + 8, []
        for bit in (1, 2):
            values.append(struct.unpack(">I", data[place : place + 4])[0] if flags & bit else 0)
            place += 4 if flags & bit else 0
        return kind.decode(), values[0], values[1], data[place : place + 100] if flags & 4 else b""
    return None


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\0" + text.encode("latin-1")
    return name + struct.pack(">IH", len(body), 0) + body


def store(payload: bytes) -> bytes:
    """The stream that holds ``payload``, whose length is a positive multiple of 192."""
    n, left = divmod(len(payload), UNIT)
    if left or not n:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    check = int(crc16(np.concatenate([frames[:1, 2:4], frames[:1, 6:BODY]], axis=1))[0])
    frames[:, 4], frames[:, 5] = check >> 8, check & 0xFF
    frames[:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    seek = bytes(i * 256 // 100 for i in range(100))
    first = bytes([0xFF, 0xFB, 0x38, 0xC0]) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, n, (n + 1) * FRAME) + seek
    inner = _text_frame(b"TLEN", str(n * 36)) + _text_frame(b"TSSE", "payload in ancillary data")
    size = bytes(len(inner) >> s & 0x7F for s in (21, 14, 7, 0))
    return b"ID3\x03\x00\x00" + size + inner + first.ljust(FRAME, b"\0") + frames.tobytes()


def load(media: bytes, stream: Stream | None = None) -> bytes:
    """The payload that :func:`store` put into the stream's frames."""
    stream = stream or parse(media)
    if not len(stream.offsets):
        return b""
    raw = np.frombuffer(media, np.uint8)
    return raw[stream.offsets[:, None] + np.arange(BODY, BODY + UNIT)].tobytes()


def pad(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stream) of each row's whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_cs_text")
            for a in range(0, len(texts), 512):
                raw = [t.as_py().encode("utf-8", "surrogatepass") for t in texts.slice(a, 512)]
                media = pa.array([store(pad(x)) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 512), pa.array(map(len, raw), pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    picked = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_cs_text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_ms double, seek_offsets array<long>"


def features(media: DataFrame) -> DataFrame:
    """The streams' checksums, exact durations and frame offsets, read from the column ``media``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("duration_ms", pa.float64()), ("seek_offsets", pa.list_(pa.int64()))])
        for batch in batches:
            streams = batch.column("media")
            for a in range(0, len(streams), 512):
                rows = [_row(m.as_py()) for m in streams.slice(a, 512)]
                columns = [batch.column(k).slice(a, 512) for k in ("doc_id", "n_bytes")]
                columns += [pa.array(x, schema.field(i + 2).type) for i, x in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def _row(media: bytes) -> tuple:
    stream = parse(media)
    payload = load(media, stream)
    table = stream.table or ("none", 0, 0, b"")
    feature = (
        f"layer={stream.layer};rate={stream.rate};frames={len(stream.offsets)};samples={stream.samples};"
        f"table={table[0]}:{table[1]}:{table[2]};bad={stream.bad_checksums};resyncs={stream.resyncs};"
        f"tlen={stream.tags.get('TLEN', '')};seek={zlib.crc32(stream.offsets.astype('<i8').tobytes()):08x}"
    )
    return (
        len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha256(media).hexdigest(),
        feature, stream.milliseconds, stream.offsets,
    )


def store_and_read(docs: DataFrame) -> DataFrame:
    """Write each row's stream to a table in the shared folder and return what is read back from it."""
    return features(staged(media_column(docs), "media"))
