"""Media columns: GIF decoding (LZW, palettes, disposal, transparency) into timed frames with colour histograms,
and the lossless storage of byte payloads as GIF samples.

Defined results: a null payload counts as empty; bytes that are no GIF, or a GIF without frames, give an empty frame
list; a truncated code stream leaves the missing samples at the background index. Repeated rows give equal values,
and columns beside the named ones pass by untouched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import only, slices, table, tidy, utf8

UNIT = 64
FRAME_ROWS = 1024
FIRST_STRING = 258
TABLE_SIZE = 4096
TO_BACKGROUND = 2
BINS_PER_CHANNEL = 4
DELAY_CS = 10

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long, histogram array<long>"
)


@dataclass(frozen=True)
class Frame:
    """One image block: its own samples (palette indices), and the whole canvas as RGB after it is drawn."""

    start_ms: int
    delay_ms: int
    left: int
    top: int
    samples: np.ndarray
    canvas: np.ndarray | None
    disposal: int


# --- writing -------------------------------------------------------------------------------------------------------


def _lzw_codes(samples: bytes) -> list[list[int]]:
    """The codes of eight-bit samples, one list for each life of the string table."""
    segments: list[list[int]] = []
    codes: list[int] = []
    known: dict[int, int] = {}
    after, current = FIRST_STRING, samples[0]
    for octet in samples[1:]:
        longer = current << 8 | octet
        if (code := known.get(longer)) is not None:
            current = code
            continue
        codes.append(current)
        known[longer] = after
        after += 1
        current = octet
        if after == TABLE_SIZE:  # full: start anew after a clear code
            segments.append(codes)
            codes, known, after = [], {}, FIRST_STRING
    codes.append(current)
    return [*segments, codes]


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of eight-bit samples: clear code, strings at a width that grows from 9 to 12 bits, end code."""
    segments = _lzw_codes(samples)
    flat = np.array([c for codes in segments for c in (256, *codes)] + [257], np.uint32)
    # the width follows from the place: a clear code still has the width of the segment before it
    place = np.concatenate([np.arange(1, len(codes) + 2) for codes in segments])
    widths = np.concatenate([[9], 9 + (place > 255) + (place > 767).astype(np.int64) + (place > 1791)])
    at = np.cumsum(widths) - widths
    shifted = flat << (at & 7).astype(np.uint32)
    size = int(at[-1] + widths[-1] + 7) // 8
    out = sum(np.bincount((at >> 3) + k, shifted >> np.uint32(8 * k) & np.uint32(255), size + 3) for k in range(3))
    return out.astype(np.uint8)[:size].tobytes()


def _sub_blocks(data: bytes) -> bytes:
    whole = len(data) // 255 * 255
    framed = np.full((whole // 255, 256), 255, np.uint8)
    framed[:, 1:] = np.frombuffer(data, np.uint8, whole).reshape(-1, 255)
    rest = data[whole:]
    return framed.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _palette() -> bytes:
    """256 colours spread over the cube: the six low bits of an index choose the quarter of each channel, two bits a
    channel, and the two high bits the place inside. Neighbouring sample values thus fall into different bins of a colour
    histogram, four values to a bin."""
    index = np.arange(256)
    quarter = np.stack([index & 3, index >> 2 & 3, index >> 4 & 3], axis=1)
    return (64 * quarter + 16 * (index >> 6)[:, None]).astype(np.uint8).tobytes()


_PALETTE = _palette()


def encode_samples(payload: bytes, width: int = UNIT, frame_rows: int = FRAME_ROWS) -> bytes:
    """An animated GIF whose frames hold the payload row by row; its length must be a multiple of the width."""
    if not payload or len(payload) % width:
        raise ValueError("payload must be a positive multiple of the width")
    rows = len(payload) // width
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), _PALETTE]
    for first in range(0, rows, frame_rows):
        high = min(frame_rows, rows - first)
        samples = payload[first * width : (first + high) * width]
        # sample 0, the padding, is transparent, and each frame gives way to the background before the next
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", TO_BACKGROUND << 2 | 1, DELAY_CS, 0, 0))
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, high, 0) + b"\x08")
        parts.append(_sub_blocks(lzw_encode(samples)))
    parts.append(b"\x3b")
    return b"".join(parts)


# --- reading -------------------------------------------------------------------------------------------------------


def _codes(bits: np.ndarray, at: int, width: int, count: int) -> np.ndarray:
    """Up to count codes of the given width from bit position at."""
    count = max(0, min(count, (len(bits) - at) // width))
    table_ = bits[at : at + count * width].reshape(count, width).astype(np.uint16)
    return (table_ << np.arange(width, dtype=np.uint16)).sum(axis=1, dtype=np.uint16)


def lzw_decode(data: bytes, min_size: int, expected: int) -> np.ndarray:
    """Samples of one code stream. Between two clear codes the width of each code follows from its position, so a
    segment's codes are cut at once, and then the string table is rebuilt from them."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.frombuffer(data, np.uint8)
    bits = np.unpackbits(raw, bitorder="little")
    out: list[bytes] = []
    made, at = 0, 0
    while made < expected and at + min_size + 1 <= len(bits):
        codes, at, over = _segment(bits, at, min_size, clear, end)
        text = _strings(codes, clear)
        out.append(text)
        made += len(text)
        if over:
            break
    got = np.frombuffer(b"".join(out), np.uint8)[:expected]
    return np.concatenate([got, np.zeros(expected - len(got), np.uint8)])


def _segment(bits: np.ndarray, at: int, min_size: int, clear: int, end: int) -> tuple[np.ndarray, int, bool]:
    """The codes up to the next clear or end code, the bit position after it, and whether the stream is over."""
    parts, width, count = [], min_size + 1, (1 << min_size) - 1
    while True:
        codes = _codes(bits, at, width, count)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if len(stops):
            parts.append(codes[: stops[0]])
            return np.concatenate(parts), at + (int(stops[0]) + 1) * width, codes[stops[0]] == end
        parts.append(codes)
        at += len(codes) * width
        if len(codes) < count:
            return np.concatenate(parts), len(bits), True
        count = 1 << width
        width = min(width + 1, 12)


def _strings(codes: np.ndarray, clear: int) -> bytes:
    """The bytes of the codes between two clear codes. The j-th string of the table is what code j gave and the byte
    after it, so a code repeats output from where code j began: lengths and bytes follow such references to their
    literals, all at once, in as many rounds as the longest chain has bits. A code beyond the table ends the stream."""
    n = len(codes)
    made_by = codes.astype(np.int64) - clear - 2
    if (bad := np.flatnonzero(made_by >= np.arange(n))).size:
        n = int(bad[0])
        codes, made_by = codes[:n], made_by[:n]
    if not n:
        return b""
    literal = made_by < 0
    lengths = np.append(np.ones(n, np.int64), 0)
    jump = np.append(np.where(literal, n, made_by), n)
    while (jump < n).any():
        lengths += lengths[jump]
        jump = jump[jump]
    lengths = lengths[:n]
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(n), lengths)
    place = np.arange(len(owner))
    source = np.where(literal[owner], place, starts[np.maximum(made_by, 0)[owner]] + place - starts[owner])
    while not np.array_equal(further := source[source], source):
        source = further
    return codes[owner[source]].astype(np.uint8).tobytes()


def _rows_of(samples: np.ndarray, high: int, wide: int, interlaced: bool) -> np.ndarray:
    image = samples.reshape(high, wide)
    if not interlaced:
        return image
    order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, high, step)]
    woven = np.empty_like(image)
    woven[order] = image
    return woven


def decode(media: bytes | None, canvases: bool = True) -> list[Frame]:
    """The frames of a GIF in order; with canvases, each also as the RGB picture it leaves on the screen."""
    if not media or media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        return []
    wide, high, flags, background, _ = struct.unpack_from("<HHBBB", media, 6)
    at, shared = 13, None
    if flags & 128:
        size = 3 << (flags & 7) + 1
        shared = np.frombuffer(media[at : at + size].ljust(size, b"\0"), np.uint8).reshape(-1, 3)
        at += size
    screen = np.zeros((high, wide, 3), np.uint8) if canvases else None
    frames: list[Frame] = []
    clock, delay, disposal, hidden = 0, 0, 0, None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(media) and media[at]:
            parts.append(media[at + 1 : at + 1 + media[at]])
            at += 1 + media[at]
        return b"".join(parts), at + 1

    while at < len(media) and media[at] != 0x3B:
        kind, at = media[at], at + 1
        if kind == 0x21 and at < len(media):
            label = media[at]
            body, at = blocks(at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                hidden = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C or at + 10 > len(media):
            break
        left, top, w, h, local = struct.unpack_from("<HHHHB", media, at)
        at += 9
        palette = shared
        if local & 128:
            size = 3 << (local & 7) + 1
            palette = np.frombuffer(media[at : at + size].ljust(size, b"\0"), np.uint8).reshape(-1, 3)
            at += size
        if at >= len(media):
            break
        min_size = media[at]
        data, at = blocks(at + 1)
        image = _rows_of(lzw_decode(data, min_size, w * h), h, w, bool(local & 64)) if 1 < min_size < 12 else None
        if image is None:
            break
        shown = None
        if canvases:
            before = screen
            screen = screen.copy()
            view = screen[top : top + h, left : left + w]
            part = image[: view.shape[0], : view.shape[1]]
            colours = np.zeros((256, 3), np.uint8)
            if palette is not None:
                colours[: len(palette)] = palette
            seen = part != hidden if hidden is not None else slice(None)
            view[seen] = colours[part][seen]
            shown = screen
            if disposal == 2:
                screen = screen.copy()
                fill = shared[background] if shared is not None and background < len(shared) else 0
                screen[top : top + h, left : left + w] = fill
            elif disposal == 3:
                screen = before
        frames.append(Frame(clock * 10, delay * 10, left, top, image, shown, disposal))
        clock += delay
        delay, disposal, hidden = 0, 0, None
    return frames


def histogram(canvas: np.ndarray, bins: int = BINS_PER_CHANNEL) -> np.ndarray:
    """Counts of an RGB picture's colours, each channel cut into equal ranges."""
    if not canvas.size:
        return np.zeros(bins**3, np.int64)
    part = (canvas.reshape(-1, 3).astype(np.uint16) * bins) >> 8
    return np.bincount(part[:, 0] * bins * bins + part[:, 1] * bins + part[:, 2], minlength=bins**3)


def feature_of(counts: np.ndarray) -> str:
    """Shares of a histogram in 1/255 as hexadecimal."""
    total = max(int(counts.sum()), 1)
    return bytes(int(c * 255 // total) for c in counts.tolist()).hex()


def store_payload(text: bytes) -> tuple[bytes, bytes]:
    """The padded payload and the GIF that holds it."""
    payload = text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT))
    return payload, encode_samples(payload)


# --- on tables -----------------------------------------------------------------------------------------------------


def decode_media(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """One row per frame of each GIF: key, frame number, times, place, raw samples and the canvas histogram."""
    schema = (
        f"{key} long, frame int, start_ms long, delay_ms long, left int, top int, width int, height int, "
        "disposal int, samples binary, histogram array<long>"
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            found = []
            for k, blob in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist(), strict=True):
                for n, f in enumerate(decode(blob)):
                    h, w = f.samples.shape
                    found.append((k, n, f.start_ms, f.delay_ms, f.left, f.top, w, h, f.disposal, f.samples.tobytes(), histogram(f.canvas).tolist()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.list_(pa.int64())]
            names = [key, "frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "samples", "histogram"]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return only(media, key, column).mapInArrow(tidy(rows), schema)


def text_media(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as GIF samples, read back and described: see SCHEMA."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = []
            for content in utf8(batch.column(text)):
                _, media = store_payload(content)
                frames = decode(media)
                back = b"".join(f.samples.tobytes() for f in frames)
                counts = sum((histogram(f.canvas[: f.samples.shape[0]]) for f in frames), np.zeros(BINS_PER_CHANNEL**3, np.int64))
                found.append(
                    (
                        len(content), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]),
                        len(media), hashlib.sha256(media).hexdigest(), feature_of(counts), len(frames),
                        sum(f.delay_ms for f in frames), counts.tolist(),
                    )
                )
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            columns = [batch.column(doc_id).cast(pa.int64())] + [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return only(documents, doc_id, text).withColumnRenamed(doc_id, "doc_id").mapInArrow(tidy(rows), SCHEMA)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
