"""Media columns: texts stored as PNG images in binary columns, read back and hashed.

The writer and the reader are separate steps, so that features come from the stored bytes
alone. A PNG is read chunk by chunk with its checksums tested, inflated by zlib and
unfiltered with numpy; the feature is the sign pattern of the low frequencies of a
two-dimensional cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statutory.llm.common import same_rows, slices, utf8

WIDTH = 64
CHANNELS = 3
ROW_BYTES = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format
IDAT_BYTES = 1 << 20
SIDE, LOW = 32, 8


def payload_of(text: bytes) -> bytes:
    """The text, padded with spaces to a positive multiple of a row."""
    return text + b" " * (-len(text) % ROW_BYTES if text else ROW_BYTES)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes, level: int = 4) -> bytes:
    """An 8-bit RGB image of WIDTH columns with the payload as its samples; rows are filtered by the row above."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    lines = np.empty((len(rows), ROW_BYTES + 1), np.uint8)
    lines[:, 0] = 2
    lines[0, 0] = 1
    lines[1:, 1:] = rows[1:] - rows[:-1]
    lines[0, 1 : 1 + CHANNELS] = rows[0, :CHANNELS]
    lines[0, 1 + CHANNELS :] = rows[0, CHANNELS:] - rows[0, :-CHANNELS]
    data = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    at = 0
    while at < len(out):
        kind = kinds[at]
        if kind == 2:  # a run of rows filtered by the row above is one running sum
            end = at + 1
            while end < len(out) and kinds[end] == 2:
                end += 1
            if at:
                out[at] += out[at - 1]
            out[at:end] = np.cumsum(out[at:end], axis=0, dtype=np.uint8)
            at = end
            continue
        row = out[at]
        above = out[at - 1] if at else np.zeros_like(row)
        if kind == 1:
            row[:] = np.cumsum(row.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            a, c = np.zeros(bpp, np.int64), np.zeros(bpp, np.int64)
            for i in range(0, len(row), bpp):
                b = above[i : i + bpp].astype(np.int64)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c))
                a = (row[i : i + bpp] + guess) % 256
                row[i : i + bpp] = a
                c = b
        at += 1
    return out


def read_png(media: bytes) -> np.ndarray:
    """Rows x columns x channels of an 8-bit gray, RGB or RGBA image; ValueError if anything in it is wrong."""
    if media[: len(SIGNATURE)] != SIGNATURE:
        raise ValueError("no PNG")
    at, head, data, ended = len(SIGNATURE), None, [], False
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("cut chunk")
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(body) != size or media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("checksum of a chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + size
    if head is None or not ended:
        raise ValueError("cut image")
    width, height, depth, colour, method, filtering, interlace = head
    channels = {0: 1, 2: 3, 6: 4}.get(colour)
    if channels is None or (depth, method, filtering, interlace) != (8, 0, 0, 0):
        raise ValueError("kind of image")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as error:
        raise ValueError("data of an image") from error
    if len(raw) != height * (width * channels + 1):
        raise ValueError("size of an image")
    return _unfilter(raw.reshape(height, -1), channels).reshape(height, width, channels)


def _transform(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi / n * (k[None, :] + 0.5) * k[:, None])


def _shrink(values: np.ndarray, side: int) -> np.ndarray:
    """Means over side blocks of rows; few rows are repeated."""
    n = len(values)
    if n < side:
        return values[np.arange(side) * n // side]
    edges = np.arange(side) * n // side
    sums = np.add.reduceat(values, edges, axis=0)
    return sums / np.diff(np.append(edges, n))[:, None]


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the low-frequency coefficients are above their median, without the mean's."""
    gray = image.sum(axis=2, dtype=np.uint32).astype(np.float64)
    small = _shrink(_shrink(gray, SIDE).T, SIDE).T
    basis = _transform(SIDE)[:LOW]
    low = np.round(basis @ small @ basis.T, 6).reshape(-1)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = utf8(batch, "text")
        yield same_rows(batch, ["doc_id"], {
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "media": pa.array([write_png(payload_of(t)) for t in texts], pa.binary()),
        })


def with_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column (a PNG) of every row.

    Null and empty texts are an image of one row of spaces; equal texts give equal bytes;
    repeated rows are repeated, null ids stay; other columns are ignored; no rows give no rows.
    """
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_write, f"doc_id {kind}, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "cosine_hash")}
        for media in batch.column("media").to_pylist():
            try:
                image = read_png(media or b"")
                payload = image.tobytes()
                values = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), cosine_hash(image)]
            except ValueError:
                values = [None] * 4
            media_values = [None, None] if media is None else [len(media), hashlib.sha256(media).hexdigest()]
            for column, value in zip(out.values(), [*values[:3], *media_values, values[3]], strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield same_rows(batch, ["doc_id", "n_bytes"], {c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})


def media_features(stored: DataFrame) -> DataFrame:
    """Sizes, digests and the cosine hash of a media column; what is no sound PNG (null, too) has null features.

    Repeated rows are repeated, null ids stay; other columns are ignored; no rows give no rows.
    """
    rows = stored.select("doc_id", "n_bytes", "media")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _read,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, cosine_hash binary",
    )
