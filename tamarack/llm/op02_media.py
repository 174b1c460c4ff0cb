"""Media columns: 8-bit greyscale PNG in binary columns, and low-frequency cosine-transform hashes of what is stored.

`encode_png` writes a payload as an image of `width` samples a row: IHDR, IDAT and IEND chunks with CRC-32, zlib
deflate, each row filtered with None or Up, whichever has the smaller sum of absolute values. `decode_png` is a
general reader for 8-bit greyscale: it walks the chunks, tests each CRC-32, inflates the joined IDAT data and undoes
all five PNG filters with numpy (None, Sub and Up are whole-row operations; Average and Paeth go sample by sample).
The feature is a perceptual hash: the image is reduced to a 32 x 32 grid of block means, transformed by a cosine transform, and
the signs of its 8 x 8 lowest frequencies about their median (without the constant term) give 64 bits.

Defined results: null or empty text is a payload of one row of 255s; equal texts give equal stored bytes and
features; a damaged chunk raises ValueError. Texts of any length are stored whole. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import map_arrow, texts

#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 576
GRID, LOW = 32, 8


def payload_of(raw: bytes, width: int = WIDTH) -> bytes:
    return raw + b"\xff" * (width - len(raw) % width if len(raw) % width or not raw else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = lambda x: np.minimum(x, 256 - x.astype(np.int16)).sum(axis=1)
    kind = (cost(up) < cost(rows)).astype(np.uint8) * 2
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.where(kind[:, None] == 2, up, rows)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, end = data[at + 8 : at + 8 + size], at + 12 + size
        if len(data) < end or struct.unpack(">I", data[end - 4 : end])[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, body
        at = end
        if kind == b"IEND":
            return
    raise ValueError("IEND is missing")


def _sequential(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Average (3) and Paeth (4) need the sample to the left before the next."""
    out, left, corner = [], 0, 0
    for x, b in zip(line.tolist(), above.tolist(), strict=True):
        if kind == 3:
            guess = (left + b) >> 1
        else:
            p = left + b - corner
            guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
        left, corner = (x + guess) & 255, b
        out.append(left)
    return np.array(out, np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The image's samples, rows by columns."""
    found: dict[bytes, bytes] = {}
    for kind, body in _chunks(data):
        found[kind] = found.get(kind, b"") + body
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("only 8-bit greyscale without interlace is stored here")
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, width + 1)
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    rows[kinds == 1] = np.cumsum(rows[kinds == 1], axis=1, dtype=np.uint8)
    for y in np.flatnonzero(kinds > 1):
        above = rows[y - 1] if y else np.zeros(width, np.uint8)
        if kinds[y] == 2:
            rows[y] += above
        elif kinds[y] <= 4:
            rows[y] = _sequential(int(kinds[y]), rows[y], above)
        else:
            raise ValueError(f"filter {kinds[y]} is not defined")
    return rows


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(low)[:, None] / (2 * n))


_DCT = _cosines(GRID, LOW)


def _means(rows: np.ndarray, n: int) -> np.ndarray:
    """Block means along the first axis; fewer than n rows are repeated."""
    if len(rows) < n:
        return rows[np.arange(n) * len(rows) // n]
    edges = np.arange(n + 1) * len(rows) // n
    return np.add.reduceat(rows, edges[:-1], axis=0) / np.diff(edges).reshape(-1, *[1] * (rows.ndim - 1))


def cosine_hash(image: np.ndarray) -> str:
    grid = _means(_means(image.astype(np.float64).T, GRID).T, GRID)
    low = np.round(_DCT @ grid @ _DCT.T, 6).ravel()[1:]  # rounded: the same bits on every CPU
    bits = np.concatenate(([False], low > np.median(low)))
    return np.packbits(bits).tobytes().hex()


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (PNG): each whole text of docs as a binary column."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch["text"].cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array([encode_png(payload_of(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(texts(docs), kernel, "doc_id long, n_bytes long, media binary", 256)


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload (read back from the stored bytes) and feature."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        images = [decode_png(x) for x in batch["media"].to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in images], pa.binary()), pa.array([cosine_hash(x) for x in images], pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    return map_arrow(media.select("doc_id", "n_bytes", "media"), kernel, "doc_id long, n_bytes long, media binary, payload binary, feature string", 256)


def digest(read: DataFrame) -> DataFrame:
    """The stored and the read bytes, as lengths and checksums."""
    payload, media = F.col("payload"), F.col("media")
    return read.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"), "feature",
    )
