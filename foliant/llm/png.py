"""Binary media columns: bytes as PNG images and back, and a perceptual hash of the image.

Writing: 8-bit RGB rows of 64 pixels, each filtered by the one of None, Sub and Up with the least sum of differences,
deflated into IDAT chunks, every chunk with its checksum. Reading tests the signature, each chunk's checksum, the
header and the inflated length, and undoes all five filter types on numpy rows. The hash is the signs of the 8 x 8
lowest cosine coefficients of the image, shrunk to 32 x 32 means of brightness, against their median.

Null and empty texts are the padding alone. Repeated rows get equal values; null ids are kept. Damaged images raise
``ValueError`` in ``decode``; ``decoded`` gives null for them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small

WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
PAD = 32
LEVEL = 1
CHUNK = 1 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
_COS = np.cos(np.pi * (2 * np.arange(SIDE)[None] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def padded(data: bytes) -> bytes:
    """The bytes with PAD appended up to a positive multiple of ROW."""
    n = max(1, -(-len(data) // ROW)) * ROW
    return data.ljust(n, bytes([PAD]))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """An image of len(payload) / ROW rows."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"the payload must be a positive multiple of {ROW} bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub = rows.copy()
    sub[:, SAMPLES:] -= rows[:, :-SAMPLES]
    up = rows.copy()
    up[1:] -= rows[:-1]
    # differences count by their distance from 0 on the circle of bytes
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (rows, sub, up)])
    best = cost.argmin(axis=0).astype(np.uint8)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0] = best
    for k, x in enumerate((rows, sub, up)):
        out[best == k, 1:] = x[best == k]
    packed = zlib.compress(out.tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _slanted(kind: int, data: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Average (3) or Paeth (4) rows undone. A pixel needs those at its left, above and between; pixels whose row and
    column add up to the same number need none of each other, so they are undone together."""
    rows, width, _ = data.shape
    out = np.zeros((rows + 1, width + 1, data.shape[2]), np.int16)
    out[0, 1:] = above
    for d in range(rows + width - 1):
        r = np.arange(max(0, d - width + 1), min(rows, d + 1))
        i = d - r
        left, up, corner = out[r + 1, i], out[r, i + 1], out[r, i]
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            to_left, to_up, to_corner = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[r + 1, i + 1] = (data[r, i] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(kinds: np.ndarray, data: np.ndarray, bpp: int) -> np.ndarray:
    """The samples of filtered rows. Rows of one type that follow each other are undone together."""
    out = np.empty_like(data)
    above = np.zeros(data.shape[1], np.uint8)
    starts = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(kinds)], strict=True):
        kind, part = int(kinds[a]), data[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part.reshape(b - a, -1, bpp), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            out[a:b] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            out[a:b] = _slanted(kind, part.reshape(b - a, -1, bpp), above.reshape(-1, bpp)).reshape(b - a, -1)
        else:
            raise ValueError(f"no filter type {kind}")
        above = out[b - 1]
    return out


def decode(image: bytes) -> np.ndarray:
    """The samples as rows of bytes, after every test."""
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(image) and not ended:
        if at + 12 > len(image):
            raise ValueError("cut short")
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if len(data) != n or at + 12 + n > len(image):
            raise ValueError("cut short")
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if head is None or not ended:
        raise ValueError("header or end is missing")
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit grey or RGB images without interlace")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width * channels + 1):
        raise ValueError("the samples have another length than the header says")
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return unfilter(rows[:, 0], rows[:, 1:], channels)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: whether each low coefficient is over their median (the first, the mean, left out of the median)."""
    grey = samples.reshape(len(samples), -1, SAMPLES).sum(axis=2, dtype=np.int64)
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(axis=0).cumsum(axis=1)

    def cuts(n: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(SIDE) * n // SIDE
        return a, np.maximum(a + 1, (np.arange(SIDE) + 1) * n // SIDE)

    (ya, yb), (xa, xb) = cuts(h), cuts(w)
    mean = (total[yb][:, xb] - total[ya][:, xb] - total[yb][:, xa] + total[ya][:, xa]) / ((yb - ya)[:, None] * (xb - xa)[None])
    low = np.round(_COS @ mean @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, image, feature): each whole text as a stored image with its hash, both binary."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            images = [encode(padded(t)) for t in texts]
            hashes = [cosine_hash(decode(x)) for x in images]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(images, pa.binary()), pa.array(hashes, pa.binary())], names=["id", "n_bytes", "image", "feature"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, image binary, feature binary").withColumnRenamed("id", id_col)


def decoded(images: DataFrame, image_col: str = "image") -> DataFrame:
    """All columns of images and ``payload`` (with ``_`` added while that name is taken): the samples read back from
    image_col; null where the image is damaged."""
    names, own = images.columns, "payload"
    while own in names:
        own += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def back(x):
            try:
                return None if x is None else decode(x).tobytes()
            except ValueError:
                return None

        for batch in small(batches):
            payload = pa.array([back(x) for x in batch.column(names.index(image_col)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, payload], names=[*names, own])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return images.mapInArrow(run, StructType([*images.schema.fields, StructField(own, BinaryType())]))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the images that ``media`` stores, and of the payloads that ``decoded`` reads back from them."""
    back = decoded(media(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text"))
    return back.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.expr("crc32(substring(payload, -16, 16))").alias("tail_crc32"),
        F.octet_length("image").cast("long").alias("media_bytes"),
        F.sha2("image", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )
