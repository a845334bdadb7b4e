"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by integral images, stored as NPY tiles
together with difference hashes.

Images are decoded inside tasks, one row at a time; nothing is shuffled. A null or undecodable image gives a null tile and
hash in ``media_tiles``. For ``text_media`` a null text counts as empty, an empty one becomes one padded block, texts of
any length are streamed through the integral image by bands of rows, equal texts give equal values, and an empty table an
empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

SIDE = 24  # samples in a row; a block is SIDE * SIDE bytes
BLOCK = SIDE * SIDE
BAND = 4096  # rows that are summed at once

_HEADER = re.compile(rb"P([2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def encode_pgm(samples: bytes, width: int) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits a pixel, bottom row first. image: height x width x 3, RGB."""
    h, w, _ = image.shape
    row = -(-w * 3 // 4) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = image[::-1, :, ::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + h * row, 0, 0, 54, 40, w, h, 1, 24, 0, h * row, 2835, 2835, 0, 0) + body.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    m = _HEADER.match(data)
    if not m:
        raise ValueError("not a P2, P3, P5 or P6 file")
    kind, w, h, top = (int(x) for x in m.groups())
    if not (0 < top < 65536 and w and h):
        raise ValueError("no samples, or no largest value from 1 to 65535")
    n = w * h * (3 if kind in (3, 6) else 1)
    if n > len(data):  # not even a byte for each sample
        raise ValueError("fewer samples than the header says")
    if kind in (5, 6):
        image = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, m.end())
    else:
        image = np.array([int(x) for x in data[m.end() :].split()[:n]])
        if len(image) < n:
            raise ValueError("fewer samples than the header says")
    if image.min() < 0 or image.max() > top:
        raise ValueError("a sample below 0 or above the largest value")
    image = image if top == 255 else np.rint(image.astype(np.float64) * 255 / top)
    return image.astype(np.uint8, copy=False).reshape((h, w, 3) if kind in (3, 6) else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    start, head, w, h, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if data[:2] != b"BM" or packed or bits not in (8, 24, 32):
        raise ValueError("not an uncompressed BMP of 8, 24 or 32 bits")
    row, high = -(-w * bits // 32) * 4, abs(h)
    if w <= 0 or not high or row * high > len(data):
        raise ValueError("no samples, or fewer than the header says")
    body = np.frombuffer(data, np.uint8, row * high, start).reshape(high, row)[:, : w * bits // 8]
    body = body[::-1] if h > 0 else body
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1]
        return palette[body]
    return body.reshape(high, w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma in thousandths for colour, so that sums stay whole numbers."""
    return image if image.ndim == 2 else (image.astype(np.int64) @ np.array([299, 587, 114])) // 1000


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from the integral image at the areas' (fractional) edges, taken by linear interpolation.

    Rows are summed a band at a time; only the values at the edges are kept, so memory does not grow with the image.
    """
    h, w = image.shape
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    at_y, at_x = np.minimum(ys.astype(np.int64), h - 1), np.minimum(xs.astype(np.int64), w - 1)
    lines = {y: None for y in np.unique(np.concatenate([at_y, at_y + 1])).tolist()}
    if 0 in lines:
        lines[0] = np.zeros(w + 1, np.int64)
    total = np.zeros(w + 1, np.int64)
    for top in range(0, h, BAND):
        band = image[top : top + BAND]
        integral = np.zeros((len(band) + 1, w + 1), np.int64)
        np.cumsum(np.cumsum(band, axis=0, dtype=np.int64), axis=1, out=integral[1:, 1:])
        for y in [y for y in lines if top < y <= top + len(band)]:
            lines[y] = total + integral[y - top]
        total = total + integral[-1]
    low, high = np.stack([lines[y] for y in at_y.tolist()]), np.stack([lines[y] for y in (at_y + 1).tolist()])
    edge = low + (high - low) * (ys - at_y)[:, None]
    edge = edge[:, at_x] + (edge[:, at_x + 1] - edge[:, at_x]) * (xs - at_x)[None, :]
    return (edge[1:, 1:] - edge[:-1, 1:] - edge[1:, :-1] + edge[:-1, :-1]) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: is each cell of 8 x 9 darker than its right neighbour."""
    small = area_resize(gray(image), 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_bytes(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def npy_array(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def media_tiles(df: DataFrame, image: str, height: int = 0, width: int = 0) -> DataFrame:
    """Adds ``tile`` (NPY bytes: the image, area-resized to height x width in gray if these are given) and ``dhash``. Columns of
    these names are replaced."""
    df = df.drop("tile", "dhash")
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, tiles, hashes = batch.slice(k, 256), [], []
                for data in part.column(names.index(image)):
                    try:
                        pixels = decode(data.as_py())
                        hashes.append(difference_hash(pixels))
                        tiles.append(npy_bytes(np.rint(area_resize(gray(pixels), height, width)).astype(np.uint8) if height else pixels))
                    except (ValueError, TypeError, OverflowError, struct.error, IndexError):
                        hashes = hashes[: len(tiles)] + [None]
                        tiles.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tiles, pa.binary()), pa.array(hashes, pa.string())], [*names, "tile", "dhash"])

    schema = T.StructType([*df.schema.fields, T.StructField("tile", T.BinaryType()), T.StructField("dhash", T.StringType())])
    return df.mapInArrow(work, schema)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media): each text's bytes, padded with 255 to whole blocks, as a PGM image."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = part.column(1).to_pylist()
                padded = [x.ljust(max(1, -(-len(x) // BLOCK)) * BLOCK, b"\xff") for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode_pgm(x, SIDE) for x in padded], pa.binary())], ["doc_id", "n_bytes", "image"]
                )

    return rows.mapInArrow(work, "doc_id bigint, n_bytes bigint, image binary")


def stored_tiles(tiles: DataFrame, image: str = "image") -> DataFrame:
    """Writes the tiles, with all columns but the image they come from, as a table in the shared folder, and reads it."""
    return Scratch(tiles.sparkSession, "tiles").put(tiles.drop(image))


def tile_digests(tiles: DataFrame) -> DataFrame:
    """Reads NPY tiles back: adds payload_bytes, payload_sha256, tail_crc32; drops the tile."""
    names = tiles.columns
    keep = [n for n in names if n not in ("tile", "image")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, crcs, media, media_shas = [], [], [], [], []
            for tile in batch.column(names.index("tile")):
                stored = tile.as_py()
                payload = npy_array(stored).tobytes()
                sizes.append(len(payload))
                shas.append(hashlib.sha256(payload).hexdigest())
                crcs.append(zlib.crc32(payload[-32:]))
                media.append(len(stored))
                media_shas.append(hashlib.sha256(stored).hexdigest())
            new = [pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(crcs, pa.int64()), pa.array(media, pa.int64()), pa.array(media_shas, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in keep), *new], [*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema if f.name in keep)
    return tiles.mapInArrow(work, f"{kept}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string")
