"""Media columns: Netpbm and BMP files to numpy arrays and back, area resizing by integral images, NPY tiles, difference hashes.

Decoded arrays are (height, width, channels), 8-bit. Area resizing averages the exact (fractional) source area of
each target cell with an integral image, strip by strip of rows, so memory stays bounded for tall images.

Null and empty texts are one padded row; equal texts, repeated rows included, have equal values; very long texts are
stored whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import has, prepare, stage

#: Bytes of a payload come in this unit: a row of 192 pixels with three samples each.
UNIT = 576
WIDTH = UNIT // 3


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm of an 8-bit array: P5 for one channel, P6 for three."""
    h, w, c = pixels.shape
    return b"P%d\n%d %d\n255\n" % (5 if c == 1 else 6, w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP of an 8-bit array with three channels, bottom row first."""
    h, w, _ = pixels.shape
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    head = b"BM" + (54 + rows.size).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + rows.size.to_bytes(4, "little") + bytes(16)
    return head + info + rows.tobytes()


_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with a maximum of up to 255; samples are scaled to 8 bits where the maximum is smaller."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    at, fields = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    most = fields[2] if len(fields) > 2 else 1
    if not 0 < most < 256:
        raise ValueError("only 8-bit samples")
    c = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        stride = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * stride, at + 1).reshape(h, stride), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8)[:, :, None]
    if kind == b"P1":
        bits = np.array([int(x) for x in re.findall(rb"[01]", re.sub(rb"#[^\n\r]*", b"", data[at:]))[: w * h]], np.uint8)
        return ((1 - bits) * 255).astype(np.uint8).reshape(h, w, 1)
    if kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[: w * h * c], np.int64)
    else:
        out = np.frombuffer(data, np.uint8, w * h * c, at + 1)
    if most != 255:
        out = (out.astype(np.int64) * 255 + most // 2) // most
    return out.astype(np.uint8, copy=False).reshape(h, w, c)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (with palette), 24-bit and 32-bit BMP."""
    u = lambda at, n=4: int.from_bytes(data[at : at + n], "little", signed=n == 4)
    if data[:2] != b"BM" or u(30) not in (0, 3):
        raise ValueError("not an uncompressed BMP")
    begin, head, w, h, bits = u(10), u(14), u(18), u(22), u(28, 2)
    if bits not in (8, 24, 32):
        raise ValueError("only 8, 24 and 32 bits")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), begin).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        n = u(46) or 256
        palette = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
        return np.ascontiguousarray(palette[rows])
    return np.ascontiguousarray(rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _edges(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(cells + 1) * size
    return at // cells, at % cells  # whole samples, and the rest in units of 1/cells


def area_resize(pixels: np.ndarray, height: int, width: int, strip: int = 2048) -> np.ndarray:
    """Mean over each cell's source area, as (height, width, channels) floats; sums are exact integers until the end."""
    return area_sums(pixels, height, width, strip) / (pixels.shape[0] * pixels.shape[1])


def area_sums(pixels: np.ndarray, height: int, width: int, strip: int = 2048) -> np.ndarray:
    """The means of area_resize times the number of pixels, as integers.

    The integral image of a strip of rows is read at the cells' edges by linear interpolation, in units of
    1/(height * width).
    """
    h, w, c = pixels.shape
    x, fx = _edges(w, width)
    y, fy = _edges(h, height)
    columns = np.zeros((height + 1, width + 1, c), np.int64)  # integral at the cells' edges
    above = np.zeros((w + 1, c), np.int64)
    for top in range(0, h, strip):
        part = pixels[top : top + strip]
        table = np.zeros((len(part) + 1, w + 1, c), np.int64)
        np.cumsum(part, axis=0, out=table[1:, 1:])
        np.cumsum(table[1:, 1:], axis=1, out=table[1:, 1:])
        table += above
        inside = np.flatnonzero((y >= top) & ((y < top + len(part)) | ((y == h) & (top + len(part) == h))))
        for k in inside:
            r = y[k] - top
            row = table[r] * (height - fy[k]) + (table[min(r + 1, len(part))] * fy[k])
            right = np.minimum(x + 1, w)
            columns[k] = row[x] * (width - fx)[:, None] + row[right] * fx[:, None]
        above = table[-1].copy()
    return columns[1:, 1:] - columns[:-1, 1:] - columns[1:, :-1] + columns[:-1, :-1]


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, row by row: whether a cell of the 8 x 9 grey area means is darker than its right neighbour."""
    grey = area_sums(pixels, 8, 9).sum(axis=2)
    return f"{int(''.join('1' if b else '0' for b in (grey[:, 1:] > grey[:, :-1]).ravel()), 2):016x}"


def npy_tile(pixels: np.ndarray, size: int = 16) -> bytes:
    """The area-resized image as an NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, size, size)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def text_media(spark: SparkSession, docs: DataFrame, form: str = "ppm") -> DataFrame:
    """Each whole text as a lossless image (doc_id, n_bytes, media): its UTF-8 bytes padded with 255 to whole rows.

    A null text is empty; every payload has at least one row. Equal texts give equal media; repeated rows are kept.
    """
    prepare(spark)
    encode = {"ppm": encode_ppm, "bmp": encode_bmp}[form]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                data = text or b""
                sizes.append(len(data))
                rows = max(1, -(-len(data) // UNIT))
                media.append(encode(np.frombuffer(data + b"\xff" * (rows * UNIT - len(data)), np.uint8).reshape(rows, WIDTH, 3)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return has(docs, "doc_id", "text").mapInArrow(make, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, tiles: bool = False) -> DataFrame:
    """Reads stored media back: payload size, digest and tail, the file's size and digest, difference hash, and an NPY tile if asked.

    Null or unreadable media give null features.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(2).to_pylist():
                try:
                    pixels = decode(data)
                except (TypeError, ValueError):
                    rows.append((None,) * 7)
                    continue
                payload = pixels.reshape(-1)
                rows.append((payload.size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels), npy_tile(pixels) if tiles else None))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
            keep = 7 if tiles else 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in list(zip(cols, kinds))[:keep])], ["doc_id", "n_bytes", *names[:keep]])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return has(media, "doc_id", "n_bytes", "media").mapInArrow(read, schema + ", tile binary" * tiles)


def store_and_read(spark: SparkSession, docs: DataFrame, form: str = "ppm") -> DataFrame:
    """Media of every text written to a table of the shared folder, then read back with their features and tiles."""
    return media_features(stage(spark, text_media(spark, docs, form), "media"), tiles=True)
