"""Media columns: Netpbm and BMP bytes as numpy arrays, area-resized tiles and difference hashes.

`decode` reads P1 to P6 (8 and 16 bit) and uncompressed BMP of 1, 4, 8, 24 and 32 bit;
`encode_pgm` and `encode_bmp` write.  `area_resize` averages over the exact source area of each
target cell by an integral image (summed-area table) with bilinear reading at fractional
corners.  `difference_hash` compares neighbours of a (size + 1) x size tile.  `npy` gives a tile as NPY bytes.

Work is per row, in Arrow batches, without a shuffle: memory is a batch of inputs and one image.
A text is stored as binary PGM, from BMP_FROM payload bytes on as 8-bit grey BMP, so equal texts have equal images.
Defined cases: null and empty texts are 64 zero bytes; null and broken image bytes raise ValueError in
`decode`, and in `media_columns` and `image_digests` give null in every derived column.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import field, read, with_columns

#: Bytes of an image row in which a text is stored; the payload is padded to a multiple of it.
ROW = 64
#: Payloads of so many bytes or more are stored as BMP, whose head of 1,078 bytes is then under 7 per cent.
BMP_FROM = 16_384
#: Side of the NPY tile of an image.
TILE = 32


def encode_pgm(samples: np.ndarray) -> bytes:
    """An (height, width) uint8 array as binary PGM (P5)."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An (height, width) uint8 array as 8-bit grey BMP, bottom row first."""
    height, width = samples.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def decode(raw: bytes) -> np.ndarray:
    """The samples of a Netpbm or BMP image: (height, width) or (height, width, 3)."""
    if raw[:2] == b"BM":
        return _decode_bmp(raw)
    if len(raw) > 2 and raw[:1] == b"P" and raw[1:2] in b"123456":
        return _decode_netpbm(raw)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(raw: bytes) -> np.ndarray:
    kind, at, numbers = raw[1] - 48, 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at : at + 1] == b"#"):
            at = (raw.find(b"\n", at) if b"\n" in raw[at:] else len(raw)) if raw[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(raw) and raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        numbers.append(int(raw[at:end]))
        at = end
    width, height, top = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    if not (width and height and 0 < top < 65536):
        raise ValueError("empty Netpbm image")
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    if kind < 4:
        body = raw[at:]
        values = np.frombuffer(body, np.uint8)[np.isin(np.frombuffer(body, np.uint8), (48, 49))] - 48 if kind == 1 else np.array(body.split()[:count], np.int64)
        if len(values) < count:
            raise ValueError("short Netpbm image")
        samples = values[:count].astype(np.uint8 if top < 256 else np.uint16)
        samples = 1 - samples if kind == 1 else samples
    else:
        at += 1  # one white space ends the header
        if kind == 4:
            stride = -(-width // 8)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, stride * height, at).reshape(height, stride), axis=1)
            samples = (1 - bits[:, :width]).astype(np.uint8)
        else:
            samples = np.frombuffer(raw, np.uint8 if top < 256 else ">u2", count, at)
    return samples.reshape((height, width, 3) if channels == 3 else (height, width))


def _decode_bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise ValueError("short BMP")
    start = struct.unpack_from("<I", raw, 10)[0]
    head, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("this kind of BMP isn't read")
    stride, rows = -(-width * bits // 32) * 4, abs(height)
    body = np.frombuffer(raw, np.uint8, stride * rows, start).reshape(rows, stride)
    body = body if height < 0 else body[::-1]
    if bits >= 24:
        return body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    if bits == 8:
        index = body[:, :width]
    else:
        index = np.unpackbits(body, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
        index = index[:, :width]
    n = struct.unpack_from("<I", raw, 46)[0] or 1 << bits
    palette = np.frombuffer(raw, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
    colours = palette[np.minimum(index, n - 1)]
    grey = bool((palette == palette[:, :1]).all())
    return colours[:, :, 0] if grey else colours


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """float64 means over the exact area of each target cell, by an integral image."""
    if samples.ndim == 3:
        return np.stack([area_resize(samples[:, :, c], height, width) for c in range(samples.shape[2])], axis=2)
    rows, cols = samples.shape
    integral = np.zeros((rows + 1, cols + 1))
    np.cumsum(np.cumsum(samples, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])
    at_rows = _between(integral, np.linspace(0, rows, height + 1))
    corners = _between(at_rows.T, np.linspace(0, cols, width + 1)).T
    cells = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return cells / (rows / height) / (cols / width)


def _between(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    low = np.minimum(at.astype(np.int64), len(table) - 2)
    part = (at - low)[:, None]
    return table[low] * (1 - part) + table[low + 1] * part


def difference_hash(samples: np.ndarray, size: int = 8) -> str:
    """size x size bits in hex: is a cell of the resized image darker than its right neighbour."""
    grey = samples.mean(axis=2) if samples.ndim == 3 else samples
    tile = np.round(area_resize(grey, size, size + 1), 6)
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def tile_of(samples: np.ndarray, side: int = TILE) -> np.ndarray:
    """A side x side uint8 tile."""
    return np.clip(np.round(area_resize(samples, side, side)), 0, 255).astype(np.uint8)


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def media_columns(df: DataFrame, image_col: str, tile: int = TILE) -> DataFrame:
    """df with height, width, channels, tile_npy (tile x tile uint8 NPY) and dhash of each image; null where it can't be read."""

    def derive(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("height", "width", "channels", "tile_npy", "dhash")}
        for raw in batch.column(batch.schema.get_field_index(image_col)):
            try:
                samples = decode(raw.as_py() or b"")
                row = (samples.shape[0], samples.shape[1], samples.shape[2] if samples.ndim == 3 else 1, npy(tile_of(samples, tile)), difference_hash(samples))
            except (ValueError, IndexError, struct.error):
                row = (None,) * 5
            for values, value in zip(out.values(), row, strict=True):
                values.append(value)
        return out

    kinds = {"height": "int", "width": "int", "channels": "int", "tile_npy": "binary", "dhash": "string"}
    return with_columns(df, [field(n, k) for n, k in kinds.items()], derive)


def payload_image(text: str | None) -> tuple[bytes, int]:
    """(image bytes, unpadded length) of a text: UTF-8 and zero bytes up to a positive multiple of ROW, ROW samples a row."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // ROW))
    samples = np.zeros(rows * ROW, np.uint8)
    samples[: len(raw)] = np.frombuffer(raw, np.uint8)
    return (encode_bmp if len(samples) >= BMP_FROM else encode_pgm)(samples.reshape(rows, ROW)), len(raw)


def text_images(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with image (PGM or BMP bytes) and n_bytes of each whole text."""

    def make(batch: pa.RecordBatch) -> dict:
        made = [payload_image(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
        return {"image": [m[0] for m in made], "n_bytes": [m[1] for m in made]}

    return with_columns(df, [field("image", "binary"), field("n_bytes", "long")], make)


def image_digests(df: DataFrame, image_col: str = "image") -> DataFrame:
    """df with the digests of each stored image, of the payload read back from it and of its NPY tile, and its difference hash."""
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "tile_sha256": "string"}

    def digest(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in kinds}
        for raw in batch.column(batch.schema.get_field_index(image_col)):
            stored = raw.as_py()
            try:
                samples = decode(stored or b"")
                payload = samples.tobytes()
                row = (
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(),
                    difference_hash(samples), hashlib.sha256(npy(tile_of(samples))).hexdigest(),
                )
            except (ValueError, IndexError, struct.error):
                row = (None,) * len(kinds)
            for values, value in zip(out.values(), row, strict=True):
                values.append(value)
        return out

    return with_columns(df, [field(n, k) for n, k in kinds.items()], digest)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = text_images(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return image_digests(images).drop("image")


QUERIES = {"op7_media_columns": op7_media_columns}
ORACLES: dict[str, str] = {}
