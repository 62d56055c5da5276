"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized, kept as NPY tiles with difference hashes.

Images come as binary columns. ``decode`` reads P1 to P6 Netpbm files (plain and raw, 8 and 16 bits) and
uncompressed BMP files (1, 4, 8, 24 and 32 bits, bottom-up or top-down) to arrays of height x width (x 3).
``area_resize`` averages the exact area under each target pixel by an integral image, so any ratio works in
one pass. A tile is the resized grey image in NPY format; the difference hash compares neighbours in an
8 x 9 tile: 64 bits.

The text query stores a text's bytes, padded with zeros to a positive multiple of 64, as a raw grey Netpbm
image 64 pixels wide in a written table of the shared folder, reads the table back, and writes digests, hash and
NPY tile of what it read as a second one.

Defined cases: null and empty texts are one row of zeros; a binary that isn't such an image, or is cut off,
gives null features (``media_features``) or ValueError (``decode``); equal inputs give equal values; other
columns don't matter.
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

from rankweave.llm.columns import pick, texts
from rankweave.runtime import materialize, small_batches

WIDTH = 64
TILE = 32
#: White space and comments between a header's values; possessive, so a header that isn't one is refused in linear time.
_GAP = rb"(?:\s|#[^\n\r]*+[\n\r])++"
_HEADER = re.compile(rb"P([1-6])" + _GAP + rb"(\d{1,9})" + _GAP + rb"(\d{1,9})")
_MAXVAL = re.compile(_GAP + rb"(\d{1,9})")


def decode(data: bytes) -> np.ndarray:
    """A Netpbm or BMP image as uint8 or uint16 samples; bitmaps as 0 (black) and 255."""
    if data[:2] == b"BM":
        return _bmp(data)
    if not (found := _HEADER.match(data)):
        raise ValueError("neither a Netpbm nor a BMP image")
    kind, width, height, at, top = int(found[1]), int(found[2]), int(found[3]), found.end(), 1
    if kind not in (1, 4):
        if not (most := _MAXVAL.match(data, at)):
            raise ValueError("no largest value")
        top, at = int(most[1]), most.end()
    if not (width and height and 0 < top < 65536):
        raise ValueError("bad size or largest value")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind <= 3:
        text = re.sub(rb"#[^\n\r]*", b"", data[at:])
        if kind == 1:
            samples = np.frombuffer(b"".join(text.split())[:n], np.uint8).astype(np.int64) - 48
        else:
            values = text.split()[:n]
            if any(len(v) > 9 or not v.isdigit() for v in values):
                raise ValueError("a sample that is no number")
            samples = np.array([int(v) for v in values], dtype=np.int64)
        if samples.size and (samples.min() < 0 or samples.max() > top):
            raise ValueError("a sample beyond the largest value")
    elif kind == 4:
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, offset=at + 1)[: row * height]
        if packed.size < row * height:
            raise ValueError("cut off")
        samples = np.unpackbits(packed.reshape(height, row), axis=1)[:, :width].ravel().astype(np.int64)
    else:
        samples = np.frombuffer(data[at + 1 : at + 1 + n * (1 if top < 256 else 2)], np.uint8 if top < 256 else ">u2")
    if samples.size < n:
        raise ValueError("cut off")
    if kind in (1, 4):
        samples = (1 - samples) * 255
    elif top not in (255, 65535):
        samples = (samples.astype(np.int64) * (255 if top < 256 else 65535) + top // 2) // top
    shape = (height, width, 3) if channels == 3 else (height, width)
    return samples.astype(np.uint8 if top < 256 else np.uint16).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("cut off")
    offset, size, width, height, planes, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if size < 40 or planes != 1 or width <= 0 or not height or packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or packing == 3 and bits != 32:
        raise ValueError("a BMP of a kind that isn't read")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, offset=offset)
    if raw.size < rows * stride:
        raise ValueError("cut off")
    raw = raw[: rows * stride].reshape(rows, stride)
    if bits >= 24:
        order = [2, 1, 0]  # bytes of red, green and blue
        if packing == 3:
            masks = struct.unpack_from("<III", data, 54) if len(data) >= 66 else ()
            known = {0xFF << 8 * i: i for i in range(4)}
            if len(masks) != 3 or any(m not in known for m in masks):
                raise ValueError("a BMP whose masks aren't whole bytes")
            order = [known[m] for m in masks]
        image = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, order]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, count=4 * used, offset=14 + size).reshape(-1, 4)[:, 2::-1]
        if bits == 8:
            index = raw[:, :width]
        elif bits == 4:
            index = np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)[:, :width]
        else:
            index = np.unpackbits(raw, axis=1)[:, :width]
        if index.max(initial=0) >= used:
            raise ValueError("a colour outside the palette")
        image = palette[index]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit bottom-up BMP of a height x width x 3 image."""
    rows, width, _ = image.shape
    stride = (width * 24 + 31) // 32 * 4
    body = np.zeros((rows, stride), np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(rows, width * 3)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + body.size, 0, 0, 54, 40, width, rows, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    wide = image.astype(np.float64) / (257 if image.dtype == np.uint16 else 1)
    return wide @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else wide


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of ``image`` (2-d) over the exact area of each target pixel, by its integral image."""
    rows, columns = image.shape
    whole = np.issubdtype(image.dtype, np.integer)
    integral = np.zeros((rows + 1, columns + 1), np.int64 if whole else np.float64)
    np.cumsum(np.cumsum(image, axis=0, dtype=integral.dtype), axis=1, out=integral[1:, 1:])

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
        share = (edges - low)[:, None]
        return table[low] * (1 - share) + table[low + 1] * share

    y = np.arange(height + 1) * (rows / height)
    x = np.arange(width + 1) * (columns / width)
    corners = at(x, at(y, integral).T).T
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (rows / height * columns / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: is a pixel of the 8 x 9 image darker than its right neighbour?"""
    small = area_resize(image, 8, 9)
    return np.packbits((small[:, 1:] > small[:, :-1] + 1e-9).ravel()).tobytes().hex()


def tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The grey image as a side x side uint8 tile in NPY format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def media_features(frame: DataFrame, id_column: str, media_column: str, side: int = TILE) -> DataFrame:
    """id, height, width, hash, tile (NPY bytes) of images in a binary column; null for what isn't one."""
    small_batches(frame.sparkSession, 64)
    kind = dict(frame.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    image = decode(data or b"")
                    flat = image if image.ndim == 2 and image.dtype == np.uint8 else grey(image)
                    rows.append((image.shape[0], image.shape[1], difference_hash(flat), tile(flat, side)))
                except ValueError:
                    rows.append((None,) * 4)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.record_batch({id_column: batch.column(0), "height": pa.array(columns[0], pa.int32()), "width": pa.array(columns[1], pa.int32()), "hash": pa.array(columns[2], pa.string()), "tile": pa.array(columns[3], pa.binary())})

    return pick(frame, **{id_column: kind, media_column: "binary"}).mapInArrow(run, f"`{id_column}` {kind}, height int, width int, hash string, tile binary")


def text_media(documents: DataFrame, keep: bool = False) -> DataFrame:
    """Each text stored as a grey image, and what is read back from the store; ``keep`` adds the image (media) and its NPY tile.

    Two written tables in the shared folder: ``media`` (doc_id, n_bytes, media) and ``media-tiles`` (the digests and NPY tiles
    of the stored images). The result is read from the second.
    """
    small_batches(documents.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch, "text"):
                raw = text.encode()
                padded = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
                rows.append((len(raw), encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))))
            yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": pa.array([r[0] for r in rows], pa.int64()), "media": pa.array([r[1] for r in rows], pa.binary())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2).to_pylist():
                image = decode(media)
                back = image.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), tile(image)))
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kept = {"media": batch.column(2)} if keep else {}
            yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": batch.column(1)} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)} | kept)

    stored = materialize(pick(documents, doc_id="long", text="string").mapInArrow(store, "doc_id long, n_bytes long, media binary"), "media", "zstd")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary" + (", media binary" if keep else "")
    tiles = materialize(stored.mapInArrow(read, schema), "media-tiles", "zstd")
    shown = [c for c in tiles.columns if c not in ("media", "tile")]
    return tiles.select(*shown, *(["media", "tile"] if keep else []))
