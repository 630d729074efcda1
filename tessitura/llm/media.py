"""Media columns: Netpbm and BMP images as numpy arrays, tiles and hashes.

Images are decoded from a binary column, resized by area with integral images,
and written as NPY tiles with difference hashes: a table in the shared folder
has each image's tile as the bytes of an NPY file. ``encode_pgm`` stores any
payload losslessly as the 8-bit samples of a grey image.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbers, slices

WIDTH = 64
TILE = (32, 32)
#: Magic numbers of Netpbm: (samples a pixel, stored as text, one bit each).
NETPBM = {b"P1": (1, True, True), b"P2": (1, True, False), b"P3": (3, True, False), b"P4": (1, False, True), b"P5": (1, False, False), b"P6": (3, False, False)}
_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of (height, width, samples); bitmaps as 0 (black) and 255.

    Samples over the header's maximum, or a maximum that isn't in 1 to 65535, are errors.
    """
    if data[:2] not in NETPBM:
        raise ValueError("not a Netpbm image")
    samples, as_text, bits = NETPBM[data[:2]]
    at, fields = 2, []
    for _ in range(2 if bits else 3):
        m = _FIELD.match(data, at)
        if m is None:
            raise ValueError("header is cut off")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = fields[0], fields[1], 1 if bits else fields[2]
    count = width * height * samples
    if not 0 < most < 65536:
        raise ValueError("the largest sample is out of range")
    if count > 8 * len(data):  # not even a bit for each
        raise ValueError("samples are missing")
    if as_text:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        values = np.array([c - 48 for c in body if c in b"01"] if bits else body.split(), dtype=np.int64)
    elif bits:
        row = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        values = np.unpackbits(raw, axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at + 1)
    if len(values) < count:
        raise ValueError("samples are missing")
    values = values[:count].reshape(height, width, samples)
    if count and (as_text or most not in (255, 65535)) and not 0 <= values.min() <= values.max() <= most:
        raise ValueError("a sample is out of range")
    if bits:
        return ((1 - values) * 255).astype(np.uint8)
    return values.astype(np.uint8 if most < 256 else np.uint16)


def encode_netpbm(image: np.ndarray) -> bytes:
    """A uint8 array of (height, width) or (height, width, 1 or 3) as P5 or P6."""
    image = image if image.ndim == 3 else image[:, :, None]
    magic = {1: b"P5", 3: b"P6"}[image.shape[2]]
    return b"%s\n%d %d\n255\n" % (magic, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def _field(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits under a mask as 8-bit samples; 0 without a mask."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    return np.round(((values & np.uint32(mask)) >> np.uint32(low)) * (255 / top)).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits as (height, width, 3); bit fields by their masks, 5 bits a sample at 16 without."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    word = lambda at, size=4, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    start, header, width, height, depth = word(10), word(14), word(18, signed=True), word(22, signed=True), word(28, 2)
    fields = word(30) == 3
    if word(30) not in (0, 3) or depth not in (1, 4, 8, 16, 24, 32) or fields and depth not in (16, 32):
        raise ValueError("compressed, or of an unknown depth")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if width < 1 or stride * rows > len(data):
        raise ValueError("samples are missing")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if fields or depth == 16:
        values = raw[:, : width * depth // 8].copy().view("<u4" if depth == 32 else "<u2").astype(np.uint32)
        masks = [word(at) for at in (54, 58, 62)] if fields else [0x7C00, 0x03E0, 0x001F]
        image = np.stack([_field(values, m) for m in masks], axis=2)
    elif depth >= 24:
        step = depth // 8
        image = raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
    else:
        bits = np.unpackbits(raw, axis=1)[:, : width * depth].reshape(rows, width, depth)
        index = bits @ (1 << np.arange(depth - 1, -1, -1))
        colours = word(46) or 1 << depth
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(colours, 4)
        image = palette[index][:, :, 2::-1]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """A uint8 array of (height, width, 3) as a 24-bit BMP."""
    height, width, _ = image.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    header = b"BM" + (54 + rows.size).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = b"".join(x.to_bytes(4, "little") for x in (40, width, height)) + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + rows.size.to_bytes(4, "little") + bytes(16)
    return header + info + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over the area that each pixel of the result covers, by an integral image."""
    image = image if image.ndim == 3 else image[:, :, None]
    rows, columns, samples = image.shape
    total = np.zeros((rows + 1, columns + 1, samples))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def edges(n: int, parts: int):
        at = np.arange(parts + 1) * (n / parts)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, (at - low)[:, None]

    (y, fy), (x, fx) = edges(rows, height), edges(columns, width)
    across = total[:, x] * (1 - fx) + total[:, x + 1] * fx
    both = across[y] * (1 - fy[:, :, None]) + across[y + 1] * fy[:, :, None]
    return np.diff(np.diff(both, axis=0), axis=1) / ((rows / height) * (columns / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits along the rows, then 64 along the columns, as 32 hex digits."""
    grey = image.mean(axis=2, keepdims=True) if image.ndim == 3 and image.shape[2] > 1 else image
    small = np.round(area_resize(grey, 9, 9)[:, :, 0], 6)
    bits = np.concatenate([(small[:8, 1:] > small[:8, :-1]).ravel(), (small[1:, :8] > small[:-1, :8]).ravel()])
    return np.packbits(bits).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def describe(media: DataFrame, key: str = "doc_id", column: str = "media", tile: tuple[int, int] = TILE, with_tiles: bool = False) -> DataFrame:
    """Decodes ``column`` and describes each image.

    Returns the key, height, width, samples, the bytes and SHA-256 of the
    decoded samples, the crc32 of their last 64 bytes, the bytes and SHA-256
    of the stored form, the difference hash, and with ``with_tiles`` the image
    resized to ``tile`` as the bytes of an NPY file.

    Where the column is null or can't be decoded, ``error`` says so and what
    needs the samples is null. Repeated and null keys stay rows of their own;
    other columns are dropped; an empty table gives no rows.
    """
    kind = media.schema[key].dataType.simpleString()
    names = ["height", "width", "samples", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", *(["tile"] if with_tiles else [])]
    types = [pa.int32()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *([pa.binary()] if with_tiles else [])]
    schema = f"{key} {kind}, height int, width int, samples int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string" + ", tile binary" * with_tiles

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 9 + ("null",) + (None,) * with_tiles
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            image = decode(data)
        except (ValueError, IndexError, OverflowError, MemoryError) as e:
            return (None,) * 6 + stored + (None, str(e)) + (None,) * with_tiles
        raw = image.tobytes()
        shape = (*image.shape, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        if not image.size:
            return shape + stored + (None, "empty") + (None,) * with_tiles
        tiles = (npy(np.round(np.round(area_resize(image, *tile), 6)).astype(image.dtype)),) if with_tiles else ()
        return shape + stored + (difference_hash(image), None) + tiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            columns = zip(*map(one, numbers(batch, column)), strict=True)
            arrays = [pa.array(x, type=t) for x, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *arrays], names=[key, *names])

    return media.select(key, column).mapInArrow(run, schema)


def encode_pgm(payload: Column, width: int = WIDTH) -> Column:
    """Bytes as the samples of a grey image of ``width``, with bytes 0 up to whole rows and one row at least."""
    size = F.octet_length(payload)
    rows = F.greatest(F.lit(1), F.ceil(size / width)).cast("int")
    header = F.concat(F.lit(f"P5\n{width} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(header, payload, F.substr(F.lit(bytes(width)), F.lit(1), (rows * width - size).cast("int")))


def store_texts(docs: DataFrame) -> DataFrame:
    """Stores every text's UTF-8 as a PGM image in a table of the shared folder: doc_id, n_bytes, media. A null text counts as empty."""
    payload = F.coalesce("text", F.lit("")).cast("binary")
    return materialise(docs.select("doc_id", F.octet_length(payload).cast("long").alias("n_bytes"), encode_pgm(payload).alias("media")), "media")


def write_tiles(media: DataFrame, key: str = "doc_id", column: str = "media", tile: tuple[int, int] = TILE) -> DataFrame:
    """``describe`` with tiles, written as a table in the shared folder and read back: one row per image, its NPY file in ``tile``."""
    return materialise(describe(media, key, column, tile, with_tiles=True), "tiles")


def text_features(docs: DataFrame) -> DataFrame:
    """Texts stored as images, read back, described and written as NPY tiles.

    ``n_bytes`` is taken from the text; all else from the stored bytes.
    ``feature`` is the difference hash and, behind a colon, the SHA-1 of the
    NPY file as it was written.
    """
    keyed = store_texts(docs).select(F.struct("doc_id", "n_bytes").alias("key"), "media")
    feature = F.concat_ws(":", "feature", F.sha1("tile")).alias("feature")
    return write_tiles(keyed, key="key").select("key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)
