"""
Media columns: texts as progressive JPEG images, stored losslessly, read back, decoded to RGB tensors, and described.

A text's bytes, filled up with spaces to whole units of three blocks, are the quantised coefficients of an image (the format's own
unit, one byte each): frequent bytes become small coefficients, luma blocks come first, then chroma at half resolution. The images are a binary column of a
Parquet table in the shared folder. Reading takes the bytes from that column alone: all scans are accumulated into coefficients, which give the payload
back; the inverse transform and the upsampling of chroma give the full-resolution tensor. Tensors are stored as columns of a second table, two bytes for
each byte of text before Parquet's compression, and features are computed from that table alone. All tensors of a table can be kept (``stored_tensors``); where only
their features are wanted (``described_in_waves``), the images' files are dealt over waves, and a wave's tensors are removed when their features are written.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import common, jpeg

UNIT = 192
#: Text bytes whose images are coded together.
STEP = 2 << 20
#: Waves at most, bytes of images from which one more is worth its jobs, and bytes of a row group of images, the least that a task of a wave reads.
WAVES, WAVE_BYTES, GROUP_BYTES = 16, 32 << 20, 8 << 20

# Bytes that are frequent in prose, most frequent first; the others follow in order of their numbers.
_FREQUENT = b" etanoihrsdlucmgfpwyb.,v\n" + bytes([0xC3]) + b"kSEATONIHRD!|#$%&*xjqz"


def _coefficients() -> np.ndarray:
    """Coefficient of each byte: 0, 1, -1, 2, -2, ... in the order of frequency."""
    order = [*_FREQUENT, *(b for b in range(256) if b not in _FREQUENT)]
    out = np.zeros(256, np.int32)
    out[order] = [(k + 1) // 2 * (1 if k % 2 else -1) for k in range(256)]
    return out


COEFFICIENT = _coefficients()
_BYTE = np.zeros(512, np.uint8)
_BYTE[COEFFICIENT + 256] = np.arange(256)


def payloads(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(payload bytes of all texts, units of each): filled up with spaces to a positive multiple of UNIT."""
    sizes = np.diff(off)
    counts = np.maximum(1, -(-sizes // UNIT))
    out = np.full(int(counts.sum()) * UNIT, 32, np.uint8)
    starts = (np.cumsum(counts) - counts) * UNIT
    out[np.repeat(starts - off[:-1], sizes) + np.arange(len(data))] = data
    return out, counts


def encode_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` as row, n_bytes (of the text, without filling) and media, the image. Null texts are empty: one unit of spaces. Equal texts have equal images, in whatever rows; an empty table gives no rows."""
    inner = docs.select(F.struct(*keep).alias("row"), common.text_of().alias("text"))
    schema = inner.select("row").schema.simpleString()[7:-1].replace("row:", "row ", 1)

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, most=STEP):
                data, off = common.array_bytes(part.column("text"))
                payload, counts = payloads(data, off)
                images = jpeg.encode(COEFFICIENT[payload].reshape(-1, 64), counts * (UNIT // 64))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(off), pa.int64()), pa.array(images, pa.binary())], ["row", "n_bytes", "media"])

    return ship(inner).mapInArrow(run, f"{schema}, n_bytes long, media binary")


def payload_of(reader: jpeg.Reader, k: int) -> bytes:
    (n,) = struct.unpack(">I", reader.images[k].comments[0])
    return _BYTE[reader.stored(k)[:n] + 256].tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel (in thousandths) and a histogram of luma in 8 bins, of a tensor (height, width, 3)."""
    h, w, _ = rgb.shape
    means = [int(rgb[..., k].sum(dtype=np.int64)) * 1000 // (h * w) for k in range(3)]
    luma = rgb[..., 0] * np.uint16(77)
    luma += rgb[..., 1] * np.uint16(150)
    luma += rgb[..., 2] * np.uint16(29)
    bins = np.bincount((luma >> np.uint16(13)).ravel(), minlength=8)
    return f"{w}x{h};{','.join(map(str, means))};{','.join(map(str, bins.tolist()))}"


def decode_media(table: DataFrame, keep: tuple[str, ...] = ("row", "n_bytes")) -> DataFrame:
    """
    ``keep`` of ``table`` (which has media) as kept, with payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes,
    media_sha256, and the tensor: width, height and rgb (height * width * 3 bytes).
    """
    names = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "width": "int", "height": "int", "rgb": "binary"}

    def rows(part: pa.RecordBatch) -> list[tuple]:
        media = part.column("media").to_pylist()
        reader = jpeg.Reader(media)
        for k, m in enumerate(media):
            payload, rgb = payload_of(reader, k), reader.rgb(k)
            yield len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), rgb.shape[1], rgb.shape[0], rgb.tobytes()

    return _mapped(table.select(F.struct(*keep).alias("kept"), "media"), "media", rows, names, STEP)


def stored_tensors(table: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``decode_media`` written to the shared folder (to ``path``, of ``common.new_path``, if given) and read again: a table of tensors, each beside the facts of its image."""
    return common.written(decode_media(table), "tensors", path=path, codec="zstd")


def stored_images(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows of ``encode_texts`` written to ``path`` (of ``common.new_path``) and read again."""
    return common.written(encode_texts(docs, keep), "media", path=path, codec="zstd", group_bytes=GROUP_BYTES)


def described(tensors: DataFrame, keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """``keep`` of ``tensors`` (which has width, height and rgb) as kept, with feature."""

    def rows(part: pa.RecordBatch) -> list[tuple]:
        for w, h, rgb in zip(*(part.column(c).to_pylist() for c in ("width", "height", "rgb")), strict=True):
            yield (feature(np.frombuffer(rgb, np.uint8).reshape(h, w, 3)),)

    return _mapped(tensors.select(F.struct(*keep).alias("kept"), "width", "height", "rgb"), "rgb", rows, {"feature": "string"}, 4 * STEP)


def waves(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of the table at ``path`` in WAVES parts at most, of WAVE_BYTES or more, as even as whole files allow."""
    files = common.files(spark, path)
    parts = max(1, min(WAVES, len(files), sum(size for _, size in files) // WAVE_BYTES))
    dealt, held = [[] for _ in range(parts)], [0] * parts
    for name, size in sorted(files, key=lambda f: (-f[1], f[0])):
        least = held.index(min(held))
        dealt[least].append(name)
        held[least] += size
    return dealt


def described_in_waves(images: DataFrame, path: str, keep: tuple[str, ...]) -> DataFrame:
    """
    ``described`` of the tensors of all ``images``, which are the table at ``path``. The tensors of one wave are stored at a time, read back, and removed when their features are
    in a table of the shared folder. An image's tensor is some 2.7 times its size as compressed, so that all of them would need far more room than the images.
    """
    spark = images.sparkSession
    out = common.new_path(spark, "features")
    for files in waves(spark, path):
        with common.scratch(spark):
            got = described(stored_tensors(spark.read.schema(images.schema).parquet(*files)), keep)
            got.write.mode("append").parquet(out)
    return spark.read.schema(got.schema).parquet(out)


def _mapped(inner: DataFrame, column: str, rows, names: dict[str, str], step: int) -> DataFrame:
    """kept, and the columns ``names`` of what ``rows`` gives for batches with about ``step`` bytes in ``column``."""
    schema = inner.select("kept").schema.simpleString()[7:-1].replace("kept:", "kept ", 1)
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, column, step):
                cols = [pa.array(c, types[t]) for c, t in zip(zip(*rows(part), strict=True), names.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("kept"), *cols], ["kept", *names])

    return ship(inner).mapInArrow(run, schema + "".join(f", {n} {t}" for n, t in names.items()))


def op9_media(spark, sf_dir: str) -> DataFrame:
    """
    Every whole text of ``documents`` as an image: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Two tables are
    written, of images and (in waves) of their tensors; the first five columns after n_bytes come from the images read back, the feature from the tensors read back.
    """
    path = common.new_path(spark, "media")
    images = stored_images(common.table(spark, sf_dir, "documents"), path)
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    got = described_in_waves(images, path, keep=("kept.row.doc_id", "kept.n_bytes", *names))
    return got.select("kept.doc_id", "kept.n_bytes", *(f"kept.{n}" for n in names), "feature")
