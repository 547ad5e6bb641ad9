"""Frames from files or arrays.

Encoded images come through Spark's ``binaryFile`` source and are decoded in Arrow batches by a decoder that the caller
names; raw 24-bit BMP, the reference's frame format for split videos, is decoded here."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import filesystem, kept

#: Extension -> loader.
LOADERS = {"bmp": "images", "jpg": "images", "jpeg": "images", "png": "images", "gif": "images", "avi": "video", "config": "config", "task": "snapshot", "scr": "script", "uda": "sidecar"}


def loader_name(path: str) -> str:
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    if ext not in LOADERS:
        raise ValueError(f"no loader for {path}")
    return LOADERS[ext]


def loader(path: str):
    """The same of a column of paths; null where nothing reads them."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LOADERS.items() for x in pair]), end)


def decode_colours(data: bytes) -> np.ndarray:
    """Height x width x 3 levels, as stored (blue, green, red), of an uncompressed 24-bit BMP."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    offset, = struct.unpack_from("<I", data, 10)
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if bits != 24 or packed:
        raise ValueError("only uncompressed 24-bit BMP")
    stride = (width * 3 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, : width * 3].reshape(abs(height), width, 3)
    return rows if height < 0 else rows[::-1]


def decode_bmp(data: bytes) -> np.ndarray:
    """Rows x columns of grey levels (the mean of the three channels) of an uncompressed 24-bit BMP."""
    return decode_colours(data).astype(np.int64).sum(axis=2) // 3


def bmp_rows(picture: np.ndarray) -> bytes:
    """The rows of a picture (height x width, or x 3 as blue, green, red), last first, padded to four bytes."""
    height, width = picture.shape[:2]
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    colours = picture if picture.ndim == 3 else np.repeat(picture[:, :, None], 3, axis=2)
    rows[:, : width * 3] = colours[::-1].astype(np.uint8).reshape(height, width * 3)
    return rows.tobytes()


def encode_bmp(picture: np.ndarray) -> bytes:
    height, width = picture.shape[:2]
    rows = bmp_rows(picture)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, width, height, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def natural(name: Column) -> Column:
    """A key that sorts names by their runs of digits as numbers, of any length: f99999 before f100000."""
    digits = lambda r: F.regexp_replace(r, "^0+", "")
    number = lambda r: F.concat(F.lit("0"), F.lpad(F.length(digits(r)).cast("string"), 9, "0"), digits(r))
    return F.concat_ws("", F.transform(F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), lambda r: F.when(r.rlike("^[0-9]"), number(r)).otherwise(r)))


def numbered(names: DataFrame) -> DataFrame:
    """name -> name, frame_no: its place among the names, sorted by their text and their numbers.  Sorted in ranges; only the
    ranges' sizes come together."""
    keyed = names.select("name").distinct().withColumn("key", natural(F.col("name")))
    dealt = keyed.repartitionByRange("key", "name").sortWithinPartitions("key", "name").withColumn("mark", F.monotonically_increasing_id())
    dealt = kept(dealt.select("name", F.shiftright("mark", 33).alias("part"), F.col("mark").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "frame-names")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    return dealt.join(F.broadcast(before), "part").select("name", (F.col("before") + F.col("place")).cast("int").alias("frame_no"))


def _decoded(files: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """frame_no, name, content -> frame_no, name, width, height, g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grey = decode(batch.column(2)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([grey.shape[1]], pa.int32()), pa.array([grey.shape[0]], pa.int32()), pa.array([grey.ravel().tolist()], pa.list_(pa.int64()))], names=["frame_no", "name", "width", "height", "g"])

    return files.select("frame_no", "name", "content").mapInArrow(run, "frame_no int, name string, width int, height int, g array<long>")


def _files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).withColumn("name", F.element_at(F.split("path", "/"), -1))


def read_images(spark: SparkSession, paths: list[str] | str, decode: Callable[[bytes], np.ndarray] = decode_bmp) -> DataFrame:
    """frame_no, name, width, height, g of image files; frames are numbered in the order of the list, or of the names."""
    files = _files(spark, paths)
    if isinstance(paths, str):
        order = numbered(files.select("name"))  # reads no content
    else:
        order = F.broadcast(spark.createDataFrame([(os.path.basename(p), i) for i, p in enumerate(paths)], "name string, frame_no int"))  # the caller's list
    return _decoded(files.join(order, "name"), decode)


def read_split_video(spark: SparkSession, folder: str, video: str, decode: Callable[[bytes], np.ndarray] = decode_bmp) -> DataFrame:
    """The frames that a splitter left beside a video, named after it with a number: frame_no, name, width, height, g."""
    stem = os.path.splitext(os.path.basename(video))[0]
    files = _files(spark, f"{folder.rstrip('/')}/{stem}*.bmp").withColumn("frame_no", F.regexp_extract("name", r"(\d+)\.bmp$", 1).try_cast("int"))
    return _decoded(files.where(F.col("frame_no").isNotNull()), decode)


def write_images(frames: DataFrame, folder: str, encode: Callable[[np.ndarray], bytes] = encode_bmp, colours: bool = False) -> DataFrame:
    """frames (name, width, height, g) -> name, bytes of the files written; with colours, g holds three levels a pixel.  A task
    that runs twice writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for name, width, height, g in zip(*batch.columns, strict=True):
                shape = (height.as_py(), width.as_py(), 3) if colours else (height.as_py(), width.as_py())
                data = encode(np.array(g.as_py()).reshape(shape))
                with files.open_output_stream(f"{base}/{name.as_py()}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return kept(frames.select("name", "width", "height", "g").mapInArrow(run, "name string, bytes long"), "frame-manifest")


def write_video(frames: DataFrame, folder: str, fps: int) -> DataFrame:
    """frames (video, frame_no, width, height, g) -> video, frames, bytes: one uncompressed AVI a video, <video>.avi.  A video is
    one file, so one task writes it."""
    from . import avi

    def run(table: pa.Table) -> pa.Table:
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        rows = sorted(table.select(["frame_no", "width", "height", "g"]).to_pylist(), key=lambda r: r["frame_no"])
        data = avi.encode([np.array(r["g"]).reshape(r["height"], r["width"]) for r in rows], fps)
        video = table.column("video")[0].as_py()
        with files.open_output_stream(f"{base}/{video}.avi") as out:
            out.write(data)
        return pa.table({"video": pa.array([video]), "frames": pa.array([len(rows)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    return kept(frames.groupBy("video").applyInArrow(run, "video string, frames long, bytes long"), "video-manifest")


def read_videos(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """video, frame_no, width, height, g (grey) of uncompressed AVI files."""
    from . import avi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                for k, picture in enumerate(avi.decode(content.as_py())):
                    grey = picture.astype(np.int64).sum(axis=2) // 3
                    yield pa.RecordBatch.from_arrays([pa.array([os.path.splitext(name.as_py())[0]]), pa.array([k], pa.int32()), pa.array([grey.shape[1]], pa.int32()), pa.array([grey.shape[0]], pa.int32()), pa.array([grey.ravel().tolist()], pa.list_(pa.int64()))], names=["video", "frame_no", "width", "height", "g"])

    return _files(spark, paths).select("name", "content").mapInArrow(run, "video string, frame_no int, width int, height int, g array<long>")


def navigation(count, frame, typed) -> tuple:
    """Columns of a viewer's moves from ``frame`` among ``count``: next and previous, around the ends, and a typed number,
    held within them."""
    return F.pmod(frame + 1, count), F.pmod(frame - 1, count), F.greatest(F.lit(0), F.least(typed, count - 1))


def from_arrays(raw: DataFrame, width: int, height: int) -> DataFrame:
    """frame_no, g -> frame_no, width, height, g, with the size checked."""
    ok = F.when(F.size("g") == width * height, F.col("g")).otherwise(F.raise_error(F.lit("frame of another size")))
    return raw.select("frame_no", F.lit(width).alias("width"), F.lit(height).alias("height"), ok.alias("g"))


def pixels(frames: DataFrame) -> DataFrame:
    """One row a pixel."""
    p = frames.select("frame_no", "width", F.posexplode("g").alias("k", "g"))
    return p.select("frame_no", (F.col("k") % F.col("width")).cast("long").alias("x"), F.floor(F.col("k") / F.col("width")).alias("y"), "g")
