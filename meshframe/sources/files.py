"""File listings and per-file decoding of arrays and images."""

from __future__ import annotations

import io
import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.operators.curation import LANDMARK_COUNT, LANDMARK_DIM
from meshframe.session import path_exists

# File bytes travel to Python, so batches of files are kept small.
_FILES_PER_BATCH = 64


def file_name(path: str | Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem_of(name: Column) -> Column:
    """Name without its last extension; leading dots do not start an extension."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def _binary_files(spark: SparkSession, folder: str, ext: str) -> DataFrame:
    glob = "*" + re.sub(r"([\[\]{}*?\\])", r"\\\1", ext)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def scan_files(spark: SparkSession, folder: str, ext: str) -> DataFrame:
    """Files of a folder ending in ``ext`` (case-sensitive, not recursive): (stem, path, length).

    Contents are not read. Stems are unique; a missing folder is an error. Names that start with ``_`` or ``.``
    are no data: Spark's file sources keep them for logs and half-written files and do not list them.
    """
    return listed(_binary_files(spark, folder, ext).select("path", "length"), ext)


def listed(files: DataFrame, ext: str) -> DataFrame:
    """Listing rows (path, length) that end in ``ext``, one per stem, the smallest path of equal stems."""
    hidden = F.substring(file_name("path"), 1, 1).isin("_", ".")
    named = files.where(F.endswith("path", F.lit(ext)) & ~hidden).select(stem_of(file_name("path")).alias("stem"), "path", "length")
    return named.groupBy("stem").agg(F.min(F.struct("path", "length")).alias("_f")).select("stem", "_f.*")


def list_names(spark: SparkSession, folder: str, ext: str) -> DataFrame:
    """Files of a folder with hidden ones (names that start with ``_`` or ``.``), which Spark's own sources pass over:
    (path, length, modified). The names of one folder are asked for on the driver, contents are not read."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(location)
    rows = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found if f.isFile() and f.getPath().getName().endswith(ext)]
    return spark.createDataFrame(rows, "path string, length long, modified long")


def listed_files(spark: SparkSession, folder: str, ext: str, hidden: bool = False) -> DataFrame:
    """Files of a folder ending in ``ext``: (path, length, modified in milliseconds)."""
    if hidden:
        return list_names(spark, folder, ext)
    return _binary_files(spark, folder, ext).select("path", "length", F.unix_millis("modificationTime").alias("modified"))


def listing_changes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, length, modified, change): what a listing has ``added``, ``changed`` (length or time) or ``deleted`` since ``known``."""
    old = known.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    moved = ~(F.col("length").eqNullSafe(F.col("_length")) & F.col("modified").eqNullSafe(F.col("_modified")))
    change = F.when(F.col("_path").isNull(), "added").when(F.col("path").isNull(), "deleted").when(moved, "changed")
    return listing.join(old, F.col("path") == F.col("_path"), "full_outer").withColumn("change", change).where("change IS NOT NULL").select(
        F.coalesce("path", "_path").alias("path"), "length", "modified", "change")


def known_files(spark: SparkSession, state: str) -> DataFrame:
    """The listing as the state folder has it: the last word on each path, without deleted ones."""
    if not path_exists(spark, state):
        return spark.createDataFrame([], "path string, length long, modified long")
    last = spark.read.parquet(state).groupBy("path").agg(F.max_by(F.struct("length", "modified", "change"), "run").alias("_s"))
    return last.select("path", "_s.*").where("change <> 'deleted'").drop("change")


def refresh_listing(listing: DataFrame, state: str) -> DataFrame:
    """Changes of a listing (path, length, modified) since the last refresh, which are appended to the state folder.

    The state grows by what changes and is never rewritten. The changes are read back from the state.
    """
    spark, run = listing.sparkSession, time.time_ns()
    changes = listing_changes(listing, known_files(spark, state)).withColumn("run", F.lit(run))
    changes.write.mode("append").parquet(state)
    return spark.read.parquet(state).where(F.col("run") == run).drop("run")


def decode_arrays(df: DataFrame, key: str = "stem", content: str = "content",
                  n: int = LANDMARK_COUNT, d: int = LANDMARK_DIM) -> DataFrame:
    """Array files to landmark points: (key, points, reason).

    Files that are no plain array of shape (n, d) get a reason and no points. Object arrays are
    refused, nothing is unpickled.
    """
    key_type = df.schema[key].dataType.simpleString()
    axes = ("x", "y", "z")[:d]
    point = ", ".join(f"{a}: float" for a in axes)
    fields = pa.list_(pa.struct([(a, pa.float32()) for a in axes]))

    def read(blob: bytes) -> tuple[np.ndarray | None, str | None]:
        try:
            array = np.load(io.BytesIO(blob), allow_pickle=False)
        except Exception as problem:
            return None, f"unreadable: {type(problem).__name__}"
        if not isinstance(array, np.ndarray) or array.dtype.kind not in "fiu":
            return None, "not a numeric array"
        if array.shape != (n, d):
            return None, f"shape {tuple(array.shape)}"
        return array.astype(np.float32), None

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for start in range(0, record.num_rows, _FILES_PER_BATCH):
                part = record.slice(start, _FILES_PER_BATCH)
                results = [read(blob) for blob in part.column(content).to_pylist()]
                good = [a for a, _ in results if a is not None]
                flat = np.concatenate(good) if good else np.zeros((0, d), np.float32)
                structs = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(d)], names=list(axes))
                ends = np.cumsum([0, *(0 if a is None else n for a, _ in results)]).astype(np.int32)
                missing = pa.array([a is None for a, _ in results], pa.bool_())
                points = pa.ListArray.from_arrays(pa.array(ends), structs, mask=missing).cast(fields)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), points, pa.array([r for _, r in results], pa.string())],
                    names=[key, "points", "reason"],
                )

    schema = f"`{key}` {key_type}, points array<struct<{point}>>, reason string"
    return df.select(key, content).mapInArrow(run, schema)


def read_landmarks(spark: SparkSession, folder: str, ext: str = ".npy") -> DataFrame:
    """Landmark files of a folder as points: (stem, points, reason)."""
    files = _binary_files(spark, folder, ext).select(stem_of(file_name("path")).alias("stem"), "content")
    return decode_arrays(files)


def to_rgb(df: DataFrame) -> DataFrame:
    """Image-source rows (blue, green, red order; 1, 3 or 4 channels) with ``data`` in RGB, three channels, and ``reason``.

    Gray values are repeated and alpha is dropped. An image that can't be read, has another number of channels or
    not the bytes of its size keeps its row, with null data and the reason.
    """
    df = df.drop("reason")
    names = [c for c in df.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", reason string"

    def rgb(data: bytes | None, channels: int | None, height: int | None, width: int | None) -> tuple[bytes | None, str | None]:
        if data is None or not height or not width or height < 0 or width < 0:
            return None, "undecodable"
        if channels not in (1, 3, 4):
            return None, f"{channels} channels"
        if len(data) != height * width * channels:
            return None, f"{len(data)} bytes"
        pixels = np.frombuffer(data, dtype=np.uint8).reshape(-1, channels)
        if channels == 1:
            return np.repeat(pixels, 3, axis=1).tobytes(), None
        return np.ascontiguousarray(pixels[:, 2::-1]).tobytes(), None

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for start in range(0, record.num_rows, _FILES_PER_BATCH):
                part = record.slice(start, _FILES_PER_BATCH)
                done = [rgb(*x) for x in zip(*(part.column(c).to_pylist() for c in ("data", "nChannels", "height", "width")))]
                columns = {n: part.column(n) for n in names}
                columns["data"] = pa.array([x for x, _ in done], pa.binary())
                columns["nChannels"] = pa.array([3 if x is not None else None for x, _ in done], pa.int32())
                columns["reason"] = pa.array([r for _, r in done], pa.string())
                yield pa.RecordBatch.from_arrays([columns[n] for n in (*names, "reason")], names=[*names, "reason"])

    return df.mapInArrow(run, schema)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images as RGB bytes: (stem, height, width, nChannels, data, reason); undecodable files have a reason."""
    images = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    return to_rgb(images.select(
        stem_of(file_name("origin")).alias("stem"), "height", "width", "nChannels", "data"
    ))
