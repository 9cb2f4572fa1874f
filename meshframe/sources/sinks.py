"""Corpus landing, mesh text files and the scalar metric log."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.session import ensure_checkpoint_dir, path_exists

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Folders of a new corpus; a record's folder follows from its key.
BUCKETS = 64
# Appended rows of a folder, as a share of its landed ones, beyond which they are merged.
COMPACT_SHARE = 0.25


def delete_folder(spark: SparkSession, path: str) -> None:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


def corpus_buckets(spark: SparkSession, path: str) -> int | None:
    """Folders of a landed corpus, as stored with it; none before the first landing."""
    if not path_exists(spark, f"{path}/layout"):
        return None
    return spark.read.parquet(f"{path}/layout").agg(F.max_by("buckets", "at")).first()[0]


def _folders(path: str, buckets: int) -> tuple[str, str]:
    return f"{path}/base-{buckets}", f"{path}/added-{buckets}"


def _added(spark: SparkSession, path: str, buckets: int) -> DataFrame | None:
    """The appended rows; none before the first and after a full compaction."""
    folder = _folders(path, buckets)[1]
    if not path_exists(spark, folder):
        return None
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    parts = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(location)
    return spark.read.parquet(folder) if any(p.isDirectory() and p.getPath().getName().startswith("_bucket=") for p in parts) else None


def _placed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def land_corpus(df: DataFrame, path: str, key: str = "stem", points: str = "points", buckets: int = BUCKETS,
                share: float = COMPACT_SHARE) -> None:
    """Land image records, one per key whatever is landed again; one whose landmarks failed has null points.

    Of several records of a key one with points wins, then the later landed one, then the larger. Records without a key can't
    be found again and are refused.

    A run appends its records and leaves landed ones alone; :func:`read_corpus` takes the best of each key. A folder whose appended
    rows exceed ``share`` of its landed ones is compacted, so reading stays cheap and a key is rewritten a bounded number of times
    on average. ``buckets`` holds for a new corpus; it is stored with it, and :func:`grow_corpus` changes it. One job lands at a time.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    stored = corpus_buckets(spark, path)
    buckets = stored or buckets
    base, added = _folders(path, buckets)
    keyed = df.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit("record without a key")).cast(df.schema[key].dataType)))
    fresh = one_per_key(_placed(keyed, key, buckets).withColumn("_run", F.lit(time.time_ns())), key, points)
    first = stored is None
    fresh.repartition("_bucket").write.mode("overwrite" if first else "append").partitionBy("_bucket").parquet(base if first else added)
    if first:
        _store_buckets(spark, path, buckets)
        return
    compact(spark, path, key, points, share)


def _store_buckets(spark: SparkSession, path: str, buckets: int) -> None:
    row = spark.createDataFrame([(buckets, time.time_ns())], "buckets int, at long")
    row.coalesce(1).write.mode("append").parquet(f"{path}/layout")


def compact(spark: SparkSession, path: str, key: str = "stem", points: str = "points", share: float = COMPACT_SHARE) -> list[int]:
    """Merge the appended rows into their folder where they exceed ``share`` of its rows; the folders' numbers.

    Only counts are read of the others. A run that is broken off leaves appended rows that are merged once more, to the same result.
    """
    buckets = corpus_buckets(spark, path)
    base, added = _folders(path, buckets)
    new = _added(spark, path, buckets)
    if new is None:
        return []
    counts = new.groupBy("_bucket").agg(F.count("*").alias("new")).join(
        spark.read.parquet(base).groupBy("_bucket").agg(F.count("*").alias("old")), "_bucket", "left")
    due = sorted(r["_bucket"] for r in counts.where(F.col("new") > F.coalesce("old", F.lit(0)) * share).collect())
    if due:
        rows = [df.where(F.col("_bucket").isin(due)) for df in (spark.read.parquet(base), new)]
        merged = one_per_key(rows[0].unionByName(rows[1], allowMissingColumns=True), key, points).checkpoint()
        merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(base)
        for bucket in due:
            delete_folder(spark, f"{added}/_bucket={bucket}")
    return due


def grow_corpus(spark: SparkSession, path: str, buckets: int, key: str = "stem", points: str = "points") -> None:
    """Deal a corpus over another number of folders. The new ones count once they are written whole."""
    old = corpus_buckets(spark, path)
    if buckets == old:
        return
    _placed(_best(spark, path, key, points).drop("_bucket"), key, buckets).repartition("_bucket").write.mode("overwrite").partitionBy(
        "_bucket").parquet(_folders(path, buckets)[0])
    delete_folder(spark, _folders(path, buckets)[1])
    _store_buckets(spark, path, buckets)
    for folder in _folders(path, old):
        delete_folder(spark, folder)


def one_per_key(df: DataFrame, key: str, points: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    rank = F.struct(F.col(points).isNotNull(), "_run", F.xxhash64(*[c for c in rest if c not in ("_run", "_bucket")]))
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(key, "_r.*")


def _best(spark: SparkSession, path: str, key: str, points: str) -> DataFrame:
    buckets = corpus_buckets(spark, path)
    landed, new = spark.read.parquet(_folders(path, buckets)[0]), _added(spark, path, buckets)
    if new is None:
        return landed
    keys = new.select("_bucket", key).distinct()
    again = landed.join(keys, ["_bucket", key], "left_semi").select(*landed.columns)
    rest = landed.join(keys, ["_bucket", key], "left_anti").select(*landed.columns)
    return rest.unionByName(one_per_key(new.unionByName(again, allowMissingColumns=True), key, points), allowMissingColumns=True)


def read_corpus(spark: SparkSession, path: str, key: str = "stem", points: str = "points") -> DataFrame:
    """The landed records, one per key: landed rows as they lie, but for the keys that were appended to since the last compaction."""
    return _best(spark, path, key, points).drop("_bucket", "_run")


def landed_keys(df: DataFrame, key: str = "stem", points: str = "points") -> tuple[DataFrame, DataFrame]:
    """Keys with an image, and keys with landmarks, of a landed corpus; inputs of the resume filter."""
    return df.select(key), df.filter(F.col(points).isNotNull()).select(key)


def obj_lines(verts: DataFrame, faces: DataFrame | None = None, key: str = "sid") -> DataFrame:
    """Mesh text lines (key, section, ord, line): vertices in order, then faces counted from one.

    A vertex lacking a coordinate fails the job. Faces are the same for every mesh.
    """
    for axis in "xyz":
        if axis not in verts.columns:
            raise ValueError("vertices need the columns x, y and z")
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    numbers = F.format_string("v %.6f %.6f %.6f", *[F.round(F.col(a), 6) + F.lit(0.0) for a in "xyz"])
    line = F.when(whole, numbers).otherwise(F.raise_error(F.lit("vertex without three coordinates")))
    lines = verts.select(key, F.lit(0).alias("section"), F.col("v").cast("int").alias("ord"), line.alias("line"))
    if faces is None:
        return lines
    for corner in "abc":
        if not isinstance(faces.schema[corner].dataType, _INTEGERS):
            raise TypeError(f"face corner {corner} must be an integer column")
    # One row with all faces, as a mesh is of fixed size; every mesh's key meets it once.
    text = F.format_string("f %d %d %d", *[(F.col(c) + 1).cast("bigint") for c in "abc"])
    listed = faces.agg(F.array_sort(F.collect_list(F.struct(F.col("f").cast("int").alias("ord"), text.alias("line")))).alias("_f"))
    meshes = verts.select(key).distinct().select(key, F.lit(1).alias("section"), F.inline(listed.scalar()))
    return lines.unionByName(meshes)


def export_obj(verts: DataFrame, faces: DataFrame | None, path: str, key: str = "sid") -> None:
    """One text file per mesh under ``path/key=...``; a mesh is of fixed size, so it fits one task."""
    (
        obj_lines(verts, faces, key)
        .repartition(key)
        .sortWithinPartitions(key, "section", "ord")
        .select(key, "line")
        .write.mode("overwrite")
        .partitionBy(key)
        .text(path)
    )


def export_obj_buckets(verts: DataFrame, faces: DataFrame | None, path: str, buckets: int, key: str = "sid") -> None:
    """Meshes as Parquet rows (key, text), whole meshes in each of ``buckets`` files, for numbers of meshes that
    would be too many files."""
    line = F.array_sort(F.collect_list(F.struct("section", "ord", "line")))
    text = F.concat(F.array_join(F.transform(line, lambda x: x["line"]), "\n"), F.lit("\n"))
    obj_lines(verts, faces, key).groupBy(key).agg(text.alias("text")).repartition(buckets, key).write.mode("overwrite").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Write scalar log rows (tag, step, value), one for each tag and step: a retried epoch replaces its rows.

    Rows lie in folders by step; those of the steps at hand are read, merged and replaced, the others left alone. Of
    several new rows of a tag and step the one with the largest value counts.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = df.select("tag", F.col("step").cast("bigint"), F.col("value").cast("double")).withColumn("_new", F.lit(True)).checkpoint()
    if path_exists(spark, path):
        steps = rows.select("step").distinct()
        rows = rows.unionByName(read_metrics(spark, path).join(F.broadcast(steps), "step", "left_semi").withColumn("_new", F.lit(False)))
    kept = rows.groupBy("tag", "step").agg(F.max_by("value", F.struct("_new", "value")).alias("value")).checkpoint()
    kept.repartition("step").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("tag", F.col("step").cast("bigint").alias("step"), "value")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """The rows written as a table bucketed and sorted by ``key``. Tables with equal buckets join on it without an exchange.

    A bucket is one file. The table is external, under a name of its own in the session's catalog.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
