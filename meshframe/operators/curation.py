"""Pairing, resuming, naming, detection outcomes and batching of a sample corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.operators.numbering import number_rows
from meshframe.operators.permutation import Permutation, dense_count, permuted
from meshframe.operators.quality import dangling, with_presence
from meshframe.session import path_exists

BATCH_SIZE = 190
LANDMARK_COUNT = 68
LANDMARK_DIM = 2

OUTCOMES = ("exists", "ok", "no_face", "bad_shape_multi", "bad_shape_single", "bad_rank", "error")


def key_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each distinct key once, with the sides it occurs on.

    One aggregate over both key columns: duplicates collapse before the shuffle, so a key that
    fills a third of a side costs one row per task.
    """
    tagged = left.select(F.col(key), F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(
        right.select(F.col(key), F.lit(False).alias("l"), F.lit(True).alias("r"))
    )
    return (
        tagged.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.bool_or("l").alias("in_left"), F.bool_or("r").alias("in_right"))
    )


def pair(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides, ascending."""
    return key_sides(left, right, key).filter("in_left and in_right").select(key).orderBy(key)


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, with that side's name."""
    return (
        key_sides(left, right, key)
        .filter("in_left <> in_right")
        .select(key, F.when(F.col("in_left"), "left").otherwise("right").alias("side"))
    )


def pair_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of manifest counts; ``warning`` is set when no key pairs up."""
    counted = key_sides(left, right, key).agg(
        F.count_if(F.expr("in_left and in_right")).alias("paired"),
        F.count_if(F.expr("in_left and not in_right")).alias("left_only"),
        F.count_if(F.expr("in_right and not in_left")).alias("right_only"),
    )
    return counted.withColumn("warning", F.when(F.col("paired") == 0, "no matching pairs"))


def pending(df: DataFrame, images: DataFrame, landmarks: DataFrame, key: str) -> DataFrame:
    """Rows still to process: their image and landmarks do not both exist."""
    done = key_sides(images, landmarks, key).filter("in_left and in_right").select(key)
    return df.join(done, key, "left_anti")


def pending_ids(df: DataFrame, images: DataFrame, landmarks: DataFrame, key: str) -> DataFrame:
    """:func:`pending` for keys that are numbers from 0 on: rows are tested against bitmaps of the two sides and stay where they are."""
    marked = with_presence(with_presence(df, key, images, key, "_image"), key, landmarks, key, "_landmarks")
    return marked.where("NOT (_image AND _landmarks)").drop("_image", "_landmarks")


def orphan_ids(refs: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Keys of ``refs`` that ``target`` lacks, for keys that are numbers from 0 on; the larger side is best taken as ``refs``, which stays
    where it is."""
    return dangling(refs.select(key), key, target, key)


def require_unique(df: DataFrame, key: str) -> None:
    """Fail where a key repeats; repeats collapse before the shuffle."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")


def name_rows(df: DataFrame, order: Sequence[str | Column], out: str = "stem", prefix: str = "thumb_",
              key: str | None = None) -> DataFrame:
    """Sequential names with at least five digits, in the given order.

    With a unique ``key``, which the order then consists of, only the key is numbered and joined back, so that wide
    rows (image bytes) are not sorted; a key that repeats is an error.
    """
    name = F.format_string(f"{prefix}%05d", F.col("_n")).alias(out)
    if key is None:
        return number_rows(df, order, "_n").select(*df.columns, name)
    require_unique(df, key)
    return df.join(number_rows(df.select(key), order, "_n").select(key, name), key)


def name_new(df: DataFrame, path: str, order: Sequence[str | Column], key: str, out: str = "stem", prefix: str = "thumb_") -> DataFrame:
    """Sequential names that go on where the last run ended: ``df`` with the names of its keys, new and old.

    The names given so far lie under ``path`` as (key, number), which is only appended to. Keys found there keep their names;
    only the others are ordered and numbered, from the count on. The key must be unique, the order consist of it, and one run be at work.
    """
    spark = df.sparkSession
    require_unique(df, key)
    fresh, start = df.select(key), 0
    if path_exists(spark, path):
        named = spark.read.parquet(path)
        highest = named.agg(F.max("number")).first()[0]
        start = 0 if highest is None else highest + 1
        fresh = fresh.join(named.select(key), key, "left_anti")
    numbered = number_rows(fresh, order, "number").withColumn("number", F.col("number") + F.lit(start))
    numbered.write.mode("append").parquet(path)
    return df.join(spark.read.parquet(path), key).select(*df.columns, F.format_string(f"{prefix}%05d", F.col("number")).alias(out))


def first_detection(df: DataFrame, key: str, pos: str, images: DataFrame | None = None) -> DataFrame:
    """The detection at the lowest position of each image.

    With ``images``, images without a detection are kept with nulls.
    """
    rest = [c for c in df.columns if c != key]
    first = (
        df.filter(F.col(pos).isNotNull())
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.col(pos)).alias("_first"))
        .select(key, "_first.*")
    )
    return first if images is None else images.join(first, key, "left")


def classify(df: DataFrame, shape: str = "shape", exists: str = "exists", error: str = "error",
             n: int = LANDMARK_COUNT, d: int = LANDMARK_DIM, out: str = "status") -> DataFrame:
    """Outcome of one image from the shape of its first detection.

    ``shape`` holds the dimensions of the detected array (null or empty when nothing was found),
    ``exists`` marks images already on disk, ``error`` a failure message.
    """
    dims = F.col(shape)
    rank = F.coalesce(F.size(dims), F.lit(0))
    wanted = (F.element_at(dims, -2) == n) & (F.element_at(dims, -1) == d)
    status = (
        F.when(F.coalesce(F.col(exists), F.lit(False)), "exists")
        .when(F.col(error).isNotNull(), "error")
        .when(dims.isNull() | (rank == 0), "no_face")
        .when(rank == 3, F.when((F.get(dims, F.lit(0)) > 0) & wanted, "ok").otherwise("bad_shape_multi"))
        .when(rank == 2, F.when(wanted, "ok").otherwise("bad_shape_single"))
        .otherwise("bad_rank")
    )
    return df.withColumn(out, status)


def tally(df: DataFrame, status: str = "status") -> DataFrame:
    """Images counted as processed (already there or fine) and as skipped."""
    fine = F.col(status).isin("exists", "ok")
    return df.agg(F.count_if(fine).alias("processed"), F.count_if(~fine).alias("skipped"))


def tally_by_status(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("images"))


def shuffle_key(key: str, seed: int, epoch: int) -> Column:
    """Pseudo-random sort key that depends on nothing but the sample key, seed and epoch."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(epoch))))


def batches(df: DataFrame, key: str, size: int = BATCH_SIZE, seed: int = 42, epoch: int = 0,
            unique: bool = False) -> DataFrame:
    """Random order per epoch cut into batches; the last partial batch is kept.

    Whole rows are numbered, so repeated keys keep every row once. With ``unique=True`` the key (the pair
    manifest's) is numbered alone and joined back to the other columns; a key that repeats is then an error.
    """
    narrow = unique and len(df.columns) > 1
    if narrow:
        require_unique(df, key)
    keyed = df.select(key) if narrow else df
    others = [c for c in keyed.columns if c != key]
    numbered = number_rows(keyed.withColumn("_h", shuffle_key(key, seed, epoch)), ["_h", key], "_n").select(
        key,
        *others,
        F.floor(F.col("_n") / size).cast("bigint").alias("batch"),
        F.pmod(F.col("_n"), F.lit(size)).cast("int").alias("slot"),
    )
    return df.join(numbered, key) if narrow else numbered


def permuted_batches(df: DataFrame, ids: str, size: int = BATCH_SIZE, seed: int = 42, epoch: int = 0,
                     n: int | None = None) -> DataFrame:
    """Random order per epoch cut into batches, for rows numbered from 0 without gaps (the pair manifest's numbers).

    Batch and slot follow from an id by arithmetic, so rows are neither sorted nor moved, and a sample's place can be told
    without reading the others. ``n`` saves the aggregate that counts and checks the ids.
    """
    place = Permutation(dense_count(df, ids) if n is None else n, seed, epoch)
    rest = [c for c in df.columns if c not in ("batch", "slot")]
    return permuted(df, ids, place, "_place").select(
        *rest, F.expr(f"_place div {size}").alias("batch"), (F.col("_place") % size).cast("int").alias("slot"))


def collate(df: DataFrame, cols: Sequence[str], batch: str = "batch", slot: str = "slot") -> DataFrame:
    """One row per batch with arrays aligned by slot; a group never exceeds the batch size."""
    rows = F.sort_array(F.collect_list(F.struct(slot, *cols)))
    return (
        df.groupBy(batch)
        .agg(rows.alias("_rows"))
        .select(batch, *[F.col(f"_rows.{c}").alias(c) for c in cols])
    )


def head_of_last_batch(df: DataFrame, k: int = 4, batch: str = "batch", slot: str = "slot") -> DataFrame:
    """The first k slots of the highest batch; a batch with fewer rows gives all of them."""
    last = F.broadcast(df.agg(F.max(batch).alias(batch)))
    return df.filter(F.col(slot) < k).join(last, batch)
