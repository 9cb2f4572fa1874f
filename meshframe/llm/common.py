"""What the training-data operators share: words, reading tables, pinning, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.session import ensure_checkpoint_dir

# A word is a maximal run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """The words of a text in order; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def pin(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    Later steps then start from files that outlive any executor, and values that depend on how rows
    were dealt out stay as they were.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """Inner join of ``rows`` with the fewer rows of ``few``, one per key, where a key may hold a third of ``rows``.

    Rows of a key are dealt over ``salts`` tasks by a hash of ``by``; ``few`` is sent to all of them.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    copied = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def _stars(edges: DataFrame) -> bool:
    """Whether every id either has one smaller neighbour, which has none itself, or is such a neighbour."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (columns a, b): rows (id, component).

    Component is the smallest id in it; ids without an edge to another id are left out. Alternates
    large-star and small-star steps: each hangs neighbours on the smallest of them, so chains halve
    and a hub costs one aggregate with partial sums, never one task that holds all its neighbours.
    """
    e = pin(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u")
        e = pin(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
