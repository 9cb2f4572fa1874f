"""Checks: non-finite numbers, array contracts, reconciliation, index ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.session import BROADCAST_BYTES

# Names under which an array of landmark vertex indices is looked for, in order.
INDEX_KEYS = (
    "static_landmark_vertex_ids", "vertex_ids_68", "landmark_vertex_ids", "landmark_indices",
    "lmk_idx", "ids", "v_idx_68",
)
BARY_KEYS = ("lmk_face_idx", "lmk_b_coords")
# Buckets of keys that are compared by digest first, a bound on the rows that reach the driver; keys of one bitmap.
DIGEST_BUCKETS = 4096
BITMAP_BITS = 32768
INTEGER_TYPES = ("tinyint", "smallint", "int", "bigint", "int8", "int16", "int32", "int64",
                 "uint8", "uint16", "uint32", "uint64")


def is_non_finite(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def non_finite(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """NaN and infinite values per column: (by, col, bad, rows)."""
    counts = [F.struct(F.lit(c).alias("col"), F.count_if(is_non_finite(c)).alias("bad"), F.count("*").alias("rows"))
              for c in cols]
    return df.groupBy(*by).agg(F.array(*counts).alias("_c")).select(*by, F.inline("_c"))


def contract(profiles: DataFrame, candidates: Sequence[str] = INDEX_KEYS, file: str = "file", n: int = 68) -> DataFrame:
    """Landmark arrays offered by each file, from array profiles (file, key, shape, dtype).

    Per file: the first candidate key with shape (n), whether its type is an integer, whether the
    barycentric pair has shapes (n) and (n, 3), and the overall verdict. One aggregate; files
    without a usable array are kept as ``missing``.
    """
    shape = F.col("shape")
    flat = (F.size(shape) == 1) & (F.get(shape, F.lit(0)) == n)
    wide = (F.size(shape) == 2) & (F.get(shape, F.lit(0)) == n) & (F.get(shape, F.lit(1)) == 3)
    names = F.array(*[F.lit(k) for k in candidates])
    # Rank and type share one number, so the aggregate keeps fixed-width state: rank first, integers first.
    rank = F.array_position(names, F.col("key"))
    other_type = F.when(F.lower("dtype").isin(*INTEGER_TYPES), 0).otherwise(1)
    per_file = profiles.groupBy(file).agg(
        F.min(F.when(flat & (rank > 0), rank * 2 + other_type)).alias("_best"),
        F.bool_or((F.col("key") == BARY_KEYS[0]) & flat).alias("_face"),
        F.bool_or((F.col("key") == BARY_KEYS[1]) & wide).alias("_bary"),
    )
    bary = F.coalesce(F.col("_face") & F.col("_bary"), F.lit(False))
    verdict = F.when(F.col("_best").isNotNull(), "indices").when(bary, "barycentric").otherwise("missing")
    return per_file.select(
        file,
        F.get(names, (F.shiftright("_best", 1) - 1).cast("int")).alias("key"),
        (F.col("_best") % 2 == 0).alias("is_integer"),
        bary.alias("bary_ok"),
        verdict.alias("status"),
    )


def contract_failures(profiles: DataFrame, checked: DataFrame, file: str = "file") -> DataFrame:
    """All arrays of the files that offer no usable landmark array."""
    usable = checked.filter(F.col("status") != "missing").select(file)
    return profiles.join(usable, file, "left_anti")


def reconcile(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], cols: Sequence[str],
              tol: float = 1e-9) -> DataFrame:
    """Compare two tables row by row: (keys, diff, status).

    ``diff`` is the sum of absolute differences; rows on one side only are kept and named so.
    """
    left = stored.select(*keys, F.struct(*cols).alias("_a"))
    right = recomputed.select(*keys, F.struct(*cols).alias("_b"))
    gaps = [F.abs(F.col(f"_a.{c}") - F.col(f"_b.{c}")) for c in cols]
    diff = sum(gaps[1:], gaps[0])
    status = (
        F.when(F.col("_b").isNull(), "stored_only")
        .when(F.col("_a").isNull(), "recomputed_only")
        .when(F.col("diff").isNull() | F.isnan("diff") | (F.col("diff") > tol), "mismatch")
        .otherwise("match")
    )
    return (
        left.join(right, list(keys), "full_outer")
        .withColumn("diff", diff)
        .withColumn("status", status)
        .select(*keys, "diff", "status")
    )


def reconcile_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(F.count("*").alias("rows"), F.sum("diff").alias("diff"))


def bucket_digests(df: DataFrame, keys: Sequence[str], cols: Sequence[str], quantum: float, buckets: int) -> DataFrame:
    """(bucket, rows, mark, total, odd): a digest of each bucket of keys that does not depend on the order of rows.

    Values count in steps of ``quantum``. ``odd`` are rows without a finite number somewhere, which no digest vouches for.
    """
    steps = [F.rint(F.col(c).cast("double") / F.lit(quantum)) + F.lit(0.0) for c in cols]
    finite = [~F.coalesce(is_non_finite(F.col(c).cast("double")), F.lit(True)) for c in cols]
    fine = finite[0]
    for c in finite[1:]:
        fine = fine & c
    rows = df.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"), F.xxhash64(*keys, *steps).alias("h"), fine.alias("fine"))
    return rows.groupBy("bucket").agg(
        F.count("*").alias("rows"), F.bit_xor("h").alias("mark"), F.sum(F.col("h") % F.lit(1 << 31)).alias("total"), F.count_if(~F.col("fine")).alias("odd"))


def reconcile_by_digest(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float = 1e-9,
                        buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """The summary of :func:`reconcile` (status, rows, diff), full comparison only where it is needed.

    Both sides are reduced to one digest per bucket of keys, so equal tables shuffle a row for each bucket and task instead of all rows.
    Values within the same step of tolerance over columns are equal to the digest. Only buckets whose digests differ are
    compared row by row. A matching row that no comparison has seen counts no difference. Keys are unique on each side.
    """
    quantum = tol / len(cols)
    left, right = (bucket_digests(df, keys, cols, quantum, buckets) for df in (stored, recomputed))
    names = [F.col(c).alias(f"_{c}") for c in right.columns]
    same = (F.col("odd") + F.col("_odd") == 0) & (F.col("rows") == F.col("_rows")) & (F.col("mark") == F.col("_mark")) & (F.col("total") == F.col("_total"))
    both = left.join(right.select(*names), F.col("bucket") == F.col("_bucket"), "full_outer").select(
        F.coalesce("bucket", "_bucket").alias("bucket"), "rows", F.coalesce(same, F.lit(False)).alias("same"))
    # One row per bucket.
    judged = both.collect()
    equal = sum(r["rows"] for r in judged if r["same"])
    spark = stored.sparkSession
    known = spark.createDataFrame([("match", equal, 0.0)] if equal else [], "status string, rows long, diff double")
    differ = [r["bucket"] for r in judged if not r["same"]]
    if not differ:
        return known
    chosen = F.broadcast(spark.createDataFrame([(b,) for b in differ], "_b int"))
    sides = [df.join(chosen, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") == F.col("_b"), "left_semi") for df in (stored, recomputed)]
    return reconcile_summary(reconcile(*sides, keys, cols, tol)).unionByName(known).groupBy("status").agg(
        F.sum("rows").alias("rows"), F.sum("diff").alias("diff"))


def key_bitmaps(target: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): which integer keys from 0 on exist, a bit each, in pieces of 4 KB; as many pieces as the keys' range needs."""
    x = F.col(key).cast("bigint")
    return target.where(x >= 0).groupBy(F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))


def with_presence(refs: DataFrame, col: str, target: DataFrame, key: str, out: str = "present") -> DataFrame:
    """``refs`` with whether each reference has a row in the target. Null and negative references have none.

    Integer keys go into bitmaps, which are sent to the references where their pieces, bounded by the largest key, stay within the
    broadcast budget; the references then stay where they are, and no key is looked up by a hash. Beyond it the pieces meet them by a join.
    """
    pieces = key_bitmaps(target, key)
    highest = target.agg(F.max(F.col(key).cast("bigint"))).first()[0]
    if ((highest or 0) // BITMAP_BITS + 2) * (BITMAP_BITS // 8 + 16) <= BROADCAST_BYTES:
        pieces = F.broadcast(pieces)
    x = F.col(col).cast("bigint")
    place = F.bitmap_bit_position(x)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    found = F.coalesce((x >= 0) & (F.getbit(byte, (place % 8).cast("int")) == 1), F.lit(False))
    named = pieces.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    return refs.join(named, F.when(x >= 0, F.bitmap_bucket_number(x)) == F.col("_bucket"), "left").select(
        *[F.col(f"`{c}`") for c in refs.columns if c != out], found.alias(out))


def dangling(refs: DataFrame, col: str, target: DataFrame, key: str) -> DataFrame:
    """Reference rows whose index is null, negative or has no row in the target."""
    return with_presence(refs, col, target, key, "_present").where("NOT _present").drop("_present")
