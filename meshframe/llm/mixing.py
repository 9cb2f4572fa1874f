"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshframe.llm.common import pin, table, words
from meshframe.operators.numbering import number_rows
from meshframe.session import broadcast_if_small

# Weights in the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
# Words of the mix as a share of all words, as a fraction.
SHARE = (3, 2)
# No document is taken more often than this.
MOST = 2
# Each level of the histogram splits a range of hashes into 2 ** BITS buckets.
BITS = 10
_HASH_BITS = 60
TOP_SHIFT = _HASH_BITS - BITS


def source_targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
                   most: int = MOST) -> DataFrame:
    """One row per source: weight, source_size and target, from partial sums (source, size).

    Sources are ordered by code point, null last, and take the weights in turn. Targets share ``share``
    of all sizes by weight; one that would exceed ``most`` times its source stops there, and the excess
    is shared again by weight among the rest. Only sums come to the driver.
    """
    sources = number_rows(
        sums.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "_nth"
    ).withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.pmod("_nth", F.lit(len(weights))) + 1).cast("int"))).drop("_nth")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    up, down = share
    unit, capped = 0.0, -1
    most_of = F.col("source_size") * most
    while True:
        over = F.lit(unit) * F.col("weight") > most_of if capped >= 0 else most_of == 0
        n, full, free = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, most_of)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == capped or not free:
            break
        unit, capped = (total * up / down - (full or 0)) / free, n
    target = F.least(F.lit(unit) * F.col("weight"), most_of.cast("double"))
    return sources.withColumn("target", target)


def _histogram(rows: DataFrame, shift: int) -> DataFrame:
    """Sizes by source and bucket of hashes, with the bucket's lowest and highest hash; sums meet before they are shuffled."""
    return rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
        F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))


def _thresholds(rows: DataFrame, first: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the threshold: of the hashes below it the sizes come to at most ``rest``, and with the
    next hash they would pass it; ``rest`` becomes what is then still wanted.

    ``first`` is the histogram of all rows at the top level. Each level finds the bucket in which the sum passes the budget and
    keeps only its rows for the next, some 2 ** BITS times fewer than before.
    """
    state = sources.select("source", "rest", F.lit(0).cast("bigint").alias("threshold"))
    edge, hist = rows, first
    for shift in range(TOP_SHIFT, -1, -BITS):
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        crossing = (
            hist.withColumn("upto", F.sum("size").over(running))
            .join(state.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .where(F.col("upto") > F.col("rest"))
            .groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "low", "high", "rest")).alias("at"))
            .select("source", "at.bucket", (F.col("at.low") < F.col("at.high")).alias("several"),
                    (F.col("at.rest") - F.col("at.upto") + F.col("at.size")).alias("rest"))
        )
        crossing = pin(crossing)
        state = pin(
            state.join(crossing.select(F.col("source").alias("_s"), "bucket", F.col("rest").alias("_rest")),
                       F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("source", F.coalesce("_rest", "rest").alias("rest"),
                    F.coalesce(F.shiftleft("bucket", shift), "threshold").alias("threshold"))
        )
        n, wide = crossing.agg(F.count("*"), F.count(F.when(F.col("several"), 1))).first()
        if not wide:
            # Each crossing bucket holds one hash, so its start splits the source as its hash would.
            break
        marks = broadcast_if_small(crossing.select(F.col("source").alias("_s"), "bucket"), n, 64)
        edge = pin(edge.join(
            marks, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", shift) == F.col("bucket"))
        ).drop("_s", "bucket"))
        hist = _histogram(edge, shift - BITS)
    return state


def _fill(rows: DataFrame, thresholds: DataFrame, n_sources: int) -> DataFrame:
    """Per source the hashes past the threshold that fill what is still wanted.

    Of each power of two of the sizes, the first hash past the threshold in each of eight classes of hashes
    is a candidate, with the sizes of all its rows; from large to small those that fit are taken, and at last the one that comes nearest
    to what then remains, if it comes nearer than none. A source has at most 8 * 63 candidates.
    """
    side = broadcast_if_small(thresholds.withColumnRenamed("source", "_s"), n_sources, 64)
    first = (
        rows.join(side, F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("hash") >= F.col("threshold")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("rest")))
        .groupBy("source", F.length(F.bin("size")).alias("power"), F.pmod("hash", F.lit(8)).alias("eighth"))
        .agg(F.min("hash").alias("hash"), F.first("rest").alias("rest"))
    )
    first = pin(first.select(F.col("source").alias("_s"), "power", F.col("hash").alias("_h"), "rest"))
    # Rows of a hash are equal and of one power.
    whole = rows.join(broadcast_if_small(first, 8 * 63 * n_sources, 64), F.col("source").eqNullSafe(F.col("_s")) & (F.col("hash") == F.col("_h")))
    candidates = (
        whole.groupBy("source", "hash").agg(F.sum("size").alias("size"), F.first("power").alias("power"), F.first("rest").alias("rest"))
        .where(F.col("size") < 2 * F.col("rest")).groupBy("source").agg(
            F.sort_array(F.collect_list(F.struct("power", "hash", "size")), asc=False).alias("cs"),
            F.first("rest").alias("rest"))
    )

    def step(state, c):
        fits = c["size"] <= state["rest"]
        return F.struct(
            (state["rest"] - F.when(fits, c["size"]).otherwise(0)).alias("rest"),
            F.when(fits, F.concat(state["picks"], F.array(c["hash"]))).otherwise(state["picks"]).alias("picks"),
        )

    def finish(state):
        left = F.filter("cs", lambda c: ~F.array_contains(state["picks"], c["hash"]) & (c["size"] < 2 * state["rest"]))
        nearest = F.array_min(F.transform(left, lambda c: F.struct(F.abs(c["size"] - state["rest"]), c["hash"].alias("hash"))))
        return F.when(nearest.isNull(), state["picks"]).otherwise(F.array_append(state["picks"], nearest["hash"]))

    start = F.struct(F.col("rest").alias("rest"), F.array().cast("array<bigint>").alias("picks"))
    return candidates.select(F.col("source").alias("_s"), F.aggregate("cs", start, step, finish).alias("picks"))


def mix(records: DataFrame, source: Column, size: Column, key: Column, weights: tuple[int, ...] = WEIGHTS,
        share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """The records with ``size``, ``source_size``, ``target`` and ``copies``, how often the mix takes each.

    A source takes all its records as often as its target holds it whole, and once more those below a
    hash threshold. Thresholds come from nested histograms; nothing is sorted. Records whose ``key`` and
    source are equal share one hash and are taken alike. A null source is a source of its own; records
    of size 0 are taken as often as the whole source, or once more; an empty table gives none. ``key``, a
    string, decides the order, so reruns agree. Columns of the records may have any names but size, source_size, target and copies, which are
    replaced. The records are read twice, once for source, hash and size, once to be marked, and never shuffled: what is shuffled
    are sums by source and bucket, and the rows of boundary buckets.
    """
    sized = records.withColumns({
        "_source": source, "size": size.cast("bigint"),
        "_hash": F.conv(F.substring(F.md5(F.coalesce(key, F.lit("")).cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("bigint"),
    })
    rows = pin(sized.select(F.col("_source").alias("source"), F.col("_hash").alias("hash"), "size"))
    first = pin(_histogram(rows, TOP_SHIFT))
    sources = pin(
        source_targets(first, weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    n = sources.count()
    thresholds = _thresholds(rows, first, sources)
    plan = pin(
        sources.drop("rest", "weight")
        .join(thresholds.select(F.col("source").alias("_t"), "threshold"), F.col("source").eqNullSafe(F.col("_t")))
        .join(_fill(rows, thresholds, n), F.col("source").eqNullSafe(F.col("_s")), "left")
        .select(F.col("source").alias("_s"), F.struct("source_size", "target", "whole", "threshold", "picks").alias("_plan"))
    )
    below = (F.col("_hash") < F.col("_plan.threshold")) | F.coalesce(F.array_contains("_plan.picks", F.col("_hash")), F.lit(False))
    more = below & (F.col("_plan.whole") < most)
    return (
        sized.drop("source_size", "target", "copies")
        .join(broadcast_if_small(plan, n, 8192), F.col("_source").eqNullSafe(F.col("_s")))
        .withColumns({"source_size": F.col("_plan.source_size"), "target": F.col("_plan.target"),
                      "copies": (F.col("_plan.whole") + more.cast("int")).cast("int")})
        .drop("_source", "_s", "_hash", "_plan")
    )


def document_key(doc_id: str, text: str) -> Column:
    """What tells documents apart that share an id, or have none."""
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each; a document is taken whole, up to twice."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.size(words("text")).alias("_words"), document_key("doc_id", "text").alias("_key"))
    mixed = mix(docs, F.col("source"), F.col("_words"), F.col("_key"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 15))::BIGINT AS h FROM documents),
lump AS (SELECT source, h, sum(size)::BIGINT AS size FROM d GROUP BY ALL),
src AS (SELECT source, sum(size)::BIGINT AS ss, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
        FROM lump GROUP BY source),
levels AS (SELECT 2e0 * ss / w AS b, row_number() OVER o AS k,
    ((SELECT sum(ss) FROM src) * 1.5e0 - coalesce(sum(2 * ss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM src WINDOW o AS (ORDER BY 2e0 * ss / w, source)),
unit AS (SELECT arg_min(unit, k) AS unit FROM levels WHERE unit <= b),
goal AS (SELECT source, ss, least(unit * w, 2e0 * ss) AS target FROM src, unit),
plan AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole FROM goal),
ranked AS (SELECT lump.*, target - whole * ss AS rest, whole, sum(size) OVER (PARTITION BY lump.source ORDER BY h) AS upto
           FROM lump JOIN plan ON lump.source IS NOT DISTINCT FROM plan.source),
left_ AS (SELECT source, max(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS r FROM ranked GROUP BY source),
first_ AS (SELECT d.source, length(bin(d.size)) AS p, min(d.h) AS h, max(r) AS r
  FROM d JOIN ranked ON ranked.source IS NOT DISTINCT FROM d.source AND ranked.h = d.h
  JOIN left_ ON d.source IS NOT DISTINCT FROM left_.source
  WHERE upto > rest AND d.size > 0 AND d.size < 2 * r GROUP BY d.source, length(bin(d.size)), d.h % 8),
cand AS (SELECT first_.source, p, first_.h, size, r FROM first_
  JOIN lump ON lump.source IS NOT DISTINCT FROM first_.source AND lump.h = first_.h WHERE size < 2 * r),
queue AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p DESC, h DESC) AS i FROM cand),
fold(source, i, h, fits, r) AS (
  SELECT DISTINCT source, 0::BIGINT, NULL::BIGINT, false, r FROM cand UNION ALL
  SELECT f.source, q.i, q.h, q.size <= f.r, f.r - CASE WHEN q.size <= f.r THEN q.size ELSE 0 END
  FROM fold f JOIN queue q ON q.source IS NOT DISTINCT FROM f.source AND q.i = f.i + 1),
final AS (SELECT source, arg_max(r, i) AS r FROM fold GROUP BY source),
spare AS (SELECT q.source, q.h, row_number() OVER (PARTITION BY q.source ORDER BY abs(q.size - final.r), q.h) AS n
  FROM queue q JOIN final ON q.source IS NOT DISTINCT FROM final.source
  WHERE q.size < 2 * final.r AND NOT EXISTS (
    SELECT 1 FROM fold WHERE fold.source IS NOT DISTINCT FROM q.source AND fold.h = q.h AND fits)),
pick AS (SELECT source, h FROM fold WHERE fits UNION ALL SELECT source, h FROM spare WHERE n = 1),
often AS (SELECT source, h, whole + CASE WHEN whole < 2 AND (upto <= rest OR EXISTS (
    SELECT 1 FROM pick WHERE pick.source IS NOT DISTINCT FROM ranked.source AND pick.h = ranked.h)) THEN 1 ELSE 0 END AS copies FROM ranked)
SELECT doc_id, size, ss AS source_size, target, (size * copies)::BIGINT AS taken, d.source
FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
JOIN often ON d.source IS NOT DISTINCT FROM often.source AND d.h = often.h
"""
