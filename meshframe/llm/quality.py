"""Quality rules with cutoffs whose false rejections are bounded on labelled holdouts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm.common import pin, table, words
from meshframe.session import broadcast_if_small

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Rules of the method: a document is rejected where a share exceeds its cutoff.
RULES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share")
# Cutoffs tried for each rule, the most lenient first.
CUTOFFS = (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)
# At most this part of a stratum's good documents may be rejected by the rules ...
MAX_FALSE_REJECTION = 0.02
# ... in all strata at once, except with this probability.
DELTA = 0.05
# A rejected good document weighs as much as so many caught bad ones where certified cutoffs compete.
COST = 5


def _repeat_words(df: DataFrame, text_words: str, out: str) -> DataFrame:
    """Adds the number of words that lie in a WINDOW of words found twice or more in the text.

    Hashes of windows grow by doubling: 1, 2, 4, 8 words. Texts whose hashes all differ stop there; in
    the others equal hashes are found as neighbours in a sorted array.
    """
    df = df.withColumn("_h", F.transform(text_words, lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        df = df.withColumn("_h", F.zip_with(
            "_h", F.slice("_h", step + 1, F.greatest(F.size("_h") - step, F.lit(0))),
            lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))
    df = df.withColumn("_h", F.slice("_h", 1, F.greatest(F.size(text_words) - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.zip_with("_h", F.sequence(F.lit(0), F.size("_h") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(repeats, F.sort_array(placed)))
    same = lambda x, i: (
        F.coalesce(F.get("_s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)))
    starts = F.array_sort(F.transform(F.filter("_s", same), lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"])
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_h", "_s")


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts, the shares of ``RULES`` and base_failed. Null and empty texts count 0 and fail."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({
        "_words": words(text),
        "_lines": F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("bigint"),
        "_upper": (F.length(whole) - F.length(F.regexp_replace(whole, r"\p{Lu}+", ""))).cast("bigint"),
        "_n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
    }).drop("_lines")
    df = _repeat_words(df, "_words", "n_repeat_words").drop("_words")
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    # A filter on the verdict would be pushed below these steps and repeat their formulas many times over;
    # it can't pass a projection with a row number that the verdict reads.
    return df.withColumns({
        "_row_number": F.monotonically_increasing_id(),
        "symbol_share": part("n_symbols", "word_chars"), "upper_share": part("_upper", "word_chars"),
        "dup_line_share": part("n_dup_lines", "_n_lines"), "repeat_share": part("n_repeat_words", "n_words"),
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    }).drop("_upper", "_n_lines")


def _log_factorial(n: Column) -> Column:
    """Exact up to 20, then Stirling's series, right to double precision."""
    z = n.cast("double")
    series = (
        (z + 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z**5)
    )
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, p) for k < n p; 1 for other k, which is enough to refuse a bound.

    Terms are summed from k downwards by their ratio. Beyond 40 standard deviations they are below
    the last bit of a double, so the number of terms grows with the root of n only.
    """
    first = F.exp(
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    many = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 100)
    total = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), many), F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            (s["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term"), (s["sum"] + s["term"]).alias("sum")),
        lambda s: s["sum"])
    return F.when(k < n * p, total).otherwise(1.0)


def select_cutoffs(features: DataFrame, stratum: str, good: str, max_false_rejection: float = MAX_FALSE_REJECTION,
                   delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: one row per stratum, a column per rule (null where no cutoff is certified).

    ``features`` are labelled rows (``good`` 1 or 0; rows with a null label, and those that the base rules
    fail, take no part). All rules of a stratum tighten together, cutoff by cutoff from lenient to strict, and what is tested is whether
    any of them rejects, so the whole risk is spent once. Each step is tested by the exact binomial tail of its false rejections, up to the first
    that isn't certified (fixed sequence, so no correction within a stratum). Across strata delta is divided by the number of those
    tested, and what a stratum does not need any more, as all its steps are certified, goes to the others (Holm's way). Among the certified
    steps the one that catches most bad documents, less COST for each good one, is taken, the lenient on ties.

    Strata whose good rows are too few to certify anything, even without a false rejection, are pooled: the bound then holds for the
    pool as a whole, not for each of them.
    """
    n_cutoffs = len(CUTOFFS)
    grid = F.array(*[F.lit(c) for c in CUTOFFS])
    # The first step at which some rule rejects.
    share = F.greatest(*RULES)
    level = n_cutoffs + 1 - F.size(F.filter(grid, lambda c: share > c))
    counts = (
        features.where(F.col(good).isNotNull() & ~F.col("base_failed"))
        .select(F.col(stratum).alias("stratum"), (F.col(good) == 1).alias("is_good"), level.alias("level"))
        .groupBy("stratum", "level").agg(
            F.count(F.when(F.col("is_good"), 1)).alias("good"), F.count(F.when(~F.col("is_good"), 1)).alias("bad"))
    )
    counts = pin(counts)
    sizes = counts.groupBy("stratum").agg(F.sum("good").alias("n_good"))
    strata = sizes.agg(F.count("*")).scalar()
    # (1 - risk) ** n above its share of delta: no n rows could certify a step.
    few = F.pow(F.lit(1 - max_false_rejection), F.col("n_good")) * strata > delta
    marked = sizes.select(F.col("stratum").alias("_s"), few.alias("pooled"))
    placed = counts.join(marked, F.col("stratum").eqNullSafe(F.col("_s"))).select(
        F.col("pooled"), F.when(~F.col("pooled"), F.col("stratum")).alias("unit"), "level", "good", "bad")
    # At most one entry per cutoff in each list.
    cells = placed.groupBy("pooled", "unit", "level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).groupBy("pooled", "unit").agg(
        F.collect_list(F.struct("level", "good", "bad")).alias("levels"), F.sum("good").alias("n_good"))
    upto = lambda j, what: F.aggregate(
        "levels", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["level"] <= j, x[what]).otherwise(0))
    tried = pin(
        cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_cutoffs))).alias("j"))
        .withColumns({"n_false": upto(F.col("j"), "good"), "n_caught": upto(F.col("j"), "bad")})
        .withColumn("tail", binomial_tail(F.col("n_false"), F.col("n_good"), max_false_rejection)).drop("levels")
    )
    # A step counts with the worst of those before it. Units whose last step holds at delta over the units still open leave their share to them.
    worst = tried.groupBy("pooled", "unit").agg(F.max("tail").alias("worst"))
    ranked = worst.agg(F.array_sort(F.collect_list("worst")).alias("w"), F.count("*").alias("n"))
    closed = F.aggregate("w", F.lit(0), lambda k, w: F.when(w * (F.col("n") - k) <= delta, k + 1).otherwise(k))
    open_units = ranked.select(F.greatest(F.col("n") - closed, F.lit(1))).scalar()
    tried = tried.withColumn("certified", F.col("tail") * open_units <= delta)
    worth = F.col("n_caught") - COST * F.col("n_false")
    chosen = (
        tried.groupBy("pooled", "unit").agg(
            F.min(F.when(~F.col("certified"), F.col("j"))).alias("stop"),
            F.collect_list(F.struct(worth.alias("worth"), (-F.col("j")).alias("lenient"))).alias("options"))
        .withColumn("best", F.array_max(F.filter(
            "options", lambda o: (-o["lenient"] < F.coalesce("stop", F.lit(n_cutoffs + 1))) & (o["worth"] > 0))))
        .select(F.col("pooled").alias("_p"), "unit", F.get(grid, -F.col("best.lenient") - 1).alias("cutoff"))
    )
    same = (F.col("pooled") == F.col("_p")) & F.when(F.col("pooled"), F.lit(True)).otherwise(F.col("_s").eqNullSafe(F.col("unit")))
    return marked.join(broadcast_if_small(chosen, 1024, 64), same).select(
        F.col("_s").alias("stratum"), *[F.col("cutoff").alias(f"max_{r}") for r in RULES])


def judge(features: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Adds ``kept``: false where the base rules fail or a share exceeds its stratum's certified cutoff."""
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    side = broadcast_if_small(cutoffs.withColumnRenamed("stratum", "_stratum"), cutoffs.count(), 128)
    return (
        features.join(side, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~over & (F.col("_row_number") >= 0))
        .drop("_stratum", "_row_number", *[f"max_{r}" for r in RULES])
    )


def labelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows with ``quality``; a document with several labels has the lowest of them."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return features.drop("quality").join(known, "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and verdict; strata are languages, a null language is one too.

    A null doc_id has no label and is judged like others; repeated rows are judged alike. Without
    labels only the base rules reject; languages with too few are certified together, as a pool. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    features = pin(text_features(docs).drop("text"))
    cutoffs = pin(select_cutoffs(labelled(features, table(spark, sf_dir, "labels")), "lang", "quality"))
    return judge(features, cutoffs, "lang").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *RULES)
