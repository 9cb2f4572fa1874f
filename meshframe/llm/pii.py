"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm.common import pin, table

KINDS = ("email", "ip", "card", "phone")

# The base patterns. They match what their plain forms match, leftmost and non-overlapping: possessive
# loops keep the regex engine off its stack in long runs, and a look-behind starts a match at the
# beginning of a run or right after the match before (\G), so a run is read once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Candidates beyond the base: look-alikes in other spellings.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Gazetteers and context words of the labelers, as alternatives of a pattern.
TOP_DOMAINS = "com|org|net|edu|gov|info|int|de|fr|es|uk|eu|it|nl|io"
CONTEXT = {
    "email": "mail|contact|write to|courriel|correo|kontakt",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|dial|handy",
}
AGAINST = r"(?:version|isbn|issn|doi|order|invoice|page|serial|build|\bv|\bno|\bid|[#=/_])[\x20.:]{0,2}$"
CONTEXT_CHARS = 40

LABELERS = ("pattern", "check", "gazetteer", "context", "against")
ROUNDS = 25
# A span is added where the classifier is this sure and the labelers for it outnumber those against by so many.
SURE = 0.95
MAJORITY = 3

_BLOCK = 512


def _running(xs: Column) -> Column:
    """Sums of the elements before each one. Folds run over blocks, so long arrays cost n * _BLOCK at most."""
    def fold(arr: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            arr, start,
            lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")),
            lambda s: s["out"])

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda k: F.slice(xs, k * _BLOCK + 1, _BLOCK))
    offsets = fold(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)))
    return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(fold(b), lambda x: x + o)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = digits.substr(n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: p.rlike("[1-9][0-9]{3}") | (F.right(p, F.lit(3)).cast("int") > 255))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _gazetteer(kind: str, value: Column) -> Column:
    """1 where the list of the kind knows the value, -1 where it doesn't, 0 where it has no say."""
    if kind == "email":
        known = F.lower(value).rlike(rf"(?:\.|\(dot\)|\[dot\])\x20?(?:{TOP_DOMAINS})$")
    elif kind == "card":
        known = value.rlike("^[3-6]")
    elif kind == "phone":
        known = ~_digits(value).rlike(r"^(?:00)?(\d)\1+$") & value.rlike(r"^(?:\+[1-9]|00[1-9]|\(?[2-9])")
    else:
        known = ~value.rlike(r"^0")
    return F.when(known, 1).otherwise(-1)


def _found(df: DataFrame, kind: str, pattern: str, loose: bool, worth: Column) -> DataFrame:
    """Adds array ``_c``: the matches of a pattern with place, votes and shape, in order.

    Places come from the lengths of the matches and of the text between them, so the text is read once
    for either, whatever the number of matches. Context reaches back to the match before at most.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({
        "_m": F.when(worth, F.regexp_extract_all("_text", F.lit(pattern), 0)).otherwise(none)})
    df = df.withColumn("_gaps", F.when(F.size("_m") > 0, F.split("_text", pattern, -1)).otherwise(none))
    df = df.withColumn("_steps", F.zip_with(
        "_m", F.slice("_gaps", 1, F.size("_m")), lambda m, g: (F.length(m) + F.length(g)).cast("int")))
    df = df.withColumn("_at", F.when(F.size("_m") > 0, _running(F.col("_steps"))).otherwise(F.array().cast("array<int>")))

    def candidate(m: Column, i: Column) -> Column:
        gap, after = F.get("_gaps", i), F.substring(F.get("_gaps", i + 1), 1, 1)
        start = F.get("_at", i) + F.length(gap)
        before = F.lower(F.right(gap, F.lit(CONTEXT_CHARS)))
        valid = _valid(kind, m) if not loose or kind == "phone" else F.lit(kind == "ip") if kind != "email" else (
            m.rlike(r"(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,24}$"))
        votes = [
            F.lit(0 if loose else 1),
            F.when(valid, 1).otherwise(-1),
            _gazetteer(kind, m),
            F.when(before.rlike(CONTEXT[kind]), 1).otherwise(0),
            F.when(before.rlike(AGAINST), -1).otherwise(0),
        ]
        side = lambda c: F.when(c == "", "e").when(c.rlike(r"\s"), "s").when(c.rlike(r"[\p{L}\p{N}]"), "w").otherwise("p")
        shape = F.array(
            F.concat(F.lit("b"), side(F.right(gap, F.lit(1)))), F.concat(F.lit("a"), side(after)),
            F.concat(F.lit("n"), F.least(F.floor(F.length(m) / 6), F.lit(6)).cast("string")))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.cast("int").alias("start"),
            (start + F.length(m)).cast("int").alias("end"), (F.lit(not loose) & valid).alias("base"),
            F.array(*votes).alias("votes"), shape.alias("shape"))

    return df.withColumn("_c", F.transform("_m", candidate)).drop("_m", "_gaps", "_steps", "_at")


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``cands``: the valid base matches and all look-alikes that touch none of them, by start and kind.

    Null and empty texts have none. Only texts that hold an @ or a digit are searched.
    """
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    at = F.contains("_text", F.lit("@")) | F.contains("_text", F.lit("(at)")) | F.contains("_text", F.lit("[at]"))
    df = df.withColumns({"_has_at": at, "_has_digit": F.col("_text").rlike("[0-9]")})
    lists: dict[bool, list[str]] = {False: [], True: []}
    for loose, patterns in ((False, BASE), (True, LOOSE)):
        for kind, pattern in patterns.items():
            worth = F.col("_has_at" if kind == "email" else "_has_digit")
            df = _found(df, kind, pattern, loose, worth)
            lists[loose].append(name := f"_{kind}_{int(loose)}")
            df = df.withColumnRenamed("_c", name)
    # A base match that fails its check is a look-alike.
    df = df.withColumn("_tried", F.concat(*lists[False]))
    df = df.withColumn("_base", F.filter("_tried", lambda c: c["base"]))
    df = df.withColumn("_more", F.array_distinct(F.concat(F.filter("_tried", lambda c: ~c["base"]), *lists[True])))
    free = F.filter("_more", lambda c: ~F.exists(
        "_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    by_place = lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"),
        c["votes"].alias("votes"), c["shape"].alias("shape"))
    return df.withColumn("cands", F.array_sort(F.transform(F.concat("_base", free), by_place))).drop(
        "_text", "_has_at", "_has_digit", "_tried", "_base", "_more", *lists[False], *lists[True])


def _code(c: Column) -> Column:
    """What the classifier knows of a span, as one string."""
    return F.concat_ws("|", c["kind"].cast("string"), F.concat_ws(",", F.transform(c["votes"], lambda v: v.cast("string"))),
                       F.concat_ws(",", c["shape"]))


def _evidence(votes: Column, a: Column, b: Column) -> Column:
    """Log-odds that the votes add: a and b are each labeler's chance of a yes for true and false spans."""
    return F.aggregate(
        F.zip_with(votes, F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda v, r:
                   F.when(v == 1, F.log(r["a"] / r["b"])).when(v == -1, F.log((1 - r["a"]) / (1 - r["b"]))).otherwise(0.0)),
        F.lit(0.0), lambda s, x: s + x)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def train(cands: DataFrame) -> DataFrame:
    """Classifier of spans from unlabelled candidates: rows (code, probability).

    Equal spans in the sense of ``_code`` are counted first; what follows works on those counts, of which
    there are 3 ** 5 votes times 112 shapes for each kind at most, whatever the number of documents.
    Expectation-maximisation estimates, kind by kind, the share of true spans and how often each labeler
    says yes to true and to false ones (Beta priors of ten spans keep rare kinds stable). Its posteriors
    are soft labels of a naive Bayes classifier over the votes and the shape of the span.
    """
    one = F.col("c")
    counts = cands.select(F.explode("cands").alias("c")).groupBy(
        one["kind"].alias("kind"), one["votes"].alias("votes"), one["shape"].alias("shape")
    ).agg(F.count("*").alias("n"), F.first(_code(one)).alias("code"))
    counts = pin(counts)
    per_votes = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    per_kind = per_votes.groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("seen"))
    n_labelers = len(LABELERS)
    start = F.struct(
        F.lit(0.5).alias("pi"), F.array_repeat(F.lit(0.8), n_labelers).alias("a"),
        F.array_repeat(F.lit(0.2), n_labelers).alias("b"))

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform("seen", lambda x: F.struct(
            x["votes"].alias("votes"), x["n"].alias("n"),
            (x["n"] * _sigmoid(F.log(state["pi"] / (1 - state["pi"])) + _evidence(x["votes"], state["a"], state["b"]))).alias("yes")))
        total = lambda value: F.aggregate(weighed, F.lit(0.0), lambda s, x: s + value(x))
        yes, no = (lambda x: x["yes"]), (lambda x: x["n"] - x["yes"])

        def rate(weight, mean: float) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(n_labelers - 1)), lambda j: (
                total(lambda x: F.when(F.get(x["votes"], j) == 1, weight(x)).otherwise(0.0)) + 10 * mean
            ) / (total(lambda x: F.when(F.get(x["votes"], j) != 0, weight(x)).otherwise(0.0)) + 10))

        return F.struct(
            ((total(yes) + 5) / (total(lambda x: x["n"].cast("double")) + 10)).alias("pi"),
            rate(yes, 0.8).alias("a"), rate(no, 0.2).alias("b"))

    fitted = per_kind.select(
        F.col("kind").alias("_kind"), F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("fit"))
    posterior = _sigmoid(F.log(F.col("fit.pi") / (1 - F.col("fit.pi")))
                         + _evidence(F.col("votes"), F.col("fit.a"), F.col("fit.b")))
    soft = pin(
        counts.join(F.broadcast(fitted), F.col("kind") == F.col("_kind"))
        .withColumn("yes", F.col("n") * posterior).drop("_kind", "fit")
        .withColumn("features", F.concat(
            F.transform("votes", lambda v, j: F.concat(j.cast("string"), F.lit(":"), v.cast("string"))), "shape"))
    )
    sums = [F.sum("yes").alias("yes"), F.sum(F.col("n") - F.col("yes")).alias("no")]
    prior = soft.groupBy("kind").agg(*sums).select(
        F.col("kind").alias("_kind"), (F.col("yes") + 5).alias("all_yes"), (F.col("no") + 5).alias("all_no"))
    ratio = (
        soft.select("kind", "n", "yes", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(*sums)
        .join(F.broadcast(prior), F.col("kind") == F.col("_kind"))
        .select("kind", "feature", F.log(
            ((F.col("yes") + 1) / (F.col("all_yes") + 3)) / ((F.col("no") + 1) / (F.col("all_no") + 3))).alias("ratio"))
    )
    return (
        soft.select("kind", "code", F.explode("features").alias("feature")).join(F.broadcast(ratio), ["kind", "feature"])
        .groupBy("kind", "code").agg(F.sum("ratio").alias("ratio"))
        .join(F.broadcast(prior), F.col("kind") == F.col("_kind"))
        .select("code", _sigmoid(F.log(F.col("all_yes") / F.col("all_no")) + F.col("ratio")).alias("probability"))
    )


def decide(cands: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``spans``: the base spans and the candidates that the classifier accepts, by start and kind."""
    accepted = model.where(F.col("probability") >= SURE).agg(F.collect_set("code")).scalar()
    wanted = lambda c: c["base"] | (
        (F.aggregate(c["votes"], F.lit(0), lambda s, v: s + v) >= MAJORITY) & F.array_contains("_accepted", _code(c)))
    return cands.withColumn("_accepted", accepted).withColumn("spans", F.filter("cands", wanted)).drop("_accepted")


def render(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(
        ":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with [EMAIL], [IP], [CARD] or [PHONE] in place of each span; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        fresh = c["start"] >= s["at"]
        return F.struct(
            F.when(fresh, F.concat(s["out"], F.array(
                text.substr(s["at"] + 1, c["start"] - s["at"]), F.get(names, c["kind"])))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], c["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda s: F.array_append(s["out"], text.substr(s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, F.array_join(done, "")).otherwise(text)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data. Repeated rows are judged alike; an empty table gives none."""
    cands = pin(candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "cands"))
    found = decide(cands, train(cands))
    base = F.filter("cands", lambda c: c["base"])
    count = lambda k: F.size(F.filter("cands", lambda c: c["base"] & (c["kind"] == KINDS.index(k)))).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(render(base).cast("binary"), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
