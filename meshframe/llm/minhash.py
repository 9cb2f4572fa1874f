"""Near-duplicate texts by probability MinHash of weighted word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm.common import components, pin, salted_join, table
from meshframe.llm.wordhash import chunks, mix, window_hashes, word_hashes, words
from meshframe.session import broadcast_if_small

SHINGLE = 5
THRESHOLD = 0.8
# A pair at the threshold meets in no band with probability (1 - 0.8 ** ROWS) ** BANDS = 7e-5.
BANDS, ROWS = 24, 5
_CHUNK_BYTES = 1 << 21
_BLOCK_BYTES = 1 << 19
_STEP = np.uint64(0xD1342543DE82EF95)


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, and how often each occurs. A text of fewer than SHINGLE words
    is one shingle; one without words has none."""
    h = word_hashes(words(text))
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(window_hashes(h, min(SHINGLE, len(h))), return_counts=True)


def _signatures(texts: list[bytes | None]) -> np.ndarray:
    """ProbMinHash registers, a row per text: which shingle reached a register first.

    Each shingle is a Poisson process whose rate is its weight; each arrival hits a random register. The
    k-th arrivals of all shingles are drawn together; a shingle ends once its time is past
    the slowest register of its text, as no later arrival of it can win. Two texts agree in a register
    with the probability Jaccard similarity of their weights.
    """
    m = BANDS * ROWS
    sets = [shingles(t) for t in texts]
    doc = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    ids = np.concatenate([s for s, _ in sets]) if sets else np.empty(0, np.uint64)
    weight = np.concatenate([c for _, c in sets]).astype(np.float64) if sets else np.empty(0)
    first = np.full(len(texts) * m, np.inf)
    winner = np.zeros(len(texts) * m, np.uint64)
    time = np.zeros(len(ids))
    seed = ids.copy()
    with np.errstate(over="ignore"):
        while len(ids):
            seed = seed + _STEP
            draw = mix(seed)
            uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(uniform) / weight
            at = doc * m + (mix(draw ^ _STEP) % np.uint64(m)).astype(np.int64)
            wins = np.flatnonzero(time < first[at])
            # Late ones first: of several arrivals at a register the earliest is written last.
            wins = wins[np.lexsort((ids[wins], -time[wins]))]
            first[at[wins]] = time[wins]
            winner[at[wins]] = ids[wins]
            live = np.unique(doc)
            slowest = np.full(len(texts), -1.0)
            slowest[live] = first.reshape(-1, m)[live].max(axis=1)
            on = time < slowest[doc]
            doc, ids, weight, time, seed = doc[on], ids[on], weight[on], time[on], seed[on]
    return winner.reshape(-1, m)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text", _CHUNK_BYTES):
        # Copies within a slice are hashed once.
        distinct = list(dict.fromkeys(texts))
        of = {t: i for i, t in enumerate(distinct)}
        won = _signatures(distinct).reshape(len(distinct), BANDS, ROWS)
        key = np.zeros((len(distinct), BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                key = mix(key * _STEP + won[:, :, r])
            key = mix(key + np.arange(BANDS, dtype=np.uint64) * _STEP)
        key = key[[of[t] for t in texts]].view(np.int64)
        flat = pa.ListArray.from_arrays(
            pa.array(np.arange(0, key.size + 1, BANDS), pa.int32()), pa.array(key.ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "t1", "t2")), flat], names=["id", "t1", "t2", "bands"])


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text", _CHUNK_BYTES):
        sets = [shingles(t) for t in texts]
        yield pa.RecordBatch.from_arrays([
            batch.column(batch.schema.get_field_index("id")), pa.array([s.tobytes() for s, _ in sets], pa.binary()),
            pa.array([c.astype(np.uint32).tobytes() for _, c in sets], pa.binary()),
        ], names=["id", "shingles", "weights"])


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common shingles i of 1 / sum over j of max(a_j / a_i, b_j / b_i).

    With shingles ordered by b_j / a_j, the larger ratio is a's for those up to i and b's beyond, so
    all denominators come from two cumulated sums.
    """
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = wa.sum(dtype=np.float64) - x.sum(), wb.sum(dtype=np.float64) - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    upto, beyond = only_a + np.cumsum(x), only_b + y.sum() - np.cumsum(y)
    return float((1.0 / (upto / x + beyond / y)).sum())


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        value = [
            probability_jaccard(np.frombuffer(sa, np.uint64), np.frombuffer(wa, np.uint32),
                                np.frombuffer(sb, np.uint64), np.frombuffer(wb, np.uint32))
            for sa, wa, sb, wb in zip(*(cols[n].to_pylist() for n in ("sa", "wa", "sb", "wb")))
        ]
        yield pa.RecordBatch.from_arrays([cols["a"], cols["b"], pa.array(value, pa.float64())], names=["a", "b", "similarity"])


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose texts are as similar as the threshold asks, by the whole shingle sets."""
    side = lambda k: sets.select(
        F.col("id").alias(k), F.col("shingles").alias(f"s{k}"), F.col("weights").alias(f"w{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "wa", "sb", "wb")
    return both.mapInArrow(_similar, "a long, b long, similarity double").where(F.col("similarity") >= threshold - 1e-9)


def _text_hashes(text: str) -> dict:
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(text, F.lit(1))}


def _classes(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """One row per row of ``docs``: id, t1 and t2 (its text's hashes), class_id and kept.

    Texts link where the probability Jaccard similarity of their word shingles, weighted by how often
    each occurs, is at least ``threshold``. Equal texts are one class from the start and never form
    pairs. Texts without words link with nothing, not even each other. Rows without a key take the class of
    their text, if another row has it, and are kept only where none has; rows that share a key share a class.

    Copies collapse to their smallest key by one aggregate. Bands of the rest meet in buckets; in the
    first round each bucket's smallest key is compared with its other members, so pairs grow with
    members, not with their square. Where a bucket's members are then not all in one component, those outside
    its largest component are compared with all texts that such buckets connect, block by block, so no
    link between two texts that share a band goes missing and no pair is emitted but the links. All
    are verified on the whole sets.
    """
    raw = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).withColumns(_text_hashes("text"))
    worded = raw.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    signed = worded.where("id is not null").withColumn("text", F.col("text").cast("binary")).mapInArrow(
        _bands, "id long, t1 long, t2 long, bands array<long>")
    reps = pin(signed.groupBy("t1", "t2").agg(F.min(F.struct("id", "bands")).alias("r")).select("t1", "t2", "r.*"))
    rows = reps.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    members = pin(salted_join(rows, shared.select("bucket", "lead"), ["bucket"], "id").select("bucket", "id", "lead").distinct())
    wanted = members.select("id").distinct()
    mark = broadcast_if_small(
        wanted.join(reps.select("id", "t1", "t2"), "id"), members.agg(F.count_distinct("id")).first()[0], 48)
    sets = pin(
        worded.join(mark, ["id", "t1", "t2"]).dropDuplicates(["id", "t1", "t2"])
        .select("id", F.col("text").cast("binary").alias("text")).mapInArrow(_weighted, "id long, shingles binary, weights binary"))

    pairs = members.where("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = pin(_links(pairs, sets, threshold))
    groups = pin(components(links.select("a", "b")))
    placed = members.select("bucket", "id").join(groups, "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    placed = pin(salted_join(placed, mixed.select("bucket"), ["bucket"], "id"))
    more = _block_links(placed, sets, threshold)
    groups = pin(components(links.select("a", "b").union(more.select("a", "b"))))

    classes = reps.select("t1", "t2", "id").join(groups, "id", "left").select(
        "t1", "t2", F.coalesce("component", "id").alias("class_id"))
    class_id = F.coalesce("class_id", "id")
    return raw.select("id", "t1", "t2").join(classes, ["t1", "t2"], "left").select(
        "id", "t1", "t2", class_id.alias("class_id"),
        F.coalesce(class_id.isNull() | (F.col("id") == class_id), F.lit(False)).alias("kept"))


def _block_similar(threshold: float):
    def overlaps(a: list, b: list) -> Iterator[tuple[int, int, float]]:
        """Index pairs and similarity of those that may reach the threshold: what they share must be
        that part of either's weight. Texts whose shingles all occur once have the plain Jaccard similarity."""
        sets = [[(np.frombuffer(x["shingles"], np.uint64), np.frombuffer(x["weights"], np.uint32)) for x in side] for side in (a, b)]
        keys = np.concatenate([s for s, _ in sets[1]])
        owner = np.repeat(np.arange(len(b)), [len(s) for s, _ in sets[1]])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        part = np.concatenate([w for _, w in sets[1]])[order].astype(np.float64)
        total = np.array([w.sum() for _, w in sets[1]], np.float64)
        plain = np.array([bool((w == 1).all()) for _, w in sets[1]])
        group = np.array([x["component"] for x in b])
        least = threshold - 1e-9
        for i, (s, w) in enumerate(sets[0]):
            lo, hi = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            theirs = np.bincount(owner[at], part[at], len(b))
            ours = np.bincount(owner[at], np.repeat(w, size), len(b))
            near = (ours >= least * w.sum()) & (theirs >= least * total) & (group != a[i]["component"])
            flat = bool((w == 1).all())
            for j in np.flatnonzero(near):
                if flat and plain[j]:
                    yield i, j, ours[j] / (w.sum() + total[j] - ours[j])
                else:
                    yield i, j, probability_jaccard(s, w, *sets[1][j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                a, b = (batch.column(batch.schema.get_field_index(c))[n].as_py() for c in ("strays", "others"))
                found = [(min(a[i]["id"], b[j]["id"]), max(a[i]["id"], b[j]["id"]), v)
                         for i, j, v in overlaps(a, b) if v >= threshold - 1e-9]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.float64())], names=["a", "b", "similarity"])

    return run


def _block_links(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between components that meet in a bucket (rows bucket, id, component).

    Of each bucket all but the largest component are strays. Buckets that share texts form a region; in it all
    strays meet all texts, in blocks of some _BLOCK_BYTES, so a task holds two blocks whatever the region's
    size, and a pair is looked at once however many buckets it shares.
    """
    per = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = per.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m")).select(
        "bucket", F.col("m.component").alias("largest"))
    stray = salted_join(placed, largest, ["bucket"], "id").where("component <> largest").select("id").distinct().withColumn("stray", F.lit(True))
    lead = placed.groupBy("bucket").agg(F.min("id").alias("a"))
    regions = components(salted_join(placed, lead, ["bucket"], "id").select("a", F.col("id").alias("b")))
    texts = pin(
        placed.select("id", "component").distinct()
        .join(regions.select("id", F.col("component").alias("region")), "id").join(stray, "id", "left").join(sets, "id")
        .dropDuplicates(["id"]))
    entry = F.struct("id", "component", "shingles", "weights")

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("region").agg(F.ceil(F.sum(F.length("shingles") + 64) / _BLOCK_BYTES).alias("blocks"))

    def blocks(rows: DataFrame, out: str) -> DataFrame:
        return salted_join(rows, sizes(rows), ["region"], "id").groupBy("region", F.pmod(F.xxhash64("id"), "blocks").alias("block")).agg(
            F.collect_list(entry).alias(out))

    # Each block of strays goes to every block of its region, so that a large region is dealt over many tasks.
    spread = blocks(texts.where("stray"), "strays").drop("block").join(sizes(texts), "region").select(
        "region", "strays", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    pairs = spread.join(blocks(texts, "others"), ["region", "block"])
    return pairs.select("strays", "others").mapInArrow(_block_similar(threshold), "a long, b long, similarity double").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: key, class_id (the smallest key among the texts that links join) and kept.

    See ``_classes`` for what links and how. Null and empty texts have a class of their own.
    """
    return _classes(docs, key, text, threshold).withColumnRenamed("id", key).drop("t1", "t2")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their class, whole; of rows equal in key and text one stays, whichever its other columns.
    Columns of any names are carried along; no rows give none."""
    at = {"_null": F.col("_id").isNull(), "_id": F.coalesce("_id", F.lit(0).cast("bigint"))}
    kept = _classes(docs, key, text, threshold).where("kept").select(
        F.col("id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).withColumns(at).distinct()
    hashes = _text_hashes(text)
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).cast("long").alias("_id"),
                       hashes["t1"].alias("_t1"), hashes["t2"].alias("_t2")).withColumns(at)
    keys = ["_null", "_id", "_t1", "_t2"]
    return rows.join(kept, keys).dropDuplicates(keys).select("_row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents.

    Null and empty texts, and texts without a shingle that equal no other, are classes of their own. Equal texts are one class whatever their
    ids; of a class the smallest id is kept, and of rows that repeat an id all carry the same verdict. A null id stays null. Texts of any
    length are compared whole; other columns are not read; an empty table gives no rows.
    """
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


# All pairs by definition, without buckets.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
rep AS (SELECT text, min(doc_id) AS doc_id FROM w WHERE len(ws) > 0 GROUP BY text),
sh AS (SELECT doc_id, array_to_string(ws[s:s + 4], ' ') AS g, count(*)::DOUBLE AS x
       FROM w JOIN rep USING (doc_id), unnest(range(1, greatest(len(ws) - 3, 2))) u(s) GROUP BY ALL),
total AS (SELECT doc_id, sum(x) AS t FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.x) AS xa, sum(b.x) AS xb
           FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN total ta ON ta.doc_id = a JOIN total tb ON tb.doc_id = b
         WHERE xa >= 0.8 * ta.t - 1e-6 AND xb >= 0.8 * tb.t - 1e-6),
both_ AS (SELECT a, b, g, sum(xa) AS xa, sum(xb) AS xb FROM (
            SELECT a, b, g, x AS xa, 0e0 AS xb FROM near JOIN sh ON doc_id = a UNION ALL
            SELECT a, b, g, 0e0, x FROM near JOIN sh ON doc_id = b) GROUP BY ALL),
share AS (SELECT i.a, i.b, i.g, 1 / sum(greatest(j.xa / i.xa, j.xb / i.xb)) AS p
          FROM both_ i JOIN both_ j ON i.a = j.a AND i.b = j.b WHERE i.xa > 0 AND i.xb > 0 GROUP BY ALL),
link AS (SELECT a, b FROM share GROUP BY a, b HAVING sum(p) >= 0.8 - 1e-9),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM rep UNION SELECT x, b FROM reach JOIN edge ON a = y),
class AS (SELECT text, min(y) AS class_id FROM reach JOIN rep ON doc_id = x GROUP BY text)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, doc_id = coalesce(class_id, doc_id) AS kept
FROM w LEFT JOIN class ON class.text = w.text
"""
