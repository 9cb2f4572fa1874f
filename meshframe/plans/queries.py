"""Queries over the given tables, one or more per operator.

Each takes the session and the folder of the tables. Computed doubles are rounded to six decimals,
so that another engine's results compare equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.functions.arrays import as_doubles
from meshframe.functions.pixels import denormalize
from meshframe.functions.rotations import global_rotation, rodrigues, rot6d
from meshframe.operators import curation, geometry, images, losses, params, quality, reporting
from meshframe.operators.params import COMPACT_LAYOUT, Layout
from meshframe.plans import training
from meshframe.plans.corpus import detection_outcomes
from meshframe.plans.small_model import small_model, truth_points
from meshframe.session import ensure_checkpoint_dir, spread
from meshframe.sources import assets, files, sinks

Query = Callable[[SparkSession, str], DataFrame]

# The compact vector with its last ten shape coefficients read as expression.
EXPRESSION_LAYOUT = Layout((
    ("shape", 30), ("expression", 10), ("global_pose", 6), ("jaw_pose", 3),
    ("eye_pose", 6), ("neck_pose", 3), ("transl", 3), ("detail", 3),
))
STAGES = reporting.TRAINING_STAGES
FIRST_WEIGHTS = STAGES[0].weights
HEAD_OUTPUTS = 8
# Vertices of a face model as it is used for training.
FULL_VERTICES = 5023


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(col: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding vectors as coefficient rows: (sid, label, coeffs)."""
    raw = table(spark, folder, "embeddings")
    return raw.select(F.col("vec_id").alias("sid"), "label", as_doubles("embedding").alias("coeffs"))


def groups(spark: SparkSession, folder: str, layout: Layout = COMPACT_LAYOUT) -> DataFrame:
    """Coefficient rows cut into parameter groups, spread over the cores for the geometry."""
    return params.split_vector(spread(samples(spark, folder)), "coeffs", layout)


def dealt(df: DataFrame) -> DataFrame:
    """Samples dealt over the cores for the native forms. Partitions are sized by bytes, and these spend far more time per byte
    than a scan; splits of a file with one row group are empty but for one, however many there are."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, "sid")


def batched(spark: SparkSession, folder: str) -> DataFrame:
    return curation.permuted_batches(samples(spark, folder), "sid")


def points_long(df: DataFrame, col: str, index: str) -> DataFrame:
    """Array of three-element arrays to (sid, index, x, y, z)."""
    # The outer form infers no filter on the array, which would repeat its whole formula.
    long = df.select("sid", F.posexplode_outer(col).alias(index, "_p"))
    return long.select("sid", index, *[r6(F.col("_p").getItem(i)).alias(a) for i, a in enumerate("xyz")])


def values_long(df: DataFrame, col: str, *keys: str, index: str = "i") -> DataFrame:
    """Array of numbers to (keys, index, value)."""
    return df.select(*keys, F.posexplode_outer(col).alias(index, "value")).withColumn("value", r6("value"))


# --- sources and sinks --------------------------------------------------------------------------


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """The urls of pages as a file listing: those of web pages, one per stem."""
    pages = table(spark, folder, "pages").select(
        F.regexp_extract("url", "^[^?#]*", 0).alias("path"), F.length("html").cast("bigint").alias("length"))
    return files.listed(pages, ".html")


def listing_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The urls of pages as a listing, refreshed: some of them gone, some longer, all others as they were."""
    state = f"{ensure_checkpoint_dir(spark)}/listing-{uuid.uuid4().hex}"
    pages = table(spark, folder, "pages").groupBy(F.col("url").alias("path")).agg(
        F.max(F.length("html")).cast("bigint").alias("length"), F.max("page_id").alias("modified")).where("path IS NOT NULL")
    files.refresh_listing(pages.where("NOT (modified % 7 = 3)"), state)
    later = pages.where("NOT (modified % 11 = 5)").withColumn("length", F.expr("IF(modified % 5 = 2, length + 1, length)"))
    return files.refresh_listing(later, state).select("path", "length", "change")


def rgb(spark: SparkSession, folder: str) -> DataFrame:
    """Images of one, three and four channels from the vectors, some of them broken, as RGB levels."""
    hexed = "lpad(hex(pmod(CAST(floor(x * 1000) AS bigint), 256)), 2, '0')"
    images = samples(spark, folder).selectExpr(
        "sid", "IF(sid % 10 = 9, -1, IF(sid % 3 = 0, 8, IF(sid % 3 = 1, 2, 4))) AS height",
        "IF(sid % 3 = 0, 8, IF(sid % 3 = 1, 11, 4)) AS width",
        "IF(sid % 10 = 8, 2, element_at(array(1, 3, 4), CAST(sid % 3 + 1 AS int))) AS nChannels",
        f"unhex(array_join(transform(IF(sid % 3 = 1, concat(coeffs, slice(coeffs, 1, 2)), coeffs), x -> {hexed}), '')) AS data",
    )
    level = "CAST(conv(hex(substring(data, i + 1, 1)), 16, 10) AS int) AS level"
    return files.to_rgb(images).selectExpr(
        "sid", "reason", "data", "explode_outer(IF(data IS NULL, NULL, sequence(0, length(data) - 1))) AS i"
    ).selectExpr("sid", "reason", "i", level)


def model_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A model whose tables come from the vectors, one vertex each, with 70 landmarks: their corners with
    the template point plus the sum of the basis, which is cut to 8 shape and 4 expression columns."""
    rows = samples(spark, folder).select(F.col("sid").cast("int").alias("v"), "coeffs")
    n = rows.count()
    axes = {a: c for c, a in enumerate("xyz")}

    def basis(prefix: str, first: int, width: int) -> DataFrame:
        return rows.select("v", *[F.slice("coeffs", first + c, width).alias(f"{prefix}{a}") for a, c in axes.items()])

    ids = spark.range(n).select(F.col("id").cast("int").alias("i"))
    face = ids.where(F.col("i") < n - 2).select(F.col("i").alias("f"), F.col("i").alias("a"), (F.col("i") + 1).alias("b"), (F.col("i") + 2).alias("c"))
    share = [(F.col("i") % m + 1) / (F.col("i") % 3 + F.col("i") % 4 + F.col("i") % 5 + 3) for m in (3, 4, 5)]
    model = assets.load_assets(spark, "", 8, 4, {
        "template": rows.select("v", *[F.get("coeffs", F.lit(c)).alias(a) for a, c in axes.items()]),
        "shape_basis": basis("b", 4, 10), "expr_basis": basis("b", 14, 6), "pose_basis": basis("p", 1, 36),
        "joint_reg": rows.select((F.col("v") % 5).alias("j"), "v", F.lit(5.0 / max(n, 1)).alias("w")),
        "skin": rows.select("v", F.slice("coeffs", 20, 5).alias("w")), "faces": face,
        "lmk_embed": spark.range(70).select(F.col("id").cast("int").alias("i")).select(
            F.col("i").alias("lmk"), (F.col("i") * 5 % (n - 2)).cast("int").alias("f"), *[s.alias(f"b{k}") for k, s in enumerate(share)]),
    })
    whole = {a: r6(F.col(a) + F.aggregate(f"b{a}", F.lit(0.0), lambda t, x: t + x)).alias(a) for a in axes}
    corners = geometry.corner_table(model).join(geometry.vertex_table(model, ("shape", "expression")), "v")
    return corners.select("lmk", "k", "v", r6("b").alias("b"), *whole.values(), F.size("bx").alias("width"))


def landmark_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors written as array files in memory and read back; every tenth has a wrong shape."""
    def encode(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for record in records:
            blobs = []
            for sid, coeffs in zip(record.column("sid").to_pylist(), record.column("coeffs").to_pylist()):
                buffer = io.BytesIO()
                array = np.asarray(coeffs, dtype=np.float32)
                np.save(buffer, array if sid % 10 == 0 else array.reshape(-1, 2), allow_pickle=False)
                blobs.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([record.column("sid"), pa.array(blobs, pa.binary())], names=["sid", "content"])

    blobs = samples(spark, folder).select("sid", "coeffs").mapInArrow(encode, "sid bigint, content binary")
    decoded = files.decode_arrays(blobs, key="sid", n=32, d=2)
    return decoded.select("sid", "reason", F.posexplode_outer("points").alias("lmk", "p")).select(
        "sid", "reason", "lmk", r6(F.col("p.x").cast("double")).alias("x"), r6(F.col("p.y").cast("double")).alias("y")
    )


def embedding_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """One landmark file per vector, under the two key conventions, some with unit axes or bad shapes."""
    base = samples(spark, folder).select("sid", F.explode(F.expr(
        "filter(array(named_struct('key', 'full_lmk_faces_idx', 'on', sid % 3 = 0),"
        " named_struct('key', 'full_lmk_bary_coords', 'on', sid % 3 = 0),"
        " named_struct('key', 'lmk_face_idx', 'on', sid % 5 <> 0),"
        " named_struct('key', 'lmk_b_coords', 'on', sid % 5 <> 0)), e -> e.on)"
    )).alias("e"), "coeffs").select("sid", "e.key", "coeffs")
    n = "(CASE WHEN sid % 11 = 0 THEN 60 ELSE 68 END)"
    return base.selectExpr(
        "sid AS file", "key",
        f"CASE WHEN key LIKE '%bary%' OR key LIKE '%coords' THEN"
        f" IF(sid % 2 = 0, array(1, {n}, 3), array({n}, 3))"
        f" ELSE IF(sid % 2 = 0, array(1, {n}), array({n})) END AS shape",
        f"CASE WHEN key LIKE '%bary%' OR key LIKE '%coords' THEN"
        f" transform(sequence(0, 3 * {n} - 1), i -> abs(coeffs[cast(i % 64 as int)]))"
        f" ELSE transform(sequence(0, {n} - 1), i -> CAST((sid * 3 + i * 5) % 23 + IF(key LIKE 'full%', 1, 0) AS double))"
        f" END AS values",
    )


def resolve_embedding(spark: SparkSession, folder: str) -> DataFrame:
    rows = assets.embedding_rows(assets.resolve_embedding(embedding_catalog(spark, folder)))
    return rounded(rows, "b0", "b1", "b2")


def embedding_rejects(spark: SparkSession, folder: str) -> DataFrame:
    resolved = assets.resolve_embedding(embedding_catalog(spark, folder))
    return resolved.filter(F.col("reason").isNotNull()).select("file", "convention", "reason")


def land_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents landed in two runs, the second skipping what the first finished."""
    path = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents").join(
        table(spark, folder, "labels").dropDuplicates(["doc_id"]), "doc_id", "left"
    ).select(F.col("doc_id").alias("stem"), "lang", "n_chars", F.col("quality").alias("points"))
    sinks.land_corpus(docs.filter(F.col("lang") == "en"), path)
    done = sinks.landed_keys(sinks.read_corpus(spark, path))
    sinks.land_corpus(curation.pending(docs, *done, "stem"), path)
    return sinks.read_corpus(spark, path).groupBy("stem").agg(
        F.count("*").alias("copies"), F.max("points").alias("points")
    )


def obj_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Mesh text, the face ids counted from one and some meshes without their first vertex."""
    model = small_model(spark)
    verts = geometry.shape_verts(groups(spark, folder), model).where("NOT (sid % 7 = 3 AND v = 0)")
    return sinks.obj_lines(verts, model.faces.withColumn("f", F.col("f") + 1))


def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    terms = event_terms(spark, folder)
    last = reporting.last_batch(terms, ["epoch", "term"], "batch")
    rates = reporting.with_settings(last.select("epoch").distinct(), STAGES).filter("lr IS NOT NULL")
    return reporting.metric_rows(last).unionByName(reporting.rate_rows(rates))


def metric_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log after all epochs are written and the even ones written once more, their losses as they were."""
    path = f"{ensure_checkpoint_dir(spark)}/metrics-{uuid.uuid4().hex}"
    rows = metric_rows(spark, folder)
    sinks.write_metrics(rows.withColumn("value", F.expr("IF(step % 2 = 0, value + 1, value)")), path)
    sinks.write_metrics(rows.where("step % 2 = 0"), path)
    return sinks.read_metrics(spark, path)


# --- curation -----------------------------------------------------------------------------------


def pair(spark: SparkSession, folder: str) -> DataFrame:
    return curation.pair(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    return curation.orphans(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


def pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return curation.pair_counts(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


def pending(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return curation.pending(docs, docs.select("doc_id"), labels.filter("toxic = 0"), "doc_id").select(
        "doc_id", "lang", "n_chars"
    )


def pending_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The same as ``pending`` by bitmaps of the document numbers."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return curation.pending_ids(docs.select("doc_id", "lang", "n_chars"), docs.select("doc_id"), labels.filter("toxic = 0"), "doc_id")


def orphan_ids(spark: SparkSession, folder: str) -> DataFrame:
    return curation.orphan_ids(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


def name_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return curation.name_rows(docs, ["doc_id"], key="doc_id").select("doc_id", "source", "stem")


def name_new(spark: SparkSession, folder: str) -> DataFrame:
    """Documents named in two runs, English ones first; the second run names only those that have no name yet."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    path = f"{ensure_checkpoint_dir(spark)}/names-{uuid.uuid4().hex}"
    curation.name_new(docs.where("lang = 'en'"), path, ["doc_id"], "doc_id")
    return curation.name_new(docs, path, ["doc_id"], "doc_id")


def first_detection(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return curation.first_detection(turns, "conv_id", "turn").select("conv_id", "turn", "role", "text")


def detections(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as images, turns as detections whose array shape follows the turn's text."""
    turns = table(spark, folder, "conversations")
    shapes = turns.selectExpr(
        "conv_id", "turn",
        "CASE conv_id % 6 WHEN 0 THEN array(68, 2) WHEN 1 THEN array(68, 3)"
        " WHEN 2 THEN array(CAST(conv_id % 5 AS int), 68, 2) WHEN 3 THEN CAST(array() AS array<int>)"
        " WHEN 4 THEN array(68) ELSE array(length(text) % 2 + 68, 2) END AS shape",
        "IF(conv_id % 17 = 0, 'unreadable', CAST(NULL AS string)) AS error",
    )
    return turns.select("conv_id").distinct(), shapes


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    found, shapes = detections(spark, folder)
    done = found.filter("conv_id % 13 = 0")
    return detection_outcomes(found, shapes, (done, done), "conv_id", "turn")


def classify(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes(spark, folder).select("conv_id", "status")


def tally(spark: SparkSession, folder: str) -> DataFrame:
    return curation.tally(outcomes(spark, folder))


def tally_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return curation.tally_by_status(outcomes(spark, folder))


def pixel_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Small RGB images, 3 rows by 8 columns, from all 64 coefficients and the first eight once more."""
    hexed = "lpad(hex(pmod(CAST(floor(x * 1000) AS bigint), 256)), 2, '0')"
    return samples(spark, folder).selectExpr(
        "sid", "3 AS height", "8 AS width",
        f"unhex(array_join(transform(concat(coeffs, slice(coeffs, 1, 8)), x -> {hexed}), '')) AS data",
    )


def prepare_images(spark: SparkSession, folder: str) -> DataFrame:
    ready = images.prepare_images(pixel_rows(spark, folder), size=(8, 8), key="sid")
    return ready.select("sid", F.posexplode("pixels").alias("i", "value")).withColumn(
        "value", r6(F.col("value").cast("double"))
    )


def denormalized(spark: SparkSession, folder: str) -> DataFrame:
    restored = samples(spark, folder).withColumn("coeffs", denormalize(F.col("coeffs"), clamp=True))
    return values_long(restored, "coeffs", "sid")


def rescale(spark: SparkSession, folder: str) -> DataFrame:
    point = F.struct(F.hour("ts").cast("double").alias("x"), F.col("value").alias("y"))
    events = table(spark, folder, "events").select("event_id", F.array(point).alias("points"))
    moved = images.rescale(events).select("event_id", F.inline("points"))
    return rounded(moved, "x", "y")


def batches(spark: SparkSession, folder: str) -> DataFrame:
    return batched(spark, folder).select("sid", "batch", "slot")


def batches_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Turns in batches by their conversation, a key that repeats: every row is in one batch."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    return curation.batches(turns, "conv_id").groupBy("batch").agg(
        F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.sum("conv_id").alias("keys"))


def collate(spark: SparkSession, folder: str) -> DataFrame:
    grouped = curation.collate(batched(spark, folder), ["sid", "label"])
    return grouped.select(
        "batch", F.size("sid").alias("n"), F.concat_ws(",", F.col("sid").cast("array<string>")).alias("sids"),
        F.concat_ws(",", F.col("label").cast("array<string>")).alias("labels"),
    )


def head_of_last_batch(spark: SparkSession, folder: str) -> DataFrame:
    return curation.head_of_last_batch(batched(spark, folder)).select("batch", "slot", "sid")


# --- parameter vectors --------------------------------------------------------------------------


def group_entries(df: DataFrame, names: tuple[str, ...], *keys: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(n).alias("grp"), F.col(n).alias("vals")) for n in names])
    return df.select(*keys, F.inline(entries))


def split_vector(spark: SparkSession, folder: str) -> DataFrame:
    cut = params.split_vector(samples(spark, folder), "coeffs", COMPACT_LAYOUT)
    return group_entries(cut, COMPACT_LAYOUT.names, "sid").select(
        "sid", "grp", F.size("vals").alias("width"),
        r6(F.aggregate("vals", F.lit(0.0), lambda t, x: t + x)).alias("total"),
    )


def check_width(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth vector shortened, then told apart by the width contract."""
    cut = samples(spark, folder).withColumn(
        "coeffs", F.when(F.col("sid") % 10 == 0, F.slice("coeffs", 1, 60)).otherwise(F.col("coeffs"))
    )
    good, bad = params.check_width(cut, "coeffs", COMPACT_LAYOUT, "quarantine")

    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.select("sid", F.size("coeffs").alias("width"), F.lit(name).alias("verdict"))

    return listed(good, "good").unionByName(listed(bad, "bad"))


def head_arrays() -> tuple[np.ndarray, np.ndarray]:
    o, i = np.arange(HEAD_OUTPUTS), np.arange(COMPACT_LAYOUT.total)
    return ((o[:, None] * 3 + i[None, :] * 5) % 7 - 3) / 10.0, o / 10.0


def score_head(spark: SparkSession, folder: str) -> DataFrame:
    weights, bias = head_arrays()
    head = spark.createDataFrame(pa.table({
        "o": pa.array(np.arange(HEAD_OUTPUTS, dtype=np.int32)), "w": pa.array(weights.tolist()), "b": pa.array(bias),
    }))
    scored = params.score_head(samples(spark, folder), "coeffs", head, HEAD_OUTPUTS, COMPACT_LAYOUT.total)
    return rounded(scored, "y").select("sid", "o", "y")


def score_head_dense(spark: SparkSession, folder: str) -> DataFrame:
    scored = params.score_head_dense(samples(spark, folder), "coeffs", *head_arrays(), out="y")
    return scored.select("sid", F.posexplode("y").alias("o", "y")).withColumn("y", r6("y"))


def neutralize(spark: SparkSession, folder: str) -> DataFrame:
    cut = params.split_vector(samples(spark, folder), "coeffs", COMPACT_LAYOUT)
    calm = params.neutralize(cut, ["global_pose", "jaw_pose", "transl"], COMPACT_LAYOUT)
    return values_long(params.join_groups(calm, COMPACT_LAYOUT, "coeffs"), "coeffs", "sid")


# --- geometry -----------------------------------------------------------------------------------


def shape_verts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(geometry.shape_verts(groups(spark, folder), small_model(spark)), *"xyz")


def expression_verts(spark: SparkSession, folder: str) -> DataFrame:
    model = small_model(spark, n_shape=30, n_expr=10)
    return rounded(geometry.shape_verts(groups(spark, folder, EXPRESSION_LAYOUT), model), *"xyz")


def rest_joints(spark: SparkSession, folder: str) -> DataFrame:
    return points_long(geometry.rest_joints(groups(spark, folder), small_model(spark)), "rest", "j")


def rot6d_rows(spark: SparkSession, folder: str) -> DataFrame:
    return values_long(rot6d(groups(spark, folder), "global_pose"), "rot", "sid")


def pose_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Global pose cut to six, three or four numbers by sample."""
    width = F.expr("CASE sid % 3 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 4 END")
    cut = groups(spark, folder).withColumn("global_pose", F.slice("global_pose", F.lit(1), width))
    return values_long(global_rotation(cut, "global_pose"), "rot", "sid", "warn")


def rodrigues_rows(spark: SparkSession, folder: str) -> DataFrame:
    return values_long(rodrigues(groups(spark, folder), "jaw_pose"), "rot", "sid")


def stacked(spark: SparkSession, folder: str) -> DataFrame:
    return geometry.rotations(groups(spark, folder), global_width=COMPACT_LAYOUT.width("global_pose"))


def rotation_rows(spark: SparkSession, folder: str) -> DataFrame:
    long = stacked(spark, folder).select("sid", F.posexplode_outer("rots").alias("j", "rot"))
    return values_long(long, "rot", "sid", "j")


def framed(spark: SparkSession, folder: str, parents: tuple[int, ...]) -> DataFrame:
    model = small_model(spark, parents=parents)
    return geometry.chain(geometry.rest_joints(stacked(spark, folder), model), parents)


def chain(spark: SparkSession, folder: str) -> DataFrame:
    df = framed(spark, folder, (-1, 0, 1, 1, 1))
    return points_long(geometry.posed_joints(df, 5), "posed", "j")


def chain_star(spark: SparkSession, folder: str) -> DataFrame:
    df = framed(spark, folder, assets.STAR_PARENTS)
    return points_long(geometry.posed_joints(df, 5), "posed", "j")


def skin_transforms(spark: SparkSession, folder: str) -> DataFrame:
    return values_long(geometry.skin_transforms(framed(spark, folder, (-1, 0, 1, 1, 1)), 5), "transforms", "sid")


def pose_offset(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(geometry.pose_offset(stacked(spark, folder), small_model(spark)), *"xyz")


def skin(spark: SparkSession, folder: str) -> DataFrame:
    """Shaped vertices skinned by a join to the samples' transforms, without the pose offset; both are written bucketed by
    sample first."""
    model = small_model(spark)
    verts = geometry.shape_verts(groups(spark, folder), model)
    moves = geometry.skin_transforms(framed(spark, folder, model.parents), model.n_joints).select("sid", "transforms")
    place = f"{ensure_checkpoint_dir(spark)}/skin-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = [sinks.write_bucketed(df, f"{place}/{name}", "sid", buckets) for name, df in (("verts", verts), ("moves", moves))]
    return rounded(geometry.skin(*tables, model, colocated=True), *"xyz")


def translate(spark: SparkSession, folder: str) -> DataFrame:
    df = geometry.rest_joints(groups(spark, folder), small_model(spark))
    points = df.select("sid", "transl", F.posexplode_outer("rest").alias("j", "_p")).select(
        "sid", "transl", "j", *[F.col("_p").getItem(i).alias(a) for i, a in enumerate("xyz")]
    )
    return rounded(geometry.translate(points).drop("transl"), *"xyz")


def landmarks(spark: SparkSession, folder: str) -> DataFrame:
    """Landmarks straight from the parameters."""
    rows = geometry.decode_landmarks(groups(spark, folder), small_model(spark), COMPACT_LAYOUT)
    return rounded(rows, *"xyz")


def landmarks_native(spark: SparkSession, folder: str) -> DataFrame:
    """The same in column arithmetic alone."""
    cut = params.split_vector(dealt(samples(spark, folder)), "coeffs", COMPACT_LAYOUT)
    rows = geometry.decode_landmarks(cut, small_model(spark), COMPACT_LAYOUT, dense=False)
    return rounded(rows, *"xyz")


def landmarks_of_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """Landmarks gathered from all decoded vertices of a sample's row."""
    model = small_model(spark)
    verts = geometry.decode_dense(groups(spark, folder), model, COMPACT_LAYOUT, landmarks=False)
    return rounded(geometry.unroll_points(geometry.gather_landmarks(verts, model), points="landmarks"), *"xyz")


def landmarks_of_long_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a table of vertices, one a row, as it is stored."""
    model = small_model(spark)
    verts, _ = geometry.decode(groups(spark, folder), model, COMPACT_LAYOUT)
    return rounded(geometry.landmarks3d(verts, model), *"xyz")


def landmarks_dense(spark: SparkSession, folder: str) -> DataFrame:
    rows = geometry.decode_dense(groups(spark, folder), small_model(spark), COMPACT_LAYOUT)
    return rounded(geometry.unroll_points(rows), *"xyz")


def screen_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = geometry.decode_dense(groups(spark, folder), small_model(spark), COMPACT_LAYOUT)
    shown = geometry.project(geometry.unroll_points(rows))
    return rounded(shown.select("sid", "lmk", "sx", "sy"), "sx", "sy")


def decode(spark: SparkSession, folder: str) -> DataFrame:
    verts, _ = geometry.decode(groups(spark, folder), small_model(spark), COMPACT_LAYOUT, dense=False)
    return rounded(verts, *"xyz")


def full_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficient rows of the full width, each vector repeated until it fills one."""
    wide = samples(spark, folder).withColumn("coeffs", F.slice(F.concat(*["coeffs"] * 4), 1, params.FULL_LAYOUT.total))
    return params.split_vector(spread(wide), "coeffs", params.FULL_LAYOUT)


def full_vertex_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Shaped vertices of a model of real size, 5,023 vertices with 100 coefficients, in blocks of a megabyte; statistics per sample."""
    model = small_model(spark, n_shape=100, vertices=FULL_VERTICES)
    verts = geometry.shape_verts(full_samples(spark, folder), model, budget=1 << 20)
    return rounded(reporting.axis_stats(verts, ["x", "y", "z"], ["sid"]), "mean", "std", "min", "max")


def decode_dense(spark: SparkSession, folder: str) -> DataFrame:
    verts, _ = geometry.decode(groups(spark, folder), small_model(spark), COMPACT_LAYOUT)
    return rounded(verts, *"xyz")


# --- losses -------------------------------------------------------------------------------------


def pixel_l1(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector against the following one, the last against the first."""
    rows = samples(spark, folder)
    following = rows.select(F.pmod(F.col("sid") - 1, F.lit(rows.count())).alias("sid"), F.col("coeffs").alias("truth"))
    return rounded(losses.pixel_l1(rows.join(following, "sid"), "coeffs", "truth", ["label"]), "value")


def with_truth(df: DataFrame) -> DataFrame:
    return df.withColumn("truth", truth_points(F.col("sid")))


def landmark_mse(spark: SparkSession, folder: str) -> DataFrame:
    rows = training.landmark_rows(with_truth(groups(spark, folder)), small_model(spark), COMPACT_LAYOUT, ["label"])
    return rounded(losses.landmark_mse(rows, ["label", "sid"]), "value")


def landmark_mse_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The same error with the truth as a landmark table of its own."""
    rows = samples(spark, folder)
    truth = with_truth(rows.select("sid")).select("sid", F.posexplode("truth").alias("lmk", "p")).select(
        "sid", "lmk", "p.x", "p.y"
    )
    found = geometry.decode_dense(groups(spark, folder), small_model(spark), COMPACT_LAYOUT, keep=["label"])
    shown = geometry.project(geometry.unroll_points(found))
    return rounded(losses.landmark_mse(losses.align_landmarks(shown, truth), ["label"]), "value")


def landmark_mse_partial(spark: SparkSession, folder: str) -> DataFrame:
    """Landmark errors by label with a truth table that lacks all samples of the odd labels: these count 0."""
    rows = samples(spark, folder)
    truth = with_truth(rows.where("label % 2 = 0").select("sid")).select("sid", F.posexplode("truth").alias("lmk", "p")).select(
        "sid", "lmk", "p.x", "p.y"
    )
    found = geometry.decode_dense(groups(spark, folder), small_model(spark), COMPACT_LAYOUT, keep=["label"])
    shown = geometry.project(geometry.unroll_points(found))
    return rounded(losses.landmark_mse(losses.align_landmarks(shown, truth), ["label"]), "value")


def regularizer(term: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        cut = params.split_vector(samples(spark, folder), "coeffs", COMPACT_LAYOUT)
        return rounded(losses.regularizer(cut, term, ["label"]), "value")

    return query


def term_table(spark: SparkSession, folder: str) -> DataFrame:
    """Terms and total per batch, the landmark errors given as a table of their own."""
    cut = with_truth(params.split_vector(batched(spark, folder), "coeffs", COMPACT_LAYOUT))
    rows = training.landmark_rows(cut, small_model(spark), COMPACT_LAYOUT, ["batch"])
    terms = losses.loss_terms(cut, FIRST_WEIGHTS, ["batch"], rows)
    return rounded(losses.with_total(terms, FIRST_WEIGHTS, ["batch"]), "value")


def loss_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of a weight map with a zero, a missing and a perceptual weight."""
    weights = {"reg_shape": 1.0, "reg_detail": 0.0, "reg_transl": 2.0, "reg_global_pose": 0.5, "perceptual": 1.0}
    cut = params.split_vector(samples(spark, folder), "coeffs", COMPACT_LAYOUT)
    return rounded(losses.loss_terms(cut, weights, ["label"]), "value")


def total_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted total of active terms per batch, one of them without a weight in the total."""
    cut = params.split_vector(batched(spark, folder), "coeffs", COMPACT_LAYOUT)
    terms = losses.loss_terms(cut, {**FIRST_WEIGHTS}, ["batch"])
    partial = {k: v for k, v in FIRST_WEIGHTS.items() if k != "reg_transl"}
    return rounded(losses.total_loss(terms, partial, ["batch"]), "value")


def batch_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients to weighted losses of every batch under the first stage."""
    rows = with_truth(batched(spark, folder))
    return rounded(training.batch_losses(rows, small_model(spark), COMPACT_LAYOUT, FIRST_WEIGHTS), "value")


def image_losses(dense: bool) -> Query:
    """Losses with a positive pixel weight, a perceptual one and some samples without true landmarks."""
    weights = {**FIRST_WEIGHTS, "pixel": 0.5, "perceptual": 1.0}

    def query(spark: SparkSession, folder: str) -> DataFrame:
        given = batched(spark, folder)
        rows = with_truth(given if dense else dealt(given)).withColumns({
            "truth": F.when(F.col("sid") % 10 != 3, F.col("truth")), "shown": F.col("coeffs"), "seen": F.reverse("coeffs")})
        found = training.batch_losses(
            rows, small_model(spark), COMPACT_LAYOUT, weights, dense=dense, images=("shown", "seen"))
        return rounded(found, "value")

    return query


def batch_losses_native(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_truth(dealt(batched(spark, folder)))
    found = training.batch_losses(rows, small_model(spark), COMPACT_LAYOUT, FIRST_WEIGHTS, dense=False)
    return rounded(found, "value")


def epoch_samples(spark: SparkSession, folder: str) -> DataFrame:
    return with_truth(batched(spark, folder)).withColumn("epoch", F.col("label") * 3)


def staged_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Losses per epoch and batch under the epoch's stage."""
    return rounded(training.staged_losses(epoch_samples(spark, folder), small_model(spark), COMPACT_LAYOUT, STAGES), "value")


def epoch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    terms = training.staged_losses(epoch_samples(spark, folder), small_model(spark), COMPACT_LAYOUT, STAGES)
    return rounded(training.epoch_metrics(terms, STAGES), "value")


# --- reports and checks -------------------------------------------------------------------------


def event_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Events as loss values: the day is the epoch, the type the term, the id the batch."""
    return table(spark, folder, "events").select(
        (F.dayofmonth("ts") - 1).alias("epoch"), F.col("event_type").alias("term"), F.col("event_id").alias("batch"), "value"
    )


def with_settings(spark: SparkSession, folder: str) -> DataFrame:
    rows = reporting.with_settings(event_terms(spark, folder), STAGES)
    return rows.select(
        F.col("batch").alias("event_id"), "epoch", "stage", "name", "stage_epoch", "lr",
        F.col("verbose").alias("verbose_mark"), F.col("progress").alias("progress_mark"),
        F.col("weights").getItem("landmark").alias("landmark_weight"),
    )


def last_batch(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reporting.last_batch(event_terms(spark, folder), ["epoch", "term"], "batch"), "last_value", "mean_value")


def axis_stats(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    stats = reporting.axis_stats(table(spark, folder, "lineitem"), cols, ["l_returnflag"])
    return rounded(stats, "mean", "std", "min", "max")


def merged_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of order lines by flag, merged from states by flag and month of shipment."""
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    lines = table(spark, folder, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    states = reporting.moment_states(lines, cols, ["l_returnflag", "month"])
    merged = reporting.merge_states(states.drop("month"), ["l_returnflag"])
    return rounded(reporting.stats_of_states(merged, ["l_returnflag"]), "mean", "std", "min", "max")


def vertex_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = geometry.decode_dense(groups(spark, folder), small_model(spark), COMPACT_LAYOUT, landmarks=False)
    stats = reporting.axis_stats(geometry.unroll_points(rows, "v"), ["x", "y", "z"], ["sid"])
    return rounded(stats, "mean", "std", "min", "max")


def group_stats(spark: SparkSession, folder: str) -> DataFrame:
    names = [*COMPACT_LAYOUT.names, "texture"]
    stats = reporting.group_stats(samples(spark, folder), "coeffs", COMPACT_LAYOUT, names)
    return rounded(stats, "mean", "std", "min", "max").withColumnRenamed("group", "grp")


def non_finite(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select(
        "l_returnflag",
        "l_extendedprice",
        F.expr("IF(l_discount = 0, double('NaN'), 1 / l_discount)").alias("per_discount"),
        F.expr("IF(l_tax = 0, -double('Infinity'), 1 / l_tax)").alias("per_tax"),
    )
    return quality.non_finite(items, ["l_extendedprice", "per_discount", "per_tax"], ["l_returnflag"])


def grid(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "events").select(F.hour("ts").cast("double").alias("x"), F.col("value").alias("y"))
    return reporting.grid(points, 24, 500)


def preview(spark: SparkSession, folder: str) -> DataFrame:
    return values_long(reporting.preview(samples(spark, folder), "coeffs"), "coeffs", "sid")


def profile(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "embeddings")
    found = reporting.profile(raw, "embedding", ["label"], "vec_id")
    heads = [F.get("head", F.lit(i)).alias(f"h{i}") for i in range(5)]
    return rounded(
        found.select("label", "rows", "width", "dtype", "min", "mean", "max", *heads),
        "min", "mean", "max", *[f"h{i}" for i in range(5)],
    )


def array_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as arrays of a file: the line number picks the key, quantity and flag the shape and type."""
    names = ", ".join(f"'{k}'" for k in quality.INDEX_KEYS)
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS file",
        f"CASE WHEN l_suppkey % 4 = 0 THEN 'lmk_face_idx' WHEN l_suppkey % 4 = 1 THEN 'lmk_b_coords'"
        f" ELSE element_at(array({names}), l_linenumber % 7 + 1) END AS key",
        "CASE WHEN l_suppkey % 4 = 1 THEN array(68, CAST(l_quantity % 2 AS int) + 2)"
        " WHEN l_partkey % 5 = 0 THEN array(1, 68) ELSE array(CAST(l_quantity % 3 AS int) + 66) END AS shape",
        "IF(l_returnflag = 'R', 'float32', 'int64') AS dtype",
    )


def contract(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.contract(array_profiles(spark, folder))
    # Several arrays of a file may share the winning key, so its type is not compared.
    return found.select("file", "key", "bary_ok", "status")


def contract_types(spark: SparkSession, folder: str) -> DataFrame:
    """Files by verdict and by whether the chosen array holds integers, one type per key and file."""
    one = array_profiles(spark, folder).groupBy("file", "key").agg(
        F.max("shape").alias("shape"), F.max("dtype").alias("dtype")
    )
    return quality.contract(one).groupBy("status", "is_integer").agg(F.count("*").alias("files"))


def contract_failures(spark: SparkSession, folder: str) -> DataFrame:
    profiles = array_profiles(spark, folder)
    failed = quality.contract_failures(profiles, quality.contract(profiles))
    return failed.groupBy("file").agg(F.count("*").alias("arrays"))


def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Landmarks by both routes, with some rows missing or moved on the stored side."""
    model = small_model(spark)
    cut = groups(spark, folder)
    verts, direct = geometry.decode(cut, model, COMPACT_LAYOUT)
    gathered = geometry.landmarks3d(verts, model)
    stored = direct.filter("NOT (sid % 50 = 7 AND lmk = 0)").withColumn(
        "x", F.when(F.expr("sid % 20 = 3 AND lmk = 5"), F.col("x") + 0.25).otherwise(F.col("x"))
    )
    checked = quality.reconcile(stored, gathered, ["sid", "lmk"], ["x", "y", "z"])
    return rounded(quality.reconcile_summary(checked), "diff")


def reconcile_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Orders against a copy with some missing, added and moved, digests first."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    copy = orders.where("NOT (o_orderkey % 500 = 7)").withColumn(
        "o_totalprice", F.expr("IF(o_orderkey % 400 = 3, o_totalprice + 0.25, o_totalprice)"))
    extra = orders.where("o_orderkey % 600 = 1").withColumn("o_orderkey", -F.col("o_orderkey"))
    checked = quality.reconcile_by_digest(orders, copy.unionByName(extra), ["o_orderkey"], ["o_custkey", "o_totalprice"])
    return rounded(checked, "diff")


def presence(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines by whether their shifted part, and their shifted supplier, exist."""
    refs = table(spark, folder, "lineitem").selectExpr("l_partkey + l_linenumber - 4 AS part", "l_suppkey - l_linenumber + 3 AS supplier")
    found = quality.with_presence(refs, "part", table(spark, folder, "part"), "p_partkey", "has_part")
    found = quality.with_presence(found, "supplier", table(spark, folder, "supplier"), "s_suppkey", "has_supplier")
    return found.groupBy("has_part", "has_supplier").agg(F.count("*").alias("n"))


def dangling(spark: SparkSession, folder: str) -> DataFrame:
    refs = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_linenumber") - 4).alias("ref")
    )
    return quality.dangling(refs, "ref", table(spark, folder, "part"), "p_partkey")


QUERIES: dict[str, Query] = {
    "scan_files": scan_files,
    "listing_changes": listing_changes,
    "rgb": rgb,
    "model_tables": model_tables,
    "landmark_ingest": landmark_ingest,
    "resolve_embedding": resolve_embedding,
    "embedding_rejects": embedding_rejects,
    "land_corpus": land_corpus,
    "obj_lines": obj_lines,
    "metric_rows": metric_rows,
    "metric_log": metric_log,
    "pair": pair,
    "orphans": orphans,
    "pair_counts": pair_counts,
    "pending": pending,
    "pending_ids": pending_ids,
    "orphan_ids": orphan_ids,
    "name_rows": name_rows,
    "name_new": name_new,
    "first_detection": first_detection,
    "classify": classify,
    "tally": tally,
    "tally_by_status": tally_by_status,
    "prepare_images": prepare_images,
    "denormalize": denormalized,
    "rescale": rescale,
    "batches": batches,
    "batches_repeated": batches_repeated,
    "collate": collate,
    "head_of_last_batch": head_of_last_batch,
    "split_vector": split_vector,
    "check_width": check_width,
    "score_head": score_head,
    "score_head_dense": score_head_dense,
    "neutralize": neutralize,
    "shape_verts": shape_verts,
    "expression_verts": expression_verts,
    "rest_joints": rest_joints,
    "rot6d": rot6d_rows,
    "pose_dispatch": pose_dispatch,
    "rodrigues": rodrigues_rows,
    "rotations": rotation_rows,
    "chain": chain,
    "chain_star": chain_star,
    "skin_transforms": skin_transforms,
    "pose_offset": pose_offset,
    "skin": skin,
    "translate": translate,
    "landmarks": landmarks,
    "landmarks_native": landmarks_native,
    "landmarks_of_vertices": landmarks_of_vertices,
    "landmarks_of_long_vertices": landmarks_of_long_vertices,
    "landmarks_dense": landmarks_dense,
    "screen_points": screen_points,
    "decode": decode,
    "decode_dense": decode_dense,
    "full_vertex_stats": full_vertex_stats,
    "pixel_l1": pixel_l1,
    "landmark_mse": landmark_mse,
    "landmark_mse_joined": landmark_mse_joined,
    "landmark_mse_partial": landmark_mse_partial,
    **{term: regularizer(term) for term in losses.REGULARIZERS},
    "loss_gate": loss_gate,
    "term_table": term_table,
    "total_loss": total_loss,
    "batch_losses": batch_losses,
    "batch_losses_native": batch_losses_native,
    "image_losses": image_losses(dense=True),
    "image_losses_native": image_losses(dense=False),
    "staged_losses": staged_losses,
    "epoch_metrics": epoch_metrics,
    "with_settings": with_settings,
    "last_batch": last_batch,
    "axis_stats": axis_stats,
    "merged_stats": merged_stats,
    "vertex_stats": vertex_stats,
    "group_stats": group_stats,
    "non_finite": non_finite,
    "grid": grid,
    "preview": preview,
    "profile": profile,
    "contract": contract,
    "contract_types": contract_types,
    "contract_failures": contract_failures,
    "reconcile": reconcile,
    "reconcile_digests": reconcile_digests,
    "presence": presence,
    "dangling": dangling,
}
