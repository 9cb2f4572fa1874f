import math

import pytest
from pyspark.sql import functions as F

from meshframe.operators import losses as lo
from meshframe.operators import quality as q
from meshframe.operators import reporting as rp
from meshframe.operators.params import COMPACT_LAYOUT, Layout, split_vector
from meshframe.plans import training
from meshframe.plans.small_model import small_model, truth_points


@pytest.fixture(scope="module")
def cut(spark):
    rows = [(i, i // 2, [((i * 7 + k * 3) % 11 - 5) / 10.0 for k in range(64)]) for i in range(4)]
    return split_vector(spark.createDataFrame(rows, "sid bigint, batch bigint, coeffs array<double>"), "coeffs", COMPACT_LAYOUT)


def as_map(df, *keys):
    return {tuple(r[k] for k in keys): r.value for r in df.collect()}


def test_terms_are_gated_and_total_defaults_to_one(spark, cut):
    weights = {"reg_shape": 2.0, "reg_detail": 0.0, "perceptual": 3.0}
    terms = as_map(lo.loss_terms(cut, weights), "batch", "term")
    rows = [r for r in cut.collect() if r.batch == 0]
    want = sum(x * x for r in rows for x in r.shape) / 80
    assert math.isclose(terms[0, "reg_shape"], want)
    assert terms[0, "reg_detail"] == 0 and terms[0, "reg_jaw_pose"] == 0 and terms[0, "perceptual"] == 0
    assert (0, "landmark") not in terms and (0, "pixel") not in terms
    total = as_map(lo.total_loss(lo.loss_terms(cut, weights), {}), "batch")
    assert math.isclose(total[0,], want)
    assert math.isclose(as_map(lo.with_total(lo.loss_terms(cut, weights), weights), "batch", "term")[0, "total"], 2 * want)


def test_global_pose_target_and_empty_group(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.5], [])], "batch int, global_pose array<double>, expression array<double>")
    terms = as_map(lo.loss_terms(df, {"reg_global_pose": 1.0, "reg_expression": 1.0}), "term")
    assert math.isclose(terms["reg_global_pose",], 0.25 / 6) and terms["reg_expression",] == 0


def test_pixel_term_is_pruned_at_weight_zero(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [0.0, 4.0])], "batch int, a array<double>, b array<double>")
    assert as_map(lo.loss_terms(df, {}, images=("a", "b")), "term")["pixel",] == 1.5
    pruned = lo.loss_terms(df, {"pixel": 0.0}, images=("a", "b"))
    assert ("pixel",) not in as_map(pruned, "term")


def test_fused_losses_equal_separate_ones(spark, cut):
    rows = cut.withColumn("truth", truth_points(F.col("sid")))
    joined = rows.withColumn("coeffs", F.concat(*COMPACT_LAYOUT.names)).select("sid", "batch", "coeffs", "truth")
    weights = rp.TRAINING_STAGES[1].weights
    model = small_model(spark)
    fused = as_map(training.batch_losses(joined, model, COMPACT_LAYOUT, weights), "batch", "term")
    native = as_map(training.batch_losses(joined, model, COMPACT_LAYOUT, weights, dense=False), "batch", "term")
    landmarks = training.landmark_rows(rows, model, COMPACT_LAYOUT, ["batch"])
    apart = as_map(lo.with_total(lo.loss_terms(cut, weights, ["batch"], landmarks), weights), "batch", "term")
    assert set(fused) == set(apart) == set(native)
    assert all(math.isclose(fused[k], apart[k], rel_tol=1e-9) and math.isclose(fused[k], native[k], rel_tol=1e-9) for k in fused)


def test_staged_weights_and_metrics(spark, cut):
    rows = cut.withColumn("truth", truth_points(F.col("sid"))).withColumn("coeffs", F.concat(*COMPACT_LAYOUT.names)).select(
        "sid", "batch", "coeffs", "truth", F.lit(0).alias("epoch"))
    stages = (rp.Stage("one", 1, None, {"landmark": 0.0, "reg_shape": 3.0}),)
    terms = training.staged_losses(rows, small_model(spark), COMPACT_LAYOUT, stages)
    got = as_map(terms, "batch", "term")
    assert math.isclose(got[1, "total"], 3 * got[1, "reg_shape"]) and got[1, "reg_transl"] == 0
    metrics = {r.tag: r for r in training.epoch_metrics(terms, stages).collect()}
    assert metrics["Loss/train_total_epoch_last_batch"].value == got[1, "total"]
    assert metrics["Hyperparameters/learning_rate_epoch"].value == 1e-4 and {r.step for r in metrics.values()} == {1}


def test_epoch_settings_marks(spark):
    rows = {r.epoch: r for r in rp.epoch_settings(spark).collect()}
    assert sorted(rows) == list(range(30))
    assert [e for e, r in rows.items() if r.verbose] == [0, 15, 29]
    assert [e for e, r in sorted(rows.items()) if r.progress] == [0, 4, 9, 10, 14, 19, 20, 24, 29]
    assert rows[10].name == "Stage2_CoarseAlignment" and rows[10].stage_epoch == 0 and rows[10].lr == 1e-5
    df = spark.createDataFrame([(0,), (99,)], "epoch int")
    assert {r.epoch: r.stage for r in rp.with_settings(df).collect()} == {0: 1, 99: None}
    assert rp.epoch_settings(spark, ()).count() == 0


def test_last_batch_is_not_the_mean(spark):
    df = spark.createDataFrame([(0, "t", 0, 1.0), (0, "t", 1, 5.0)], "epoch int, term string, batch int, value double")
    r = rp.last_batch(df, ["epoch", "term"], "batch").first()
    assert (r.last_batch, r.last_value, r.mean_value) == (1, 5.0, 3.0)


def test_statistics_of_one_row_and_empty_groups(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    stats = {r.axis: r for r in rp.axis_stats(df, ["x", "y"]).collect()}
    assert stats["x"].std is None and stats["x"].mean == 1.0 and stats["y"].n == 1
    layout = Layout((("a", 2), ("b", 0), ("c", 1)))
    vec = spark.createDataFrame([([1.0, 3.0, 9.0],)], "v array<double>")
    got = {r.group: r for r in rp.group_stats(vec, "v", layout, ["a", "b", "c", "d"]).collect()}
    assert got["a"].mean == 2.0 and math.isclose(got["a"].std, math.sqrt(2)) and got["c"].std is None
    assert (got["b"].state, got["d"].state, got["a"].state, got["b"].n) == ("empty", "absent", "present", 0)


def test_grid_clips_and_skips_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([(-5.0, 0.0), (224.0, 224.0), (500.0, 112.0), (nan, 1.0), (None, 1.0)], "x double, y double")
    cells = {(r.gx, r.gy): r.points for r in rp.grid(df, 224, 224).collect()}
    assert cells == {(0, 0): 1, (39, 19): 1, (39, 9): 1}


def test_profile_and_preview(spark):
    df = spark.createDataFrame([("a", 1, [4.0, 5.0]), ("a", 0, [1.0, 3.0])], "f string, k int, v array<double>")
    r = rp.profile(df, "v", ["f"], "k", k=1).first()
    assert (r.rows, r.width, r.dtype, r.min, r.mean, r.max, r.head) == (2, 2, "double", 1.0, 3.25, 5.0, [1.0])
    assert rp.preview(df, "v", 1).first().v == [4.0]
    assert rp.preview_rows(spark.range(68).withColumnRenamed("id", "lmk")).count() == 5


def test_non_finite(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, -inf), (float("nan"), inf), (None, 0.0)], "a double, b double")
    assert {r.col: r.bad for r in q.non_finite(df, ["a", "b"]).collect()} == {"a": 1, "b": 2}


def test_contract(spark):
    rows = [
        ("f1", "ids", [68], "int64"), ("f1", "lmk_idx", [68], "float32"), ("f1", "vertex_ids_68", [68, 3], "int64"),
        ("f2", "lmk_face_idx", [68], "int64"), ("f2", "lmk_b_coords", [68, 3], "float64"),
        ("f3", "lmk_face_idx", [68], "int64"), ("f3", "ids", [67], "int64"), ("f4", "other", [68], "int64"),
    ]
    df = spark.createDataFrame(rows, "file string, key string, shape array<int>, dtype string")
    checked = q.contract(df)
    got = {r.file: (r.key, r.is_integer, r.bary_ok, r.status) for r in checked.collect()}
    assert got["f1"] == ("lmk_idx", False, False, "indices")
    assert got["f2"] == (None, None, True, "barycentric")
    assert got["f3"][3] == got["f4"][3] == "missing"
    assert {r.file for r in q.contract_failures(df, checked).collect()} == {"f3", "f4"}


def test_reconcile_names_every_difference(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (4, float("nan"))], "k int, x double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.5), (3, 3.0), (4, 1.0)], "k int, x double")
    got = {r.k: (r.status, r.diff) for r in q.reconcile(a, b, ["k"], ["x"]).collect()}
    assert got[0] == ("match", 0.0) and got[1] == ("mismatch", 0.5) and got[4][0] == "mismatch"
    assert got[2][0] == "stored_only" and got[3][0] == "recomputed_only"


def test_dangling(spark):
    refs = spark.createDataFrame([(0,), (-1,), (5,), (None,)], "r int")
    target = spark.createDataFrame([(0,), (1,), (-1,)], "f int")
    assert {r.r for r in q.dangling(refs, "r", target, "f").collect()} == {-1, 5, None}
