"""Model tables that do not fit together are refused by every form; sizes change the plan, not the outcome."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshframe.operators import curation, geometry, losses, params
from meshframe.operators.params import COMPACT_LAYOUT
from meshframe.plans import small_model as sm
from meshframe.plans import training
from meshframe.sources import assets, files, sinks


def rows(spark, n=3):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=64) / 10]) for i in range(n)], "sid int, coeffs array<double>")
    return params.split_vector(df, "coeffs", COMPACT_LAYOUT)


def load(spark, **changed):
    tables = sm.tables(spark)
    joints = spark.createDataFrame([(j, p) for j, p in enumerate(sm.TREE)], "j int, parent int")
    return assets.load_assets(spark, "", 40, 0, {**tables, "joints": joints, **changed})


def points(df):
    return {(r["sid"], r["lmk"]): (r["x"], r["y"], r["z"]) for r in df.collect()}


def test_a_model_of_seventy_landmarks(spark):
    lmk = np.arange(70)
    embed = spark.createDataFrame(pa.table({
        "lmk": pa.array(lmk.astype(np.int32)), "f": pa.array((lmk % 23).astype(np.int32)), "b0": np.full(70, 0.2), "b1": np.full(70, 0.3), "b2": np.full(70, 0.5)}))
    model = load(spark, lmk_embed=embed)
    native = points(geometry.decode_landmarks(rows(spark), model, COMPACT_LAYOUT, dense=False))
    dense = points(geometry.unroll_points(geometry.decode_dense(rows(spark), model, COMPACT_LAYOUT)))
    assert len(native) == 210 and native.keys() == dense.keys()
    assert all(np.allclose(native[k], dense[k], atol=1e-9) for k in native)


@pytest.mark.parametrize("name, change", [
    ("lmk_embed", lambda df: df.withColumn("f", F.when(F.col("lmk") == 0, 99).otherwise(F.col("f")))),
    ("lmk_embed", lambda df: df.where("lmk <> 5")),
    ("lmk_embed", lambda df: df.union(df.where("lmk = 5"))),
    ("skin", lambda df: df.where("v <> 3")),
    ("skin", lambda df: df.union(df.where("v = 3"))),
    ("template", lambda df: df.withColumn("v", F.col("v") + 1)),
    ("shape_basis", lambda df: df.where("v <> 0")),
    ("pose_basis", lambda df: df.where("v <> 0")),
    ("faces", lambda df: df.withColumn("c", F.col("c") + 5)),
    ("faces", lambda df: df.withColumn("f", F.col("f") * 2)),
    ("joint_reg", lambda df: df.withColumn("v", F.col("v") + 9)),
])
def test_faulty_tables_are_refused(spark, name, change):
    tables = sm.tables(spark)
    with pytest.raises(ValueError, match="do not fit together"):
        load(spark, **{name: change(tables[name])})
    broken = replace(sm.small_model(spark), **{name: change(tables[name])})
    for decode in (geometry.decode_landmarks, geometry.decode_vertices, geometry.decode_dense):
        with pytest.raises(ValueError, match="do not fit together"):
            decode(rows(spark), broken, COMPACT_LAYOUT)


def test_small_blocks_give_the_same_rows(spark, monkeypatch):
    model = sm.small_model(spark)

    def everything():
        fresh = replace(model)
        cut = rows(spark, 40)
        head = params.score_head_dense(rows(spark).select("sid", "shape"), "shape", np.ones((7, 40)), np.arange(7.0))
        return [sorted(map(tuple, df.collect())) for df in (
            geometry.unroll_points(geometry.decode_dense(cut, fresh, COMPACT_LAYOUT)),
            geometry.unroll_points(geometry.decode_dense(cut, fresh, COMPACT_LAYOUT, landmarks=False), "v"),
            geometry.shape_verts(cut, fresh), geometry.pose_offset(geometry.rotations(cut), fresh), head)]

    want = everything()
    for module, size in ((geometry, 8000), (params, 700)):
        monkeypatch.setattr(module, "BROADCAST_BYTES", size)
        monkeypatch.setattr(module, "BLOCK_BYTES", size)
    assert geometry._block_step(model, False, None) <= 5 and geometry._block_step(model, True, None) <= 5
    for a, b in zip(want, everything()):
        assert len(a) == len(b) and all(np.allclose(np.array(x[-3:], float) if len(x) > 2 else x[1], np.array(y[-3:], float) if len(y) > 2 else y[1]) for x, y in zip(a, b))


def test_dense_and_native_offsets_agree(spark):
    model, cut = sm.small_model(spark), rows(spark, 5)
    for f, df in ((geometry.shape_verts, cut), (geometry.pose_offset, geometry.rotations(cut))):
        a, b = ({(r[0], r[1]): r[2:] for r in f(df, model, dense=d).collect()} for d in (True, False))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-12) for k in a)


def test_missing_truth_counts_alike(spark):
    cut = rows(spark, 6).withColumns({
        "batch": F.lit(0), "truth": F.when(F.col("sid") % 2 == 0, sm.truth_points(F.col("sid"))),
        "coeffs": F.concat(*COMPACT_LAYOUT.names)}).select("sid", "batch", "truth", "coeffs")
    weights = {"reg_detail": 1.0, "landmark": 1.0}
    dense, native = ({r["term"]: r["value"] for r in training.batch_losses(
        cut, sm.small_model(spark), COMPACT_LAYOUT, weights, dense=d).collect()} for d in (True, False))
    assert dense.keys() == native.keys() and all(dense[t] == pytest.approx(native[t]) for t in dense)


def test_losses_of_missing_and_unequal_inputs(spark):
    gaps = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 0.0, None, None)], "g int, sx double, sy double, tx double, ty double")
    assert losses.landmark_mse(gaps, ["g"]).first()["value"] == 1.0
    images = spark.createDataFrame([(1, [1.0, 2.0], [2.0, 2.0]), (1, [5.0], None)], "g int, a array<double>, b array<double>")
    assert losses.pixel_l1(images, "a", "b", ["g"]).first()["value"] == 0.5
    uneven = spark.createDataFrame([(1, [1.0, 2.0], [2.0])], "g int, a array<double>, b array<double>")
    with pytest.raises(Exception, match="elements"):
        losses.pixel_l1(uneven, "a", "b", ["g"]).collect()
    with pytest.raises(ValueError, match="image"):
        losses.with_sample_sums(uneven, ["pixel"])


def test_repeated_keys_are_batched_once(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 3)], "k string, x int")
    got = curation.batches(df, "k", size=3).collect()
    assert sorted((r["k"], r["x"]) for r in got) == [("a", 1), ("a", 2), ("a", 2), ("b", 3)]
    assert sorted((r["batch"], r["slot"]) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0)]
    for call in (lambda: curation.batches(df, "k", unique=True), lambda: curation.name_rows(df, ["k"], key="k")):
        with pytest.raises(ValueError, match="repeats"):
            call()
    named = curation.name_rows(df.where("x <> 2"), ["k"], key="k").collect()
    assert sorted((r["k"], r["stem"]) for r in named) == [("a", "thumb_00000"), ("b", "thumb_00001")]


def test_landing_again_replaces(spark, tmp_path):
    path, schema = str(tmp_path / "corpus"), "stem string, points array<double>, note string"
    def land(*records):
        sinks.land_corpus(spark.createDataFrame(list(records), schema), path)
    for _ in range(3):
        land(("a", None, "x"), ("a", None, "x"), ("b", [1.0], "x"), ("c", None, "x"))
    land(("c", [2.0], "y"), ("b", None, "y"), ("d", None, "y"))
    got = {r["stem"]: (r["points"], r["note"]) for r in sinks.read_corpus(spark, path).collect()}
    assert got == {"a": (None, "x"), "b": ([1.0], "x"), "c": ([2.0], "y"), "d": (None, "y")}
    assert sinks.read_corpus(spark, path).count() == 4
    with pytest.raises(Exception, match="without a key"):
        land((None, None, "x"))


def test_mesh_text_of_any_face_ids(spark):
    verts = spark.createDataFrame([(7, 1, 0.0, 0.0, 0.0), (8, 0, 1.0, 1.0, 1.0)], "sid int, v int, x double, y double, z double")
    faces = spark.createDataFrame([(1, 0, 1, 2), (5, 2, 1, 0)], "f int, a int, b int, c int")
    got = sorted((r["sid"], r["ord"], r["line"]) for r in sinks.obj_lines(verts, faces).where("section = 1").collect())
    assert got == [(s, *rest) for s in (7, 8) for rest in ((1, "f 1 2 3"), (5, "f 3 2 1"))]


def test_mesh_buckets(spark, tmp_path):
    verts = spark.createDataFrame([(i, 0, float(i), 0.0, 0.0) for i in range(20)], "sid int, v int, x double, y double, z double")
    sinks.export_obj_buckets(verts, None, str(tmp_path / "m"), 3)
    got = {r["sid"]: r["text"] for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert len(got) == 20 and got[4] == "v 4.000000 0.000000 0.000000\n"


def test_images_that_cannot_be_read_stay(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = files.read_images(spark, str(tmp_path)).collect()
    assert [(r["stem"], r["data"], r["reason"]) for r in got] == [("bad", None, "undecodable")]


def test_hidden_names_are_not_listed(spark, tmp_path):
    for name in ("a.x", "_b.x", ".c.x", "d.y"):
        (tmp_path / name).write_text("1")
    assert [r["stem"] for r in files.scan_files(spark, str(tmp_path), ".x").collect()] == ["a"]
