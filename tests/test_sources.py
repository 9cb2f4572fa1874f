import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.functions.pixels import denormalize, normalize
from meshframe.operators import images
from meshframe.operators.curation import pair, pending
from meshframe.operators.geometry import decode_vertices
from meshframe.operators.params import COMPACT_LAYOUT, split_vector
from meshframe.plans import small_model as sm
from meshframe.sources import assets, files, sinks
from meshframe.streaming.landing import land_stream


def png(pixels):
    """Minimal 8-bit PNG of an (h, w, 1|3|4) array."""
    h, w, c = pixels.shape
    raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_scan_files(spark, tmp_path):
    for name in ("a.png", "a.b.png", "c.PNG", "d.npy", "e.png.txt"):
        (tmp_path / name).write_bytes(b"xx")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.png").write_bytes(b"x")
    rows = files.scan_files(spark, str(tmp_path), ".png").collect()
    assert {r.stem for r in rows} == {"a", "a.b"} and all(r.length == 2 for r in rows)
    found = pair(files.scan_files(spark, str(tmp_path), ".png"), files.scan_files(spark, str(tmp_path), ".npy"), "stem")
    assert found.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_files(spark, str(tmp_path / "none"), ".png").count()


def test_read_landmarks(spark, tmp_path):
    points = np.arange(136, dtype=np.float64).reshape(68, 2)
    np.save(tmp_path / "ok.v2.npy", points)
    np.save(tmp_path / "short.npy", points[:5])
    np.save(tmp_path / "objects.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    (tmp_path / "junk.npy").write_bytes(b"junk")
    got = {r.stem: r for r in files.read_landmarks(spark, str(tmp_path)).collect()}
    assert got["ok.v2"].reason is None and len(got["ok.v2"].points) == 68 and got["ok.v2"].points[3].y == 7.0
    assert got["short"].reason == "shape (5, 2)" and got["short"].points is None
    assert got["objects"].reason.startswith("unreadable") and got["junk"].reason.startswith("unreadable")


def test_read_images_as_rgb(spark, tmp_path):
    color = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    (tmp_path / "color.png").write_bytes(png(color))
    (tmp_path / "alpha.png").write_bytes(png(np.dstack([color, np.full((2, 3), 200, np.uint8)])))
    (tmp_path / "gray.png").write_bytes(png(color[..., :1]))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r.stem: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"color", "alpha", "gray", "broken"}
    broken = got.pop("broken")
    assert broken.data is None and broken.reason == "undecodable"
    assert bytes(got["color"].data) == color.tobytes() == bytes(got["alpha"].data)
    assert bytes(got["gray"].data) == np.repeat(color[..., :1], 3, axis=2).tobytes()
    assert (got["color"].height, got["color"].width, got["gray"].nChannels) == (2, 3, 3)


def test_prepare_images(spark):
    flat = np.full((128, 128, 3), 128, np.uint8)
    ramp = np.tile(np.arange(0, 128, dtype=np.uint8)[None, :, None], (128, 1, 3))
    df = spark.createDataFrame([("flat", 128, 128, bytearray(flat.tobytes())), ("ramp", 128, 128, bytearray(ramp.tobytes()))],
                               "stem string, height int, width int, data binary")
    got = {r.stem: np.array(r.pixels).reshape(3, 224, 224) for r in images.prepare_images(df).collect()}
    assert np.allclose(got["flat"][0], (128 / 255 - 0.485) / 0.229, atol=1e-5)
    restored = (got["ramp"][1] * 0.224 + 0.456) * 255
    want = np.clip((np.arange(224) + 0.5) * 128 / 224 - 0.5, 0, 127)
    assert np.allclose(restored[100], want, atol=0.51) and np.allclose(restored, np.round(restored), atol=1e-3)
    own = images.prepare_images(df, transform=lambda p: p[:1, :1].transpose(2, 0, 1) / 2)
    assert {r.stem: list(r.pixels) for r in own.collect()} == {"flat": [64.0] * 3, "ramp": [0.0] * 3}
    assert images.resize_weights(8, 4).sum(axis=1).tolist() == [1.0] * 4


def test_pixel_normalization_round_trip(spark):
    df = spark.createDataFrame([([0.0, 0.5, 1.0, 0.25, 2.0, -1.0],)], "p array<double>")
    for plane in (None, 2):
        back = df.select(denormalize(normalize(F.col("p"), plane=plane), plane=plane).alias("p")).first().p
        assert np.allclose(back, df.first().p)
    clamped = df.select(denormalize(normalize(F.col("p")), clamp=True).alias("p")).first().p
    assert np.allclose(clamped, [0.0, 0.5, 1.0, 0.25, 1.0, 0.0])


def test_rescale(spark):
    df = spark.createDataFrame([([(64.0, 32.0)],)], "points array<struct<x:float,y:float>>")
    assert tuple(images.rescale(df).first().points[0]) == (112.0, 56.0)
    assert tuple(images.rescale(df, dst=images.STORED_SIZE).first().points[0]) == (64.0, 32.0)
    rows = df.select(F.inline("points"))
    assert tuple(images.rescale_rows(rows).first()) == (112.0, 56.0)


def test_load_assets_round_trip(spark, tmp_path):
    tables = sm.tables(spark, n_shape=50, n_expr=12)
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    model = assets.load_assets(spark, str(tmp_path), 40, 0)
    assert (model.n_vertices, model.n_shape, model.n_expr, model.n_pose, model.parents) == (25, 40, 0, 36, sm.TREE)
    df = spark.createDataFrame([(1, [((k * 3) % 11 - 5) / 10.0 for k in range(64)])], "sid bigint, coeffs array<double>")
    cut = split_vector(df, "coeffs", COMPACT_LAYOUT)
    rows = lambda m: sorted(map(tuple, decode_vertices(cut, m, COMPACT_LAYOUT).collect()))
    assert np.allclose(rows(model), rows(sm.small_model(spark)), atol=1e-12)
    bare = assets.load_assets(spark, "", 40, 10, {k: v for k, v in tables.items() if k not in ("joints", "expr_basis", "lmk_embed")})
    assert bare.parents == assets.STAR_PARENTS and bare.n_expr == 0 and bare.lmk_embed is None


def test_parents_and_pose_axes(spark):
    assert assets.tree_parents({0: 7, 1: 0, 2: 1, 3: 1}, 3) == (-1, 0, 1)
    assert assets.tree_parents(None, 5) == assets.STAR_PARENTS
    with pytest.raises(ValueError):
        assets.tree_parents({0: -1, 1: 2, 2: 0}, 3)
    tensor = np.arange(3 * 36, dtype=float)
    df = spark.createDataFrame([(0, tensor.tolist())], "v int, values array<double>")
    first = assets.pose_basis_from_tensor(df, (1, 3, 36)).first()
    assert np.allclose(first.py, tensor.reshape(3, 36)[1])
    last = assets.pose_basis_from_tensor(df, (1, 36, 3)).first()
    assert np.allclose(last.py, tensor.reshape(36, 3)[:, 1])


def test_resolve_embedding_prefers_and_shifts(spark):
    idx, bary = [float(i + 1) for i in range(68)], [0.25] * 204
    rows = [
        ("a", "full_lmk_faces_idx", [1, 68], idx), ("a", "full_lmk_bary_coords", [1, 68, 3], bary),
        ("a", "lmk_face_idx", [68], idx), ("a", "lmk_b_coords", [68, 3], bary),
        ("b", "full_lmk_faces_idx", [68], idx), ("b", "lmk_face_idx", [68], idx), ("b", "lmk_b_coords", [68, 3], bary),
        ("c", "lmk_face_idx", [67], idx[:67]), ("c", "lmk_b_coords", [68, 3], bary), ("d", "other", [68], idx),
        ("e", "lmk_face_idx", [68], idx), ("e", "lmk_b_coords", [68, 2], bary[:136]),
    ]
    df = spark.createDataFrame(rows, "file string, key string, shape array<int>, values array<double>")
    got = {r.file: r for r in assets.resolve_embedding(df).collect()}
    assert got["a"].faces[:2] == [0, 1] and got["b"].faces[:2] == [1, 2]
    assert [got[f].reason for f in "abcde"] == [None, None, "face index shape", "no known landmark keys", "barycentric shape"]
    assert assets.embedding_rows(assets.resolve_embedding(df)).count() == 136


def test_obj_export(spark, tmp_path):
    verts = spark.createDataFrame([(7, 1, 0.5, -0.25, 1e-9), (7, 0, 1.0, 2.0, 3.0), (8, 0, 0.0, 0.0, 0.0)],
                                  "sid int, v int, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2)], "f int, a int, b int, c int")
    out = tmp_path / "mesh"
    sinks.export_obj(verts, faces, str(out))
    text = [open(os.path.join(root, n)).read() for root, _, names in os.walk(out / "sid=7") for n in names if n.endswith(".txt")]
    assert text == ["v 1.000000 2.000000 3.000000\nv 0.500000 -0.250000 0.000000\nf 1 2 3\n"]
    assert sinks.obj_lines(verts).count() == 3
    with pytest.raises(TypeError):
        sinks.obj_lines(verts, faces.withColumn("a", F.col("a").cast("double")))
    with pytest.raises(Exception, match="three coordinates"):
        sinks.obj_lines(verts.withColumn("x", F.lit(None).cast("double"))).collect()


def test_landing_resumes(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = spark.createDataFrame([("a", [1.0]), ("b", None)], "stem string, points array<double>")
    sinks.land_corpus(rows, path)
    left = pending(rows, *sinks.landed_keys(sinks.read_corpus(spark, path)), "stem")
    assert [r.stem for r in left.collect()] == ["b"]


def test_stream_lands_new_records_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "corpus")
    schema = "stem string, points array<double>"
    rows = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], schema)
    rows.write.parquet(str(source))
    def run(n):
        land_stream(spark.readStream.schema(schema).parquet(str(source)), path, str(tmp_path / f"ckpt{n}")).awaitTermination(60)
    run(0)
    spark.createDataFrame([("b", [2.0]), ("c", None)], schema).write.mode("append").parquet(str(source))
    run(0)
    run(1)
    assert sorted(r.stem for r in sinks.read_corpus(spark, path).collect()) == ["a", "b", "c"]


def test_a_retried_epoch_replaces_its_metrics(spark, tmp_path):
    path = str(tmp_path / "m")
    def log(*rows):
        sinks.write_metrics(spark.createDataFrame(list(rows), "tag string, step int, value double"), path)
    log(("Loss/x", 1, 0.5), ("Loss/x", 2, 0.4), ("Loss/y", 2, 0.1))
    log(("Loss/x", 1, 0.5), ("Loss/x", 2, 0.4), ("Loss/y", 2, 0.1))
    log(("Loss/x", 2, 0.3), ("Loss/x", 3, 0.2), ("Loss/x", 3, 0.1))
    back = sinks.read_metrics(spark, path)
    assert dict(back.dtypes) == {"tag": "string", "step": "bigint", "value": "double"}
    assert sorted(map(tuple, back.collect())) == [("Loss/x", 1, 0.5), ("Loss/x", 2, 0.3), ("Loss/x", 3, 0.2), ("Loss/y", 2, 0.1)]


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet") if "layout" not in str(p)}


def test_landing_appends_and_leaves_landed_files_alone(spark, tmp_path):
    path = tmp_path / "corpus"
    landed = spark.range(20_000).selectExpr("concat('k', id) AS stem", "array(CAST(id AS double)) AS points")
    sinks.land_corpus(landed, str(path), buckets=8)
    before = files_of(path)
    sinks.land_corpus(landed.limit(100).unionByName(spark.createDataFrame([("new", None)], "stem string, points array<double>")), str(path))
    after = files_of(path)
    assert all(after.get(name) == at for name, at in before.items()) and len(after) > len(before)
    back = sinks.read_corpus(spark, str(path))
    assert back.count() == 20_001 and back.select("stem").distinct().count() == 20_001
    assert back.columns == ["stem", "points"]


def test_the_better_record_of_a_key_wins_before_and_after_compaction(spark, tmp_path):
    path, schema = str(tmp_path / "corpus"), "stem string, points array<double>, v int"
    runs = [
        [("a", [1.0], 1), ("b", None, 1), ("c", None, 1)], [("a", None, 2), ("b", [2.0], 2), ("d", None, 2)],
        [("a", [3.0], 3), ("c", None, 3)], [("a", [3.0], 3), ("c", None, 3)]]
    want = [("a", [3.0], 3), ("b", [2.0], 2), ("c", None, 3), ("d", None, 2)]
    for share in (0.0, 0.5, 1e9):
        where = f"{path}-{share}"
        for rows in runs:
            sinks.land_corpus(spark.createDataFrame(rows, schema), where, buckets=2, share=share)
        assert sorted(map(tuple, sinks.read_corpus(spark, where).collect())) == want
        sinks.compact(spark, where, share=0.0)
        assert sorted(map(tuple, sinks.read_corpus(spark, where).collect())) == want


def test_a_corpus_keeps_and_grows_its_folders(spark, tmp_path):
    path = tmp_path / "corpus"
    rows = spark.range(500).selectExpr("concat('k', id) AS stem", "array(1D) AS points")
    sinks.land_corpus(rows, str(path), buckets=3)
    sinks.land_corpus(rows.limit(10), str(path), buckets=7)
    assert sinks.corpus_buckets(spark, str(path)) == 3
    sinks.grow_corpus(spark, str(path), 5)
    sinks.land_corpus(spark.createDataFrame([("x", None)], "stem string, points array<double>"), str(path))
    assert sinks.corpus_buckets(spark, str(path)) == 5
    assert {p.name.split("-")[1] for p in path.iterdir() if "-" in p.name} == {"5"}
    assert sinks.read_corpus(spark, str(path)).count() == 501


def test_records_without_a_key_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="without a key"):
        sinks.land_corpus(spark.createDataFrame([(None, [1.0])], "stem string, points array<double>"), str(tmp_path / "c"))


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    left = spark.range(300).selectExpr("id % 40 AS sid", "id AS v")
    right = spark.range(40).selectExpr("id AS sid", "id * 2 AS w")
    a, b = (sinks.write_bucketed(df, str(tmp_path / n), "sid", 4) for n, df in (("l", left), ("r", right)))
    joined = a.join(b.hint("merge"), "sid")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect())) == sorted((i % 40, i, i % 40 * 2) for i in range(300))
