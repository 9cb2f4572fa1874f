"""Geometry against a plain matrix computation of the same definitions, and by invariants."""

import math
from dataclasses import replace

import numpy as np
import pytest

from meshframe.functions.camera import Camera
from meshframe.functions.rotations import global_rotation, rodrigues, rot6d
from meshframe.operators import geometry as g
from meshframe.operators.params import COMPACT_LAYOUT, Layout, neutralize, split_vector
from meshframe.plans import small_model as sm
from meshframe.sources.assets import STAR_PARENTS

V = np.arange(25)
T = np.stack([sm.template_value(V, c) for c in range(3)], 1)
S = np.stack([sm.shape_value(V[:, None], c, np.arange(40)[None]) for c in range(3)], 1)
P = np.stack([sm.pose_value(V[:, None], c, np.arange(36)[None]) for c in range(3)], 1)
W = ((V[:, None] + np.arange(5)) % 5 + 1) / 15.0
J = np.array([[0.2 if v % 5 == j else 0.0 for v in V] for j in range(5)])


def np_axis_angle(r):
    angle = np.linalg.norm(np.asarray(r) + 1e-8)
    x, y, z = np.asarray(r) / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def np_six(p):
    b1 = p[:3] / np.linalg.norm(p[:3])
    b2 = p[3:] - (b1 @ p[3:]) * b1
    b2 /= np.linalg.norm(b2)
    return np.stack([b1, b2, np.cross(b1, b2)])


def np_decode(e, parents):
    shaped = T + S @ e[:40]
    rest = J @ shaped
    rots = [np_six(e[40:46]), *[np_axis_angle(e[a:a + 3]) for a in (55, 46, 49, 52)]]
    frames = []
    for j, parent in enumerate(parents):
        local = np.eye(4)
        local[:3, :3] = rots[j]
        local[:3, 3] = rest[j] - (rest[parent] if parent >= 0 else 0)
        frames.append(local if parent < 0 else frames[parent] @ local)
    motions = []
    for frame, joint in zip(frames, rest):
        m = frame.copy()
        m[:3, 3] -= frame[:3, :3] @ joint
        motions.append(m)
    feature = np.concatenate([(r - np.eye(3)).reshape(-1) for r in rots[1:]])
    posed = shaped + P @ feature
    blend = np.einsum("vj,jab->vab", W, np.array(motions))
    return np.einsum("vab,vb->va", blend, np.c_[posed, np.ones(25)])[:, :3] + e[58:61]


def np_landmarks(verts):
    out = []
    for lmk in range(68):
        f = lmk * 5 % 23
        b = np.array([lmk % 3 + 1, lmk % 4 + 1, lmk % 5 + 1], dtype=float)
        out.append((b / b.sum()) @ verts[[f, f + 1, f + 2]])
    return np.array(out)


@pytest.fixture(scope="module")
def coeffs():
    return np.random.default_rng(3).normal(size=(4, 64)) * 0.3


@pytest.fixture(scope="module")
def cut(spark, coeffs):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(coeffs)], "sid bigint, coeffs array<double>")
    return split_vector(df, "coeffs", COMPACT_LAYOUT)


def table(df, index):
    rows = df.toPandas().sort_values(["sid", index])
    return rows[["x", "y", "z"]].to_numpy().reshape(rows.sid.nunique(), -1, 3)


@pytest.mark.parametrize("parents", [sm.TREE, STAR_PARENTS])
@pytest.mark.parametrize("dense", [False, True])
def test_decode_matches_matrices(spark, coeffs, cut, parents, dense):
    model = sm.small_model(spark, parents=parents)
    verts, landmarks = g.decode(cut, model, COMPACT_LAYOUT, dense=dense)
    want = np.array([np_decode(e, parents) for e in coeffs])
    assert np.allclose(table(verts, "v"), want, atol=1e-9)
    assert np.allclose(table(landmarks, "lmk"), [np_landmarks(v) for v in want], atol=1e-9)


def test_landmarks_from_vertices(spark, coeffs, cut):
    model = sm.small_model(spark)
    verts = g.decode_vertices(cut, model, COMPACT_LAYOUT)
    want = [np_landmarks(np_decode(e, sm.TREE)) for e in coeffs]
    assert np.allclose(table(g.landmarks3d(verts, model), "lmk"), want, atol=1e-9)


def test_neutral_row_is_the_template(spark, cut):
    verts = g.decode_vertices(neutralize(cut, COMPACT_LAYOUT.names, COMPACT_LAYOUT), sm.small_model(spark), COMPACT_LAYOUT)
    assert np.allclose(table(verts, "v"), T[None], atol=1e-12)


def test_expression_and_pose_of_other_widths(spark, coeffs, cut):
    layout = Layout((("shape", 30), ("expression", 10), *COMPACT_LAYOUT.groups[2:]))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(coeffs)], "sid bigint, coeffs array<double>")
    model = sm.small_model(spark, n_shape=30, n_expr=10)
    got = table(g.shape_verts(split_vector(df, "coeffs", layout), model), "v")
    E = np.stack([sm.expression_value(V[:, None], c, np.arange(10)[None]) for c in range(3)], 1)
    assert np.allclose(got, [T + S[..., :30] @ e[:30] + E @ e[30:40] for e in coeffs], atol=1e-12)
    # A pose basis of another width has no effect.
    plain = replace(sm.small_model(spark), n_pose=27)
    assert table(g.pose_offset(g.rotations(cut), plain), "v").any() == False  # noqa: E712
    assert g.decode_vertices(cut, plain, COMPACT_LAYOUT).count() == 100
    with pytest.raises(ValueError, match="shape"):
        g.decode_vertices(cut, model, COMPACT_LAYOUT)


def test_missing_landmarks(spark, cut):
    model = replace(sm.small_model(spark), lmk_embed=None)
    with pytest.raises(ValueError):
        g.decode_landmarks(cut, model, COMPACT_LAYOUT)
    _, zeros = g.decode(cut, model, COMPACT_LAYOUT, on_missing="zeros")
    assert zeros.count() == 4 * 68 and zeros.filter("x <> 0 OR y <> 0 OR z <> 0").count() == 0


def test_rotations_are_orthogonal_and_guarded(spark):
    rows = [(0, [0.3, -1.0, 2.0], [1.0, 0.2, 0.1, 0.3, 1.0, 0.0]), (1, [0.0] * 3, [0.0] * 6), (2, [-1e-8] * 3, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "sid bigint, a array<double>, s array<double>")
    angles = {r.sid: np.array(r.rot).reshape(3, 3) for r in rodrigues(df, "a").collect()}
    assert np.allclose(angles[0] @ angles[0].T, np.eye(3), atol=1e-7)
    assert np.allclose(angles[0], np_axis_angle(rows[0][1]), atol=1e-14)
    assert np.allclose(angles[1], np.eye(3)) and np.allclose(angles[2], np.eye(3))
    sixes = {r.sid: np.array(r.rot).reshape(3, 3) for r in rot6d(df, "s").collect()}
    assert np.allclose(sixes[0] @ sixes[0].T, np.eye(3)) and np.linalg.det(sixes[0]) > 0
    assert not sixes[1].any() and np.allclose(sixes[2], np.eye(3))


def test_global_pose_by_width(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]), (1, [0.0, 0.5, 0.0]), (2, [1.0])], "sid bigint, p array<double>")
    got = {r.sid: (np.array(r.rot).reshape(3, 3), r.warn) for r in global_rotation(df, "p").collect()}
    assert got[0][1] is None and np.allclose(got[0][0], np.eye(3))
    assert "axis-angle" in got[1][1] and np.allclose(got[1][0], np_axis_angle([0, 0.5, 0]))
    assert "identity" in got[2][1] and np.allclose(got[2][0], np.eye(3))


def test_global_rotation_moves_joints_as_one(spark, cut):
    model = sm.small_model(spark)
    calm = neutralize(cut, ["jaw_pose", "eye_pose", "neck_pose"], COMPACT_LAYOUT)
    df = g.posed_joints(g.chain(g.rest_joints(g.rotations(calm), model), model.parents), 5)
    for r in df.select("rots", "rest", "posed").collect():
        R = np.array(r.rots[0]).reshape(3, 3)
        rest = np.array(r.rest)
        assert np.allclose(np.array(r.posed), (rest - rest[0]) @ R.T + rest[0], atol=1e-7)


def test_translation_moves_landmarks(spark, cut):
    model = sm.small_model(spark)
    still = table(g.decode_landmarks(neutralize(cut, ["transl"], COMPACT_LAYOUT), model, COMPACT_LAYOUT), "lmk")
    moved = table(g.decode_landmarks(cut, model, COMPACT_LAYOUT), "lmk")
    shift = np.array([r.transl for r in cut.orderBy("sid").collect()])
    assert np.allclose(moved - still, shift[:, None], atol=1e-12)


def test_missing_translation_counts_as_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, None), (1.0, 2.0, 3.0, [1.0, 1.0, 1.0])], "x double, y double, z double, transl array<double>")
    assert sorted((r.x, r.y, r.z) for r in g.translate(df).collect()) == [(1, 2, 3), (2, 3, 4)]


def test_projection(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (0.1, 0.2, 0.3)], "x double, y double, z double")
    a, b = g.project(df).collect()
    assert (a.sx, a.sy) == (112.0, 112.0)
    scale = 112 / math.tan(math.radians(15))
    assert math.isclose(b.sx, 112 + scale * 0.1 / 2.4) and math.isclose(b.sy, 112 - scale * 0.2 / 2.4)
    side = g.project(df, Camera(azimuth=90.0)).collect()[1]
    assert math.isclose(side.sx, 112 - scale * 0.3 / 2.6, rel_tol=1e-9)
    wide = g.project(df, Camera(width=448, height=224)).collect()[1]
    assert math.isclose(wide.sx, 224 + scale * 0.1 / 2.4)


def test_empty_input(spark, cut):
    verts, landmarks = g.decode(cut.limit(0), sm.small_model(spark), COMPACT_LAYOUT)
    assert verts.count() == 0 and landmarks.count() == 0
