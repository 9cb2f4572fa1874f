"""Decoding of parameter rows into vertices, joints, landmarks and screen points.

Samples stay one row each until the last step. Shape, expression and pose bases are joined into one
basis per vertex, so a vertex needs one inner product per axis. Rows fan out to vertices or
landmarks by exploding an index and joining a broadcast model table on it: no shuffle is involved,
whatever the number of samples. Native landmarks take the model as one broadcast row instead, so that the
vertices they share are computed once for a sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.functions.camera import Camera
from meshframe.functions.rotations import IDENTITY3, rotation_stack
from meshframe.functions.steps import array_sql, dot_sql, number_sql, numbers_sql, product_sql, run_steps
from meshframe.operators.blocks import BLOCK_BYTES, map_blocks, packed_blocks
from meshframe.operators.params import Layout, matrix_of
from meshframe.session import BROADCAST_BYTES, broadcast_if_small, doubles
from meshframe.sources.assets import FaceModel

AXES = ("x", "y", "z")
LANDMARK_COUNT = 68
# Vertices computed at once in a dense batch, so that intermediate arrays stay in cache, and the
# fewest samples at once, so that a large basis is not re-read for every few of them.
_CHUNK_ROWS = 16_384
_CHUNK_SAMPLES = 32
POINTS = T.StructField("points", T.ArrayType(T.StructType([T.StructField(a, T.DoubleType()) for a in AXES])))


# --- per-sample columns -------------------------------------------------------------------------


def check_model(layout: Layout, model: FaceModel) -> None:
    model.verify()
    for name, width in (("shape", model.n_shape), ("expression", model.n_expr)):
        if layout.width(name) != width:
            raise ValueError(f"{name}: {layout.width(name)} coefficients for a basis of width {width}")


def rest_joints(params: DataFrame, model: FaceModel, out: str = "rest") -> DataFrame:
    """Add the rest position of every joint, an array of three-element arrays."""
    def place(row: dict[str, list[float]], a: str) -> str:
        return f"{number_sql(row[a][0])} + {dot_sql('_c', numbers_sql(row[a][1:]))}"

    joints = array_sql(array_sql(place(row, a) for a in AXES) for row in model.joint_basis)
    steps = [{"_c": "concat(shape, expression)"}, {out: joints}]
    return run_steps(params, steps).drop("_c")


def rotations(params: DataFrame, out: str = "rots", global_width: int | None = None) -> DataFrame:
    """Add the rotation stack of every row."""
    return rotation_stack(params, out, global_width)


def chain(df: DataFrame, parents: Sequence[int], rots: str = "rots", rest: str = "rest",
          out: str = "chain") -> DataFrame:
    """Add the posed frame of every joint: its parent's frame times its local one.

    A frame is three rows of four, row-major; the constant last row is left out. Joints of equal
    depth share a step, so a frame is computed once however many children it has.
    """
    depth: list[int] = []
    levels: list[dict[str, str]] = []
    for j, parent in enumerate(parents):
        r, t = f"{rots}[{j}]", f"{rest}[{j}]"
        depth.append(0 if parent < 0 else depth[parent] + 1)
        if parent < 0:
            frame = [x for row in range(3) for x in (*[f"{r}[{3 * row + c}]" for c in range(3)], f"{t}[{row}]")]
        else:
            g, up = f"_g{parent}", f"{rest}[{parent}]"
            frame = []
            for row in range(3):
                turn = [f"{g}[{4 * row + i}]" for i in range(3)]
                frame += [product_sql(turn, [f"{r}[{3 * i + c}]" for i in range(3)]) for c in range(3)]
                step = [f"({t}[{i}] - {up}[{i}])" for i in range(3)]
                frame.append(f"{product_sql(turn, step)} + {g}[{4 * row + 3}]")
        while len(levels) <= depth[j]:
            levels.append({})
        levels[depth[j]][f"_g{j}"] = array_sql(frame)
    names = [f"_g{j}" for j in range(len(parents))]
    return run_steps(df, levels).selectExpr(*[f"`{c}`" for c in df.columns], f"{array_sql(names)} AS {out}")


def posed_joints(df: DataFrame, n_joints: int, frames: str = "chain", out: str = "posed") -> DataFrame:
    """Add the positions of the posed joints."""
    joints = array_sql(array_sql(f"{frames}[{j}][{4 * a + 3}]" for a in range(3)) for j in range(n_joints))
    return df.selectExpr("*", f"{joints} AS {out}")


def skin_transforms(df: DataFrame, n_joints: int, frames: str = "chain", rest: str = "rest",
                    out: str = "transforms") -> DataFrame:
    """Add the motion of every joint relative to its rest position.

    All motions lie in one flat array, twelve numbers per joint: three rows of four.
    """
    motions = []
    for j in range(n_joints):
        g, t = f"{frames}[{j}]", [f"{rest}[{j}][{i}]" for i in range(3)]
        for a in range(3):
            turn = [f"{g}[{4 * a + i}]" for i in range(3)]
            motions += [*turn, f"{g}[{4 * a + 3}] - ({product_sql(turn, t)})"]
    return df.selectExpr("*", f"{array_sql(motions)} AS {out}")


def pose_feature(df: DataFrame, rots: str = "rots", joints: int = 4, out: str = "pose_feature") -> DataFrame:
    """Add the non-root rotations minus identity, flattened row-major."""
    values = [f"{rots}[{j}][{i}] - {number_sql(IDENTITY3[i])}" for j in range(1, joints + 1) for i in range(9)]
    return df.selectExpr("*", f"{array_sql(values)} AS {out}")


def posed(params: DataFrame, model: FaceModel, layout: Layout, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample with what the fan-out needs: kept columns, ``coeffs``, ``transforms``, ``shift``."""
    check_model(layout, model)
    df = rest_joints(rotations(params, global_width=layout.width("global_pose")), model)
    df = skin_transforms(chain(pose_feature(df), model.parents), model.n_joints)
    parts = ["shape", "expression"] + (["pose_feature"] if model.uses_pose else [])
    shift = array_sql(f"coalesce(get(transl, {a}), 0D)" for a in range(3))
    return df.selectExpr(*keep, f"concat({', '.join(parts)}) AS coeffs", "transforms", f"{shift} AS shift")


# --- model tables -------------------------------------------------------------------------------


def vertex_table(model: FaceModel, parts: Sequence[str] = ("shape", "expression", "pose")) -> DataFrame:
    """Template, joined bases and skin weights of each vertex: (v, x, y, z, bx, by, bz, w)."""
    df = model.template.join(model.skin, "v")
    basis: dict[str, list[Column]] = {a: [] for a in AXES}
    sources = {"shape": (model.shape_basis, "b"), "expression": (model.expr_basis, "b"), "pose": (model.pose_basis, "p")}
    for part in parts:
        if part == "pose" and not model.uses_pose:
            continue
        table, prefix = sources[part]
        df = df.join(table.select("v", *[F.col(f"{prefix}{a}").alias(f"{part}_{a}") for a in AXES]), "v")
        for a in AXES:
            basis[a].append(F.col(f"{part}_{a}"))
    bases = [(F.concat(*basis[a]) if basis[a] else doubles()).alias(f"b{a}") for a in AXES]
    return df.select("v", *AXES, *bases, "w")


def vertex_bytes(model: FaceModel) -> int:
    return 8 * (3 * model.n_coeffs + model.n_joints + 16)


def corner_table(model: FaceModel) -> DataFrame:
    """Landmark corners: (lmk, k, v, b)."""
    embed = model.lmk_embed.join(model.faces, "f")
    corners = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(c).alias("v"), F.col(f"b{k}").alias("b")) for k, c in enumerate("abc")
    ])
    return embed.select("lmk", F.inline(corners))


def landmark_table(model: FaceModel) -> DataFrame:
    """Each landmark with its three corners: (lmk, corners, mix, share, weight).

    ``corners`` packs the corners' vertex rows. ``mix`` is corner weight times skin weight, three
    numbers per joint, ``share`` their sum per joint, ``weight`` the sum of the corner weights. Only
    vertices that some landmark uses are kept, so a landmark query never decodes the others.
    """
    packed = F.sort_array(F.collect_list(F.struct("k", "b", *AXES, "bx", "by", "bz", "w")))
    table = corner_table(model).join(vertex_table(model), "v").groupBy("lmk").agg(packed.alias("corners"))
    joints = range(model.n_joints)
    mix = array_sql(f"corners[{k}].b * corners[{k}].w[{j}]" for j in joints for k in range(3))
    share = array_sql(" + ".join(f"mix[{3 * j + k}]" for k in range(3)) for j in joints)
    weight = " + ".join(f"corners[{k}].b" for k in range(3))
    return run_steps(table, [{"mix": mix}, {"share": share, "weight": weight}])


def _landmark_row(model: FaceModel) -> DataFrame:
    """All landmarks in one row: (_base, _basis, _skin, _lmks).

    ``_base`` and ``_basis`` hold the axes of the vertices that some landmark uses, three per vertex, ``_skin`` a vertex' weights,
    ``_lmks`` a landmark's corners as places among these vertices, with their weights.
    """
    corners = corner_table(model)
    verts = vertex_table(model).join(corners.select("v").distinct(), "v")
    packed = verts.agg(F.sort_array(F.collect_list(F.struct("v", *AXES, "bx", "by", "bz", "w"))).alias("_m"))
    packed = packed.selectExpr(
        "transform(_m, m -> m.v) AS _ids", "flatten(transform(_m, m -> array(m.x, m.y, m.z))) AS _base",
        "flatten(transform(_m, m -> array(m.bx, m.by, m.bz))) AS _basis", "transform(_m, m -> m.w) AS _skin")
    three = corners.groupBy("lmk").agg(F.sort_array(F.collect_list(F.struct("k", "v", "b"))).alias("_c"))
    listed = three.agg(F.sort_array(F.collect_list(F.struct("lmk", "_c"))).alias("_l"))
    places = ", ".join(f"CAST(array_position(_ids, l._c[{k}].v) - 1 AS int) AS v{k}, l._c[{k}].b AS b{k}" for k in range(3))
    return packed.crossJoin(F.broadcast(listed)).selectExpr("_base", "_basis", "_skin", f"transform(_l, l -> struct({places})) AS _lmks")


# --- fan-out to vertices ------------------------------------------------------------------------


def _indexed(rows: DataFrame, n: int, name: str) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))


def _blend(vertex: str = "", coeffs: str = "coeffs") -> list[str]:
    """Template point plus the coefficients' offset; ``vertex`` prefixes the model columns."""
    return [f"{vertex}{a} + {dot_sql(coeffs, f'{vertex}b{a}')}" for a in AXES]


def _skinned(point: Sequence[str], n_joints: int, weights: str = "w", transforms: str = "transforms") -> list[str]:
    """Weighted sum of the joint motions applied to a point."""
    def row(j: int, a: int) -> list[str]:
        return [f"{transforms}[{12 * j + 4 * a + i}]" for i in range(4)]

    return [
        " + ".join(
            f"{weights}[{j}] * ({product_sql(row(j, a), point)} + {row(j, a)[3]})" for j in range(n_joints)
        )
        for a in range(3)
    ]


def shape_verts(params: DataFrame, model: FaceModel, key: str = "sid", dense: bool = True, budget: int | None = None) -> DataFrame:
    """Template plus shape and expression offsets: (key, v, x, y, z). ``budget`` bounds the bytes of the model that a worker holds."""
    model.verify()
    parts = ("shape", "expression")
    rows = params.select(key, F.concat(*parts).alias("coeffs"))
    if dense:
        return unroll_blocks(_dense_offsets(rows, vertex_table(model, parts), model, "coeffs", key, budget), "v")
    table = broadcast_if_small(vertex_table(model, parts).drop("w"), model.n_vertices, vertex_bytes(model))
    df = _indexed(rows, model.n_vertices, "v").join(table, "v")
    return df.selectExpr(key, "v", *[f"{c} AS {a}" for a, c in zip(AXES, _blend())])


def pose_offset(df: DataFrame, model: FaceModel, key: str = "sid", rots: str = "rots", dense: bool = True,
                budget: int | None = None) -> DataFrame:
    """Pose-dependent offset of every vertex; zero when the basis does not fit the feature."""
    model.verify()
    rows = pose_feature(df, rots).select(key, "pose_feature")
    if not model.uses_pose:
        return _indexed(rows, model.n_vertices, "v").select(key, "v", *[F.lit(0.0).alias(a) for a in AXES])
    if dense:
        flat = model.pose_basis.select("v", *[F.lit(0.0).alias(a) for a in AXES], *[F.col(f"p{a}").alias(f"b{a}") for a in AXES])
        return unroll_blocks(_dense_offsets(rows, flat, model, "pose_feature", key, budget), "v")
    table = broadcast_if_small(model.pose_basis, model.n_vertices, vertex_bytes(model))
    return _indexed(rows, model.n_vertices, "v").join(table, "v").selectExpr(
        key, "v", *[f"{dot_sql('pose_feature', f'p{a}')} AS {a}" for a in AXES])


def _dense_offsets(rows: DataFrame, table: DataFrame, model: FaceModel, coeffs: str, key: str, budget: int | None = None) -> DataFrame:
    """Base point plus basis times coefficients, one matrix product per Arrow batch: (key, first, points), the points
    of the vertices from ``first`` on.

    ``table`` is (v, x, y, z, bx, by, bz). A table within the budget is broadcast; a larger one goes block by block, of which a
    worker holds one.
    """
    step = _block_step(model, False, budget)
    count = -(-model.n_vertices // step)
    fields = T.StructType([rows.schema[key], T.StructField("first", T.IntegerType()), POINTS])

    def arrays(data: pa.Table) -> dict[str, np.ndarray]:
        base = np.stack([data.column(a).to_numpy() for a in AXES], axis=1)
        lists = [data.column(f"b{a}").combine_chunks() for a in AXES]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        width = len(lists[0].flatten()) // max(len(base), 1)
        return {"base": base, "basis": np.stack([matrix_of(x, width) for x in lists], axis=1)}

    def offsets(m: dict[str, np.ndarray], record: pa.RecordBatch, first: int) -> Iterator[pa.RecordBatch]:
        base, basis = m["base"], m["basis"]
        few = max(_CHUNK_SAMPLES, _CHUNK_ROWS // max(len(base), 1))
        for start in range(0, record.num_rows, few):
            part = record.slice(start, few)
            x = matrix_of(part.column(part.schema.get_field_index(coeffs)), basis.shape[2])
            points = (x @ basis.reshape(-1, basis.shape[2]).T).reshape(len(x), -1, 3) + base
            yield pa.RecordBatch.from_arrays([
                part.column(part.schema.get_field_index(key)), pa.array(np.full(len(x), first, np.int32)), _points_column(points)], names=fields.names)

    if count > 1:
        return map_blocks(rows, packed_blocks(table, "v", step, arrays), count, lambda held, record: offsets(held[1], record, held[0]),
                          fields, lambda block, m: (block * step, m))
    shared = rows.sparkSession.sparkContext.broadcast(arrays(table.orderBy("v").toArrow()))

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            yield from offsets(shared.value, record, 0)

    return rows.mapInArrow(run, fields)


def _points_column(points: np.ndarray) -> pa.ListArray:
    samples, count, _ = points.shape
    structs = pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(points[..., a]).reshape(-1)) for a in range(3)], names=list(AXES)
    )
    return pa.ListArray.from_arrays(pa.array(np.arange(samples + 1, dtype=np.int32) * count), structs)


def skin(verts: DataFrame, transforms: DataFrame, model: FaceModel, key: str = "sid", colocated: bool = False) -> DataFrame:
    """Skin given vertices (key, v, x, y, z) by the samples' joint motions.

    With ``colocated`` both are tables bucketed alike by the sample, whose merge join moves no row.
    """
    weights = broadcast_if_small(model.skin, model.n_vertices, 8 * (model.n_joints + 4))
    moves = transforms.select(key, "transforms")
    df = verts.join(moves.hint("merge") if colocated else moves, key).join(weights, "v")
    return df.selectExpr(key, "v", *[f"{c} AS {a}" for a, c in zip(AXES, _skinned(AXES, model.n_joints))])


def translate(verts: DataFrame, col: str = "transl") -> DataFrame:
    """Add each row's translation to its point; a missing one leaves it in place."""
    moved = {a: f"{a} + coalesce(get({col}, {i}), 0D)" for i, a in enumerate(AXES)}
    return verts.withColumns({a: F.expr(text) for a, text in moved.items()})


def decode_vertices(params: DataFrame, model: FaceModel, layout: Layout, key: str = "sid") -> DataFrame:
    """All posed vertices (key, v, x, y, z)."""
    rows = posed(params, model, layout, [key])
    table = broadcast_if_small(vertex_table(model), model.n_vertices, vertex_bytes(model))
    df = _indexed(rows, model.n_vertices, "v").join(table, "v")
    point = [f"_p{a}" for a in AXES]
    df = run_steps(df, [dict(zip(point, _blend()))])
    moved = _skinned(point, model.n_joints)
    return df.selectExpr(key, "v", *[f"{text} + shift[{i}] AS {a}" for i, (a, text) in enumerate(zip(AXES, moved))])


# --- landmarks ----------------------------------------------------------------------------------


def no_landmarks(params: DataFrame, key: str, on_missing: str, keep: Sequence[str] = ()) -> DataFrame:
    if on_missing != "zeros":
        raise ValueError("the model has no landmark embedding")
    return _indexed(params.select(key, *keep), LANDMARK_COUNT, "lmk").select(
        key, *keep, "lmk", *[F.lit(0.0).alias(a) for a in AXES]
    )


def landmarks3d(verts: DataFrame, model: FaceModel, key: str = "sid", on_missing: str = "raise") -> DataFrame:
    """Landmarks (key, lmk, x, y, z) from a table of decoded vertices.

    For vertices that already exist; the corner sums combine within a task before the shuffle.
    Without an embedding, ``on_missing='zeros'`` gives 68 zero points per sample.
    """
    if model.lmk_embed is None:
        return no_landmarks(verts.select(key).distinct(), key, on_missing)
    model.verify()
    corners = broadcast_if_small(corner_table(model), 3 * model.n_landmarks, 64)
    sums = [F.sum(F.col("b") * F.col(a)).alias(a) for a in AXES]
    return verts.join(corners, "v").groupBy(key, "lmk").agg(*sums)


def gather_landmarks(df: DataFrame, model: FaceModel, points: str = "points", out: str = "landmarks") -> DataFrame:
    """``df`` with the landmarks of each row's array of decoded vertices in place of the vertices.

    Each row has all its vertices, so nothing is shuffled: the corners' numbers and weights, three for each landmark, are sent to the
    workers, and only corner vertices are touched.
    """
    if model.lmk_embed is None:
        raise ValueError("the model has no landmark embedding")
    model.verify()
    corners = corner_table(model).orderBy("lmk", "k").toArrow()
    shared = df.sparkSession.sparkContext.broadcast(
        (corners.column("v").to_numpy().astype(np.int64), corners.column("b").to_numpy().reshape(-1, 3)))
    count = model.n_vertices
    rest = [f for f in df.schema.fields if f.name not in (points, out)]

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, weights = shared.value
        for record in records:
            column = record.column(record.schema.get_field_index(points))
            if column.null_count or len(column.flatten()) != len(column) * count:
                raise ValueError(f"expected {count} vertices a row")
            places = (np.arange(len(column))[:, None] * count + where).reshape(-1)
            flat = column.flatten()
            found = np.stack([
                (flat.field(a).to_numpy(zero_copy_only=False)[places].reshape(len(column), -1, 3) * weights).sum(axis=2) for a in AXES], axis=2)
            yield pa.RecordBatch.from_arrays(
                [*[record.column(record.schema.get_field_index(f.name)) for f in rest], _points_column(found)], names=[*[f.name for f in rest], out])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(out, POINTS.dataType)]))


def decode_landmarks(params: DataFrame, model: FaceModel, layout: Layout, key: str = "sid",
                     keep: Sequence[str] = (), truth: str | None = None,
                     on_missing: str = "raise", dense: bool = True) -> DataFrame:
    """Posed landmarks (key, lmk, x, y, z) straight from the parameters, without a shuffle.

    ``truth`` names an array of points that is unrolled alongside as tx, ty; this and ``dense=False`` take the native form.
    """
    if model.lmk_embed is None:
        return no_landmarks(params, key, on_missing, keep)
    if dense and truth is None:
        return unroll_blocks(decode_blocks(params, model, layout, key, keep), "lmk")
    carried = [*keep, *([truth] if truth else [])]
    if 3 * vertex_bytes(model) * model.n_landmarks > BROADCAST_BYTES:
        return _fanned_landmarks(params, model, layout, key, keep, truth)
    rows = landmark_points(params, model, layout, [key, *carried])
    # The outer form infers no filter on the points, which would repeat their whole formula, and keeps a sample without truth,
    # whose other terms still count.
    if not truth:
        return rows.select(key, *keep, F.posexplode_outer("points").alias("lmk", "_p")).select(key, *keep, "lmk", *[f"_p.{a}" for a in AXES])
    shown = F.slice("points", F.lit(1), F.greatest(F.size(truth), F.lit(0)))
    long = rows.select(key, *keep, F.posexplode_outer(F.arrays_zip(shown.alias("points"), F.col(truth).alias("truth"))).alias("lmk", "_p"))
    return long.select(key, *keep, "lmk", *[f"_p.points.{a}" for a in AXES],
                       *[F.col(f"_p.truth.{a}").cast("double").alias(f"t{a}") for a in "xy"])


def landmark_points(params: DataFrame, model: FaceModel, layout: Layout, keep: Sequence[str] = ()) -> DataFrame:
    """Posed landmarks as one array of points per sample, in column arithmetic: (keep, points).

    The model's landmarks go to every sample as one row. A vertex is blended and skinned once for a sample, however many landmarks
    share it; a landmark is then the weighted sum of its three corners.
    """
    rows = posed(params, model, layout, keep).crossJoin(F.broadcast(_landmark_row(model)))
    blended = f"zip_with(_base, _basis, (o, b) -> o + {dot_sql('coeffs', 'b')})"
    moved = _skinned([f"_q[3 * i + {a}]" for a in range(3)], model.n_joints, "w")
    moved = ", ".join(f"{text} + shift[{i}] AS {a}" for i, (a, text) in enumerate(zip(AXES, moved)))
    mixed = ", ".join(f"{product_sql([f'l.b{k}' for k in range(3)], [f'_v[l.v{k}].{a}' for k in range(3)])} AS {a}" for a in AXES)
    # Every step is read more than once by the next, so that Spark does not put its formula into the next one's lambda.
    rows = rows.selectExpr(*keep, "transforms", "shift", "_skin", "_lmks", f"{blended} AS _q")
    rows = rows.selectExpr(*keep, "_lmks", f"transform(_skin, (w, i) -> struct({moved})) AS _v")
    return rows.selectExpr(*keep, f"transform(_lmks, l -> struct({mixed})) AS points")


def _fanned_landmarks(params: DataFrame, model: FaceModel, layout: Layout, key: str, keep: Sequence[str], truth: str | None) -> DataFrame:
    """The same as a row per sample and landmark joined with the landmark's corners, for a model too large for one row."""
    rows = posed(params, model, layout, [key, *keep, *([truth] if truth else [])])
    if truth:
        # The outer form keeps a sample without truth, whose other terms still count.
        points = F.posexplode_outer(truth).alias("lmk", "_t")
        rows = rows.select(key, *keep, "coeffs", "transforms", "shift", points)
        extra = ["CAST(_t.x AS double) AS tx", "CAST(_t.y AS double) AS ty"]
    else:
        rows = _indexed(rows, model.n_landmarks, "lmk")
        extra = []
    table = broadcast_if_small(landmark_table(model), model.n_landmarks, 3 * vertex_bytes(model))
    # Skinning is linear, so the corners are mixed per joint before the joint motions apply.
    blended = {f"_p{k}{a}": text for k in range(3) for a, text in zip(AXES, _blend(f"corners[{k}]."))}
    mixed = array_sql(
        product_sql([f"mix[{3 * j + k}]" for k in range(3)], [f"_p{k}{a}" for k in range(3)])
        for j in range(model.n_joints) for a in AXES
    )
    points = []
    for i, a in enumerate(AXES):
        terms = [
            product_sql(
                [f"transforms[{12 * j + 4 * i + c}]" for c in range(4)],
                [*[f"_u[{3 * j + c}]" for c in range(3)], f"share[{j}]"],
            )
            for j in range(model.n_joints)
        ]
        # The translation moves every corner, so it counts once per corner weight.
        points.append(f"{' + '.join(terms)} + weight * shift[{i}] AS {a}")
    joined = rows.join(table, "lmk", "left" if truth else "inner")
    return run_steps(joined, [blended, {"_u": mixed}]).selectExpr(key, *keep, "lmk", *points, *extra)


def project(df: DataFrame, camera: Camera = Camera(), out: Sequence[str] = ("sx", "sy")) -> DataFrame:
    """Add screen coordinates of the points x, y, z."""
    sx, sy = camera.screen(F.col("x"), F.col("y"), F.col("z"))
    return df.withColumns({out[0]: sx, out[1]: sy})


# --- dense form ---------------------------------------------------------------------------------


def _point_table(model: FaceModel, landmarks: bool) -> DataFrame:
    table = vertex_table(model)
    return corner_table(model).join(table, "v") if landmarks else table


def _point_arrays(model: FaceModel, landmarks: bool) -> Callable[[pa.Table, int, int], dict[str, np.ndarray]]:
    """How rows of the point table in a range of ids become matrices. Sizes are read here, so that tasks need no model."""
    n_coeffs, n_joints = model.n_coeffs, model.n_joints

    def arrays(data: pa.Table, start: int, stop: int) -> dict[str, np.ndarray]:
        data = data.sort_by([("lmk", "ascending"), ("k", "ascending")] if landmarks else [("v", "ascending")])
        # A point's id is its place in the arrays.
        places = np.arange(start, stop)
        if not np.array_equal(data.column("lmk" if landmarks else "v").to_numpy(), np.repeat(places, 3) if landmarks else places):
            raise ValueError("every landmark needs three corners, every vertex one row")

        def lists(name: str, width: int) -> np.ndarray:
            return np.concatenate([matrix_of(c, width) for c in data.column(name).chunks])

        out = {
            "base": np.stack([data.column(a).to_numpy() for a in AXES], axis=1),
            "basis": np.stack([lists(f"b{a}", n_coeffs) for a in AXES], axis=1),
            "weights": lists("w", n_joints),
        }
        if landmarks:
            out["bary"] = data.column("b").to_numpy().reshape(-1, 3)
        return out

    return arrays


def _joint_arrays(model: FaceModel) -> dict[str, np.ndarray]:
    joints = np.array([[row[a] for a in AXES] for row in model.joint_basis])
    return {"joint_base": joints[:, :, 0], "joint_basis": joints[:, :, 1:].reshape(3 * model.n_joints, -1), "parents": np.array(model.parents)}


def _dense_motions(coeffs: np.ndarray, rots: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Turn (samples, joints, 3, 3) and shift (samples, joints, 3) of every joint relative to rest."""
    rest = (coeffs @ m["joint_basis"].T).reshape(len(coeffs), -1, 3) + m["joint_base"]
    turns, places = rots.copy(), rest.copy()
    for j, parent in enumerate(m["parents"]):
        if parent >= 0:
            turns[:, j] = turns[:, parent] @ rots[:, j]
            step = (rest[:, j] - rest[:, parent])[:, :, None]
            places[:, j] = places[:, parent] + (turns[:, parent] @ step)[:, :, 0]
    return turns, places - (turns @ rest[..., None])[..., 0]


def _dense_points(coeffs: np.ndarray, rots: np.ndarray, shift: np.ndarray, m: dict, uses_pose: bool) -> np.ndarray:
    """(samples, points, 3) of one chunk: blend, skin, translate, and mix corners for landmarks."""
    turns, places = _dense_motions(coeffs, rots, m)
    inputs = [coeffs]
    if uses_pose:
        inputs.append((rots[:, 1:5] - np.eye(3)).reshape(len(rots), -1))
    v = len(m["base"])
    blended = (np.concatenate(inputs, axis=1) @ m["basis"].reshape(3 * v, -1).T).reshape(-1, v, 3) + m["base"]
    moves = np.concatenate([turns.reshape(len(rots), -1, 9), places], axis=2)
    skinning = m["weights"] @ moves
    points = skinning[..., 9:] + shift[:, None, :]
    for a in range(3):
        points[..., a] += (
            skinning[..., 3 * a] * blended[..., 0]
            + skinning[..., 3 * a + 1] * blended[..., 1]
            + skinning[..., 3 * a + 2] * blended[..., 2]
        )
    if "bary" in m:
        points = np.einsum("slkc,lk->slc", points.reshape(len(points), -1, 3, 3), m["bary"])
    return points


def _block_step(model: FaceModel, landmarks: bool, budget: int | None) -> int:
    """Points in a block; all of them where the whole table stays within the broadcast budget."""
    count = model.n_landmarks if landmarks else model.n_vertices
    size = vertex_bytes(model) * (3 if landmarks else 1)
    if budget is None and size * count <= BROADCAST_BYTES:
        return max(count, 1)
    return max(1, (budget or BLOCK_BYTES) // size)


def decode_blocks(params: DataFrame, model: FaceModel, layout: Layout, key: str = "sid", keep: Sequence[str] = (),
                  landmarks: bool = True, budget: int | None = None) -> DataFrame:
    """Posed landmarks or vertices by matrix products per Arrow batch: (key, keep, first, points), the points from
    number ``first`` on.

    Rotations stay column arithmetic; joint regression, joint motions and the dense products run in
    the batch, where each is one product for all its samples. A model within the budget is broadcast and gives one row
    per sample. A larger one is cut into blocks of points, of which a worker holds one, and gives a row per sample and block.
    """
    if landmarks and model.lmk_embed is None:
        raise ValueError("the model has no landmark embedding")
    check_model(layout, model)
    step = _block_step(model, landmarks, budget)
    total = model.n_landmarks if landmarks else model.n_vertices
    count = -(-total // step)
    n_coeffs, n_joints, uses_pose = model.n_shape + model.n_expr, model.n_joints, model.uses_pose
    shift = array_sql(f"coalesce(get(transl, {a}), 0D)" for a in range(3))
    flat = rotations(params, global_width=layout.width("global_pose")).selectExpr(
        f"`{key}`", *[f"`{c}`" for c in keep], "concat(shape, expression) AS coeffs", "flatten(rots) AS rots", f"{shift} AS shift"
    )
    names = [key, *keep]
    fields = T.StructType([*[flat.schema[n] for n in names], T.StructField("first", T.IntegerType()), POINTS])
    joints, arrays = _joint_arrays(model), _point_arrays(model, landmarks)

    def points_of(m: dict[str, np.ndarray], record: pa.RecordBatch, first: int) -> Iterator[pa.RecordBatch]:
        few = max(_CHUNK_SAMPLES, _CHUNK_ROWS // max(len(m["base"]), 1))
        for start in range(0, record.num_rows, few):
            part = record.slice(start, few)
            column = lambda name, part=part: part.column(part.schema.get_field_index(name))
            points = _dense_points(
                matrix_of(column("coeffs"), n_coeffs), matrix_of(column("rots"), n_joints * 9).reshape(-1, n_joints, 3, 3),
                matrix_of(column("shift"), 3), m, uses_pose)
            yield pa.RecordBatch.from_arrays(
                [*[column(n) for n in names], pa.array(np.full(len(points), first, np.int32)), _points_column(points)], names=fields.names)

    if count > 1:
        table = packed_blocks(
            _point_table(model, landmarks), "lmk" if landmarks else "v", step,
            lambda data: arrays(data, data.column("block")[0].as_py() * step, min((data.column("block")[0].as_py() + 1) * step, total)))
        return map_blocks(flat, table, count, lambda held, record: points_of(held[1], record, held[0]), fields,
                          lambda block, m: (block * step, {**m, **joints}))
    kept = model.__dict__.setdefault("_dense", {})
    if landmarks not in kept:
        # Within the broadcast budget; kept as long as the model is.
        kept[landmarks] = {**arrays(_point_table(model, landmarks).toArrow(), 0, total), **joints}
    shared = params.sparkSession.sparkContext.broadcast(kept[landmarks])

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            yield from points_of(shared.value, record, 0)

    return flat.mapInArrow(run, fields)


def decode_dense(params: DataFrame, model: FaceModel, layout: Layout, key: str = "sid",
                 keep: Sequence[str] = (), landmarks: bool = True, budget: int | None = None) -> DataFrame:
    """Posed landmarks or vertices as one array of points per sample: (key, keep, points).

    Of a model in blocks the rows of a sample are put together by a shuffle, which the long form of :func:`decode`
    does without.
    """
    if _block_step(model, landmarks, budget) >= (model.n_landmarks if landmarks else model.n_vertices):
        return decode_blocks(params, model, layout, key, keep, landmarks, budget).drop("first")
    # Equal rows stay rows of their own.
    numbered = params.withColumn("_row", F.monotonically_increasing_id())
    found = decode_blocks(numbered, model, layout, key, [*keep, "_row"], landmarks, budget)
    parts = F.array_sort(F.collect_list(F.struct("first", "points")))
    return found.groupBy(key, "_row").agg(
        *[F.any_value(c).alias(c) for c in keep], F.flatten(F.transform(parts, lambda p: p["points"])).alias("points")).drop("_row")


def unroll_blocks(df: DataFrame, index: str) -> DataFrame:
    """Long form of rows with the points from number ``first`` on."""
    rest = [c for c in df.columns if c not in ("first", "points")]
    return df.select(*rest, "first", F.posexplode("points").alias("_at", "_p")).select(
        *rest, (F.col("first") + F.col("_at")).alias(index), "_p.x", "_p.y", "_p.z")


def unroll_points(df: DataFrame, index: str = "lmk", points: str = "points") -> DataFrame:
    """Long form of an array of points."""
    rest = [c for c in df.columns if c != points]
    return df.select(*rest, F.posexplode(points).alias(index, "_p")).select(*rest, index, "_p.x", "_p.y", "_p.z")


def decode(params: DataFrame, model: FaceModel, layout: Layout, key: str = "sid", dense: bool = True,
           on_missing: str = "raise", budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (key, v, x, y, z) and landmarks (key, lmk, x, y, z) of a batch of parameter rows.

    The dense form is several times faster; the native one needs no Python. ``budget`` bounds the bytes of the model
    that a worker of the dense form holds.
    """
    if dense:
        verts = unroll_blocks(decode_blocks(params, model, layout, key, landmarks=False, budget=budget), "v")
        if model.lmk_embed is None:
            return verts, no_landmarks(params, key, on_missing)
        return verts, unroll_blocks(decode_blocks(params, model, layout, key, budget=budget), "lmk")
    return decode_vertices(params, model, layout, key), decode_landmarks(
        params, model, layout, key, on_missing=on_missing, dense=False
    )
