"""Model tables: the fixed dimension tables that the geometry operators join to.

A model is small and of known size (a few thousand vertices), whatever the number of samples. Its
sizes are read once, checked, and decide whether a side is hinted for broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.session import doubles

STAR_PARENTS = (-1, 0, 0, 0, 0)
POSE_FEATURES = 36
TABLES = ("template", "shape_basis", "pose_basis", "joint_reg", "skin", "faces")
OPTIONAL_TABLES = ("expr_basis", "joints", "lmk_embed")


@dataclass(frozen=True, eq=False)
class FaceModel:
    """Model tables with their sizes."""

    template: DataFrame      # v, x, y, z
    shape_basis: DataFrame   # v, bx, by, bz
    expr_basis: DataFrame    # v, bx, by, bz
    pose_basis: DataFrame    # v, px, py, pz
    joint_reg: DataFrame     # j, v, w
    skin: DataFrame          # v, w array
    faces: DataFrame         # f, a, b, c
    lmk_embed: DataFrame | None  # lmk, f, b0, b1, b2
    parents: tuple[int, ...]
    n_vertices: int
    n_shape: int
    n_expr: int
    n_pose: int
    n_landmarks: int = 0

    @cached_property
    def problems(self) -> list[str]:
        """What keeps the tables from being one model, found once and checked before anything is decoded.

        Every other step relies on it: ids run from 0 without gaps or repeats, each vertex has one row in
        every table, and references point at rows that exist.
        """
        v = self.n_vertices
        checks: list[tuple[DataFrame, dict[str, Column]]] = []

        def ids(col: str, count: int | None) -> tuple[str, Column]:
            rows = F.count("*")
            size = F.lit(count) if count is not None else rows
            fine = (rows == size) & (F.count_distinct(col) == size) & ((size == 0) | ((F.min(col) == 0) & (F.max(col) == size - 1)))
            return f"ids are not 0 to {'rows' if count is None else count} - 1, once each", ~F.coalesce(fine, F.lit(False))

        def inside(cols: Sequence[str], count: int) -> tuple[str, Column]:
            bad = [F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) >= count) for c in cols]
            return f"reference outside 0 to {count} - 1", F.count_if(reduce(or_, bad)) > 0

        def width(cols: Sequence[str], size: int) -> tuple[str, Column]:
            bad = [F.coalesce(F.size(c), F.lit(-1)) != size for c in cols]
            return f"not {size} numbers", F.count_if(reduce(or_, bad)) > 0

        def check(name: str, df: DataFrame, *found: tuple[str, Column]) -> None:
            checks.append((df, {f"{name}: {text}": bad for text, bad in found}))

        basis = ["bx", "by", "bz"]
        check("template", self.template, ids("v", v))
        check("skin", self.skin, ids("v", v), width(["w"], self.n_joints))
        check("shape_basis", self.shape_basis, ids("v", v), width(basis, self.n_shape))
        check("expr_basis", self.expr_basis, ids("v", v), width(basis, self.n_expr))
        check("pose_basis", self.pose_basis, ids("v", v), *([width(["px", "py", "pz"], self.n_pose)] if self.uses_pose else []))
        check("joint_reg vertices", self.joint_reg, inside(["v"], v))
        check("faces", self.faces, ids("f", None), inside(["a", "b", "c"], v))
        if self.lmk_embed is not None:
            check("lmk_embed", self.lmk_embed, ids("lmk", self.n_landmarks))
            lost = self.lmk_embed.join(self.faces, "f", "left_anti")
            check("lmk_embed", lost, ("landmark without its face", F.count("*") > 0))
        # One aggregate for each table, all in one job.
        rows = [df.agg(F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in found.items()])).alias("found")) for df, found in checks]
        return sorted(text for r in reduce(DataFrame.unionAll, rows).collect() for text in r["found"])

    def verify(self) -> None:
        if self.problems:
            raise ValueError("the model tables do not fit together: " + "; ".join(self.problems))

    @property
    def n_joints(self) -> int:
        return len(self.parents)

    @cached_property
    def joint_basis(self) -> list[dict[str, list[float]]]:
        """Joint regression applied to template and bases: per joint and axis, a constant and one
        number per shape and expression coefficient.

        Regression is linear, so a sample's joints follow from these constants by inner products and
        never need its vertices. Only joints times coefficients numbers come to the driver.
        """
        shape = self.shape_basis.select("v", *[F.col(f"b{a}").alias(f"s{a}") for a in "xyz"])
        expr = self.expr_basis.select("v", *[F.col(f"b{a}").alias(f"e{a}") for a in "xyz"])
        axes = [F.concat(F.array(a), f"s{a}", f"e{a}").alias(a) for a in "xyz"]
        rows = self.joint_reg.join(self.template, "v").join(shape, "v").join(expr, "v").select("j", "w", *axes)
        sums = [F.sum(F.col("w") * F.col(f"b.{a}")).alias(a) for a in "xyz"]
        spread = rows.select("j", "w", F.posexplode(F.arrays_zip("x", "y", "z")).alias("s", "b"))
        out = [{a: [0.0] * (1 + self.n_shape + self.n_expr) for a in "xyz"} for _ in self.parents]
        for r in spread.groupBy("j", "s").agg(*sums).filter(F.col("j") < self.n_joints).collect():
            for a in "xyz":
                out[r["j"]][a][r["s"]] = r[a]
        return out

    @property
    def uses_pose(self) -> bool:
        """A pose basis of another width than the pose feature has no effect."""
        return self.n_pose == POSE_FEATURES

    @property
    def n_coeffs(self) -> int:
        """Length of the per-sample vector that multiplies the joined bases."""
        return self.n_shape + self.n_expr + (self.n_pose if self.uses_pose else 0)


def cut_basis(df: DataFrame, n: int, cols: Sequence[str] = ("bx", "by", "bz")) -> DataFrame:
    """First n columns of a basis."""
    kept = {c: F.slice(c, 1, n) if n else doubles() for c in cols}
    return df.withColumns(kept)


def no_basis(template: DataFrame) -> DataFrame:
    """Basis of width zero: a missing expression basis has no effect."""
    return template.select("v", doubles().alias("bx"), doubles().alias("by"), doubles().alias("bz"))


def pose_basis_from_tensor(df: DataFrame, shape: Sequence[int], values: str = "values") -> DataFrame:
    """Pose basis rows (v, px, py, pz) from one flat row-major array per vertex.

    ``shape`` is the stored rank-3 shape. A second axis of 3 with a third axis other than 3 means
    (vertex, axis, feature); anything else is (vertex, feature, axis).
    """
    axis_first = len(shape) == 3 and shape[1] == 3 and shape[2] != 3
    width = shape[2] if axis_first else shape[1]

    def axis(c: int) -> Column:
        if axis_first:
            return F.slice(values, c * width + 1, width)
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda p: F.get(values, p * 3 + c))

    return df.select("v", axis(0).alias("px"), axis(1).alias("py"), axis(2).alias("pz"))


def tree_parents(parents: Mapping[int, int] | None, n_joints: int) -> tuple[int, ...]:
    """Parents cut to the skinned joints with the root at -1; a star when the tree is too short."""
    if not parents or len(parents) < n_joints:
        if n_joints != len(STAR_PARENTS):
            raise ValueError(f"no parents for {n_joints} joints")
        return STAR_PARENTS
    tree = (-1, *[int(parents[j]) for j in range(1, n_joints)])
    if any(p < 0 or p >= j for j, p in enumerate(tree) if j):
        raise ValueError(f"parents must come before their children: {tree}")
    return tree


def load_assets(spark: SparkSession, folder: str, n_shape: int, n_exp: int,
                tables: Mapping[str, DataFrame] | None = None) -> FaceModel:
    """Model from the Parquet tables of a folder, or from given DataFrames of the same schemas.

    All counts come from the tables; tables that do not fit together are refused with their faults.
    """
    found: dict[str, DataFrame] = dict(tables or {})
    if tables is None:
        for name in TABLES:
            found[name] = spark.read.parquet(f"{folder}/{name}")
        present = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = present.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in OPTIONAL_TABLES:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            if fs.exists(path):
                found[name] = spark.read.parquet(f"{folder}/{name}")
    template = found["template"]
    expr_given = "expr_basis" in found
    embed = found.get("lmk_embed")
    # All sizes in one job.
    asked = {"v": template.agg(F.count("*")), **{
        name: found[name].agg(F.max(F.size(col)))
        for name, col in (("skin", "w"), ("pose_basis", "px"), ("shape_basis", "bx"), ("expr_basis", "bx")) if name in found}}
    if embed is not None:
        asked["lmk_embed"] = embed.agg(F.count("*"))
    rows = [df.toDF("n").select(F.lit(name).alias("name"), F.col("n").cast("bigint").alias("n")) for name, df in asked.items()]
    sizes = {r["name"]: r["n"] for r in reduce(DataFrame.unionAll, rows).collect()}
    skin_width, pose_width, shape_width = sizes["skin"], sizes["pose_basis"], sizes["shape_basis"]
    expr_width = sizes["expr_basis"] if expr_given else n_exp
    parents = None
    if "joints" in found:
        rows = found["joints"].orderBy("j").limit(skin_width).collect()
        parents = {r["j"]: r["parent"] for r in rows}
    model = FaceModel(
        template=template,
        shape_basis=cut_basis(found["shape_basis"], min(n_shape, shape_width)),
        expr_basis=cut_basis(found["expr_basis"], min(n_exp, expr_width)) if expr_given else no_basis(template),
        pose_basis=found["pose_basis"],
        joint_reg=found["joint_reg"].filter("w <> 0"),
        skin=found["skin"],
        faces=found["faces"],
        lmk_embed=embed,
        n_landmarks=sizes.get("lmk_embed", 0),
        parents=tree_parents(parents, skin_width),
        n_vertices=sizes["v"],
        n_shape=min(n_shape, shape_width),
        n_expr=min(n_exp, expr_width) if expr_given else 0,
        n_pose=pose_width,
    )
    model.verify()
    return model


# Key names of the two embedding conventions, preferred one first, and the index of
# the first face in each.
EMBEDDING_CONVENTIONS = (
    ("full_lmk_faces_idx", "full_lmk_bary_coords", 1),
    ("lmk_face_idx", "lmk_b_coords", 0),
)


def resolve_embedding(df: DataFrame, file: str = "file", n: int = 68) -> DataFrame:
    """Landmark embedding of each file from its named arrays.

    Input rows are (file, key, shape, values) with values flattened row-major. The first convention
    with both keys present is used; a leading unit axis is dropped; only shapes (n) and (n, 3) are
    accepted. Output is (file, convention, reason, faces, bary): ``reason`` is null for accepted
    files, faces are 0-based.
    """
    def entry(name: str) -> Column:
        return F.max(F.when(F.col("key") == name, F.struct("shape", "values")))

    keys = [k for face, bary, _ in EMBEDDING_CONVENTIONS for k in (face, bary)]
    files = df.groupBy(file).agg(*[entry(k).alias(k) for k in keys])
    chosen = F.lit(None)
    for face, bary, base in reversed(EMBEDDING_CONVENTIONS):
        option = F.struct(
            F.lit(face).alias("convention"), F.col(face).alias("face"), F.col(bary).alias("bary"),
            F.lit(base).alias("base"),
        )
        chosen = F.when(F.col(face).isNotNull() & F.col(bary).isNotNull(), option).otherwise(chosen)

    def squeezed(shape: Column, rank: int) -> Column:
        unit = (F.size(shape) == rank) & (F.get(shape, F.lit(0)) == 1)
        return F.when(unit, F.slice(shape, 2, rank - 1)).otherwise(shape)

    picked = files.select(file, chosen.alias("c")).select(
        file,
        F.col("c.convention").alias("convention"),
        squeezed(F.col("c.face.shape"), 2).alias("face_shape"),
        squeezed(F.col("c.bary.shape"), 3).alias("bary_shape"),
        F.transform("c.face.values", lambda f: f.cast("int")).alias("face_values"),
        F.col("c.bary.values").alias("bary_values"),
        F.col("c.base").alias("base"),
    )
    face_fits = (F.size("face_shape") == 1) & (F.get("face_shape", F.lit(0)) == n)
    bary_fits = (
        (F.size("bary_shape") == 2) & (F.get("bary_shape", F.lit(0)) == n) & (F.get("bary_shape", F.lit(1)) == 3)
    )
    reason = (
        F.when(F.col("convention").isNull(), "no known landmark keys")
        .when(~face_fits, "face index shape")
        .when(~bary_fits, "barycentric shape")
    )
    return picked.withColumn("reason", reason).select(
        file,
        "convention",
        "reason",
        F.when(F.col("reason").isNull(), F.transform("face_values", lambda f: f - F.col("base"))).alias("faces"),
        F.when(F.col("reason").isNull(), F.col("bary_values")).alias("bary"),
    )


def embedding_rows(resolved: DataFrame, file: str = "file") -> DataFrame:
    """Accepted embeddings as (file, lmk, f, b0, b1, b2)."""
    def corner(k: int) -> Column:
        return F.get("bary", F.col("lmk") * 3 + k).alias(f"b{k}")

    return (
        resolved.filter(F.col("reason").isNull())
        .select(file, "bary", F.posexplode("faces").alias("lmk", "f"))
        .select(file, "lmk", "f", corner(0), corner(1), corner(2))
    )
