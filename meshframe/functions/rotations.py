"""Rotation encodings as row-major nine-element array columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meshframe.functions.steps import Steps, array_sql, number_sql, numbers_sql, product_sql, run_steps

# The shift inside the axis-angle norm, and the floor of a normalizing length.
AXIS_ANGLE_SHIFT = 1e-8
LENGTH_FLOOR = 1e-12
IDENTITY3 = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)

ROTATION_ORDER = ("global_pose", "neck_pose", "jaw_pose", "left_eye", "right_eye")


def _get(col: str, start: int = 0, n: int = 3) -> list[str]:
    return [f"get({col}, {i})" for i in range(start, start + n)]


def _length(v: list[str]) -> str:
    return f"greatest(sqrt({product_sql(v, v)}), {number_sql(LENGTH_FLOOR)})"


def rot6d_steps(col: str, out: str, tag: str = "_r6") -> Steps:
    """6D encoding (Zhou et al. 2019): Gram-Schmidt of the two halves, third row by cross product.

    A zero half gives zero rows instead of an error.
    """
    a, b = _get(col), _get(col, 3)
    u, w, q = (_get(f"{tag}_{n}") for n in ("u", "w", "q"))
    cross = [f"{u[i]} * {w[j]} - {u[j]} * {w[i]}" for i, j in ((1, 2), (2, 0), (0, 1))]
    return [
        {f"{tag}_n": _length(a)},
        {f"{tag}_u": array_sql(f"{x} / {tag}_n" for x in a)},
        {f"{tag}_d": product_sql(u, b)},
        {f"{tag}_q": array_sql(f"{y} - {tag}_d * {x}" for x, y in zip(u, b))},
        {f"{tag}_m": _length(q)},
        {f"{tag}_w": array_sql(f"{x} / {tag}_m" for x in q)},
        {out: array_sql([*u, *w, *cross])},
    ]


def rodrigues_steps(col: str, out: str, tag: str = "_aa") -> Steps:
    """Axis-angle to rotation.

    The angle is the norm of the vector shifted by a tiny amount per component, while the axis
    divides the unshifted vector, so the axis is a hair off unit length; both are kept on purpose.
    """
    v = _get(col)
    shifted = [f"({x} + {number_sql(AXIS_ANGLE_SHIFT)})" for x in v]
    x, y, z = _get(f"{tag}_d")
    s, k = f"{tag}_s", f"{tag}_k"
    return [
        {f"{tag}_t": f"sqrt({product_sql(shifted, shifted)})"},
        {
            f"{tag}_d": array_sql(f"coalesce(try_divide({c}, {tag}_t), 0D)" for c in v),
            s: f"sin({tag}_t)",
            k: f"1D - cos({tag}_t)",
        },
        {out: array_sql([
            f"1D - {k} * ({y} * {y} + {z} * {z})", f"{k} * {x} * {y} - {s} * {z}", f"{k} * {x} * {z} + {s} * {y}",
            f"{k} * {x} * {y} + {s} * {z}", f"1D - {k} * ({x} * {x} + {z} * {z})", f"{k} * {y} * {z} - {s} * {x}",
            f"{k} * {x} * {z} - {s} * {y}", f"{k} * {y} * {z} + {s} * {x}", f"1D - {k} * ({x} * {x} + {y} * {y})",
        ])},
    ]


def rot6d(df: DataFrame, col: str, out: str = "rot") -> DataFrame:
    return run_steps(df, rot6d_steps(col, out)).select(*df.columns, out)


def rodrigues(df: DataFrame, col: str, out: str = "rot") -> DataFrame:
    return run_steps(df, rodrigues_steps(col, out)).select(*df.columns, out)


def _by_width(col: str, out: str, tag: str = "_gp") -> tuple[Steps, Steps, Steps]:
    choice = (
        f"CASE size({col}) WHEN 6 THEN {tag}_six WHEN 3 THEN {tag}_three ELSE {numbers_sql(IDENTITY3)} END"
    )
    six = rot6d_steps(col, f"{tag}_six", f"{tag}6")
    three = rodrigues_steps(col, f"{tag}_three", f"{tag}3")
    return six, three, [{}] * len(six) + [{out: choice}]


def global_rotation(df: DataFrame, col: str, out: str = "rot", warn: str = "warn") -> DataFrame:
    """Rotation by the width of the encoding, and a warning for widths other than six."""
    warning = (
        f"CASE size({col}) WHEN 6 THEN CAST(NULL AS string) WHEN 3 THEN 'axis-angle global pose' "
        "ELSE 'unexpected global pose width, identity used' END"
    )
    return run_steps(df, *_by_width(col, out), [{warn: warning}]).select(*df.columns, out, warn)


def rotation_stack(df: DataFrame, out: str = "rots", global_width: int | None = None) -> DataFrame:
    """All joint rotations of a row, in the order of ROTATION_ORDER.

    With a known width of the global pose only that encoding is computed.
    """
    if global_width == 6:
        leading = (rot6d_steps("global_pose", "_rot0", "_gp6"),)
    else:
        leading = _by_width("global_pose", "_rot0")
    angles = {"_rot1": "neck_pose", "_rot2": "jaw_pose", "_rot3": "slice(eye_pose, 1, 3)", "_rot4": "slice(eye_pose, 4, 3)"}
    others = [rodrigues_steps(col, name, f"_aa{name[-1]}") for name, col in angles.items()]
    stacked = run_steps(df, *leading, *others)
    return stacked.selectExpr(*[f"`{c}`" for c in df.columns], f"array(_rot0, _rot1, _rot2, _rot3, _rot4) AS {out}")
