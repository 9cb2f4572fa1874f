"""The registered queries as SQL for another engine, written relationally: numbers are unrolled to
rows and recombined by joins and sums, where the Spark side works on arrays."""

from __future__ import annotations

from meshframe.operators.losses import REGULARIZERS
from meshframe.operators.permutation import PRIME, Permutation
from meshframe.operators.quality import INDEX_KEYS
from meshframe.operators.reporting import TRAINING_STAGES

_GROUPS = (
    ("shape", 0, 40), ("expression", 40, 0), ("global_pose", 40, 6), ("jaw_pose", 46, 3),
    ("eye_pose", 49, 6), ("neck_pose", 55, 3), ("transl", 58, 3), ("detail", 61, 3),
)
_WEIGHTS = TRAINING_STAGES[0].weights


def r6(text: str, name: str | None = None) -> str:
    """Six decimals without a negative zero."""
    value = f"(CASE WHEN round({text}, 6) = 0 THEN 0e0 ELSE round({text}, 6) END)"
    return f"{value} AS {name}" if name else value


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


EMB = "emb AS (SELECT vec_id AS sid, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
VALS = "vals AS (SELECT sid, label, unnest(range(len(e))) AS i, unnest(e) AS x FROM emb)"


def _pass(x: str) -> str:
    """One pass of the keyed permutation over ``x``: its place is ``placed``."""
    p = f"{PRIME}::BIGINT"
    text, left, right = f"LATERAL (SELECT ({x}) // b AS l, ({x}) % b AS r) h", "h.l", "h.r"
    for k, (u, v, w) in enumerate(Permutation(0, 42, 0).keys):
        here, there, modulus = (right, left, "b") if k % 2 else (left, right, "a")
        text += f""", LATERAL (SELECT ({there} + {u}) % {p} AS y) y{k}, LATERAL (SELECT (y{k}.y * y{k}.y + {v}) % {p} AS z) z{k},
  LATERAL (SELECT ({here} + z{k}.z * z{k}.z % {p} * {w} % {p}) % {modulus} AS s) h{k}"""
        left, right = (left, f"h{k}.s") if k % 2 else (f"h{k}.s", right)
    return text + f", LATERAL (SELECT {left} * b + {right} AS placed) q"


# A sample's place: passes of the permutation over its id until the result is an id again.
BATCHED = f"""sized AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (
    SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM (SELECT count(*) AS n FROM embeddings))),
walk AS (
  SELECT vec_id AS sid, placed AS x FROM embeddings, sized, {_pass("vec_id")}
  UNION ALL
  SELECT sid, placed FROM walk, sized, {_pass("x")} WHERE x >= n),
batched AS (
  SELECT sid, CAST(x // 190 AS BIGINT) AS batch, CAST(x % 190 AS INTEGER) AS slot FROM walk, sized WHERE x < n)"""
GROUP_CASE = "CASE " + " ".join(
    f"WHEN i BETWEEN {o} AND {o + w - 1} THEN '{g}'" for g, o, w in _GROUPS if w
) + " END"

# --- the small model ----------------------------------------------------------------------------

MODEL = """tmpl AS (SELECT v, c, ((v * 7 + c * 3) % 11 - 5) / 50e0 AS t FROM range(25) a(v), range(3) b(c)),
sbasis AS (SELECT v, c, s, ((v * 5 + c * 2 + s * 3) % 13 - 6) / 100e0 AS b FROM range(25) a(v), range(3) b(c), range(40) d(s)),
pbasis AS (SELECT v, c, p, ((v + p * 2 + c) % 7 - 3) / 200e0 AS b FROM range(25) a(v), range(3) b(c), range(36) d(p)),
skinw AS (SELECT v, j, ((v + j) % 5 + 1) / 15e0 AS w FROM range(25) a(v), range(5) b(j)),
embed AS (
  SELECT l AS lmk, (l * 5) % 23 AS f, k,
         (CASE k WHEN 0 THEN l % 3 + 1 WHEN 1 THEN l % 4 + 1 ELSE l % 5 + 1 END)
         / CAST((l % 3 + 1) + (l % 4 + 1) + (l % 5 + 1) AS DOUBLE) AS b
  FROM range(68) a(l), range(3) d(k))"""
SHAPED = """offs AS (
  SELECT vals.sid, sbasis.v, sbasis.c, sum(vals.x * sbasis.b) AS d
  FROM vals JOIN sbasis ON vals.i = sbasis.s GROUP BY ALL),
shaped AS (SELECT offs.sid, v, c, t + d AS p FROM offs JOIN tmpl USING (v, c))"""
JOINTS = "rest AS (SELECT sid, v % 5 AS j, c, sum(0.2e0 * p) AS p FROM shaped GROUP BY ALL)"


def _xyz(source: str, keys: str, value: str = "p") -> str:
    axes = ", ".join(r6(f"max(CASE WHEN c = {c} THEN {value} END)", a) for c, a in enumerate("xyz"))
    return f"SELECT {keys}, {axes} FROM {source} GROUP BY ALL"


def _wide(source: str, keys: str, value: str = "p") -> str:
    axes = ", ".join(f"max(CASE WHEN c = {c} THEN {value} END) AS {a}" for c, a in enumerate("xyz"))
    return f"SELECT {keys}, {axes} FROM {source} GROUP BY ALL"


ROT6 = """six AS (SELECT sid, e[41] AS a1, e[42] AS a2, e[43] AS a3, e[44] AS c1, e[45] AS c2, e[46] AS c3 FROM emb),
six1 AS (SELECT *, greatest(sqrt(a1*a1 + a2*a2 + a3*a3), 1e-12) AS n FROM six),
six2 AS (SELECT *, a1/n AS x1, a2/n AS x2, a3/n AS x3 FROM six1),
six3 AS (SELECT *, x1*c1 + x2*c2 + x3*c3 AS d FROM six2),
six4 AS (SELECT *, c1 - d*x1 AS q1, c2 - d*x2 AS q2, c3 - d*x3 AS q3 FROM six3),
six5 AS (SELECT *, greatest(sqrt(q1*q1 + q2*q2 + q3*q3), 1e-12) AS m FROM six4),
six6 AS (SELECT *, q1/m AS y1, q2/m AS y2, q3/m AS y3 FROM six5),
rot6 AS (SELECT sid, [x1, x2, x3, y1, y2, y3, x2*y3 - x3*y2, x3*y1 - x1*y3, x1*y2 - x2*y1] AS r FROM six6)"""


def _axis_angle(name: str, source: str, keys: str) -> str:
    """CTEs turning (keys, r1, r2, r3) into (keys, r)."""
    return f"""{name}1 AS (SELECT *, sqrt((r1+1e-8)*(r1+1e-8) + (r2+1e-8)*(r2+1e-8) + (r3+1e-8)*(r3+1e-8)) AS t FROM {source}),
{name}2 AS (SELECT *, r1/t AS x, r2/t AS y, r3/t AS z, sin(t) AS s, 1 - cos(t) AS k FROM {name}1),
{name} AS (SELECT {keys}, [1 - k*(y*y + z*z), k*x*y - s*z, k*x*z + s*y,
  k*x*y + s*z, 1 - k*(x*x + z*z), k*y*z - s*x,
  k*x*z - s*y, k*y*z + s*x, 1 - k*(x*x + y*y)] AS r FROM {name}2)"""


ROTS = ROT6 + """,
angles AS (
  SELECT sid, 1 AS j, e[56] AS r1, e[57] AS r2, e[58] AS r3 FROM emb UNION ALL
  SELECT sid, 2, e[47], e[48], e[49] FROM emb UNION ALL
  SELECT sid, 3, e[50], e[51], e[52] FROM emb UNION ALL
  SELECT sid, 4, e[53], e[54], e[55] FROM emb),
""" + _axis_angle("turned", "angles", "sid, j") + """,
rots AS (SELECT sid, 0 AS j, r FROM rot6 UNION ALL SELECT sid, j, r FROM turned)"""


def _chain(parents: tuple[int, ...]) -> str:
    tree = ", ".join(f"({j}, {p})" for j, p in enumerate(parents))
    cells = []
    for row in range(3):
        turn = [f"g.g[{4 * row + i + 1}]" for i in range(3)]
        cells += [
            " + ".join(f"{turn[i]} * l.r[{3 * i + c + 1}]" for i in range(3)) for c in range(3)
        ]
        cells.append(" + ".join(f"{turn[i]} * l.t[{i + 1}]" for i in range(3)) + f" + g.g[{4 * row + 4}]")
    root = ", ".join(x for row in range(3) for x in (*[f"l.r[{3 * row + c + 1}]" for c in range(3)], f"l.t[{row + 1}]"))
    levels = []
    depth = [0 if p < 0 else None for p in parents]
    for j, p in enumerate(parents):
        if p >= 0:
            depth[j] = depth[p] + 1
    for level in range(max(depth) + 1):
        if level == 0:
            levels.append(f"lev0 AS (SELECT l.sid, l.j, [{root}] AS g FROM loc l WHERE l.parent < 0)")
        else:
            levels.append(
                f"lev{level} AS (SELECT l.sid, l.j, [{', '.join(cells)}] AS g FROM loc l"
                f" JOIN lev{level - 1} g ON g.sid = l.sid AND g.j = l.parent)"
            )
    union = " UNION ALL ".join(f"SELECT * FROM lev{i}" for i in range(max(depth) + 1))
    return f"""tree(j, parent) AS (VALUES {tree}),
joint AS (SELECT sid, j, list(p ORDER BY c) AS p FROM rest GROUP BY ALL),
loc AS (
  SELECT a.sid, a.j, tree.parent, rots.r,
         [a.p[1] - coalesce(b.p[1], 0), a.p[2] - coalesce(b.p[2], 0), a.p[3] - coalesce(b.p[3], 0)] AS t
  FROM joint a JOIN tree ON tree.j = a.j JOIN rots ON rots.sid = a.sid AND rots.j = a.j
  LEFT JOIN joint b ON b.sid = a.sid AND b.j = tree.parent),
{", ".join(levels)},
frames AS ({union})"""


CHAIN = _chain((-1, 0, 1, 1, 1))
_MOTION = ", ".join(
    x for a in range(3) for x in (
        *[f"g[{4 * a + i + 1}]" for i in range(3)],
        f"g[{4 * a + 4}] - (" + " + ".join(f"g[{4 * a + i + 1}] * p[{i + 1}]" for i in range(3)) + ")",
    )
)
MOTIONS = f"motions AS (SELECT f.sid, f.j, [{_MOTION}] AS m FROM frames f JOIN joint USING (sid, j))"
POSE = """feature AS (
  SELECT sid, (j - 1) * 9 + q AS p, r[q + 1] - (CASE WHEN q % 4 = 0 THEN 1 ELSE 0 END) AS x
  FROM rots, range(9) a(q) WHERE j >= 1),
poff AS (SELECT sid, v, c, sum(x * b) AS p FROM feature JOIN pbasis USING (p) GROUP BY ALL)"""
BLENDED = "blended AS (SELECT s.sid, s.v, s.c, s.p + o.p AS p FROM shaped s JOIN poff o USING (sid, v, c))"


def _skin(source: str, name: str) -> str:
    moved = [f"w * (m[{4 * a + 1}] * x + m[{4 * a + 2}] * y + m[{4 * a + 3}] * z + m[{4 * a + 4}])" for a in range(3)]
    sums = ", ".join(f"sum({t}) AS {a}" for t, a in zip(moved, "xyz"))
    return f"""{name}_in AS ({_wide(source, 'sid, v')}),
{name} AS (SELECT sid, v, {sums} FROM {name}_in JOIN skinw USING (v) JOIN motions USING (sid, j) GROUP BY ALL)"""


GEOMETRY = [EMB, VALS, MODEL, SHAPED, JOINTS, ROTS, CHAIN, MOTIONS, POSE, BLENDED, _skin("blended", "skinned")]
VERTS = "verts AS (SELECT sid, v, x + e[59] AS x, y + e[60] AS y, z + e[61] AS z FROM skinned JOIN emb USING (sid))"
LMKS = """lmks AS (
  SELECT sid, lmk, sum(b * x) AS x, sum(b * y) AS y, sum(b * z) AS z
  FROM embed JOIN verts ON verts.v = embed.f + embed.k GROUP BY ALL)"""
SCREEN = """screen AS (
  SELECT sid, lmk, 112 + 112 / tan(radians(15e0)) * x / (2.7e0 - z) AS sx,
         112 - 112 / tan(radians(15e0)) * y / (2.7e0 - z) AS sy FROM lmks)"""
TRUTH = """truth AS (
  SELECT sid, l AS lmk, 112 + ((sid * 3 + l * 7) % 41 - 20) AS tx, 112 + ((sid * 5 + l * 11) % 37 - 18) AS ty
  FROM emb, range(68) a(l))"""
DECODED = [*GEOMETRY, VERTS]
LANDMARKS = [*DECODED, LMKS]
SHOWN = [*LANDMARKS, SCREEN, TRUTH]

# --- losses -------------------------------------------------------------------------------------

_TARGET = "(CASE WHEN i IN (40, 44) THEN 1 ELSE 0 END)"


def _term(term: str) -> str:
    """Regularizer as an aggregate over vals rows."""
    group = REGULARIZERS[term]
    target = _TARGET if group == "global_pose" else "0"
    offset, width = next((o, w) for g, o, w in _GROUPS if g == group)
    inside = f"i BETWEEN {offset} AND {offset + width - 1}" if width else "false"
    return f"coalesce(sum((x - {target}) * (x - {target})) FILTER ({inside}) / nullif(count(*) FILTER ({inside}), 0), 0)"


def _terms(source: str, keys: str, active: list[str]) -> str:
    parts = []
    for term in REGULARIZERS:
        value = _term(term) if term in active else "0e0"
        parts.append(f"SELECT {keys}, '{term}' AS term, {value} AS value FROM {source} GROUP BY {keys}")
    return " UNION ALL ".join(parts)


def _weight_case(weights: dict[str, float]) -> str:
    cases = " ".join(f"WHEN '{t}' THEN {w!r}e0" if "e" not in repr(w) else f"WHEN '{t}' THEN {w!r}" for t, w in weights.items())
    return f"(CASE term {cases} ELSE 1e0 END)"


_ACTIVE = [t for t in REGULARIZERS if _WEIGHTS.get(t, 0.0) > 0]
BVALS = "bvals AS (SELECT vals.*, batch FROM vals JOIN batched USING (sid))"
LMK_TERM = """SELECT {keys}, 'landmark' AS term,
  sum((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty)) / (2 * count(*)) AS value
  FROM screen JOIN truth USING (sid, lmk) JOIN batched USING (sid) JOIN emb USING (sid) GROUP BY ALL"""


def _batch_losses() -> str:
    terms = f"terms AS ({_terms('bvals', 'batch', _ACTIVE)} UNION ALL {LMK_TERM.format(keys='batch')})"
    return _with(*SHOWN, BATCHED, BVALS, terms) + f"""
SELECT batch, term, {r6('value', 'value')} FROM terms UNION ALL
SELECT batch, 'total', {r6(f"sum({_weight_case(dict(_WEIGHTS))} * value)")} FROM terms GROUP BY batch"""


def _image_losses() -> str:
    """Losses with pixel and perceptual weights; samples without truth have no landmark error."""
    pixel = """SELECT batch, 'pixel' AS term, avg(abs(a.x - b.x)) AS value
  FROM bvals a JOIN vals b ON b.sid = a.sid AND b.i = 63 - a.i GROUP BY batch"""
    seen = LMK_TERM.format(keys="batch").replace("GROUP BY ALL", "WHERE sid % 10 <> 3 GROUP BY ALL")
    terms = f"terms AS ({_terms('bvals', 'batch', _ACTIVE)} UNION ALL {seen} UNION ALL {pixel})"
    weights = {**dict(_WEIGHTS), "pixel": 0.5}
    return _with(*SHOWN, BATCHED, BVALS, terms) + f"""
SELECT batch, term, {r6('value', 'value')} FROM terms UNION ALL
SELECT DISTINCT batch, 'perceptual', 0e0 FROM terms UNION ALL
SELECT batch, 'total', {r6(f"sum({_weight_case(weights)} * value)")} FROM terms GROUP BY batch"""


def _stage_rows() -> str:
    rows, start = [], 0
    for i, stage in enumerate(TRAINING_STAGES):
        weights = ", ".join(f"'{t}': {float(w)!r}::DOUBLE" for t, w in stage.weights.items())
        rows.append(f"({i + 1}, '{stage.name}', {start}, {stage.epochs}, {stage.lr!r}::DOUBLE, MAP {{{weights}}})")
        start += stage.epochs
    return f"""stages(stage, name, start, epochs, lr, weights) AS (VALUES {', '.join(rows)}),
settings AS (
  SELECT start + k AS epoch, stage, name, k AS stage_epoch, lr, weights, start + k IN (0, 15, 29) AS verbose_mark,
         k = 0 OR (k + 1) % 5 = 0 OR k = epochs - 1 AS progress_mark
  FROM stages, range(10) a(k) WHERE k < epochs)"""


SETTINGS = _stage_rows()
STAGED = [
    *SHOWN, BATCHED,
    "bvals AS (SELECT vals.*, batch, label * 3 AS epoch FROM vals JOIN batched USING (sid))",
    SETTINGS,
    f"terms AS ({_terms('bvals', 'epoch, batch', _ACTIVE)} UNION ALL "
    f"{LMK_TERM.format(keys='label * 3 AS epoch, batch')})",
    """staged AS (
  SELECT epoch, batch, term, value FROM terms UNION ALL
  SELECT epoch, batch, 'total', sum(coalesce(weights[term], 1) * value)
  FROM terms JOIN settings USING (epoch) GROUP BY ALL)""",
]
EVENT_TERMS = """event_terms AS (
  SELECT CAST(date_part('day', ts) - 1 AS INTEGER) AS epoch, event_type AS term, event_id AS batch, value FROM events)"""


def _stats(source: str, axes: list[str], keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{a}' AS axis, {r6(f'avg({a})', 'mean')}, {r6(f'stddev_samp({a})', 'std')},"
        f" {r6(f'min({a})', 'min')}, {r6(f'max({a})', 'max')}, count({a}) AS n FROM {source} GROUP BY {keys}"
        for a in axes
    )


def _long(source: str, keys: str, array: str, width: int) -> str:
    return f"SELECT {keys}, CAST(q AS INTEGER) AS i, {r6(f'{array}[q + 1]', 'value')} FROM {source}, range({width}) a(q)"


# --- catalogues ---------------------------------------------------------------------------------

CATALOG = """keys AS (
  SELECT sid, e, key, CASE WHEN sid % 11 = 0 THEN 60 ELSE 68 END AS n
  FROM emb, (VALUES ('full_lmk_faces_idx'), ('lmk_face_idx')) k(key)
  WHERE CASE WHEN key LIKE 'full%' THEN sid % 3 = 0 ELSE sid % 5 <> 0 END),
chosen AS (SELECT sid, e, n, min(key) AS convention FROM keys GROUP BY ALL)"""
_INDEX_LIST = "[" + ", ".join(f"'{k}'" for k in INDEX_KEYS) + "]"
PROFILES = f"""profiles AS (
  SELECT l_orderkey AS file,
    CASE WHEN l_suppkey % 4 = 0 THEN 'lmk_face_idx' WHEN l_suppkey % 4 = 1 THEN 'lmk_b_coords'
         ELSE {_INDEX_LIST}[l_linenumber % 7 + 1] END AS key,
    CASE WHEN l_suppkey % 4 = 1 THEN [68, CAST(l_quantity AS BIGINT) % 2 + 2]
         WHEN l_partkey % 5 = 0 THEN [1, 68] ELSE [CAST(l_quantity AS BIGINT) % 3 + 66] END AS shape,
    CASE WHEN l_returnflag = 'R' THEN 'float32' ELSE 'int64' END AS dtype
  FROM lineitem)"""


def _contract(source: str) -> str:
    return f"""ranked AS (
  SELECT *, CASE WHEN shape = [68] THEN list_position({_INDEX_LIST}, key) END AS prio FROM {source}),
checked AS (
  SELECT file, {_INDEX_LIST}[min(prio)] AS key, min_by(dtype, prio) AS dtype,
    coalesce(bool_or(key = 'lmk_face_idx' AND shape = [68]) AND bool_or(key = 'lmk_b_coords' AND shape = [68, 3]), false) AS bary_ok
  FROM ranked GROUP BY file),
verdicts AS (
  SELECT *, CASE WHEN key IS NOT NULL THEN 'indices' WHEN bary_ok THEN 'barycentric' ELSE 'missing' END AS status
  FROM checked)"""


OUTCOMES = """firsts AS (
  SELECT conv_id, turn, text FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
outcomes AS (
  SELECT conv_id, CASE
    WHEN conv_id % 13 = 0 THEN 'exists'
    WHEN conv_id % 17 = 0 THEN 'error'
    WHEN conv_id % 6 = 0 THEN 'ok'
    WHEN conv_id % 6 = 1 THEN 'bad_shape_single'
    WHEN conv_id % 6 = 2 THEN CASE WHEN conv_id % 5 > 0 THEN 'ok' ELSE 'bad_shape_multi' END
    WHEN conv_id % 6 = 3 THEN 'no_face'
    WHEN conv_id % 6 = 4 THEN 'bad_rank'
    WHEN length(text) % 2 = 0 THEN 'ok' ELSE 'bad_shape_single' END AS status
  FROM firsts)"""


def _resize_weights(name: str, src: int, dst: int) -> str:
    return f"""{name}_raw AS (
  SELECT d, s, greatest(0e0, 1 - abs(s + 0.5e0 - (d + 0.5e0) * {src}e0 / {dst}) / {max(src / dst, 1.0)!r}e0) AS w FROM range({dst}) a(d), range({src}) b(s)),
{name} AS (SELECT d, s, w / sum(w) OVER (PARTITION BY d) AS w FROM {name}_raw)"""


ORACLE: dict[str, str] = {
    "scan_files": r"""WITH named AS (
  SELECT regexp_extract(url, '^[^?#]*') AS path, CAST(length(html) AS BIGINT) AS length FROM pages),
files AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM named WHERE path LIKE '%.html')
SELECT left(name, length(name) - 5) AS stem, min(path) AS path, arg_min(length, (path, length)) AS length
FROM files WHERE left(name, 1) NOT IN ('_', '.') GROUP BY 1""",
    "listing_changes": """WITH pages AS (
  SELECT url AS path, max(length(html))::BIGINT AS length, max(page_id) AS m FROM pages WHERE url IS NOT NULL GROUP BY url),
old AS (SELECT * FROM pages WHERE m % 7 <> 3),
new AS (SELECT path, length + CASE WHEN m % 5 = 2 THEN 1 ELSE 0 END AS length FROM pages WHERE m % 11 <> 5)
SELECT coalesce(new.path, old.path) AS path, new.length,
  CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM new FULL JOIN old ON new.path = old.path WHERE old.path IS NULL OR new.path IS NULL OR new.length <> old.length""",
    "rgb": _with(EMB, """levels AS (
  SELECT sid, sid % 3 AS kind, [1, 3, 4][sid % 3 + 1] AS ch, CASE sid % 3 WHEN 1 THEN 66 ELSE 64 END AS n,
    list_transform(e, lambda x: ((CAST(floor(x * 1000) AS BIGINT) % 256) + 256) % 256) AS b FROM emb)""",
    """fine AS (SELECT sid, ch, n, b, unnest(range(3 * n // ch)) AS i FROM levels WHERE sid % 10 NOT IN (8, 9))""") + """
SELECT sid, CAST(NULL AS VARCHAR) AS reason, CAST(i AS INTEGER) AS i,
  CAST(b[(CASE ch WHEN 1 THEN i // 3 ELSE (i // 3) * ch + 2 - i % 3 END) % 64 + 1] AS INTEGER) AS level FROM fine
UNION ALL SELECT sid, CASE sid % 10 WHEN 9 THEN 'undecodable' ELSE '2 channels' END, NULL, NULL FROM levels WHERE sid % 10 IN (8, 9)""",
    "model_tables": _with(EMB, """size AS (SELECT count(*) AS n FROM emb)""",
    """corner AS (SELECT l AS lmk, k, (l * 5) % (n - 2) + k AS v,
    (CASE k WHEN 0 THEN l % 3 + 1 WHEN 1 THEN l % 4 + 1 ELSE l % 5 + 1 END) / CAST(l % 3 + l % 4 + l % 5 + 3 AS DOUBLE) AS b
  FROM size, range(70) a(l), range(3) d(k))""") + f"""
SELECT CAST(lmk AS INTEGER) AS lmk, CAST(k AS INTEGER) AS k, CAST(v AS INTEGER) AS v, {r6('b', 'b')},
  {", ".join(r6(f"e[{c + 1}] + list_sum(e[{4 + c}:{11 + c}]) + list_sum(e[{14 + c}:{17 + c}])", a) for c, a in enumerate("xyz"))},
  12 AS width FROM corner JOIN emb ON sid = v""",
    "landmark_ingest": _with(EMB) + f"""
SELECT sid, CAST(NULL AS VARCHAR) AS reason, CAST(q AS INTEGER) AS lmk, {r6('e[2 * q + 1]', 'x')}, {r6('e[2 * q + 2]', 'y')}
FROM emb, range(32) a(q) WHERE sid % 10 <> 0
UNION ALL SELECT sid, 'shape (64,)', NULL, NULL, NULL FROM emb WHERE sid % 10 = 0""",
    "resolve_embedding": _with(EMB, CATALOG) + f"""
SELECT sid AS file, CAST(l AS INTEGER) AS lmk, CAST((sid * 3 + l * 5) % 23 AS INTEGER) AS f,
  {", ".join(r6(f'abs(e[(3 * l + {k}) % 64 + 1])', f'b{k}') for k in range(3))}
FROM chosen, range(68) a(l) WHERE n = 68""",
    "embedding_rejects": _with(EMB, CATALOG) + """
SELECT sid AS file, convention, 'face index shape' AS reason FROM chosen WHERE n <> 68""",
    "land_corpus": """SELECT doc_id AS stem, 1::BIGINT AS copies, quality AS points
FROM documents LEFT JOIN labels USING (doc_id)""",
    "obj_lines": _with(EMB, VALS, MODEL, SHAPED, f"verts AS ({_xyz('shaped', 'sid, v')})") + """
SELECT sid, 0 AS section, CAST(v AS INTEGER) AS ord, printf('v %.6f %.6f %.6f', x, y, z) AS line FROM verts WHERE NOT (sid % 7 = 3 AND v = 0) UNION ALL
SELECT sid, 1, CAST(f + 1 AS INTEGER), printf('f %d %d %d', f + 1, f + 2, f + 3) FROM emb, range(23) a(f)""",
    **{name: _with(EVENT_TERMS, SETTINGS) + """
SELECT 'Loss/train_' || term || '_epoch_last_batch' AS tag, CAST(epoch + 1 AS BIGINT) AS step, arg_max(value, batch) AS value
FROM event_terms GROUP BY epoch, term
UNION ALL SELECT 'Hyperparameters/learning_rate_epoch', CAST(epoch + 1 AS BIGINT), lr
FROM settings WHERE epoch IN (SELECT epoch FROM event_terms)""" for name in ("metric_rows", "metric_log")},
    "pair": "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY 1",
    "orphans": """SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""",
    "pair_counts": """WITH d AS (SELECT DISTINCT doc_id FROM documents), l AS (SELECT DISTINCT doc_id FROM labels)
SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS paired,
  count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only,
  CASE WHEN count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) = 0 THEN 'no matching pairs' END AS warning
FROM d FULL JOIN l ON d.doc_id = l.doc_id""",
    "orphan_ids": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "pending": """SELECT doc_id, lang, n_chars FROM documents
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 0)""",
    "pending_ids": """SELECT doc_id, lang, n_chars FROM documents
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 0)""",
    "name_new": """SELECT doc_id, lang,
  printf('thumb_%05d', row_number() OVER (ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) - 1) AS stem FROM documents""",
    "name_rows": """SELECT doc_id, source, printf('thumb_%05d', row_number() OVER (ORDER BY doc_id) - 1) AS stem FROM documents""",
    "first_detection": """SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""",
    "classify": _with(OUTCOMES) + " SELECT conv_id, status FROM outcomes",
    "tally": _with(OUTCOMES) + """ SELECT count(*) FILTER (status IN ('exists', 'ok')) AS processed,
  count(*) FILTER (status NOT IN ('exists', 'ok')) AS skipped FROM outcomes""",
    "tally_by_status": _with(OUTCOMES) + " SELECT status, count(*) AS images FROM outcomes GROUP BY status",
    "prepare_images": _with(
        EMB, _resize_weights("down", 3, 8), _resize_weights("across", 8, 8),
        """px AS (SELECT sid, q // 24 AS r, (q % 24) // 3 AS k, q % 3 AS c,
  ((CAST(floor(e[q % 64 + 1] * 1000) AS BIGINT) % 256) + 256) % 256 AS level FROM emb, range(72) a(q))""",
        """resized AS (SELECT sid, c, down.d AS i, across.d AS j, sum(down.w * across.w * level) AS v
  FROM px JOIN down ON down.s = r AND down.w > 0 JOIN across ON across.s = k AND across.w > 0 GROUP BY ALL)""",
        """scaled AS (SELECT sid, CAST(c * 64 + i * 8 + j AS INTEGER) AS i,
  CAST((floor(v + 0.5) / 255 - [0.485e0, 0.456e0, 0.406e0][c + 1]) / [0.229e0, 0.224e0, 0.225e0][c + 1] AS FLOAT) AS value
  FROM resized)""",
    ) + f" SELECT sid, i, {r6('CAST(value AS DOUBLE)', 'value')} FROM scaled",
    "denormalize": _with(EMB, VALS) + f"""
SELECT sid, CAST(i AS INTEGER) AS i, {r6('least(greatest(x * [0.229e0, 0.224e0, 0.225e0][i % 3 + 1] + [0.485e0, 0.456e0, 0.406e0][i % 3 + 1], 0), 1)', 'value')}
FROM vals""",
    "rescale": f"SELECT event_id, {r6('hour(ts) * 1.75e0', 'x')}, {r6('value * 1.75e0', 'y')} FROM events",
    "batches": _with(BATCHED) + " SELECT sid, batch, slot FROM batched",
    "batches_repeated": """WITH numbered AS (
  SELECT conv_id, row_number() OVER (ORDER BY md5(CAST(conv_id AS VARCHAR) || '|42|0'), conv_id) - 1 AS n FROM conversations)
SELECT CAST(n // 190 AS BIGINT) AS batch, count(*) AS n, count(DISTINCT n % 190) AS slots, CAST(sum(conv_id) AS BIGINT) AS keys
FROM numbered GROUP BY 1""",
    "collate": _with(BATCHED) + """
SELECT batch, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(sid AS VARCHAR), ',' ORDER BY slot) AS sids,
  string_agg(CAST(label AS VARCHAR), ',' ORDER BY slot) AS labels
FROM batched JOIN embeddings ON vec_id = sid GROUP BY batch""",
    "head_of_last_batch": _with(BATCHED) + """
SELECT batch, slot, sid FROM batched WHERE slot < 4 AND batch = (SELECT max(batch) FROM batched)""",
    "split_vector": _with(EMB, VALS) + " UNION ALL ".join(
        (" " if not n else "") +
        f"SELECT sid, '{g}' AS grp, CAST(count(*) FILTER (i BETWEEN {o} AND {o + w - 1}) AS INTEGER) AS width,"
        f" {r6(f'coalesce(sum(x) FILTER (i BETWEEN {o} AND {o + w - 1}), 0)', 'total')} FROM vals GROUP BY sid"
        for n, (g, o, w) in enumerate(_GROUPS)
    ),
    "check_width": """SELECT vec_id AS sid, CASE WHEN vec_id % 10 = 0 THEN 60 ELSE 64 END AS width,
  CASE WHEN vec_id % 10 = 0 THEN 'bad' ELSE 'good' END AS verdict FROM embeddings""",
    **{name: _with(EMB, VALS) + f"""
SELECT sid, CAST(o AS INTEGER) AS o, {r6('sum(x * ((o * 3 + i * 5) % 7 - 3) / 10e0) + o / 10e0', 'y')}
FROM vals, range(8) a(o) GROUP BY sid, o""" for name in ("score_head", "score_head_dense")},
    "neutralize": _with(EMB, VALS) + f"""
SELECT sid, CAST(i AS INTEGER) AS i, {r6(f"CASE WHEN i BETWEEN 40 AND 45 THEN {_TARGET} WHEN i BETWEEN 46 AND 48 OR i BETWEEN 58 AND 60 THEN 0 ELSE x END", 'value')}
FROM vals""",
    "shape_verts": _with(EMB, VALS, MODEL, SHAPED) + " " + _xyz("shaped", "sid, CAST(v AS INTEGER) AS v"),
    "expression_verts": _with(EMB, VALS, MODEL, """ebasis AS (
  SELECT v, c, s + 30 AS s, ((v * 3 + c * 5 + s * 2) % 13 - 6) / 100e0 AS b FROM range(25) a(v), range(3) b(c), range(10) d(s)),
both_bases AS (SELECT * FROM sbasis WHERE s < 30 UNION ALL SELECT * FROM ebasis)""",
        SHAPED.replace("sbasis", "both_bases")) + " " + _xyz("shaped", "sid, CAST(v AS INTEGER) AS v"),
    "rest_joints": _with(EMB, VALS, MODEL, SHAPED, JOINTS) + " " + _xyz("rest", "sid, CAST(j AS INTEGER) AS j"),
    "rot6d": _with(EMB, ROT6) + " " + _long("rot6", "sid", "r", 9),
    "pose_dispatch": _with(
        EMB, ROT6, "three AS (SELECT sid, e[41] AS r1, e[42] AS r2, e[43] AS r3 FROM emb WHERE sid % 3 = 1)",
        _axis_angle("rot3", "three", "sid"),
        """picked AS (
  SELECT sid, CAST(NULL AS VARCHAR) AS warn, r FROM rot6 WHERE sid % 3 = 0
  UNION ALL SELECT sid, 'axis-angle global pose', r FROM rot3
  UNION ALL SELECT sid, 'unexpected global pose width, identity used', [1e0, 0, 0, 0, 1, 0, 0, 0, 1] FROM emb WHERE sid % 3 = 2)""",
    ) + " " + _long("picked", "sid, warn", "r", 9),
    "rodrigues": _with(
        EMB, "jaw AS (SELECT sid, e[47] AS r1, e[48] AS r2, e[49] AS r3 FROM emb)", _axis_angle("rot3", "jaw", "sid"),
    ) + " " + _long("rot3", "sid", "r", 9),
    "rotations": _with(EMB, ROTS) + " " + _long("rots", "sid, CAST(j AS INTEGER) AS j", "r", 9),
    **{name: _with(EMB, VALS, MODEL, SHAPED, JOINTS, ROTS, _chain(tree)) + f"""
SELECT sid, CAST(j AS INTEGER) AS j, {r6('g[4]', 'x')}, {r6('g[8]', 'y')}, {r6('g[12]', 'z')} FROM frames"""
       for name, tree in (("chain", (-1, 0, 1, 1, 1)), ("chain_star", (-1, 0, 0, 0, 0)))},
    "skin_transforms": _with(EMB, VALS, MODEL, SHAPED, JOINTS, ROTS, CHAIN, MOTIONS) + f"""
SELECT sid, CAST(j * 12 + q AS INTEGER) AS i, {r6('m[q + 1]', 'value')} FROM motions, range(12) a(q)""",
    "pose_offset": _with(EMB, MODEL, ROTS, POSE) + " " + _xyz("poff", "sid, CAST(v AS INTEGER) AS v"),
    "skin": _with(EMB, VALS, MODEL, SHAPED, JOINTS, ROTS, CHAIN, MOTIONS, _skin("shaped", "skinned")) + f"""
SELECT sid, CAST(v AS INTEGER) AS v, {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')} FROM skinned""",
    "translate": _with(EMB, VALS, MODEL, SHAPED, JOINTS, f"wide AS ({_wide('rest', 'sid, j')})") + f"""
SELECT sid, CAST(j AS INTEGER) AS j, {r6('x + e[59]', 'x')}, {r6('y + e[60]', 'y')}, {r6('z + e[61]', 'z')} FROM wide JOIN emb USING (sid)""",
    **{name: _with(*LANDMARKS) + f"""
SELECT sid, CAST(lmk AS INTEGER) AS lmk, {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')} FROM lmks"""
       for name in ("landmarks", "landmarks_native", "landmarks_of_vertices", "landmarks_of_long_vertices", "landmarks_dense")},
    "screen_points": _with(*SHOWN) + f"""
SELECT sid, CAST(lmk AS INTEGER) AS lmk, {r6('sx', 'sx')}, {r6('sy', 'sy')} FROM screen""",
    **{name: _with(*DECODED) + f"""
SELECT sid, CAST(v AS INTEGER) AS v, {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')} FROM verts"""
       for name in ("decode", "decode_dense")},
    "pixel_l1": _with(EMB, VALS) + f"""
SELECT a.label, {r6('avg(abs(a.x - b.x))', 'value')} FROM vals a JOIN vals b ON b.sid = (a.sid + 1) % (SELECT count(*) FROM emb) AND b.i = a.i GROUP BY a.label""",
    "landmark_mse": _with(*SHOWN) + f"""
SELECT label, sid, {r6('sum((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty)) / (2 * count(*))', 'value')}
FROM screen JOIN truth USING (sid, lmk) JOIN emb USING (sid) GROUP BY label, sid""",
    "landmark_mse_partial": _with(*SHOWN) + f"""
SELECT label, {r6("coalesce(sum((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty)) FILTER (label % 2 = 0) / (2 * count(*)), 0)", 'value')}
FROM screen JOIN truth USING (sid, lmk) JOIN emb USING (sid) GROUP BY label""",
    "landmark_mse_joined": _with(*SHOWN) + f"""
SELECT label, {r6('sum((sx - tx) * (sx - tx) + (sy - ty) * (sy - ty)) / (2 * count(*))', 'value')}
FROM screen JOIN truth USING (sid, lmk) JOIN emb USING (sid) GROUP BY label""",
    **{term: _with(EMB, VALS) + f" SELECT label, {r6(_term(term), 'value')} FROM vals GROUP BY label" for term in REGULARIZERS},
    "loss_gate": _with(
        EMB, VALS,
        f"terms AS ({_terms('vals', 'label', ['reg_shape', 'reg_transl', 'reg_global_pose'])}"
        " UNION ALL SELECT DISTINCT label, 'perceptual', 0e0 FROM emb)",
    ) + f" SELECT label, term, {r6('value', 'value')} FROM terms",
    "total_loss": _with(EMB, VALS, BATCHED, BVALS, f"terms AS ({_terms('bvals', 'batch', _ACTIVE)})") + f"""
SELECT batch, {r6(f"sum({_weight_case({k: v for k, v in _WEIGHTS.items() if k != 'reg_transl'})} * value)", 'value')}
FROM terms GROUP BY batch""",
    "term_table": _batch_losses(),
    "batch_losses": _batch_losses(),
    "image_losses": _image_losses(),
    "image_losses_native": _image_losses(),
    "batch_losses_native": _batch_losses(),
    "staged_losses": _with(*STAGED) + f" SELECT epoch, batch, term, {r6('value', 'value')} FROM staged",
    "epoch_metrics": _with(*STAGED) + f"""
SELECT 'Loss/train_' || term || '_epoch_last_batch' AS tag, CAST(epoch + 1 AS BIGINT) AS step, {r6('arg_max(value, batch)', 'value')}
FROM staged GROUP BY epoch, term
UNION ALL SELECT 'Hyperparameters/learning_rate_epoch', CAST(epoch + 1 AS BIGINT), {r6('lr')} FROM settings
WHERE epoch IN (SELECT epoch FROM staged)""",
    "with_settings": _with(EVENT_TERMS, SETTINGS) + """
SELECT batch AS event_id, e.epoch, stage, name, CAST(stage_epoch AS INTEGER) AS stage_epoch, lr,
  verbose_mark, progress_mark, weights['landmark'] AS landmark_weight
FROM event_terms e LEFT JOIN settings s ON s.epoch = e.epoch""",
    "last_batch": _with(EVENT_TERMS) + f"""
SELECT epoch, term, max(batch) AS last_batch, {r6('arg_max(value, batch)', 'last_value')}, {r6('avg(value)', 'mean_value')}
FROM event_terms GROUP BY epoch, term""",
    "merged_stats": _stats("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag"),
    "axis_stats": _stats("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag"),
    "full_vertex_stats": _with(EMB, """wide AS (SELECT sid, (e || e)[1:100] AS e FROM emb),
cells AS (
  SELECT v, c, ((v * 7 + c * 3) % 11 - 5) / 50e0 AS t,
    list_transform(range(100), lambda s: ((v * 5 + c * 2 + s * 3) % 13 - 6) / 100e0) AS b FROM range(5023) f(v), range(3) g(c)),
moved AS (SELECT sid, c, t + list_dot_product(e, b) AS p FROM wide, cells)""") + f"""
SELECT sid, CASE c WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS axis, {r6('avg(p)', 'mean')}, {r6('stddev_samp(p)', 'std')},
  {r6('min(p)', 'min')}, {r6('max(p)', 'max')}, count(p) AS n FROM moved GROUP BY sid, c""",
    "vertex_stats": _with(*DECODED) + " " + _stats("verts", ["x", "y", "z"], "sid"),
    "group_stats": _with(EMB, VALS) + f"""
SELECT grp, 'present' AS state, {r6('avg(x)', 'mean')}, {r6('stddev_samp(x)', 'std')}, {r6('min(x)', 'min')}, {r6('max(x)', 'max')}, count(*) AS n
FROM (SELECT {GROUP_CASE} AS grp, x FROM vals) GROUP BY grp
UNION ALL SELECT 'expression', 'empty', NULL, NULL, NULL, NULL, 0
UNION ALL SELECT 'texture', 'absent', NULL, NULL, NULL, NULL, 0""",
    "non_finite": """SELECT l_returnflag, 'l_extendedprice' AS col, 0 AS bad, count(*) AS rows FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, 'per_discount', count(*) FILTER (l_discount = 0), count(*) FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, 'per_tax', count(*) FILTER (l_tax = 0), count(*) FROM lineitem GROUP BY ALL""",
    "grid": """SELECT CAST(floor(least(greatest(hour(ts) / 24e0, 0), 1) * 39) AS INTEGER) AS gx,
  CAST(floor(least(greatest(value / 500e0, 0), 1) * 19) AS INTEGER) AS gy, count(*) AS points FROM events GROUP BY ALL""",
    "preview": _with(EMB, VALS) + f" SELECT sid, CAST(i AS INTEGER) AS i, {r6('x', 'value')} FROM vals WHERE i < 5",
    "profile": _with(EMB, VALS, "firsts AS (SELECT label, arg_min(e, sid) AS h FROM emb GROUP BY label)") + f"""
SELECT label, count(DISTINCT sid) AS rows, max(i) + 1 AS width, 'float' AS dtype, {r6('min(x)', 'min')}, {r6('avg(x)', 'mean')}, {r6('max(x)', 'max')},
  {", ".join(r6(f'any_value(h[{i + 1}])', f'h{i}') for i in range(5))}
FROM vals JOIN firsts USING (label) GROUP BY label""",
    "contract": _with(PROFILES, _contract("profiles")) + " SELECT file, key, bary_ok, status FROM verdicts",
    "contract_types": _with(
        PROFILES, "one AS (SELECT file, key, max(shape) AS shape, max(dtype) AS dtype FROM profiles GROUP BY file, key)",
        _contract("one"),
    ) + " SELECT status, dtype = 'int64' AS is_integer, count(*) AS files FROM verdicts GROUP BY ALL",
    "contract_failures": _with(PROFILES, _contract("profiles")) + """
SELECT file, count(*) AS arrays FROM profiles WHERE file IN (SELECT file FROM verdicts WHERE status = 'missing') GROUP BY file""",
    "reconcile": _with(*LANDMARKS, """marks AS (
  SELECT CASE WHEN sid % 50 = 7 AND lmk = 0 THEN 'recomputed_only' WHEN sid % 20 = 3 AND lmk = 5 THEN 'mismatch'
    ELSE 'match' END AS status FROM lmks)""") + """
SELECT status, count(*) AS rows, CASE status WHEN 'recomputed_only' THEN NULL WHEN 'mismatch' THEN 0.25e0 * count(*) ELSE 0e0 END AS diff
FROM marks GROUP BY status""",
    "reconcile_digests": """WITH a AS (SELECT o_orderkey AS o, o_totalprice AS p FROM orders),
b AS (
  SELECT o, p + CASE WHEN o % 400 = 3 THEN 0.25 ELSE 0 END AS p FROM a WHERE o % 500 <> 7
  UNION ALL SELECT -o, p FROM a WHERE o % 600 = 1),
c AS (
  SELECT CASE WHEN b.o IS NULL THEN 'stored_only' WHEN a.o IS NULL THEN 'recomputed_only' WHEN abs(a.p - b.p) > 1e-9 THEN 'mismatch' ELSE 'match' END
    AS status, abs(a.p - b.p)::DOUBLE AS d FROM a FULL JOIN b ON a.o = b.o)
SELECT status, count(*) AS rows, round(sum(d), 6) AS diff FROM c GROUP BY status""",
    "presence": """SELECT p.p_partkey IS NOT NULL AS has_part, s.s_suppkey IS NOT NULL AS has_supplier, count(*) AS n
FROM lineitem LEFT JOIN part p ON p.p_partkey = l_partkey + l_linenumber - 4 LEFT JOIN supplier s ON s.s_suppkey = l_suppkey - l_linenumber + 3
GROUP BY 1, 2""",
    "dangling": """SELECT l_orderkey, l_linenumber, l_partkey + l_linenumber - 4 AS ref FROM lineitem
WHERE l_partkey + l_linenumber - 4 < 0 OR l_partkey + l_linenumber - 4 NOT IN (SELECT p_partkey FROM part)""",
}
