"""Products with tables too large for a worker."""

import weakref

import numpy as np
import pyarrow as pa
import pytest

from meshframe.operators import blocks, geometry, params
from meshframe.operators.params import FULL_LAYOUT
from meshframe.plans import small_model as sm

def packed(spark, n, step):
    table = spark.range(n).selectExpr("CAST(id AS int) AS v", "CAST(id AS double) AS x")
    return blocks.packed_blocks(table, "v", step, lambda t: {"v": t.column("v").to_numpy(), "x": t.column("x").to_numpy()})


def test_a_worker_holds_one_block(spark):
    # Lives in the worker; its class travels with the function.
    class Held:
        def __init__(self, block, arrays):
            self.block, self.arrays = block, arrays
            self.alive = blocks.__dict__.setdefault("_alive", weakref.WeakSet())
            self.alive.add(self)

    def work(held, record):
        yield pa.RecordBatch.from_arrays([
            record.column(record.schema.get_field_index("id")), pa.array([held.block] * record.num_rows, pa.int32()),
            pa.array([float(held.arrays["x"].sum())] * record.num_rows), pa.array([len(held.alive)] * record.num_rows, pa.int64())],
            names=["id", "block", "total", "alive"])

    for n in (40, 400):
        rows = spark.range(300).selectExpr("id", "id % 3 AS block")
        got = blocks.map_blocks(rows, packed(spark, n, 10), n // 10, work, "id long, block int, total double, alive long", Held, parts=2).collect()
        assert sorted((r["id"], r["block"]) for r in got) == [(i, b) for i in range(300) for b in range(n // 10)]
        assert all(r["total"] == sum(range(10 * r["block"], 10 * r["block"] + 10)) for r in got)
        assert max(r["alive"] for r in got) == 1


def test_a_missing_block_fails(spark):
    with pytest.raises(Exception, match="is missing"):
        blocks.map_blocks(spark.range(5), packed(spark, 10, 10).where("block > 0"), 1, lambda held, record: iter([record]), "id long",
                          lambda block, m: m).collect()


def test_no_rows(spark):
    none = blocks.map_blocks(spark.range(0), packed(spark, 30, 10), 3, lambda held, record: iter([record]), "id long", lambda block, m: m)
    assert none.collect() == []


def test_a_model_of_real_size_in_blocks_of_a_megabyte(spark):
    model = sm.small_model(spark, n_shape=100, vertices=5023)
    rng = np.random.default_rng(1)
    rows = [(i % 4, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(6, FULL_LAYOUT.total)))]
    df = params.split_vector(spark.createDataFrame(rows + rows[:1], "sid long, coeffs array<double>"), "coeffs", FULL_LAYOUT)
    assert geometry._block_step(model, False, 1 << 20) * 10 < 5023

    def points(frame):
        found = ((r["sid"], np.array([tuple(p) for p in r["points"]])) for r in frame.collect())
        return sorted(found, key=lambda x: (x[0], x[1][0, 0]))

    for landmarks in (True, False):
        want = points(geometry.decode_dense(df, model, FULL_LAYOUT, landmarks=landmarks))
        got = points(geometry.decode_dense(df, model, FULL_LAYOUT, landmarks=landmarks, budget=1 << (14 if landmarks else 20)))
        assert len(got) == len(want) == 7
        for (a, x), (b, y) in zip(want, got):
            assert a == b and x.shape == y.shape and np.allclose(x, y, atol=1e-9)
    long = geometry.decode(df, model, FULL_LAYOUT, budget=1 << 20)[0]
    assert long.count() == 7 * 5023 and long.select("v").distinct().count() == 5023


def test_a_head_in_blocks(spark):
    rng = np.random.default_rng(2)
    w, b, x = rng.normal(size=(50, 7)), rng.normal(size=50), rng.normal(size=(20, 7))
    df = spark.createDataFrame([(i // 2, v.tolist()) for i, v in enumerate(x)], "sid long, f array<double>")
    got = params.score_head_dense(df, "f", w, b, budget=200, out="y").collect()
    assert len(got) == 20
    want = sorted((i // 2, tuple(np.round(x[i] @ w.T + b, 9))) for i in range(20))
    assert sorted((r["sid"], tuple(np.round(r["y"], 9))) for r in got) == want
