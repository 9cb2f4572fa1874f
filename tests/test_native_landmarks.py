"""Native landmarks: inner products once per sample and vertex, work dealt over the cores, rows as the dense form gives them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import geometry, params
from meshframe.operators.params import COMPACT_LAYOUT
from meshframe.plans import queries
from meshframe.plans import small_model as sm


def rows(spark, n=5):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=64) / 10]) for i in range(n)], "sid int, coeffs array<double>")
    return params.split_vector(df, "coeffs", COMPACT_LAYOUT)


def points(df, *cols):
    return {(r["sid"], r["lmk"]): tuple(r[c] for c in cols) for r in df.collect()}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_inner_products_lie_below_the_fan_out(spark):
    cut = rows(spark).withColumn("truth", sm.truth_points(F.col("sid"))).localCheckpoint()
    for truth in (None, "truth"):
        plan = optimized(geometry.decode_landmarks(cut, sm.small_model(spark), COMPACT_LAYOUT, truth=truth, dense=False))
        above, _, below = plan.partition("Generate posexplode(")
        assert "zip_with" not in above and "zip_with" in below
        # One product for all vertices, fifteen for the joints; none of them again in a filter or a lambda.
        assert below.count("aggregate(zip_with(") == 16


@pytest.mark.parametrize("name", ["image_losses_native", "batch_losses_native", "landmarks_native"])
def test_native_queries_deal_their_samples(spark, name):
    assert "RepartitionByExpression [sid" in optimized(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_truth_of_any_length(spark):
    model, cut = sm.small_model(spark), rows(spark, 4)
    made = sm.truth_points(F.col("sid"))
    truth = F.when(F.col("sid") == 0, F.slice(made, 1, 3)).when(F.col("sid") == 1, F.concat(made, F.slice(made, 1, 2))).when(F.col("sid") == 2, made)
    got = points(geometry.decode_landmarks(cut.withColumn("truth", truth), model, COMPACT_LAYOUT, truth="truth", dense=False), "x", "y", "z", "tx", "ty")
    want = points(geometry.decode_landmarks(cut, model, COMPACT_LAYOUT), "x", "y", "z")
    assert sorted(got, key=str) == sorted(
        [(0, l) for l in range(3)] + [(1, l) for l in range(70)] + [(2, l) for l in range(68)] + [(3, None)], key=str)
    for key, found in got.items():
        if key in want:
            assert np.allclose(found[:3], want[key], atol=1e-9) and None not in found[3:]
    assert got[1, 69][:3] == (None,) * 3 and got[1, 69][3] is not None and got[3, None][3:] == (None, None)


def test_a_model_beyond_the_broadcast_budget(spark, monkeypatch):
    model, cut = sm.small_model(spark), rows(spark)
    one_row = points(geometry.decode_landmarks(cut, model, COMPACT_LAYOUT, dense=False), "x", "y", "z")
    monkeypatch.setattr(geometry, "BROADCAST_BYTES", 0)
    fanned = points(geometry.decode_landmarks(cut, model, COMPACT_LAYOUT, dense=False), "x", "y", "z")
    assert len(one_row) == 5 * 68 and one_row.keys() == fanned.keys()
    assert all(np.allclose(one_row[k], fanned[k], atol=1e-12) for k in one_row)
