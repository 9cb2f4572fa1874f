import numpy as np
import pyarrow as pa
import pytest

from meshframe.operators import params as p


def vectors(spark, *rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "sid bigint, coeffs array<double>")


def test_full_layout_offsets():
    layout = p.FULL_LAYOUT
    assert layout.total == 227
    assert [layout.offset(n) for n in layout.names] == [0, 100, 100, 106, 109, 115, 118, 121]
    with pytest.raises(ValueError):
        p.check_layout(layout, 226)


def test_split_and_join_are_inverse(spark):
    df = vectors(spark, range(227))
    cut = p.split_vector(df, "coeffs", p.FULL_LAYOUT)
    row = cut.first()
    assert row.expression == [] and row.global_pose == [100, 101, 102, 103, 104, 105] and len(row.detail) == 106
    assert p.join_groups(cut, p.FULL_LAYOUT, "coeffs").first().coeffs == [float(i) for i in range(227)]


def test_width_contract(spark):
    df = vectors(spark, range(64), range(63))
    good, bad = p.check_width(df, "coeffs", p.COMPACT_LAYOUT, "quarantine")
    assert [r.sid for r in good.collect()] == [0] and [r.sid for r in bad.collect()] == [1]
    assert p.check_width(good, "coeffs", p.COMPACT_LAYOUT).first().coeffs[63] == 63
    with pytest.raises(Exception, match="expected 64 coefficients, got 63"):
        p.check_width(df, "coeffs", p.COMPACT_LAYOUT).collect()


def test_neutral_values(spark):
    cut = p.split_vector(vectors(spark, range(64)), "coeffs", p.COMPACT_LAYOUT)
    row = p.neutralize(cut, p.COMPACT_LAYOUT.names, p.COMPACT_LAYOUT).first()
    assert row.shape == [0.0] * 40 and row.global_pose == [1, 0, 0, 0, 1, 0] and row.expression == []
    assert p.neutralize(cut, ["jaw_pose"], p.COMPACT_LAYOUT).first().shape[3] == 3
    assert [i for i, b in enumerate(p.neutral_bias(p.FULL_LAYOUT, 227)) if b] == [100, 104]
    assert not any(p.neutral_bias(p.FULL_LAYOUT, 105))


def test_head_native_and_dense_agree(spark):
    rng = np.random.default_rng(1)
    w, b, x = rng.normal(size=(5, 7)), rng.normal(size=5), rng.normal(size=(9, 7))
    df = vectors(spark, *x)
    head = spark.createDataFrame(pa.table({"o": pa.array(np.arange(5, dtype=np.int32)), "w": pa.array(w.tolist()), "b": pa.array(b)}))
    want = x @ w.T + b
    native = {(r.sid, r.o): r.y for r in p.score_head(df, "coeffs", head, 5, 7).collect()}
    assert all(abs(native[i, o] - want[i, o]) < 1e-12 for i in range(9) for o in range(5))
    dense = {r.sid: r.y for r in p.score_head_dense(df, "coeffs", w, b, out="y").collect()}
    assert np.allclose([dense[i] for i in range(9)], want, atol=1e-12)


def test_dense_head_refuses_wrong_width(spark):
    with pytest.raises(Exception, match="expected lists of 7 numbers"):
        p.score_head_dense(vectors(spark, range(6)), "coeffs", np.zeros((2, 7)), np.zeros(2)).collect()
