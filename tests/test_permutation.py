"""Batch order by a keyed permutation."""

import pytest
from pyspark.sql import functions as F

from meshframe.operators import curation as c
from meshframe.operators.permutation import Permutation, dense_count, permuted


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 190, 401, 1000, 99_991])
def test_every_place_once(n):
    p = Permutation(n, 42, 0)
    assert p.a * p.b >= n and p.a * p.b - n <= p.a
    assert sorted(p.of(i) for i in range(n)) == list(range(n))


def test_columns_and_numbers_agree(spark):
    for n in (1, 7, 401, 5000):
        p = Permutation(n, 3, 2)
        got = {r["id"]: r["x"] for r in permuted(spark.range(n), "id", p, "x").collect()}
        assert got == {i: p.of(i) for i in range(n)}


def test_seed_and_epoch_change_the_order():
    orders = {tuple(Permutation(300, s, e).of(i) for i in range(300)) for s in (1, 2) for e in (0, 1, 2)}
    assert len(orders) == 6
    # No order is near another or the identity: fixed places are about one.
    for order in orders:
        assert sum(i == x for i, x in enumerate(order)) < 12


def test_neighbours_are_spread():
    p = Permutation(100_000, 42, 0)
    gaps = [abs(p.of(i + 1) - p.of(i)) for i in range(2000)]
    assert 30_000 < sum(gaps) / len(gaps) < 37_000


def test_the_cut_does_not_depend_on_partitions(spark):
    cut = lambda parts: sorted(map(tuple, c.permuted_batches(spark.range(1000).repartition(parts), "id", size=30).collect()))
    rows = cut(1)
    assert rows == cut(7)
    assert sorted(b * 30 + s for _, b, s in rows) == list(range(1000))


def test_clashing_columns_and_empty_tables(spark):
    df = spark.range(10).select("id", F.lit("x").alias("batch"), F.lit("y").alias("slot"))
    out = c.permuted_batches(df, "id", size=4)
    assert out.columns == ["id", "batch", "slot"] and {r["batch"] for r in out.collect()} == {0, 1, 2}
    assert c.permuted_batches(spark.range(0), "id").collect() == []


def test_a_filter_on_the_place_stays_small(spark):
    df = c.permuted_batches(spark.range(1000), "id", size=10).where("slot < 2 AND batch > 3")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert df.count() == 96 * 2


@pytest.mark.parametrize("ids", [[0, 1, 1], [0, 2], [1, 2], [0, 1, None], [-1, 0, 1], [0, 0, 3, 3], [0, 1, 1, 3, 5, 5]])
def test_ids_that_are_not_dense_are_refused(spark, ids):
    with pytest.raises(ValueError, match="each once"):
        dense_count(spark.createDataFrame([(i,) for i in ids], "id long"), "id")
