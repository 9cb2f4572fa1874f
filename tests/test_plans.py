"""Shape of the physical plans: what is read, joined and shuffled."""

import re

import pytest

from meshframe.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("names", [sorted(QUERIES)[i::4] for i in range(4)])
def test_no_cross_products(spark, names):
    for name in names:
        assert not re.search("CartesianProduct|NestedLoopJoin", plan_of(spark, name)), name


@pytest.mark.parametrize("name, columns", [
    ("pair", ["struct<doc_id:bigint>", "struct<doc_id:bigint>"]),
    ("last_batch", ["struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>"]),
    ("grid", ["struct<ts:timestamp_ntz,value:double>"]),
    ("dangling", ["struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>", "struct<p_partkey:bigint>"]),
    ("axis_stats", ["struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_returnflag:string>"]),
])
def test_scans_read_only_what_they_need(spark, name, columns):
    assert re.findall(r"ReadSchema: (struct<[^>]*>)", plan_of(spark, name)) == columns


def test_decoding_does_not_shuffle_samples(spark):
    for name in ("landmarks_dense", "screen_points", "decode_dense"):
        plan = plan_of(spark, name)
        # The only exchange is the one that spreads an input too small to split.
        assert len(re.findall(r"Exchange (?!RoundRobin)", plan)) == 0, name


def test_losses_take_one_shuffle_after_batching(spark):
    plan = plan_of(spark, "batch_losses")
    assert len(re.findall(r"Exchange hashpartitioning\(batch", plan)) == 1
    assert plan.count("MapInArrow") == 1


def test_colocated_skinning_moves_no_row(spark):
    plan = plan_of(spark, "skin")
    assert "SortMergeJoin" in plan and not re.findall(r"(?<!Broadcast)Exchange", plan)


def test_batches_neither_sort_nor_shuffle(spark):
    assert not re.findall(r"Exchange|Sort", plan_of(spark, "batches"))
