import pytest
from pyspark.sql import functions as F

from meshframe.operators import curation as c
from meshframe.operators.numbering import number_rows
from meshframe.plans.corpus import detection_outcomes


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "stem string")


def test_pair_and_orphans_cover_all_keys_once(spark):
    left, right = keys(spark, "b", "a", "a", "c", None), keys(spark, "c", "a", "d", "d")
    assert [r.stem for r in c.pair(left, right, "stem").collect()] == ["a", "c"]
    assert {(r.stem, r.side) for r in c.orphans(left, right, "stem").collect()} == {("b", "left"), ("d", "right")}
    counts = c.pair_counts(left, right, "stem").first()
    assert (counts.paired, counts.left_only, counts.right_only, counts.warning) == (2, 1, 1, None)


def test_empty_manifest_warns(spark):
    counts = c.pair_counts(keys(spark, "a"), keys(spark, "b"), "stem").first()
    assert counts.paired == 0 and counts.warning == "no matching pairs"
    assert c.pair(keys(spark), keys(spark, "b"), "stem").count() == 0


def test_pending_needs_both(spark):
    rest = c.pending(keys(spark, "a", "b", "c"), keys(spark, "a", "b"), keys(spark, "b"), "stem")
    assert {r.stem for r in rest.collect()} == {"a", "c"}


def test_names_keep_order_and_grow_past_five_digits(spark):
    df = spark.range(100_050).select((F.lit(200_000) - F.col("id")).alias("k"))
    named = c.name_rows(df, ["k"])
    got = {r.k: r.stem for r in named.filter("k IN (200000, 99951, 99952, 100000)").collect()}
    assert got[99951] == "thumb_00000" and got[99952] == "thumb_00001" and got[200000] == "thumb_100049"
    assert named.select("stem").distinct().count() == 100_050


def test_numbers_stay_dense_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    rows = number_rows(df, ["k"]).collect()
    assert sorted(r.n for r in rows) == list(range(3000))
    by_n = sorted(rows, key=lambda r: r.n)
    assert [r.k for r in by_n] == sorted(r.k for r in rows)
    assert number_rows(df.limit(0), ["k"]).count() == 0


def test_first_detection_keeps_images_without_one(spark):
    found = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", 2, "z")], "stem string, pos int, v string")
    assert {(r.stem, r.v) for r in c.first_detection(found, "stem", "pos").collect()} == {("a", "x"), ("b", "z")}
    kept = c.first_detection(found, "stem", "pos", keys(spark, "a", "c"))
    assert {(r.stem, r.v) for r in kept.collect()} == {("a", "x"), ("c", None)}


def test_classify_every_outcome_and_tally(spark):
    rows = [
        ([68, 2], True, None, "exists"), ([68, 2], False, None, "ok"), ([2, 68, 2], False, None, "ok"),
        (None, False, None, "no_face"), ([], False, None, "no_face"), ([0, 68, 2], False, None, "bad_shape_multi"),
        ([2, 68, 3], False, None, "bad_shape_multi"), ([67, 2], False, None, "bad_shape_single"),
        ([68], False, None, "bad_rank"), ([68, 2], False, "boom", "error"), ([68, 2], None, None, "ok"),
    ]
    df = spark.createDataFrame(rows, "shape array<int>, exists boolean, error string, want string")
    got = c.classify(df)
    assert got.filter("status <> want").count() == 0
    assert {r.status for r in got.collect()} == set(c.OUTCOMES)
    total = c.tally(got).first()
    assert (total.processed, total.skipped) == (4, 7)
    assert sum(r.images for r in c.tally_by_status(got).collect()) == len(rows)


def test_outcomes_cover_landed_and_undetected_images(spark):
    images = keys(spark, "a", "b", "c")
    shapes = spark.createDataFrame([("a", 0, [68, 2], None), ("b", 0, [68, 2], None)],
                                   "stem string, face_pos int, shape array<int>, error string")
    got = detection_outcomes(images, shapes, (keys(spark, "a"), keys(spark, "a")))
    assert {(r.stem, r.status) for r in got.collect()} == {("a", "exists"), ("b", "ok"), ("c", "no_face")}


@pytest.mark.parametrize("n", [1, 190, 401])
def test_batches_are_a_permutation(spark, n):
    df = spark.range(n).select(F.format_string("s%03d", "id").alias("stem"))
    rows = c.batches(df, "stem").collect()
    assert sorted(r.batch * 190 + r.slot for r in rows) == list(range(n))
    assert max(r.batch for r in rows) + 1 == -(-n // 190)


def test_batches_depend_on_seed_and_epoch_only(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("stem"), F.lit(1).alias("v"))
    order = lambda **k: [r.stem for r in sorted(c.batches(df, "stem", **k).collect(), key=lambda r: (r.batch, r.slot))]
    assert order() == order()
    assert order() != order(epoch=1) and order() != order(seed=1)


def test_repeated_keys_keep_every_row(spark):
    df = spark.range(500).select(F.lit("same").alias("stem"), "id")
    rows = c.batches(df, "stem", unique=False).collect()
    assert len({r.id for r in rows}) == 500 and sorted(r.batch * 190 + r.slot for r in rows) == list(range(500))


def test_collate_aligns_and_head_takes_last_batch(spark):
    df = c.batches(spark.range(10).select("id"), "id", size=4)
    grouped = {r.batch: r for r in c.collate(df.withColumn("twice", F.col("id") * 2), ["id", "twice"]).collect()}
    assert sorted(len(r.id) for r in grouped.values()) == [2, 4, 4]
    assert all(r.twice == [2 * i for i in r.id] for r in grouped.values())
    head = c.head_of_last_batch(df).collect()
    assert len(head) == 2 and {r.batch for r in head} == {2}
