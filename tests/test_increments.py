"""Naming, listing and statistics that go on from an earlier run, digests and bitmaps."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import curation, images, quality, reporting
from meshframe.sources import files


def test_names_go_on(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:03d}", i) for i in range(50)], "key string, v int")
    path = str(tmp_path / "names")
    first = curation.name_new(df.where("v < 20"), path, ["key"], "key").collect()
    assert [r["stem"] for r in sorted(first, key=lambda r: r["key"])] == [f"thumb_{i:05d}" for i in range(20)]
    again = curation.name_new(df.where("v < 35 AND v > 10"), path, ["key"], "key").collect()
    assert sorted((r["v"], r["stem"]) for r in again) == [(i, f"thumb_{i:05d}") for i in range(11, 35)]
    # Runs in the order of the keys equal one run.
    curation.name_new(df, path, ["key"], "key")
    one = curation.name_new(df, str(tmp_path / "one"), ["key"], "key")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, curation.name_new(df, path, ["key"], "key").collect()))
    assert curation.name_new(df.where("false"), str(tmp_path / "none"), ["key"], "key").collect() == []
    with pytest.raises(ValueError, match="repeats"):
        curation.name_new(df.union(df), path, ["key"], "key")


def test_listing_changes_of_a_folder(spark, tmp_path):
    folder, state = tmp_path / "f", str(tmp_path / "state")
    folder.mkdir()
    for name in ("a.npy", "b.npy", "_c.npy", ".d.npy", "e.txt"):
        (folder / name).write_bytes(b"xx")

    def refresh(hidden=False):
        found = files.refresh_listing(files.listed_files(spark, str(folder), ".npy", hidden), state).collect()
        return sorted((r["path"].rsplit("/", 1)[1], r["length"], r["change"]) for r in found)

    assert refresh() == [("a.npy", 2, "added"), ("b.npy", 2, "added")]
    assert refresh() == []
    (folder / "a.npy").write_bytes(b"xxx")
    (folder / "b.npy").unlink()
    assert refresh() == [("a.npy", 3, "changed"), ("b.npy", None, "deleted")]
    (folder / "b.npy").write_bytes(b"x")
    assert refresh() == [("b.npy", 1, "added")]
    hidden = files.listed_files(spark, str(folder), ".npy", hidden=True).collect()
    assert {r["path"].rsplit("/", 1)[1] for r in hidden} == {"a.npy", "b.npy", "_c.npy", ".d.npy"}


def test_merged_states_equal_statistics_from_scratch(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 3) if i % 10 else None, int(i // 100), float(x) + 1e6, None if i % 7 == 0 else float(y))
            for i, (x, y) in enumerate(rng.normal(size=(1000, 2)))]
    df = spark.createDataFrame(rows, "g int, day int, x double, y double")
    parts = [reporting.moment_states(df.where(F.col("day") == d), ["x", "y"], ["g"]) for d in range(10)]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    half = reporting.merge_states(parts[0].unionByName(parts[1]), ["g"]).unionByName(reporting.merge_states(states.subtract(parts[0]).subtract(parts[1]), ["g"]))
    want = {(r["g"], r["axis"]): r for r in reporting.axis_stats(df, ["x", "y"], ["g"]).collect()}
    for merged in (states, half):
        got = {(r["g"], r["axis"]): r for r in reporting.stats_of_states(reporting.merge_states(merged, ["g"]), ["g"]).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert got[k]["n"] == r["n"]
            for c in ("mean", "std", "min", "max"):
                assert got[k][c] == pytest.approx(r[c], rel=1e-9), (k, c)


def test_states_without_values_or_groups(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    state = reporting.merge_states(reporting.moment_states(df, ["x"]))
    row = reporting.stats_of_states(state).first()
    assert (row["n"], row["mean"], row["std"], row["min"]) == (0, None, None, None)
    one = reporting.stats_of_states(reporting.merge_states(reporting.moment_states(spark.createDataFrame([(5.0,)], "x double"), ["x"]))).first()
    assert (one["n"], one["mean"], one["std"]) == (1, 5.0, None)


def summary(df):
    return sorted((r["status"], r["rows"], r["diff"] and round(r["diff"], 9)) for r in df.collect())


def test_digests_agree_with_the_full_comparison(spark):
    rows = [(i, i % 7 + 0.5, float("nan") if i == 50 else float(i)) for i in range(400)]
    left = spark.createDataFrame(rows, "k long, a double, b double")
    right = left.where("k NOT IN (3, 4)").withColumn("a", F.expr("CASE WHEN k = 9 THEN a + 1 WHEN k = 10 THEN a + 1e-13 WHEN k = 11 THEN NULL ELSE a END"))
    right = right.union(spark.createDataFrame([(1000, 0.0, 0.0)], right.schema))
    full = quality.reconcile_summary(quality.reconcile(left, right, ["k"], ["a", "b"]))
    for buckets in (1, 64, 4096):
        got = {s: n for s, n, _ in summary(quality.reconcile_by_digest(left, right, ["k"], ["a", "b"], buckets=buckets))}
        assert got == {s: n for s, n, _ in summary(full)}


def test_equal_tables_are_compared_by_digest_only(spark):
    df = spark.range(10_000).selectExpr("id AS k", "id * 0.1D AS a")
    out = quality.reconcile_by_digest(df, df.orderBy(F.desc("k")), ["k"], ["a"], buckets=16)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert summary(out) == [("match", 10_000, 0.0)]
    digest = quality.bucket_digests(df, ["k"], ["a"], 1e-9, 16)
    assert digest.count() == 16
    none = df.where("false")
    assert summary(quality.reconcile_by_digest(none, none, ["k"], ["a"])) == []


def test_references_stay_where_they_are(spark):
    refs = spark.createDataFrame([(i,) for i in (-5, -1, 0, 1, 2, 32767, 32768, 32769, 70000, 10**12)] + [(None,)], "r long")
    target = spark.createDataFrame([(i,) for i in (-5, 0, 2, 2, 32768, 70000)] + [(None,)], "f long")
    out = quality.with_presence(refs, "r", target, "f")
    assert {r["r"] for r in out.where("present").collect()} == {0, 2, 32768, 70000}
    plan = out._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("BroadcastHashJoin"):plan.index("BroadcastExchange")]
    assert "Exchange" not in re.sub("BroadcastExchange", "", left)
    assert quality.with_presence(refs, "r", target.where("false"), "f").where("present").count() == 0


def test_beyond_the_budget_the_bitmaps_join(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 100)
    refs, target = spark.range(2000).selectExpr("id * 50 AS r"), spark.range(1000).selectExpr("id * 100 AS f")
    assert quality.with_presence(refs, "r", target, "f").where("present").count() == 1000


def test_image_hooks(spark):
    pixels = bytes(range(48))
    rows = [("a", 4, 4, pixels), ("b", 4, 4, pixels[::-1]), ("c", 2, 2, bytes(12)), ("d", 4, 4, bytes(48))]
    df = spark.createDataFrame(rows, "stem string, height int, width int, data binary")

    def flipped(batch):
        assert batch.ndim == 4
        return batch[:, ::-1].transpose(0, 3, 1, 2) / 255.0

    def one(image):
        return image[::-1].transpose(2, 0, 1) / 255.0

    by_batch, by_image = ({r["stem"]: (r["channels"], r["height"], r["width"], r["pixels"]) for r in images.prepare_images(df, **hook).collect()}
                          for hook in ({"batch_transform": flipped}, {"transform": one}))
    assert by_batch == by_image and by_batch["c"][:3] == (3, 2, 2)
    ready = images.prepare_images(df, size=(2, 2))
    doubled = images.transform_pixels(ready, lambda p: F.transform(p, lambda x: x * 2))
    want = {r["stem"]: [2 * x for x in r["pixels"]] for r in ready.collect()}
    assert {r["stem"]: r["pixels"] for r in doubled.collect()} == want
    with pytest.raises(Exception, match="pixels"):
        images.transform_pixels(ready, lambda p: F.slice(p, 1, 2)).collect()
    with pytest.raises(Exception, match="the hook gave"):
        images.prepare_images(df.coalesce(1), batch_transform=lambda b: b[:1].transpose(0, 3, 1, 2)).collect()
    with pytest.raises(ValueError):
        images.prepare_images(df, transform=one, batch_transform=flipped)
