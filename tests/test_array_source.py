"""The data source for array files."""

import numpy as np
import pytest

from meshframe.sources import array_source, files


@pytest.fixture
def folder(tmp_path, spark):
    array_source.register(spark)
    rng = np.random.default_rng(1)
    for i in range(9):
        np.save(tmp_path / f"a{i}.npy", rng.normal(size=(68, 2)).astype(np.float32))
    np.save(tmp_path / "byte.levels.npy", np.arange(24, dtype=np.uint8).reshape(2, 4, 3))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.arange(6.0).reshape(2, 3)))
    np.save(tmp_path / "empty.npy", np.zeros((0, 2)))
    np.save(tmp_path / "words.npy", np.array(["x"]))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "a0.npy").read_bytes()[:-8])
    (tmp_path / "junk.npy").write_bytes(b"no array")
    (tmp_path / "_hidden.npy").write_bytes(b"x")
    (tmp_path / "other.txt").write_bytes(b"x")
    return tmp_path


def test_rows_as_numpy_reads_them(spark, folder):
    for path in (str(folder), folder.as_uri()):
        rows = {r["stem"]: r for r in spark.read.format("array_files").load(path).collect()}
        assert len(rows) == 15
        for stem, r in rows.items():
            if stem in ("cut", "junk", "words"):
                assert r["values"] is None and r["reason"]
                continue
            want = np.load(folder / f"{stem}.npy")
            assert (r["shape"], r["dtype"], r["reason"]) == (list(want.shape), want.dtype.name, None)
            assert r["values"] == want.reshape(-1).astype(float).tolist() and r["length"] == (folder / f"{stem}.npy").stat().st_size


def test_as_the_decoding_function(spark, folder):
    points = {r["stem"]: r["points"] for r in files.read_landmarks(spark, str(folder)).where("reason IS NULL").collect()}
    found = spark.read.format("array_files").load(str(folder)).where("shape = array(68, 2)").collect()
    assert {r["stem"] for r in found} == set(points)
    for r in found:
        assert r["values"] == [v for p in points[r["stem"]] for v in (p["x"], p["y"])]


def test_a_listing_opens_no_file_and_a_profile_reads_headers(spark, folder):
    for i in range(3):
        (folder / f"a{i}.npy").chmod(0)
    reader = array_source.ArrayReader(["stem", "length"], {"path": str(folder)})
    listing = spark.read.format("array_files").schema("stem string, length long").load(str(folder))
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "values" not in plan and "shape" not in plan
    assert listing.count() == 15 and {r["stem"] for r in listing.collect()} >= {"a0", "junk"}
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert len(rows) == 15 and set(rows[0]) == {"stem", "length"}
    for i in range(3):
        (folder / f"a{i}.npy").chmod(0o644)
    # A header is right even where the values are cut off.
    profile = spark.read.format("array_files").schema("stem string, shape array<int>, dtype string").load(str(folder))
    shapes = {r["stem"]: r["shape"] for r in profile.collect()}
    assert shapes["cut"] == [68, 2] and shapes["byte.levels"] == [2, 4, 3] and shapes["junk"] is None


def test_partitions_by_size(spark, folder):
    reader = array_source.ArrayReader(list(array_source.COLUMNS), {"path": str(folder), "partition_bytes": str(3 << 20)})
    parts = reader.partitions()
    assert len(parts) == 6 and sorted(f for p in parts for f in p.files) == sorted(f for p in array_source.ArrayReader(
        ["values"], {"path": str(folder)}).partitions() for f in p.files)
    assert max(len(p.files) for p in parts) - min(len(p.files) for p in parts) <= 1
    many = spark.read.format("array_files").option("partition_bytes", str(3 << 20)).load(str(folder))
    assert many.rdd.getNumPartitions() == 6 and many.count() == 15


def test_unknown_columns_are_refused(spark, folder):
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("array_files").schema("stem string, pixels binary").load(str(folder)).collect()
    (folder / "none").mkdir()
    assert spark.read.format("array_files").load(str(folder / "none")).collect() == []
