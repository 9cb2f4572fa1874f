from meshframe.operators.params import COMPACT_LAYOUT
from meshframe.plans.inspection import inspect_model
from meshframe.plans.small_model import small_model


def test_neutral_model_report(spark):
    found = inspect_model(spark, small_model(spark), COMPACT_LAYOUT)
    assert {r.status for r in found["recomputed"].collect()} == {"match"} and found["recomputed"].count() == 68
    assert found["landmarks_without_face"].count() == 0 and found["faces_without_vertex"].count() == 0
    stats = {r.axis: r for r in found["vertex_stats"].collect()}
    assert stats["x"].n == 25 and stats["x"].min >= -0.1 - 1e-9 and stats["x"].max <= 0.1 + 1e-9
    first = found["mesh"].filter("section = 0 AND ord = 0").first().line
    assert first == "v -0.100000 -0.040000 0.020000"
    assert found["mesh"].count() == 25 + 23 and found["landmark_mesh"].count() == 68
