import pytest

from tidemark.operators import registry


def test_runs_and_candidate(spark, tmp_path):
    path = str(tmp_path / "log")
    good = [("parse_fail_delta", 0.0), ("general_nll_ratio", 1.0), ("net_wins", 1.0), ("lenient_delta", 0.0)]
    rows = [(r, m, None, v) for r, d in (("a", 3.0), ("b", 3.5), ("c", 5.0), ("d", 1.0)) for m, v in [("delta", d), *good]]
    m = spark.createDataFrame(rows, "run string, measure string, subject string, value double")
    got = [registry.record_run(spark, path, r, f"2024-01-0{k}", m) for k, r in enumerate("abcd", 1)]
    assert [(x["passed"], x["promoted"], x["failed"]) for x in got] == [(True, True, ""), (True, False, ""), (True, True, ""), (False, False, "1")]
    assert registry.candidate(registry.read_log(spark, path)).first()["run"] == "c"
    for bad in (("d", "why", False), ("b", " ", True), ("z", "why", True)):
        with pytest.raises(ValueError):
            registry.promote(spark, path, bad[0], "2024-02-01", bad[1], bad[2])
    registry.promote(spark, path, "d", "2024-02-01", "by hand", force=True)
    log = registry.read_log(spark, path)
    assert registry.candidate(log).first()["run"] == "d" and log.count() == 5
    plan = spark.createDataFrame([(r, k) for k, r in enumerate(["x", "a", "b", "c"])], "run string, pos int")
    assert [r.run for r in registry.ranked(plan, log).orderBy("place").collect()] == ["c", "b", "a", "x"]


def test_grid():
    assert registry.grid({"a": [1, 2], "b": ["x", "y"]}) == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}, {"a": 2, "b": "y"}]
    with pytest.raises(ValueError):
        registry.grid({"a": [1, 1]})
