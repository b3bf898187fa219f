import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tablediff.plans import history as hist
from tablediff.plans import verdict as vd
from tablediff.plans.compare import compare, compare_all, run_verdict
from tablediff.sources import records as rs
from tablediff.spec import ComparisonSpec, Environment, Environments, Location, RowRange, run_from_dict, spec_from_dict


def write_parquet(spark, rows, ddl, path):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(path)


def test_run_verdict_fold():
    assert run_verdict(["PASS", "FAIL", "ERROR"]) == "FAIL"
    assert run_verdict(["PASS", "ERROR"]) == "ERROR"
    assert run_verdict(["SKIPPED", "SKIPPED"]) == "SKIPPED"
    assert run_verdict(["SKIPPED", "PASS"]) == "PASS"


def test_run_verdict_fold_as_dataframe(spark):
    v = spark.createDataFrame(
        [("a", "x", "PASS"), ("a", "y", "FAIL"), ("a", "z", "ERROR"), ("b", "x", "SKIPPED"), ("c", "x", "SKIPPED"), ("c", "y", "PASS")],
        "run_id string, dataset string, verdict string",
    )
    got = {r["run_id"]: r["verdict"] for r in vd.run_verdicts(v).collect()}
    assert got == {"a": "FAIL", "b": "SKIPPED", "c": "PASS"}


def test_multi_dataset_run_isolates_errors(spark, tmp_dir):
    ddl = "id bigint, name string"
    write_parquet(spark, [(1, "a")], ddl, f"{tmp_dir}/c/good")
    write_parquet(spark, [(1, "a")], ddl, f"{tmp_dir}/b/good")
    write_parquet(spark, [(1, "a")], ddl, f"{tmp_dir}/c/diff")
    write_parquet(spark, [(1, "b")], ddl, f"{tmp_dir}/b/diff")
    write_parquet(spark, [(1, "a")], ddl, f"{tmp_dir}/c/onlyc")
    write_parquet(spark, [(1, "a")], ddl, f"{tmp_dir}/c/x")
    specs = [
        ComparisonSpec("good", Location(path="good"), Location(path="good"), key_columns=("id",), full_refresh=True),
        ComparisonSpec("diff", Location(path="diff"), Location(path="diff"), key_columns=("id",), full_refresh=True),
        ComparisonSpec("onlyc", Location(path="onlyc"), Location(path="onlyc"), key_columns=("id",), full_refresh=True),
        ComparisonSpec("new", Location(path="x"), Location(path="x"), new_dataset=True),
    ]
    root = f"{tmp_dir}/results"
    envs = Environments(Environment(root=f"{tmp_dir}/c"), Environment(root=f"{tmp_dir}/b"))
    record = compare_all(spark, "orders-consolidation", specs, envs=envs, results_root=root, run_id="r1")
    verdicts = {d["name"]: d["verdict"] for d in record["datasets"]}
    assert verdicts == {"good": "PASS", "diff": "FAIL", "onlyc": "ERROR", "new": "SKIPPED"}
    assert "baseline" in [d for d in record["datasets"] if d["name"] == "onlyc"][0]["reason"]
    assert record["verdict"] == "FAIL"
    assert record["unverified_datasets"] == ["new"]
    diff = [d for d in record["datasets"] if d["name"] == "diff"][0]
    assert os.path.isdir(diff["mismatches_path"])
    sample = spark.read.parquet(diff["mismatches_path"]).collect()
    assert sample[0]["differing_columns"] == ["name"]
    stored = rs.read_run_records(spark, root, "orders-consolidation").collect()
    assert len(stored) == 1 and stored[0]["verdict"] == "FAIL"
    assert {d["name"]: d["verdict"] for d in stored[0]["datasets"]} == verdicts
    one = rs.read_run_record(spark, root, "orders-consolidation", "r1")
    assert one["run_id"] == "r1" and one["unverified_datasets"] == ["new"] and one["status"] == "COMPLETED"
    assert [c["name"] for c in record["config"]] == ["good", "diff", "onlyc", "new"]
    assert record["config"][0]["key_columns"] == ["id"]
    assert rs.read_run_record(spark, root, "orders-consolidation", "nope") is None


def test_run_with_invalid_specs_is_refused_before_comparing(spark, tmp_dir):
    import pytest

    write_parquet(spark, [(1, "a")], "id bigint, name string", f"{tmp_dir}/c/t")
    envs = Environments(Environment(root=f"{tmp_dir}/c"), Environment(root=f"{tmp_dir}/b"))
    typo = ComparisonSpec("t", Location(path="tt"), Location(path="tt"), key_columns=("id",), full_refresh=True)
    with pytest.raises(ValueError, match="neither side"):
        compare_all(spark, "p", [typo], envs=envs)
    bad_key = ComparisonSpec("t", Location(path="t"), Location(path="t"), key_columns=("nope",), full_refresh=True)
    with pytest.raises(ValueError, match="key column is not there"):
        compare_all(spark, "p", [bad_key], envs=envs)


def test_specs_from_plain_data_reject_unknown_fields():
    import pytest

    pipeline, specs, rng = run_from_dict(
        {
            "pipeline": "p",
            "range": {"from": "2026-09-01", "to": "2026-09-08"},
            "datasets": [{"name": "t", "candidate": {"path": "a"}, "baseline": {"path": "a"}, "key_columns": ["id"], "range_column": "d"}],
        }
    )
    assert pipeline == "p" and rng == RowRange("2026-09-01", "2026-09-08") and specs[0].key_columns == ("id",)
    with pytest.raises(ValueError, match="unknown"):
        spec_from_dict({"name": "t", "candidate": {"path": "a"}, "baseline": {"path": "a"}, "keyColumnz": ["id"]})
    with pytest.raises(ValueError, match="unknown"):
        run_from_dict({"pipeline": "p", "datasets": [], "callback": "http://x"})


def test_new_dataset_is_never_read(spark):
    spec = ComparisonSpec("n", Location(path="does/not/exist"), Location(path="does/not/exist"), new_dataset=True)
    assert compare(spark, spec).verdict == "SKIPPED"


def test_empty_versus_missing(spark, tmp_dir):
    write_parquet(spark, [], "id bigint, name string", f"{tmp_dir}/c/e")
    spec = ComparisonSpec("e", Location(path=f"{tmp_dir}/c/e"), Location(path=f"{tmp_dir}/b/e"), key_columns=("id",), full_refresh=True)
    r = compare(spark, spec)
    assert r.verdict == "ERROR" and "baseline" in r.reason


def test_new_dataset_found_nowhere_is_still_a_typo(spark, tmp_dir):
    import pytest

    envs = Environments(Environment(root=f"{tmp_dir}/c"), Environment(root=f"{tmp_dir}/b"))
    spec = ComparisonSpec("n", Location(path="n"), Location(path="n"), new_dataset=True)
    with pytest.raises(ValueError, match="neither side"):
        compare_all(spark, "p", [spec], envs=envs)


def test_nested_parquet_folders_read_recursively(spark, tmp_dir):
    ddl = "id bigint, name string"
    write_parquet(spark, [(1, "a")], ddl, f"{tmp_dir}/c/t/sub1")
    write_parquet(spark, [(2, "b")], ddl, f"{tmp_dir}/c/t/sub2")
    write_parquet(spark, [(1, "a"), (2, "b")], ddl, f"{tmp_dir}/b/t")
    spec = ComparisonSpec("t", Location(path=f"{tmp_dir}/c/t"), Location(path=f"{tmp_dir}/b/t"), key_columns=("id",), full_refresh=True)
    assert compare(spark, spec).verdict == "PASS"


def test_corrupt_file_is_error_not_pass(spark, tmp_dir):
    ddl = "id bigint, name string"
    write_parquet(spark, [(1, "a")], ddl, f"{tmp_dir}/c/t")
    write_parquet(spark, [(1, "a")], ddl, f"{tmp_dir}/b/t")
    with open(f"{tmp_dir}/c/t/broken.parquet", "w") as f:
        f.write("this is not parquet")
    spec = ComparisonSpec("t", Location(path=f"{tmp_dir}/c/t"), Location(path=f"{tmp_dir}/b/t"), key_columns=("id",), full_refresh=True)
    assert compare(spark, spec).verdict == "ERROR"


def _record(run_id, pipeline, status, started, heartbeat, verdict=None):
    return {
        "run_id": run_id, "pipeline": pipeline, "status": status, "started_at": started, "heartbeat_at": heartbeat,
        "finished_at": None, "verdict": verdict, "reason": None, "row_range": None,
        "datasets": [{"name": "t", "verdict": verdict}] if verdict else [], "unverified_datasets": [],
    }


def _store(spark, root):
    rs.write_run_record(spark, root, _record("r1", "orders", "COMPLETED", "2026-09-01T10:00:00.000Z", "2026-09-01T10:05:00.000Z", "PASS"))
    rs.write_run_record(spark, root, _record("r2", "orders", "COMPLETED", "2026-09-03T10:00:00.000Z", "2026-09-03T10:05:00.000Z", "FAIL"))
    rs.write_run_record(spark, root, _record("r3", "orders", "RUNNING", "2026-09-05T10:00:00.000Z", "2026-09-05T10:00:00.000Z"))
    rs.write_run_record(spark, root, _record("x1", "orders-2", "COMPLETED", "2026-09-02T10:00:00.000Z", "2026-09-02T10:00:00.000Z", "PASS"))
    os.makedirs(f"{root}/orders/bad1", exist_ok=True)
    with open(f"{root}/orders/bad1/run.json", "w") as f:
        f.write("{ this is not json\n")
    os.makedirs(f"{root}/orders/bad2", exist_ok=True)
    with open(f"{root}/orders/bad2/run.json", "w") as f:
        f.write('{"junk":true}\n')


def test_history_order_range_isolation_and_damage(spark, tmp_dir):
    root = f"{tmp_dir}/results"
    _store(spark, root)
    recs = rs.read_run_records(spark, root, "orders")
    ids = [r["run_id"] for r in hist.history(recs, "orders").collect()]
    assert ids == ["r3", "r2", "r1"]
    ids = [r["run_id"] for r in hist.history(recs, "orders", lo="2026-09-03T10:00:00Z", hi="2026-09-05T10:00:00Z").collect()]
    assert ids == ["r2"]
    assert [r["run_id"] for r in hist.history(recs, "orders", limit=1).collect()] == ["r3"]
    relabelled = hist.history(recs, "orders", as_of="2026-09-05T10:10:00Z", stale_after_seconds=6).collect()
    assert [(r["run_id"], r["status"], r["verdict"]) for r in relabelled][0] == ("r3", "ABANDONED", "ERROR")
    assert rs.read_run_records(spark, root, "nothing-here").count() == 0


def test_abandoned_relabelling(spark, tmp_dir):
    root = f"{tmp_dir}/results"
    _store(spark, root)
    recs = rs.read_run_records(spark, root)
    as_of = dt.datetime(2026, 9, 5, 10, 10, 0, tzinfo=dt.timezone.utc)
    short = {r["run_id"]: (r["status"], r["verdict"]) for r in hist.with_abandoned(recs, as_of, 6).collect()}
    assert short["r3"] == ("ABANDONED", "ERROR")
    assert short["r1"] == ("COMPLETED", "PASS")
    long = {r["run_id"]: r["status"] for r in hist.with_abandoned(recs, as_of, 3600).collect()}
    assert long["r3"] == "RUNNING"
    reason = [r["reason"] for r in hist.with_abandoned(recs, as_of, 6).collect() if r["run_id"] == "r3"][0]
    assert "2026-09-05T10:00:00.000Z" in reason
    running = hist.running_runs(recs).collect()
    assert [(r["pipeline"], r["run_id"]) for r in running] == [("orders", "r3")]


def test_dataset_rows_from_records(spark, tmp_dir):
    root = f"{tmp_dir}/results"
    _store(spark, root)
    recs = rs.read_run_records(spark, root, "orders")
    rows = sorted(tuple(r) for r in hist.dataset_verdict_rows(recs).collect())
    assert rows == [("r1", "t", "PASS"), ("r2", "t", "FAIL")]
    assert recs.where(F.col("run_id").startswith("bad")).count() == 0


def test_a_malformed_instant_hides_only_its_record(spark, tmp_dir):
    root = f"{tmp_dir}/damaged"
    write = rs.write_run_record
    write(spark, root, _record("r1", "p", "COMPLETED", "2026-09-01T10:00:00Z", "2026-09-01T10:00:00Z", "PASS"))
    write(spark, root, _record("r2", "p", "COMPLETED", "not a time", "2026-09-01T10:00:00Z", "PASS"))
    write(spark, root, _record("r3", "p", "RUNNING", "2026-09-01T11:00:00Z", "never"))
    rows = hist.history(rs.read_run_records(spark, root, "p"), "p", as_of="2026-09-01T11:00:01Z", stale_after_seconds=60).collect()
    assert [(r["run_id"], r["status"]) for r in rows] == [("r3", "ABANDONED"), ("r1", "COMPLETED")]


def test_a_run_that_breaks_off_is_stored_as_error(spark, tmp_dir, monkeypatch):
    from tablediff.plans import compare as plan

    def broken(*args, **kw):
        raise RuntimeError("lost")

    monkeypatch.setattr(plan, "compare", broken)
    root = f"{tmp_dir}/broken"
    frame = spark.range(1)
    spec = ComparisonSpec(name="t", candidate=Location.of(frame), baseline=Location.of(frame), kind="frame", key_columns=("id",), full_refresh=True)
    with pytest.raises(RuntimeError):
        plan.compare_all(spark, "p", [spec], results_root=root, run_id="r9")
    record = rs.read_run_record(spark, root, "p", "r9")
    assert (record["status"], record["verdict"]) == ("COMPLETED", "ERROR") and "lost" in record["reason"]
