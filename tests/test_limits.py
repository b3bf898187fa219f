"""Heartbeats, time limits, and records that survive a crash at any step."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tablediff.__main__ import main
from tablediff.plans import compare as plan
from tablediff.plans import history as hist
from tablediff.plans.limits import TimeLimitExceeded, beating, time_limit
from tablediff.sources import records as rs
from tablediff.spec import ComparisonSpec, Location


def record(run_id="r1", status="RUNNING", **kw):
    at = "2026-09-01T10:00:00.000Z"
    return {
        "run_id": run_id, "pipeline": "p", "status": status, "started_at": at, "heartbeat_at": at, "finished_at": None,
        "verdict": None, "reason": None, "row_range": None, "datasets": [], "unverified_datasets": [], **kw,
    }


def frame_spec(name, cand, base):
    return ComparisonSpec(name=name, candidate=Location.of(cand), baseline=Location.of(base), kind="frame", key_columns=("id",), full_refresh=True)


def endless(spark):
    """A long time of work in many small tasks: a cancelled job's running tasks may go on to their own end."""
    return spark.range(0, 20_000 * 300_000, 1, 20_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("v"))


# --- records ---------------------------------------------------------------------------------------------------------


def test_versions_are_added_and_only_old_ones_go(spark, tmp_dir):
    for n in range(rs.KEPT_VERSIONS + 3):
        rs.write_run_record(spark, tmp_dir, record(reason=f"version {n}"))
    files = sorted(f for f in os.listdir(f"{tmp_dir}/p/r1") if f.endswith(".json"))
    assert files == [f"run-{n:08d}.json" for n in range(4, rs.KEPT_VERSIONS + 4)]
    assert rs.read_run_record(spark, tmp_dir, "p", "r1")["reason"] == f"version {rs.KEPT_VERSIONS + 2}"


def test_a_crash_after_any_byte_leaves_the_version_before(spark, tmp_dir):
    rs.write_run_record(spark, tmp_dir, record(reason="first", datasets=[{"name": "t", "verdict": "PASS"}]))
    rs.write_run_record(spark, tmp_dir, record(reason="second", datasets=[{"name": "t", "verdict": "FAIL"}]))
    newest = f"{tmp_dir}/p/r1/run-00000002.json"
    whole = open(newest, "rb").read()
    for n in (0, 1, 20, len(whole) // 2, whole.index(b'"datasets"'), whole.index(b"}]") + 2, len(whole) - 3):
        with open(newest, "wb") as f:
            f.write(whole[:n])
        for crc in os.listdir(f"{tmp_dir}/p/r1"):
            if crc.endswith(".crc"):
                os.replace(f"{tmp_dir}/p/r1/{crc}", f"{tmp_dir}/{crc}.old")
        got = rs.read_run_record(spark, tmp_dir, "p", "r1")
        assert got["reason"] == "first" and got["datasets"] == [{"name": "t", "verdict": "PASS"}], n
        assert [r["reason"] for r in rs.read_run_records(spark, tmp_dir, "p").collect()] == ["first"]
    with open(newest, "wb") as f:
        f.write(whole)
    assert rs.read_run_record(spark, tmp_dir, "p", "r1")["reason"] == "second"
    rs.write_run_record(spark, tmp_dir, record(reason="third"))
    assert rs.read_run_record(spark, tmp_dir, "p", "r1")["reason"] == "third"


def test_no_version_is_written_twice(spark, tmp_dir):
    rs.write_run_record(spark, tmp_dir, record())
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{tmp_dir}/p/r1/run-00000001.json")
    with pytest.raises(Exception, match="exist"):
        path.getFileSystem(conf).create(path, False)


def test_a_point_lookup_shows_an_abandoned_run(spark, tmp_dir, capsys):
    rs.write_run_record(spark, tmp_dir, record())
    at = dt.datetime(2026, 9, 1, 10, 10, tzinfo=dt.timezone.utc)
    gone = hist.run_record(spark, tmp_dir, "p", "r1", at, 60)
    assert (gone["status"], gone["verdict"]) == ("ABANDONED", "ERROR") and "10:00:00" in gone["reason"]
    assert hist.run_record(spark, tmp_dir, "p", "r1", at, 3600)["status"] == "RUNNING"
    assert hist.run_record(spark, tmp_dir, "p", "nope", at, 60) is None
    args = ["show", "--results-root", tmp_dir, "--pipeline", "p", "--run-id", "r1", "--as-of", "2026-09-01T10:10:00Z", "--stale-after", "60"]
    assert main(args, spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["status"] == "ABANDONED"


# --- heartbeat -------------------------------------------------------------------------------------------------------


def test_beats_go_on_until_the_block_ends():
    times = []

    def beat():
        times.append(time.monotonic())
        if len(times) == 2:
            raise OSError("store away")

    with beating(beat, 0.05):
        time.sleep(0.5)
    n = len(times)
    assert n >= 4
    time.sleep(0.2)
    assert len(times) == n
    with beating(beat, None):
        time.sleep(0.1)
    assert len(times) == n


def test_a_run_with_one_long_dataset_is_never_abandoned(spark, tmp_dir, monkeypatch):
    seen = []
    quick = plan.compare

    def slow(spark, spec, *args, **kw):
        for _ in range(8):
            time.sleep(0.5)
            now = dt.datetime.now(dt.timezone.utc)
            seen.append(hist.run_record(spark, tmp_dir, "p", "long", now, 2)["status"])
        return quick(spark, spec, *args, **kw)

    monkeypatch.setattr(plan, "compare", slow)
    frame = spark.range(5)
    done = plan.compare_all(spark, "p", [frame_spec("t", frame, frame)], results_root=tmp_dir, run_id="long", heartbeat_seconds=0.3)
    assert done["verdict"] == "PASS"
    assert set(seen) == {"RUNNING"}
    assert rs.read_run_record(spark, tmp_dir, "p", "long")["status"] == "COMPLETED"


# --- time limit ------------------------------------------------------------------------------------------------------


def test_a_dataset_over_its_limit_is_an_error_and_the_next_one_runs(spark):
    small = spark.range(10).withColumn("v", F.lit("x"))
    plan.compare(spark, frame_spec("warm", small, small))
    began = time.monotonic()
    done = plan.compare_all(
        spark, "p", [frame_spec("long", endless(spark), endless(spark)), frame_spec("next", small, small)], validate=False, time_limit_seconds=15
    )
    assert time.monotonic() - began < 60
    assert [(d["name"], d["verdict"]) for d in done["datasets"]] == [("long", "ERROR"), ("next", "PASS")]
    assert "TimeLimitExceeded" in done["datasets"][0]["reason"] and "15 seconds" in done["datasets"][0]["reason"]
    assert done["verdict"] == "ERROR"


def test_other_jobs_of_the_session_go_on(spark):
    with pytest.raises(TimeLimitExceeded):
        with time_limit(spark, 1):
            endless(spark).agg(F.max("v")).collect()
    assert spark.range(100).count() == 100
    assert not spark.sparkContext.getJobTags()


def test_work_that_ends_in_time_is_left_alone_and_other_errors_stay(spark):
    with time_limit(spark, 60):
        assert spark.range(7).count() == 7
    with pytest.raises(KeyError):
        with time_limit(spark, 60):
            raise KeyError("x")
    with pytest.raises(TimeLimitExceeded):
        with time_limit(spark, 0.1):
            time.sleep(0.4)
