"""Command line: ``python -m tablediff run ...`` compares a run's datasets; ``python -m tablediff history ...`` lists runs.

Meant for ``spark-submit``: the session comes from the submit configuration (``getOrCreate``); only the settings the
comparison semantics rely on are applied to it.

    python -m tablediff run --config run.json --candidate-root s3a://stg --baseline-root s3a://prod --results-root s3a://res
    python -m tablediff history --results-root s3a://res --pipeline orders --from 2026-09-01T00:00:00Z --limit 20

``run.json`` is ``{"pipeline": ..., "range": {"from": ..., "to": ...}, "datasets": [{"name": ..., "candidate":
{"path": ...}, "baseline": {"path": ...}, "key_columns": [...], ...}]}``, for tables in databases also ``"connections":
{"candidate": {"url": ..., "user": ..., "password_env": ...}, "baseline": {...}}``; unknown fields are rejected. The exit code of
``run`` is 0 for PASS or SKIPPED, 1 for FAIL, 2 for ERROR and 3 for a refused configuration.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

EXIT = {"PASS": 0, "SKIPPED": 0, "FAIL": 1, "ERROR": 2}
REFUSED = 3


def _session() -> SparkSession:
    from .session import prepare

    return prepare(SparkSession.builder.appName("tablediff").getOrCreate())


def _summary(record: dict) -> dict:
    out = {k: record[k] for k in ("run_id", "pipeline", "status", "verdict", "unverified_datasets")}
    out["datasets"] = [
        {k: d.get(k) for k in ("name", "verdict", "reason", "schema_differences", "mismatches_path")}
        | {"row_diff": {k: v for k, v in (d.get("row_diff") or {}).items() if k not in ("duplicate_keys",)}}
        for d in record["datasets"]
    ]
    return out


def _connection(described: dict):
    """A database connection from the run description; ``password_env`` names the variable that holds the password."""
    from .sources.jdbc import JdbcConnection

    fields = dict(described)
    variable = fields.pop("password_env", None)
    if variable is not None:
        fields["password"] = os.environ[variable]
    return JdbcConnection(**fields)


def run(args, spark: SparkSession | None = None) -> int:
    from .plans.compare import compare_all
    from .spec import Environment, Environments, run_from_dict

    with open(args.config) as f:
        try:
            described = json.load(f)
            links = {side: _connection(c) for side, c in described.pop("connections", {}).items()}
            if set(links) - {"candidate", "baseline"}:
                raise ValueError(f"unknown side(s) in connections: {', '.join(sorted(links))}")
            pipeline, specs, rng = run_from_dict(described)
        except (ValueError, TypeError, KeyError) as e:
            print(json.dumps({"refused": [str(e)]}))
            return REFUSED
    spark = spark or _session()
    envs = Environments(
        Environment(root=args.candidate_root, jdbc=links.get("candidate")),
        Environment(root=args.baseline_root, jdbc=links.get("baseline")),
    )
    try:
        record = compare_all(spark, pipeline, specs, rng=rng, sample_size=args.sample_size, envs=envs, results_root=args.results_root,
                             time_limit_seconds=args.time_limit)
    except ValueError as e:
        print(json.dumps({"refused": str(e)}))
        return REFUSED
    print(json.dumps(_summary(record), default=str))
    return EXIT[record["verdict"]]


def history(args, spark: SparkSession | None = None) -> int:
    from .plans.history import history as history_of
    from .sources.records import read_run_records

    spark = spark or _session()
    records = read_run_records(spark, args.results_root, args.pipeline)
    rows = history_of(records, args.pipeline, args.lo, args.hi, args.limit, as_of=args.as_of, stale_after_seconds=args.stale_after).collect()
    for r in rows:
        print(json.dumps({k: r[k] for k in ("run_id", "status", "started_at", "finished_at", "verdict", "reason")}))
    return 0


def show(args, spark: SparkSession | None = None) -> int:
    from .plans.history import run_record

    record = run_record(spark or _session(), args.results_root, args.pipeline, args.run_id, args.as_of, args.stale_after)
    print(json.dumps(record, default=str))
    return 0 if record is not None else REFUSED


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tablediff")
    sub = parser.add_subparsers(dest="command", required=True)
    p_run = sub.add_parser("run", help="compare the datasets of one run")
    p_run.add_argument("--config", required=True)
    p_run.add_argument("--candidate-root", default=None)
    p_run.add_argument("--baseline-root", default=None)
    p_run.add_argument("--results-root", default=None)
    p_run.add_argument("--sample-size", type=int, default=100)
    p_run.add_argument("--time-limit", type=float, default=None, help="seconds that one dataset may take; beyond them it is ERROR")
    p_hist = sub.add_parser("history", help="list a pipeline's runs, most recent first")
    p_hist.add_argument("--results-root", required=True)
    p_hist.add_argument("--pipeline", required=True)
    p_hist.add_argument("--from", dest="lo", default=None)
    p_hist.add_argument("--to", dest="hi", default=None)
    p_hist.add_argument("--limit", type=int, default=50)
    p_hist.add_argument("--as-of", default=None, help="re-label runs whose heartbeat stopped, as of this instant")
    p_hist.add_argument("--stale-after", type=float, default=None, help="seconds without heartbeat before a run is abandoned")
    p_show = sub.add_parser("show", help="one run's record, as of an instant")
    p_show.add_argument("--results-root", required=True)
    p_show.add_argument("--pipeline", required=True)
    p_show.add_argument("--run-id", required=True)
    p_show.add_argument("--as-of", required=True)
    p_show.add_argument("--stale-after", type=float, default=300.0)
    args = parser.parse_args(argv)
    return {"run": run, "history": history, "show": show}[args.command](args, spark)


if __name__ == "__main__":
    sys.exit(main())
