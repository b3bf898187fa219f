import json

from tablediff.__main__ import main


def test_run_and_history_from_the_command_line(spark, tmp_dir, capsys):
    ddl = "id bigint, name string"
    spark.createDataFrame([(1, "a"), (2, "b")], ddl).write.parquet(f"{tmp_dir}/stg/t")
    spark.createDataFrame([(1, "a"), (2, "c")], ddl).write.parquet(f"{tmp_dir}/prod/t")
    config = {
        "pipeline": "p",
        "datasets": [{"name": "t", "candidate": {"path": "t"}, "baseline": {"path": "t"}, "key_columns": ["id"], "full_refresh": True}],
    }
    with open(f"{tmp_dir}/run.json", "w") as f:
        json.dump(config, f)
    args = ["run", "--config", f"{tmp_dir}/run.json", "--candidate-root", f"{tmp_dir}/stg", "--baseline-root", f"{tmp_dir}/prod",
            "--results-root", f"{tmp_dir}/results"]
    assert main(args, spark) == 1
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["verdict"] == "FAIL" and out["datasets"][0]["row_diff"]["different"] == 1
    assert main(["history", "--results-root", f"{tmp_dir}/results", "--pipeline", "p"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert [(x["status"], x["verdict"]) for x in lines] == [("COMPLETED", "FAIL")]


def test_refused_configuration(spark, tmp_dir, capsys):
    with open(f"{tmp_dir}/run.json", "w") as f:
        json.dump({"pipeline": "p", "datasets": [], "callbackUrl": "http://x"}, f)
    assert main(["run", "--config", f"{tmp_dir}/run.json"], spark) == 3
    with open(f"{tmp_dir}/run2.json", "w") as f:
        json.dump({"pipeline": "p", "datasets": [{"name": "t", "candidate": {"path": "nope"}, "baseline": {"path": "nope"},
                                                 "key_columns": ["id"], "full_refresh": True}]}, f)
    assert main(["run", "--config", f"{tmp_dir}/run2.json", "--candidate-root", tmp_dir, "--baseline-root", tmp_dir], spark) == 3
    assert "neither side" in capsys.readouterr().out
