import json

import pytest
from pyspark.sql import functions as F

from tallyforge.cli import main
from tallyforge.operators import collection

DATA = "/root/testdata/sf0.001"


def out(capsys):
    return json.loads(capsys.readouterr().out)


def test_commands_of_a_collection(spark, tmp_path, capsys):
    t = lambda name: f"file://{tmp_path}/{name}"
    cells = spark.range(30).select(F.col("id").alias("task_id"), F.lit("s").alias("split"), F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("db_id"), F.lit("simple").alias("complexity"))
    cells.write.parquet(t("tasks"))
    cells.groupBy("split", "db_id", "complexity").agg(F.lit(5).alias("target")).write.parquet(t("cells"))
    spark.range(30).select(F.col("id").alias("task_id"), (F.col("id") % 3 != 0).alias("accepted")).write.parquet(t("results"))
    args = ["collect", t("tasks"), t("cells"), t("results"), t("base"), "--per-round", "4", "--config-hash", "c"]
    main([*args, "--rounds", "1"], spark)
    assert out(capsys) == {"stopped": "rounds", "rounds": 1, "attempts": 4, "accepted": out_of(spark, t("base"))}
    main(args, spark)
    assert (got := out(capsys))["stopped"] == "complete" and got["accepted"] == 10
    say = lambda a, **g: json.dumps({"action": a, "arguments": g})
    sql = "SELECT r_name FROM r"
    good = [say("describe_schema", tables=["r"]), say("execute_sql", sql=sql), say("submit_sql", sql=sql)]
    spark.createDataFrame([(i, "q", "d", sql, good if i else ["?"] * 3) for i in range(2)], "task_id long, question string, db_id string, gold_sql string, answers array<string>").write.parquet(t("agents"))
    for _ in range(2):  # the second time nothing is left to do
        main(["rollout", t("agents"), t("log"), "--config-hash", "c", "--table", f"r={DATA}/region.parquet"], spark)
        assert [(r["terminal_reason"], r["n"], r["reward"]) for r in out(capsys)] == [("loop", 1, -0.4), ("submitted", 1, 1.0)]
    with pytest.raises(collection.Refused):
        main(["rollout", t("agents"), t("log"), "--config-hash", "d"], spark)
    main(["compact", t("log")], spark)
    assert out(capsys) == {"segments": 2}
    episodes = next((tmp_path / "log").glob("*.jsonl"))
    main(["judge", f"file://{episodes}", "--out", t("blind.jsonl")], spark)
    assert out(capsys) == {"episodes": 2} and "reward" not in spark.read.json(t("blind.jsonl")).first().payload
    spark.createDataFrame([("run:1", ["run:1:00"]), ("run:0", ["run:1:00"])], "episode_id string, event_citations array<string>").write.parquet(t("scores"))
    main(["judge", f"file://{episodes}", "--scores", t("scores")], spark)
    assert out(capsys) == [{"episode_id": "run:0", "unknown": ["run:1:00"]}]
    (tmp_path / "audit.jsonl").write_text("".join(json.dumps({"task_id": k, "executable": True, "deterministic": k != "b", "result_too_large": False}) + "\n" for k in "abc"))
    (tmp_path / "dev.jsonl").write_text("".join(json.dumps({"task_id": k, "question": k}) + "\n" for k in "abcd"))
    main(["clean-dev", t("audit.jsonl"), t("dev.jsonl"), t("final.jsonl")], spark)
    assert out(capsys) == {"examples": 4, "kept": 2}
    for more in ([], ["--tree"]):
        main(["hash", t("dev.jsonl"), *more], spark)
        assert out(capsys)[0]["size"] == (tmp_path / "dev.jsonl").stat().st_size


def out_of(spark, base):
    return spark.read.parquet(f"{base}/log").where("accepted").count()


def test_commands(spark, tmp_path, capsys):
    t = lambda name: f"file://{tmp_path}/{name}"
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.select(F.col("doc_id").alias("task_id"), F.col("source").alias("db_id"), F.col("text").alias("question"), F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train").alias("split"), F.lit("simple").alias("complexity")).write.parquet(t("tasks"))
    main(["config"], spark)
    assert out(capsys)["problems"] == []
    main(["inventory", t("tasks")], spark)
    assert sum(r["n"] for r in out(capsys)) == docs.count()
    spark.createDataFrame([("a", "d", "SELECT r_name FROM r"), ("b", "d", "DROP TABLE r")], "task_id string, db_id string, sql string").write.parquet(t("examples"))
    main(["audit", t("examples"), t("audit"), "--table", f"r={DATA}/region.parquet", "--timeout", "60"], spark)
    assert {(r["status"], r["clean"]) for r in out(capsys)} == {("passed", 1), ("unsafe_sql", 0)}
    spark.read.parquet(t("tasks")).drop("split").write.parquet(t("pool"))
    main(["split", t("pool"), t("split")], spark)
    assert out(capsys)["shared"] == [{"name": "db_id", "shared": 0}]
    (tmp_path / "r.jsonl").write_text('{"task_id":"a","ex":1.0,"soft_f1":1.0,"error_type":null}\n{"task_id":"b","ex":0.0,"soft_f1":0.5,"error_type":"syntax"}\n')
    main(["score", t("r.jsonl")], spark)
    assert out(capsys)["ex"] == 0.5
    main(["report", t("r.jsonl")], spark)
    assert "| EX | 50.00% |" in capsys.readouterr().out
    main(["compare", f"base={t('r.jsonl')}", f"sft={t('r.jsonl')}"], spark)
    assert capsys.readouterr().out.count("50.00%") == 2
    docs.select(F.col("doc_id").alias("task_id"), F.lit("train").alias("split"), F.col("source").alias("db_id"), F.get(F.array(F.lit("simple"), F.lit("moderate"), F.lit("challenging")), (F.col("doc_id") % 3).cast("int")).alias("complexity")).write.parquet(t("cells"))
    main(["plan", t("cells"), '{"train": 40}'], spark)
    assert sum(out(capsys)["cells"].values()) == 40
    main(["sft", f"{DATA}/conversations.parquet", t("sft")], spark)
    assert spark.read.parquet(t("sft")).count() > 0
    spark.createDataFrame([(u, u * 4 + i, float(i % (1 + u % 2))) for u in range(6) for i in range(4)], "uid int, idx int, reward double").write.parquet(t("rolls"))
    main(["groups", t("rolls"), t("kept")], spark)
    assert spark.read.parquet(t("kept")).count() == 8
    answers = [json.dumps({"action": a, "arguments": g}) for a, g in (("describe_schema", {"tables": ["r"]}), ("execute_sql", {"sql": "SELECT r_name FROM r"}), ("submit_sql", {"sql": "SELECT r_name FROM r"}))]
    (tmp_path / "a.json").write_text(json.dumps(answers))
    main(["run", f"{tmp_path}/a.json", "SELECT r_name FROM r", "--table", f"r={DATA}/region.parquet"], spark)
    episode = capsys.readouterr().out
    assert json.loads(episode)["reward"] == 1.0
    (tmp_path / "e.json").write_text(episode)
    main(["replay", f"{tmp_path}/e.json", "SELECT r_name FROM r", "--table", f"r={DATA}/region.parquet"], spark)
    assert out(capsys)["exact"]
