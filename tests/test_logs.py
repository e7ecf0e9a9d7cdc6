"""The data sources of result files and logs: pruned listings, many files a task, order, and runs that break off."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from evalloom.sources import logs


@pytest.fixture
def tree(tmp_path):
    for r in range(3):
        for f in range(4):
            for m in range(5):
                p = tmp_path / "in" / f"r{r}" / f"fam{f}" / f"model{m}.jsonl"
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_text("".join(json.dumps({"r": r, "f": f, "m": m, "i": i}) + ("\r\n" if m else "\n") for i in range(m)))
    (tmp_path / "in" / "r0" / "fam0" / "__pycache__").mkdir()
    (tmp_path / "in" / "r0" / "fam0" / "__pycache__" / "x.jsonl").write_text("no\n")
    (tmp_path / "in" / "top.jsonl").write_text("at the top\nlast line without an end")
    (tmp_path / "in" / "r0" / "notes.txt").write_text("no")
    return str(tmp_path / "in")


def test_conditions_prune_the_listing(tree):
    def reader(*filters):
        r = logs.FileReader({"path": tree})
        left = list(r.pushFilters(list(filters)))
        return r, left, [p for part in r.partitions() for p in part.found]

    every, _, files = reader()
    assert len(files) == 61 and [f[0] for f in files] == sorted(f[0] for f in files)
    one, left, files = reader(EqualTo(("round",), "r1"), In(("family",), ("fam2", "fam3")), GreaterThan(("line",), 3))
    assert len(files) == 10 and [type(f) for f in left] == [GreaterThan]
    # the top's four entries, one round's four families, two families' five models
    assert one.listed == 4 + 4 + 10 and every.listed > 60
    none, _, files = reader(EqualTo(("round",), "r1"), EqualTo(("round",), "r2"))
    assert files == [] and none.listed == 4


def test_lines_of_result_files(spark, tree):
    x = logs.result_lines(spark, tree, ["r1"], ["fam2", "fam3"])
    got = {(r.round, r.family, r.model, r.line, r.value) for r in x.collect()}
    assert got == {("r1", f"fam{f}", f"model{m}", i, json.dumps({"r": 1, "f": f, "m": m, "i": i})) for f in (2, 3) for m in range(5) for i in range(m)}
    assert logs.result_lines(spark, tree).where("round is null").orderBy("line").select("value").collect()[1][0] == "last line without an end"
    assert logs.result_lines(spark, tree).rdd.getNumPartitions() == 1  # many small files a task
    assert logs.result_lines(spark, tree, task_bytes=1).rdd.getNumPartitions() == 61
    assert logs.result_lines(spark, tree + "/nothing").count() == 0


def test_plan_shows_what_was_pushed(spark, tree):
    plan = logs.result_lines(spark, tree, ["r1"])._jdf.queryExecution().executedPlan().toString()
    assert "round" in plan and "Filter (round" not in plan.replace("isnotnull(round#", "")


def test_log_keeps_its_order(spark, tmp_path):
    path = str(tmp_path / "log")
    samples = spark.range(5000).select((4999 - F.col("id")).alias("index"), F.concat(F.lit("s"), F.col("id")).alias("name")).repartition(7)
    summary = spark.createDataFrame([(0.5,)], "mean double")
    for _ in range(2):  # the second run replaces the first
        logs.write_log(summary, samples, path, parts=5)
        rows = [json.loads(r.value) for r in logs.read_log(spark, path).orderBy("seq").collect()]
        assert rows[0] == {"kind": "summary", "mean": 0.5} and [r["index"] for r in rows[1:]] == list(range(5000))
    parts = json.load(open(path + "/manifest.json"))["parts"]
    assert len(parts) > 1 and sum(p["lines"] for p in parts) == 5001
    # read in the manifest's order, the files are the log
    text = "".join(open(os.path.join(path, p["name"])).read() for p in parts)
    assert [json.loads(x).get("index", -1) for x in text.splitlines()] == list(range(-1, 5000))
    assert {"manifest.json", *(p["name"] for p in parts)} == {f for _, _, files in os.walk(path) for f in files}


def test_broken_run_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    summary = spark.createDataFrame([(0.5,)], "mean double")
    bad = spark.range(400).select(F.col("id").alias("index"), F.when(F.col("id") == 399, F.raise_error("broken")).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="broken"):
        logs.write_log(summary, bad, path, parts=3)
    seen = [f for _, _, files in os.walk(path) for f in files]
    assert seen == []
    # nor does it touch a log that was there
    good = spark.range(10).select(F.col("id").alias("index"), F.lit("x").alias("v"))
    logs.write_log(summary, good, path)
    with pytest.raises(Exception, match="broken"):
        logs.write_log(summary, bad, path, parts=3)
    assert logs.read_log(spark, path).count() == 11


def test_empty_log(spark, tmp_path):
    path = str(tmp_path / "log")
    none = spark.range(0).select(F.col("id").alias("index"))
    logs.write_log(spark.createDataFrame([(1,)], "n int"), none, path)
    assert [json.loads(r.value) for r in logs.read_log(spark, path).collect()] == [{"kind": "summary", "n": 1}]
