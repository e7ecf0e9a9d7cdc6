"""Rows tried again with timers, and runs with a time limit."""

from __future__ import annotations

import time

from evalloom.plans import batches
from evalloom.streaming import retries


def attempts():
    """A function of its own, so that it travels by value: workers don't import tests."""

    def attempt(row: dict, n: int):
        if row["kind"] == "third" and n < 3:
            raise ValueError(f"try {n}")
        if row["kind"] in ("never", "slow"):
            raise RuntimeError("no")
        return {"id": row["id"], "n": n}

    return attempt


def test_rows_are_tried_again(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [(1, "good"), (2, "third"), (3, "never"), (1, "good")]
        spark.createDataFrame(rows, "id long, kind string").write.json(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, kind string").json(str(tmp_path / "in"))
        ended = retries.retried(stream, "id", attempts(), tries=4, limit=60, wait=0.2)
        run = ended.writeStream.format("memory").queryName("ended").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        began = time.time()
        while time.time() - began < 120 and spark.table("ended").count() < 3 and run.isActive:
            time.sleep(0.5)
        run.stop()
        got = {r.key: (r.status, r.tries, r.result) for r in spark.table("ended").collect()}
        assert got == {"1": ("done", 1, '{"id": 1, "n": 1}'), "2": ("done", 3, '{"id": 2, "n": 3}'), "3": ("failed", 4, None)}
        assert {(r.status, r.rows, r.tries) for r in retries.tally(spark.table("ended")).collect()} == {("done", 2, 4), ("failed", 1, 4)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_row_that_takes_too_long(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        spark.createDataFrame([(7, "slow")], "id long, kind string").write.json(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, kind string").json(str(tmp_path / "in"))
        ended = retries.retried(stream, "id", attempts(), tries=99, limit=0.5, wait=0.3)
        run = ended.writeStream.format("memory").queryName("late").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
        began = time.time()
        while time.time() - began < 60 and not spark.table("late").count() and run.isActive:
            time.sleep(0.3)
        run.stop()
        r = spark.table("late").first()
        assert (r.status, r.error) == ("late", "RuntimeError: no") and r.tries < 5
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_runs_have_a_limit_and_a_tally(spark):
    def slow():
        spark.range(200).repartition(50).rdd.map(lambda x: time.sleep(0.5)).count()

    runs = {"good": lambda: spark.range(10).count(), "bad": lambda: 1 / 0, "slow": slow, "after": lambda: None}
    out = {o.name: o for o in batches.run_all(spark, runs, limit=3)}
    assert {k: o.status for k, o in out.items()} == {"good": "done", "bad": "failed", "slow": "late", "after": "done"}
    assert out["good"].message == "10" and "ZeroDivisionError" in out["bad"].message and 3 <= out["slow"].seconds < 10
    # the late run's jobs are gone
    began = time.time()
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() - began < 20:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert {(r.status, r.runs) for r in batches.tally(spark, list(out.values())).collect()} == {("done", 2), ("failed", 1), ("late", 1)}
    assert [o.status for o in batches.run_all(spark, runs, dry=True)] == ["planned"] * 4
