"""Runs over many files or configurations: a time limit for each, a tally, and a dry run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 1800.0  # seconds of a run


@dataclass(frozen=True)
class Outcome:
    name: str
    status: str  # done, failed, late, planned
    seconds: float
    message: str


def run_all(spark: SparkSession, runs: dict[str, Callable[[], object]], limit: float = LIMIT, dry: bool = False) -> list[Outcome]:
    """Each run's outcome, in order; one that fails or takes too long doesn't end the others.

    The jobs of a run carry its tag, so those of a late one are cancelled wherever they are; ``dry`` only tells what would run.
    """
    out = []
    for name, run in runs.items():
        if dry:
            out.append(Outcome(name, "planned", 0.0, ""))
            continue
        tag, told, began = f"run-{uuid.uuid4().hex}", {}, time.monotonic()

        def work(run=run, tag=tag, told=told):
            spark.sparkContext.addJobTag(tag)
            try:
                told["result"] = run()
            except Exception as e:  # told in the outcome
                told["error"] = f"{type(e).__name__}: {e}"[:500]
            finally:
                spark.sparkContext.removeJobTag(tag)

        thread = InheritableThread(target=work, daemon=True)
        thread.start()
        thread.join(limit)
        took = round(time.monotonic() - began, 3)
        if thread.is_alive():
            spark.sparkContext.cancelJobsWithTag(tag)
            out.append(Outcome(name, "late", took, f"more than {limit:g} s"))
        elif "error" in told:
            out.append(Outcome(name, "failed", took, told["error"]))
        else:
            out.append(Outcome(name, "done", took, "" if told.get("result") is None else str(told["result"])))
    return out


def tally(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """status, runs, seconds."""
    x = spark.createDataFrame([(o.status, o.seconds) for o in outcomes], "status string, seconds double")
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.sum("seconds").alias("seconds"))
