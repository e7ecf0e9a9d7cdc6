"""Incremental forms: answering only what a cache lacks, and scoring or appending rows of a file stream once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(*columns: str):
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


def answered(requests: DataFrame, cache: DataFrame, respond: Callable[[DataFrame], DataFrame], key: str = "key", sampled: Column | None = None, seq: str | None = None) -> DataFrame:
    """Requests with responses: those in the cache as they are, the rest from ``respond``; the caller appends the new ones.

    Requests for which ``sampled`` holds want another answer each time and pass the cache by. ``seq`` gives the order of the
    result, if it is to have one.
    """
    fixed = requests if sampled is None else requests.where(~F.coalesce(sampled, F.lit(False)))
    known = fixed.join(cache.select(key, "response"), key)
    asked = fixed.join(cache.select(key), key, "left_anti")
    if sampled is not None:
        asked = asked.unionByName(requests.where(sampled).select(*asked.columns))
    out = known.unionByName(respond(asked).select(*known.columns))
    return out.orderBy(seq) if seq else out


def answered_through(requests: DataFrame, path: str, respond: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
    """As ``answered``, with a cache that is a table at ``path``: new answers are appended to it before they are used.

    A run that breaks off leaves whole files only, so the next one asks for the rest.
    """
    spark = requests.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        cache = spark.read.schema(f"`{key}` string, response string").parquet(path)
        asked = requests.join(cache.select(key), key, "left_anti")
    else:
        asked = requests
    respond(asked.dropDuplicates([key])).select(key, "response").write.mode("append").parquet(path)
    return requests.join(spark.read.schema(f"`{key}` string, response string").parquet(path), key)


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, path: str, checkpoint: str, at: str | None = None, late: str = "1 day"):
    """Scores new rows once; finished files are not read again.

    With an event time ``at``, keys are remembered for ``late``, so the state stays bounded; without one the files are
    trusted to hold a key once, and nothing is remembered.
    """
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if at else stream
    return score(once).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_stream(stream: DataFrame, capture: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Captured rows of new files, appended batch by batch; rows with an ``error`` go to ``errors`` beside them.

    A batch that is repeated after a failure replaces its own folder.
    """
    def keep(batch: DataFrame, number: int) -> None:
        rows = capture(batch)
        rows.where("error is null").drop("error").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        rows.where("error is not null").write.mode("overwrite").parquet(f"{path}/errors/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extra beyond parity: counts and sums by event type in tumbling windows, for batch or stream."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
