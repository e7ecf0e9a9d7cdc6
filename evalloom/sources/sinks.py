"""Sinks: evaluation logs, standard records, prompt records, tables of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluation_log(summary: DataFrame, samples: DataFrame, path: str, seq: str = "index") -> None:
    """JSON lines: the summary first, then the samples in order of ``seq``; files sort by name in that order."""
    head = summary.select(F.lit(-1).cast("long").alias("o"), F.to_json(F.struct(F.lit("summary").alias("kind"), *summary.columns)).alias("value"))
    rest = samples.select(F.col(seq).cast("long").alias("o"), F.to_json(F.struct(F.lit("sample").alias("kind"), *samples.columns)).alias("value"))
    head.union(rest).sort("o").select("value").write.mode("overwrite").text(path)


def records(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """One JSON object a line, in one folder for each value of ``by``; mode ``ignore`` skips what is there."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).json(path)


def result_table(results: DataFrame) -> str:
    """Markdown of a small result table (task, metric, value, stderr); it is collected, so it must be a report."""
    rows = results.orderBy("task", "metric").select("task", "metric", F.format_string("%.4f", F.col("value")), F.when(F.col("stderr").isNull(), "N/A").otherwise(F.format_string("%.4f", F.col("stderr")))).collect()
    return "\n".join(["|Task|Metric|Value|Stderr|", "|---|---|---:|---:|", *("|" + "|".join(r) + "|" for r in rows)])


def summary(report: DataFrame) -> DataFrame:
    """One row: overall (with ``average_score``), and by_category, by_type, by_group as maps in report order."""
    bucket = F.struct("total_expected", "total_processed", F.col("num_invalid").alias("num_invalid_response"), "mean_score")
    rows = report.groupBy("grain").agg(F.array_sort(F.collect_list(F.struct("ord", "key", bucket.alias("bucket")))).alias("rows"))
    first = F.get("rows", F.lit(0))["bucket"]
    overall = F.struct(*[first[c].alias(c) for c in ("total_expected", "total_processed", "num_invalid_response")], first["mean_score"].alias("average_score"))
    maps = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["key"], r["bucket"])))
    of = lambda grain, value, name: F.first(F.when(F.col("grain") == grain, value), ignorenulls=True).alias(name)
    return rows.agg(of("overall", overall, "overall"), *[of(g, maps, f"by_{g}") for g in ("category", "type", "group")])


def evaluation_json(report: DataFrame, samples: DataFrame, path: str, source: str, override: str | None = None) -> None:
    """A folder with ``summary`` (one JSON object) and ``samples`` (JSON lines).

    The report is small and is put together by one aggregate; samples stay distributed.
    """
    head = summary(report).select(F.lit(source).alias("std_response_jsonl"), F.lit(override).cast("string").alias("coord_override"), F.struct("overall", "by_category", "by_type", "by_group").alias("summary"))
    head.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "true").json(f"{path}/summary")
    samples.write.mode("overwrite").json(f"{path}/samples")


def sample_log(df: DataFrame, path: str) -> None:
    """Samples appended below a folder for each task."""
    df.write.mode("append").partitionBy("task").json(path)


def json_array(df: DataFrame, path: str) -> None:
    """One file that holds one JSON array; for prompt files, which are read whole."""
    one = F.to_json(F.struct(*df.columns))
    df.select(one.alias("v")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("v"), ",\n"), F.lit("]"))).coalesce(1).write.mode("overwrite").text(path)


def mirrored_name(path: str, root: str, prefix: str = "", suffix: str = ".jsonl") -> str:
    """The output name of an input below ``root``: its folders, and its name with a prefix and another suffix."""
    import os

    where, name = os.path.split(os.path.relpath(path, root))
    return os.path.join(where, prefix + os.path.splitext(name)[0] + suffix)


def latest_runs(results: DataFrame) -> DataFrame:
    """The row of each model and task with the latest stamp; stamps compare as texts."""
    rest = [c for c in results.columns if c not in ("model", "task")]
    return results.groupBy("model", "task").agg(F.max_by(F.struct(*rest), F.col("stamp")).alias("r")).select("model", "task", "r.*")


def latex_table(results: DataFrame) -> str:
    """LaTeX of a small result table (task, metric, value, stderr); it is collected, so it must be a report."""
    rows = results.orderBy("task", "metric").select("task", "metric", F.format_string("%.4f", F.col("value")), F.when(F.col("stderr").isNull(), "N/A").otherwise(F.format_string("%.4f", F.col("stderr")))).collect()
    body = [" & ".join(str(v).replace("_", "\\_") for v in r) + " \\\\" for r in rows]
    return "\n".join(["\\begin{tabular}{llrr}", "Task & Metric & Value & Stderr \\\\", "\\hline", *body, "\\end{tabular}"])


def submission_path(folder: str, name: str) -> str:
    import os

    return os.path.join(folder, "submissions", name)


def request_cache(requests: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """Built requests, kept as a table: read where it is there, written first where it isn't or is to be renewed."""
    spark = requests.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        requests.write.mode("overwrite").parquet(path)
    return spark.read.schema(requests.schema).parquet(path)
