"""From sample metrics to result tables: per-task metrics, groups, reconciliation, tables for display and logging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, names
from .order import places

MEANS = ("acc", "acc_norm", "acc_mutual_info", "exact_match", "anls", "mean")
BOOTSTRAPPED = ("median", "mcc", "f1", "perplexity", "bleu", "chrf", "ter")
SLOW = ("bleu", "chrf", "ter")  # resampled 100 times at most


def stderr_rule(metric: str, iterations: int) -> tuple[str, int] | None:
    """How a metric's standard error is found: by formula, or by so many resamples; None where there is none."""
    if iterations <= 0:
        return None
    if metric in BOOTSTRAPPED:
        return "bootstrap", min(iterations, 100) if metric in SLOW else iterations
    return ("formula", 0) if metric in (*MEANS, "acc_all") else None


def task_metrics(samples: DataFrame) -> DataFrame:
    """task, metric, filter, size, value, stderr from sample values (task, metric, filter, value), by one shuffle.

    Perplexities are exponents of negated means, the rest means; a standard error is there for means of two values or more.
    """
    x, many = F.col("value"), F.count("value")
    value = F.when(F.col("metric") == "perplexity", metrics.perplexity(x)).otherwise(F.avg(x))
    error = F.when(F.col("metric").isin(*MEANS) & (many > 1), metrics.stderr(x))
    return samples.groupBy("task", "metric", "filter").agg(many.alias("size"), value.alias("value"), error.alias("stderr"))


def wide(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row a task: alias, samples, and a value and a standard error for each of ``keys`` (``metric,filter``)."""
    key = F.concat_ws(",", "metric", "filter")
    columns = []
    for k in keys:
        columns += [F.max(F.when(key == k, F.col("value"))).alias(k), F.max(F.when(key == k, F.col("stderr"))).alias(k.replace(",", "_stderr,", 1))]
    return results.groupBy("task").agg(F.first("alias").alias("alias"), F.max("size").alias("samples"), *columns)


def closure(edges: DataFrame, depth: int = 16) -> DataFrame:
    """(grp, task) of all leaves below each group, from direct (parent, child) pairs; a leaf is never a parent.

    Each round joins the frontier with the pairs once; catalogues are small and ``depth`` bounds their nesting.
    """
    parents = edges.select(F.col("parent").alias("p")).distinct()
    is_group = lambda df: df.join(F.broadcast(parents), df["child"] == F.col("p"), "left")
    front = is_group(edges.select(F.col("parent").alias("grp"), "child"))
    out = front.where("p is null").select("grp", F.col("child").alias("task"))
    for _ in range(depth):
        rest = front.where("p is not null").select("grp", F.col("child").alias("via"))
        if not rest.limit(1).count():
            break
        front = is_group(rest.join(F.broadcast(edges), F.col("via") == F.col("parent")).select("grp", "child"))
        out = out.union(front.where("p is null").select("grp", F.col("child").alias("task")))
    return out.distinct()


def groups(results: DataFrame, members: DataFrame, wanted: dict[str, list[str]], weighted: bool = True) -> DataFrame:
    """grp, metric, filter, size, value, stderr of groups, from task results and (grp, task).

    wanted: metric name -> filters; as names are looked for anywhere in ``metric,filter``, one name can want several. Without
    weights each task counts alike, while the standard error is pooled by size; it's missing if any task's is.
    """
    key = F.concat_ws(",", "metric", "filter")
    take = F.lit(False)
    for m, filters in wanted.items():
        take = take | (F.lit(bool(filters)) & key.contains(m))
    x = results.where(take).join(F.broadcast(members), "task")
    weight = F.col("size") if weighted else F.lit(1)
    error = F.when(~F.bool_or(F.col("stderr").isNull()), metrics.pooled_stderr(F.col("stderr"), F.col("size")))
    return x.groupBy("grp", "metric", "filter").agg(F.sum("size").alias("size"), (F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"), error.alias("stderr"))


def agreed_direction(directions: DataFrame, members: DataFrame) -> DataFrame:
    """grp, metric, higher_is_better: what a group's tasks agree on, null where they don't. Groups don't mix."""
    x = directions.join(F.broadcast(members), "task").groupBy("grp", "metric")
    unlike = (F.count_distinct("higher_is_better") > 1) | F.bool_or(F.col("higher_is_better").isNull())
    return x.agg(F.when(~unlike, F.bool_and("higher_is_better")).alias("higher_is_better"))


def flat_results(results: DataFrame) -> DataFrame:
    """key (``task/metric``, without ``,none``), number, text: one row for each entry of (task, entries: map of texts).

    Entries that are no numbers, as aliases, are texts.
    """
    x = results.select("task", F.explode("entries").alias("k", "v"))
    number = F.col("v").try_cast("double")
    return x.select(F.concat_ws("/", "task", names.without_none(F.col("k"))["key"]).alias("key"), number.alias("number"), F.when(number.isNull(), F.col("v")).alias("text"))


def outline(tree: DataFrame, depth: int = 16) -> DataFrame:
    """name, alias, depth, place: a task tree (parent, name, alias) in order of display, aliases indented by depth.

    Children follow their parent in order of names; a root's parent is null.
    """
    front = tree.where("parent is null").select("name", "alias", F.lit(0).alias("depth"), F.array("name").alias("way"))
    out = front
    for d in range(1, depth):
        step = front.select(F.col("name").alias("parent"), "way").join(F.broadcast(tree), "parent")
        front = step.select("name", "alias", F.lit(d).alias("depth"), F.concat("way", F.array("name")).alias("way"))
        if not front.limit(1).count():
            break
        out = out.union(front)
    shown = F.when(F.col("depth") > 0, F.concat(F.repeat(F.lit(" "), F.col("depth")), F.lit("- "), F.col("alias"))).otherwise(F.col("alias"))
    return out.select("name", shown.alias("alias"), "depth", F.row_number().over(Window.orderBy("way")).alias("place"))


def sample_frame(samples: DataFrame, kind: Column) -> DataFrame:
    """id, data, label, choices, raw and filtered predictions of logged samples, by their kind of output.

    samples: doc_id, target, arguments array<array<string>>, losses array<double>, greedy array<boolean>, response. Unlike
    the metric, the log takes the choice of the greatest value.
    """
    first = F.get(F.get("arguments", F.lit(0)), F.lit(0))
    likely = F.concat(F.lit("log probability of continuation is "), F.get("losses", F.lit(0)).cast("string"), F.lit(" \n\ncontinuation will "), F.when(F.get("greedy", F.lit(0)), "be").otherwise("not be"), F.lit(" generated with greedy sampling"))
    most = (F.array_position("losses", F.array_max("losses")) - 1).cast("string")
    raw = F.when(kind == "loglikelihood", likely).when(kind == "multiple_choice", most).when(kind == "loglikelihood_rolling", F.get("losses", F.lit(0)).cast("string")).otherwise(F.col("response"))
    label = F.when(kind == "loglikelihood", F.get(F.get("arguments", F.lit(0)), F.lit(1))).otherwise(F.col("target"))
    listing = F.array_join(F.transform("arguments", lambda a, i: F.concat(i.cast("string"), F.lit(". "), F.get(a, F.lit(1)))), "\n")
    return samples.select(F.col("doc_id").alias("id"), first.alias("data"), label.alias("label"), F.when(kind == "multiple_choice", listing).alias("choices"), raw.alias("raw_prediction"))


# The entry of a task's results that a regression run compares.
COMPARED = {"ai2d": "exact_match,flexible-extract", "mmmu_val": "mmmu_acc,none", "ocrbench": "ocrbench_accuracy,none", "videomme": "videomme_perception_score,none", "muirbench": "muirbench_score_overall,flexible-extract"}


def compared_value(results: DataFrame, tasks: list[str]) -> DataFrame:
    """task, value of the wanted tasks from (task, key, value): each by its own entry, 0 where there is none."""
    spark = results.sparkSession
    want = spark.createDataFrame([(t, COMPARED.get(t)) for t in tasks], "task string, key string")
    return F.broadcast(want).join(results, ["task", "key"], "left").select("task", F.coalesce("value", F.lit(0.0)).alias("value"))


def bucket_mean(df: DataFrame, key: str) -> DataFrame:
    """One row: number of keys, and rows a key on average."""
    return df.groupBy(key).count().agg(F.count(F.lit(1)).alias("buckets"), F.avg("count").alias("mean_size"))


def file_counts(df: DataFrame, file: str) -> DataFrame:
    """Rows of each file, and of all (file null)."""
    return df.rollup(file).agg(F.count(F.lit(1)).alias("n"))


def median_of(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """by, median: the middle row's value in order of ``seq``, values unsorted; no group meets in a task.

    Rows get places by group and ``seq``; a group's first place and its number of rows tell the place of its middle.
    """
    placed = places(df.select(*by, F.col(value).alias("median"), F.col(seq).alias("__seq")), *by, "__seq", name="__place")
    middle = placed.groupBy(*by).agg((F.min("__place") + F.floor(F.count(F.lit(1)) / 2)).alias("__place"))
    return placed.join(middle.select("__place"), "__place", "left_semi").select(*by, "median")
