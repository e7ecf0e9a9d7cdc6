"""Multi-grain reports: overall, category, type and group in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import catalog


def score_report(scored: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """grain, key, ord, total_expected, total_processed, num_invalid, mean_score.

    scored: category, by_type, by_group (null where unresolved), score, invalid. One expand and one shuffle of partial
    sums serve all grains. expected: grain, key, n; keys only expected give zero rows at type and group grain, not at
    category grain; without an expected number it is the processed one. Categories outside the taxonomy count overall only.
    """
    spark = scored.sparkSession
    grains = F.array(
        F.struct(F.lit("overall").alias("grain"), F.lit("overall").alias("key")),
        F.struct(F.lit("category").alias("grain"), F.col("category").alias("key")),
        F.struct(F.lit("type").alias("grain"), F.col("by_type").alias("key")),
        F.struct(F.lit("group").alias("grain"), F.col("by_group").alias("key")),
    )
    rows = scored.select(F.explode(grains).alias("g"), "score", F.col("invalid").cast("long").alias("bad")).select("g.grain", "g.key", "score", "bad").where("key is not null")
    found = rows.groupBy("grain", "key").agg(F.count(F.lit(1)).alias("total_processed"), F.sum("bad").alias("num_invalid"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))
    order = [("overall", "overall", -1)] + [("category", c, i) for i, c in enumerate(catalog.TAXONOMY)] + [("type", r[4], r[0]) for r in catalog.leaves()]
    order += [("group", g, i) for i, g in enumerate(dict.fromkeys(r[5] for r in catalog.leaves()))]
    known = F.broadcast(spark.createDataFrame(order, "grain string, key string, ord int"))
    found = found.join(known, ["grain", "key"], "inner")
    if expected is None:
        return found.select("grain", "key", "ord", F.col("total_processed").alias("total_expected"), "total_processed", "num_invalid", "mean_score")
    want = expected.select("grain", "key", F.col("n").cast("long").alias("n")).join(known.withColumnRenamed("ord", "o"), ["grain", "key"], "left")
    both = found.join(want, ["grain", "key"], "full").where(F.col("total_processed").isNotNull() | F.col("grain").isin("type", "group"))
    return both.select("grain", "key", F.coalesce("ord", "o").alias("ord"), F.coalesce("n", "total_processed").alias("total_expected"), *[F.coalesce(c, F.lit(z)).alias(c) for c, z in (("total_processed", 0), ("num_invalid", 0), ("mean_score", 0.0))])


def group_rollup(results: DataFrame, closure: DataFrame) -> DataFrame:
    """grp, metric, size, value, stderr from task results (task, metric, value, stderr, size) and (grp, task) pairs.

    A missing standard error of any task makes the group's missing.
    """
    from ..functions.metrics import pooled_stderr

    x = results.join(F.broadcast(closure), "task")
    return x.groupBy("grp", "metric").agg(F.sum("size").alias("size"), (F.sum(F.col("value") * F.col("size")) / F.sum("size")).alias("value"), F.when(~F.bool_or(F.col("stderr").isNull()), pooled_stderr(F.col("stderr"), F.col("size"))).alias("stderr"))
