"""Aggregates over sample metrics, as column expressions; order-dependent ones take an explicit sequence."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bootstrap import bootstrap_stderr  # noqa: F401
from .translation import corpus_scores  # noqa: F401


def mean(x: Column) -> Column:
    return F.avg(x)


def median(x: Column, seq: Column) -> Column:
    """Middle value in order of ``seq``; values aren't sorted. Gathers one group's values; meant for per-task groups."""
    rows = F.array_sort(F.collect_list(F.struct(seq.alias("s"), x.alias("x"))))
    return F.element_at(rows, (F.floor(F.size(rows) / 2) + 1).cast("int"))["x"]


def bypass() -> Column:
    return F.max(F.lit(999))


def perplexity(x: Column) -> Column:
    return F.exp(-F.avg(x))


def weighted_mean(a: Column, b: Column) -> Column:
    return F.sum(a) / F.sum(b)


def weighted_perplexity(a: Column, b: Column) -> Column:
    return F.exp(-weighted_mean(a, b))


def bits_per_byte(a: Column, b: Column) -> Column:
    return -weighted_mean(a, b) / F.lit(math.log(2))


def f1(gold: Column, pred: Column) -> Column:
    """Binary F1; 0 when nothing is positive."""
    tp, wrong = F.count_if((gold == 1) & (pred == 1)), F.count_if(gold != pred)
    return F.when(2 * tp + wrong == 0, 0.0).otherwise(2.0 * tp / (2 * tp + wrong))


def mcc(gold: Column, pred: Column) -> Column:
    """Binary Matthews correlation; 0 when a margin is empty."""
    n = {(g, p): F.count_if((gold == g) & (pred == p)).cast("double") for g in (0, 1) for p in (0, 1)}
    below = (n[1, 1] + n[0, 1]) * (n[1, 1] + n[1, 0]) * (n[0, 0] + n[0, 1]) * (n[0, 0] + n[1, 0])
    return F.when(below == 0, 0.0).otherwise((n[1, 1] * n[0, 0] - n[0, 1] * n[1, 0]) / F.sqrt(below))


def mcc_of(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Matthews correlation of any number of classes, from the confusion matrix; one row ``mcc``, 0 where it isn't defined."""
    cells = df.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = cells.select(F.col("g").alias("k"), F.col("n").alias("t"), F.lit(0.0).alias("q")).union(cells.select("p", F.lit(0.0), "n")).groupBy("k").agg(F.sum("t").alias("t"), F.sum("q").alias("q"))
    right = cells.agg(F.sum("n").alias("s"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0.0)).alias("c"))
    both = sides.agg(F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    below = F.sqrt((F.col("s") * F.col("s") - F.col("qq")) * (F.col("s") * F.col("s") - F.col("tt")))
    return right.join(both).select(F.when(below == 0, 0.0).otherwise((F.col("c") * F.col("s") - F.col("tq")) / below).alias("mcc"))


def pop_stddev(x: Column) -> Column:
    return F.stddev_pop(x)


def sample_stddev(x: Column) -> Column:
    """Null for a single value."""
    return F.stddev_samp(x)


def any_right(score: Callable[[Column], Column], golds: Column) -> Column:
    """1.0 if the score of any target isn't 0, else 0.0."""
    return F.exists(golds, lambda g: F.coalesce(score(g), F.lit(0.0)) != 0).cast("double")


def best_of(score: Callable[[Column], Column], golds: Column) -> Column:
    """The greatest score over the targets."""
    return F.array_max(F.transform(golds, score))


def brier(gold: Column, probs: Column) -> Column:
    """Mean over rows of the summed squared distance from the one-hot truth."""
    return F.avg(F.aggregate(F.transform(probs, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2))), F.lit(0.0), lambda a, x: a + x))


def stderr(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def pooled_stderr(se: Column, size: Column) -> Column:
    """Standard error of subtasks together."""
    total = F.sum(size)
    return F.sqrt(F.sum((size - 1) * F.pow(se, F.lit(2)) * size) / (total - F.count(size)) / total)


def combined_stderr(seq: Column, se: Column, size: Column, metric: Column) -> Column:
    """Ordered pairwise fold of means and variances of a few subtasks."""
    rows = F.array_sort(F.collect_list(F.struct(seq.alias("s"), se.cast("double").alias("se"), size.cast("double").alias("n"), metric.cast("double").alias("m"))))

    def step(t, x):
        n = t["n"] + x["n"]
        v = ((t["n"] - 1) * t["v"] + (x["n"] - 1) * F.pow(x["se"], F.lit(2)) * x["n"]) / (n - 1) + t["n"] * x["n"] * F.pow(t["m"] - x["m"], F.lit(2)) / (n * (n - 1))
        return F.struct(v.alias("v"), n.alias("n"), ((t["m"] * t["n"] + x["m"] * x["n"]) / n).alias("m"))

    head = F.element_at(rows, 1)
    start = F.struct((F.pow(head["se"], F.lit(2)) * head["n"]).alias("v"), head["n"].alias("n"), head["m"].alias("m"))
    return F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), start, step, lambda t: F.sqrt(t["v"] / t["n"]))


def acc_all(df: DataFrame, keys: list[str], correct: str) -> DataFrame:
    """Share of groups all of whose answers are right."""
    return df.groupBy(*keys).agg(F.bool_and(correct).alias("all_right")).agg(F.avg(F.col("all_right").cast("int")).alias("acc_all"))


def acc_all_stderr(df: DataFrame, question: list[str], correct: str) -> DataFrame:
    """Standard error of ``acc_all``; unlike it, its groups are the questions alone, over all paragraphs."""
    return df.groupBy(*question).agg(F.bool_and(correct).alias("all_right")).agg(stderr(F.col("all_right").cast("int")).alias("acc_all_stderr"))


def mutual_info(conditional: Column, unconditional: Column, gold: Column) -> Column:
    """1.0 if the choice that gains most by the context (the first of ties) is the right one."""
    gain = F.zip_with(conditional, unconditional, lambda a, b: a - b)
    return (F.array_position(gain, F.array_max(gain)) - 1 == gold).cast("double")


def mcq_many(losses: Column, golds: Column, lengths: Column, greedy: Column) -> Column:
    """struct<acc, acc_norm, exact_match> of questions with several right choices; places out of range count as none."""
    least = lambda x: F.array_position(x, F.array_min(x)) - 1
    a, b = least(losses), least(F.zip_with(losses, lengths, lambda x, n: x / n))
    valid = F.transform(golds, lambda g: F.when(g < F.size(losses), g).otherwise(-100))
    hit = F.exists(valid, lambda g: (g != -100) & F.coalesce(F.get(greedy, g.cast("int")), F.lit(False)))
    return F.struct(F.exists(valid, lambda g: g == a).cast("double").alias("acc"), F.exists(valid, lambda g: g == b).cast("double").alias("acc_norm"), hit.cast("int").alias("exact_match"))


def loglikelihood(value: Column, greedy: Column) -> Column:
    """struct<perplexity, acc>: what each sample adds to either."""
    return F.struct(value.alias("perplexity"), greedy.cast("int").alias("acc"))


def mcq(losses: Column, gold: Column, lengths: Column) -> Column:
    """struct<acc, acc_norm, pred, pred_norm>: the choice of least loss, and of least loss a character; first of ties."""
    least = lambda x: (F.array_position(x, F.array_min(x)) - 1).cast("int")
    a, b = least(losses), least(F.zip_with(losses, lengths, lambda x, n: x / n))
    g = F.when((gold < 0) | (gold >= F.size(losses)), -100).otherwise(gold)
    return F.struct((a == g).cast("double").alias("acc"), (b == g).cast("double").alias("acc_norm"), a.alias("pred"), b.alias("pred_norm"))
