"""Resampling by blocks equals Python's generator and lists, for every kind of statistic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import bootstrap, translation


def plain(values, statistic, iterations):
    out, chunk = [], min(1000, iterations)
    for c in range(iterations // chunk):
        rnd = random.Random(c)
        out += [statistic(rnd.choices(values, k=len(values))) for _ in range(chunk)]
    return float(np.std(out, ddof=1))


def f1(rows):
    tp, wrong = sum(g == p == 1 for g, p in rows), sum(g != p for g, p in rows)
    return 2 * tp / (2 * tp + wrong) if tp + wrong else 0.0


def mcc(rows):
    n = {(g, p): sum(r == (g, p) for r in rows) for g in (0, 1) for p in (0, 1)}
    below = (n[1, 1] + n[0, 1]) * (n[1, 1] + n[1, 0]) * (n[0, 0] + n[0, 1]) * (n[0, 0] + n[1, 0])
    return (n[1, 1] * n[0, 0] - n[0, 1] * n[1, 0]) / math.sqrt(below) if below else 0.0


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_numbers(spark, size):
    rnd = random.Random(1)
    values = [rnd.choice([0.0, 1.0, 2.5, -3.25]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(values)) + [(99, None)], "i int, x double").repartition(3)
    got = lambda s, n=300: bootstrap.bootstrap_stderr(df, "x", "i", s, n, size).first()[0]
    assert got(bootstrap.MEAN) == pytest.approx(plain(values, lambda v: sum(v) / len(v), 300), abs=1e-12)
    assert got(bootstrap.PERPLEXITY) == pytest.approx(plain(values, lambda v: math.exp(-sum(v) / len(v)), 300), abs=1e-12)
    assert got(bootstrap.Middle()) == pytest.approx(plain(values, lambda v: v[len(v) // 2], 300), abs=1e-12)
    assert got(max) == pytest.approx(plain(values, max, 300), abs=1e-12)  # any function
    assert got(bootstrap.MEAN, 2000) == pytest.approx(plain(values, lambda v: sum(v) / len(v), 2000), abs=1e-12)


@pytest.mark.parametrize("size", [1 << 20, 11])
def test_pairs_and_corpora(spark, size):
    rnd = random.Random(2)
    rows = [(rnd.randrange(2), rnd.randrange(2)) for _ in range(50)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g int, p int").repartition(3)
    both = F.array("g", "p")
    for fold, slow in ((bootstrap.F1, f1), (bootstrap.MCC, mcc)):
        got = bootstrap.resampled(df, both, ["i"], fold, 200, size).agg(F.stddev_samp("s")).first()[0]
        assert got == pytest.approx(plain(rows, slow, 200), abs=1e-12)
    pairs = [(f"a b c d e{i % 3}", f"a b c {'x' if i % 4 else 'd'} e{i % 2} f") for i in range(12)]
    text = spark.createDataFrame(pairs, "p string, r string")
    stats = translation.statistics(text, "p", "r")
    words = [n for n in stats.columns if n[0] in "mtcr" and n in ("cl", "rl") or n[:1] in "mt"]
    x = stats.withColumn("i", F.monotonically_increasing_id())
    values = [tuple(float(v) for v in r) for r in x.orderBy("i").select(*words).collect()]
    bleu = lambda rows: bootstrap.BLEU.finish(np.sum(rows, 0), len(rows))
    got = bootstrap.resampled(x, F.array(*words), ["i"], bootstrap.BLEU, 100, size).agg(F.stddev_samp("s")).first()[0]
    assert got == pytest.approx(plain(values, bleu, 100), abs=1e-9)
    # the fold of all pairs is the corpus score
    assert bleu(values) == pytest.approx(translation.corpus_scores(text, "p", "r").first().bleu, abs=1e-9)


def test_empty_and_null(spark):
    none = spark.createDataFrame([(1, None)], "i int, x double")
    assert bootstrap.bootstrap_stderr(none, "x", "i", bootstrap.MEAN, 100).first()[0] is None
    assert bootstrap.bootstrap_stderr(none.where("i < 0"), "x", "i", max, 100).first()[0] is None
