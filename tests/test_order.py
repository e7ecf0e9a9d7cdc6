"""Places over ranges equal a sort of all rows, also with one value in most rows and with nulls."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evalloom.operators import instances, order, rollup


def _rows(n=400):
    rnd = random.Random(3)
    return [(i, rnd.choice(["a"] * 8 + ["b", None]), rnd.randrange(50), rnd.random()) for i in range(n)]


def test_places_and_numbers(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "i int, k string, n int, x double").repartition(7)
    got = {r.i: r.place for r in order.places(df, F.desc("n"), "i").collect()}
    want = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert got == {r[0]: p for p, r in enumerate(want)}
    got = {r.i: r.number for r in order.numbered(df, ["k"], "i").collect()}
    seen: dict = {}
    for r in rows:
        assert got[r[0]] == seen.get(r[1], 0)
        seen[r[1]] = seen.get(r[1], 0) + 1
    assert order.places(df.where("i < 0"), "i").count() == 0


def test_uses_of_places(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "i int, k string, n int, x double").repartition(7)
    got = {r.k: r.median for r in rollup.median_of(df, ["k"], "x", "i").collect()}
    of = {k: [r[3] for r in rows if r[1] == k] for k in ("a", "b", None)}
    assert got == {k: v[len(v) // 2] for k, v in of.items()}
    named = {r.i: r.k for r in instances.disambiguated(df.where("k is not null"), [], "k", "i").collect()}
    count: dict = {}
    for r in rows:
        if r[1]:
            n = count.get(r[1], 0)
            assert named[r[0]] == (f"{r[1]}-{n}" if n else r[1])
            count[r[1]] = n + 1
    batches = instances.longest_first(df.withColumnRenamed("i", "seq"), "n", 16).collect()
    assert sorted((r.place, r.batch) for r in batches) == [(p, p // 16) for p in range(len(rows))]
