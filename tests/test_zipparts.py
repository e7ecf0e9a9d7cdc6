"""Archives by a budget: the distributed chain equals a plain fold, with empty, null and too large files, over many blocks."""

from __future__ import annotations

import random

import pytest

from evalloom.operators import zipparts


def plain(sizes, most):
    part, held, out = 1, 0, []
    for s in sizes:
        s = s or 0
        if held + s > most:
            part, held = part + 1, 0
        held += s
        out.append(part)
    return out


@pytest.mark.parametrize(("kind", "block"), [("mixed", 7), ("empty runs", 3), ("large", 4), ("one", 4096), ("none", 4)])
def test_parts_equal_a_fold(spark, kind, block):
    rnd = random.Random(kind)
    n = {"one": 1, "none": 0}.get(kind, 250)
    pick = {"mixed": [0, 1, 5, 30, 100, None], "empty runs": [0, 0, 0, 0, 0, 0, 0, 120, 3], "large": [101, 500, 0, 100, 99, 1]}.get(kind, [5000])
    sizes = [rnd.choice(pick) for _ in range(n)]
    if kind == "empty runs":
        sizes[100:140] = [0] * 40
        sizes[99] = 400
    df = spark.createDataFrame([(i * 3, s, f"f{i}") for i, s in enumerate(sizes)], "seq long, size long, name string").repartition(5, "size")
    got = sorted(map(tuple, zipparts.zip_parts(df, 100, block).collect()))
    assert [r[3] for r in got] == plain(sizes, 100) and [r[:3] for r in got] == [(i * 3, s, f"f{i}") for i, s in enumerate(sizes)]


def test_no_task_gets_all(spark):
    df = spark.range(40_000).selectExpr("id AS seq", "1 + id % 50 AS size")
    out = zipparts.zip_parts(df, 200, 512)
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("marked")[-1].split("Physical Plan")[0] and out.agg({"part": "max"}).first()[0] == plain([1 + i % 50 for i in range(40_000)], 200)[-1]
