"""Media paths against a naive walk, drawings against pixels, and the bucketed cache's plans and recovery."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import drawing
from evalloom.operators import media
from evalloom.streaming.cache import Cache

# --- media ----------------------------------------------------------------------------------------------------------


def walked(stored, annotation, files, working):
    """One candidate at a time, folder by folder."""
    if stored is None or not stored.strip(" "):
        return None
    s, name = stored.strip(" "), os.path.basename(os.path.normpath(stored.strip(" ")))
    real = lambda *p: os.path.normpath("/" + os.path.join(*p).lstrip("/"))
    if s.startswith("/") and real(s) in files:
        return real(s)
    tries = []
    if annotation:
        folder = os.path.dirname(real(annotation))
        for _ in range(81):
            tries += [real(folder, s), real(folder, name)]
            if folder == "/":
                break
            folder = os.path.dirname(folder)
    if working is not None:
        tries += [real(working, s), real(working, name)]
    return next((t for t in tries if t in files), None)


@pytest.mark.parametrize("working", [None, "/work"])
def test_media_equal_a_walk(spark, working):
    rnd = random.Random(4)
    folder = lambda n: "/".join(rnd.choice("abc") for _ in range(n))
    files, rows = set(), []
    for _ in range(300):
        for _ in range(3):
            files.add("/" + "/".join(filter(None, [folder(rnd.randrange(5)), f"{rnd.choice('xyz')}.png"])))
    files |= {"/work/w.png", "/work/a/v.png"}
    for i in range(300):
        stored = rnd.choice([f"{rnd.choice('xyzw')}.png", f"{folder(2)}/{rnd.choice('xyz')}.png", f"/{folder(3)}/{rnd.choice('xyz')}.png", f"../{rnd.choice('xyz')}.png", f"./{folder(1)}//{rnd.choice('xyzv')}.png", " x.png ", "", None, "a/v.png"])
        rows.append((i, stored, rnd.choice([f"/{folder(4)}/gt.json", f"/{folder(2)}/../{folder(1)}/gt.json", "/gt.json", None, "/" + folder(90) + "/gt.json"])))
    df = spark.createDataFrame(rows, "id int, stored string, gt string").repartition(3)
    listing = spark.createDataFrame([(f,) for f in files], "path string")
    got = {r.id: r.found for r in media.resolved(df, listing, "id", "stored", "gt", working).collect()}
    want = {i: walked(s, g, files, working) for i, s, g in rows}
    assert got == want and len(set(want.values())) > 20


# --- drawings -------------------------------------------------------------------------------------------------------


def canvas(runs, h, w):
    flat = np.zeros(h * w, bool)
    for r in runs:
        assert 0 <= r["s"] < r["e"] <= h * w
        flat[r["s"] : r["e"]] = True
    return flat.reshape(w, h).T


def test_resized_masks_equal_pixels(spark):
    rng, rows, masks = np.random.default_rng(3), [], []
    for i in range(300):
        h, w, a, b = (int(v) for v in rng.integers(1, 25, 4))
        mask = rng.random((h, w)) < rng.choice([0.1, 0.5, 0.9])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.T.ravel().astype(np.int8), [0]])))
        rows.append((i, [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)], h, w, a, b))
        masks.append(mask)
    df = spark.createDataFrame(rows, "i int, runs array<struct<s:int,e:int>>, h int, w int, a int, b int")
    for r in df.select("i", "h", "w", "a", "b", drawing.resized(*(F.col(c) for c in ("runs", "h", "w", "a", "b"))).alias("out")).collect():
        y, x = ((2 * np.arange(n) + 1) * old // (2 * n) for n, old in ((r.a, r.h), (r.b, r.w)))
        assert (canvas(r.out, r.a, r.b) == masks[r.i][np.ix_(y, x)]).all()
        assert sum(q["e"] - q["s"] for q in r.out) == canvas(r.out, r.a, r.b).sum()  # disjoint


def test_outlines_marks_and_lines_equal_pixels(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        h, w = (int(v) for v in rng.integers(4, 40, 2))
        boxes = [tuple(int(v) for v in rng.integers(-5, 45, 4)) for _ in range(rng.integers(0, 3))]
        points = [tuple(float(v) for v in rng.uniform(-5, 45, 2)) for _ in range(rng.integers(0, 4))]
        rows.append((i, h, w, boxes, points))
    df = spark.createDataFrame(rows, "i int, h int, w int, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>, points array<struct<x:double,y:double>>")
    h, w = F.col("h"), F.col("w")
    out = df.select("i", drawing.outlines(F.col("boxes"), h, w).alias("o"), drawing.marks(F.col("points"), h, w).alias("m"), drawing.lines(F.col("points"), h, w).alias("l"))
    for r in out.collect():
        _, h, w, boxes, points = rows[r.i]
        o, m, ln = (np.zeros((h, w), bool) for _ in range(3))
        for x1, y1, x2, y2 in boxes:
            x1, y1, x2, y2 = max(0, x1), max(0, y1), min(w, x2), min(h, y2)
            if x2 > x1 and y2 > y1:
                for rows_, cols in ((slice(y1, y1 + 3), slice(x1, x2)), (slice(max(0, y2 - 3), y2), slice(x1, x2)), (slice(y1, y2), slice(x1, x1 + 3)), (slice(y1, y2), slice(max(0, x2 - 3), x2))):
                    o[rows_, cols] = True
        at = [(min(max(0, int(x)), w - 1), min(max(0, int(y)), h - 1)) for x, y in points]
        for x, y in at:
            m[max(0, y - 6) : y + 7, max(0, x - 6) : x + 7] = True
        for (x0, y0), (x1, y1) in zip(at, at[1:], strict=False):
            n = max(abs(x1 - x0), abs(y1 - y0)) + 1
            for x, y in zip(np.linspace(x0, x1, n).astype(int), np.linspace(y0, y1, n).astype(int), strict=True):
                for dx in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        ln[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)] = True
        assert (canvas(r.o, h, w) == o).all() and (canvas(r.m, h, w) == m).all() and (canvas(r.l, h, w) == ln).all()


def test_blended_layers_equal_pixels(spark):
    rng = np.random.default_rng(6)
    rows = [(i, *[[tuple(sorted(int(v) for v in rng.integers(0, 60, 2))) for _ in range(rng.integers(0, 4))] for _ in range(2)]) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, a array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    both = F.array(drawing.layer(F.col("a"), 255, 0, 10), drawing.layer(F.col("b"), 0, 200, 30, 0.5))
    for r in df.select("i", drawing.blended(both).alias("x")).collect():
        picture = rng.uniform(0, 255, (60, 3))
        want = picture.copy()
        for runs, colour, alpha in ((rows[r.i][1], (255, 0, 10), 0.4), (rows[r.i][2], (0, 200, 30), 0.5)):
            on = np.zeros(60, bool)
            for s, e in runs:
                on[s:e] = True
            want[on] = want[on] * (1 - alpha) + np.array(colour) * alpha
        got = picture.copy()
        for p in r.x:
            got[p["s"] : p["e"]] = picture[p["s"] : p["e"]] * p["keep"] + np.array([p["r"], p["g"], p["b"]])
        assert np.allclose(got, want)


# --- cache ----------------------------------------------------------------------------------------------------------


def test_cache_is_not_reshuffled(spark, tmp_path):
    asked = []

    def respond(rows):
        asked.append(rows.count())
        return rows.select("key", F.concat(F.lit("to "), F.col("key")).alias("response"))

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache = Cache(spark, str(tmp_path / "c"), buckets=4)
        first = spark.range(50).select(F.col("id").cast("string").alias("key"))
        assert cache.answered(first, respond).count() == 50
        more = spark.range(80).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("x"))
        got = cache.answered(more, respond, waves=2)
        assert {(r.key, r.x, r.response) for r in got.collect()} == {(str(i), 2 * i, f"to {i}") for i in range(80)}
        assert asked[0] == 50 and sum(asked[1:]) == 30
        plan = cache.known(more)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the requests' side only
        # another session's view of the same folder
        assert Cache(spark, str(tmp_path / "c")).buckets == 4 and Cache(spark, str(tmp_path / "c")).table().count() == 80
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_broken_run_is_taken_up(spark, tmp_path):
    cache, waves = Cache(spark, str(tmp_path / "c"), buckets=2), []

    def breaking(rows):
        waves.append(rows.count())
        if len(waves) == 3:
            raise RuntimeError("lost")
        return rows.select("key", F.col("key").alias("response"))

    requests = spark.range(100).select(F.col("id").cast("string").alias("key"))
    with pytest.raises(RuntimeError, match="lost"):
        cache.answered(requests, breaking, waves=4)
    kept = Cache(spark, str(tmp_path / "c")).table().count()
    assert kept == waves[0] + waves[1] > 0
    left = []

    def respond(rows):
        left.append(rows.count())
        return rows.select("key", F.col("key").alias("response"))

    assert Cache(spark, str(tmp_path / "c")).answered(requests, respond, waves=4).count() == 100 and sum(left) == 100 - kept


def test_compaction(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), buckets=2)
    for k in range(4):
        rows = spark.range(20 * k, 20 * k + 20).select(F.col("id").cast("string").alias("key"))
        cache._append(rows.select("key", F.lit("r").alias("response")), cache.version)
    assert cache.files() == 8 and not cache.compact() and cache.compact(most=3) and cache.files() == 2
    assert cache.version == 1 and Cache(spark, str(tmp_path / "c")).table().count() == 80
