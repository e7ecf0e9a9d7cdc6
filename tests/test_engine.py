"""Every SQL-expressible query against DuckDB on the smallest tables, and traps of the response and score semantics."""

import json
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from evalloom import queries as engine
from evalloom.functions import answers, coords, masks, metrics, scores, text
from evalloom.operators import filters, path, relational
from evalloom.plans import catalog
from evalloom.sources import readers, sinks

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda x: round(x, 9) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list | tuple) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = engine.queries()[name](spark, D)
    want = duck.execute(engine.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_other_queries_run(spark, name):
    assert engine.queries()[name](spark, D).count() > 0


def test_compressed_counts(spark):
    def encode(counts):
        out = []
        for i, c in enumerate(counts):
            x, more = c - (counts[i - 2] if i > 2 else 0), True
            while more:
                c5 = x & 31
                x >>= 5
                more = x != (-1 if c5 & 16 else 0)
                out.append(chr(48 + (c5 | (32 if more else 0))))
        return "".join(out)

    rnd = random.Random(2)
    cases = [[rnd.randrange(5000) for _ in range(rnd.randrange(1, 20))] for _ in range(50)]
    df = spark.createDataFrame([(i, encode(c)) for i, c in enumerate(cases)] + [(99, None), (98, "\x01")], "i int, s string")
    got = {r.i: r.c for r in df.select("i", masks.decode_counts("s").alias("c")).collect()}
    assert [got[i] for i in range(50)] == cases and got[99] is None and got[98] is None


def test_iou_against_pixels(spark):
    rnd = random.Random(7)
    data = []
    for i in range(60):
        box = lambda: [rnd.randrange(-5, 30) + 0.5 * rnd.randrange(2) for _ in range(4)]
        data.append((i, [box() for _ in range(rnd.randrange(3))], [box() for _ in range(rnd.randrange(3))]))
    df = spark.createDataFrame(data, "i int, a array<array<double>>, b array<array<double>>")
    run = lambda c: masks.box_runs(coords.normal_boxes(F.col(c), F.lit(20), F.lit(24), F.lit("absolute")), F.lit(20))
    got = {r.i: r.v for r in df.select("i", masks.iou(run("a"), run("b")).alias("v")).collect()}
    for i, a, b in data:
        sets = []
        for boxes in (a, b):
            s = set()
            for x1, y1, x2, y2 in boxes:
                x1, x2 = sorted((min(24, max(0, x1)), min(24, max(0, x2))))
                y1, y2 = sorted((min(20, max(0, y1)), min(20, max(0, y2))))
                if x2 > x1 and y2 > y1:
                    s |= {(x, y) for x in range(int(x1), int(x2)) for y in range(int(y1), int(y2))}
            sets.append(s)
        any_ = sets[0] | sets[1]
        assert abs(got[i] - (len(sets[0] & sets[1]) / len(any_) if any_ else 1.0)) < 1e-12


def test_answer_traps():
    lc, tl = {"localization": True, "count": True}, ("TargetLocalization", "Color")
    f = answers.standard_fields("x ```json\n{'bounding_boxes': [(1,2,3,4)], 'number_of_objects': 3.7}\n```", *tl, lc)
    assert json.loads(f["localization"]) == [[1, 2, 3, 4]] and json.loads(f["count"]) == [3] and json.loads(f["path"]) == ["Not Required"]
    assert json.loads(answers.standard_fields("<think>{'number_of_objects': 3}", *tl, lc)["count"]) == ["No Valid Response"]
    assert json.loads(answers.standard_fields('{"number_of_objects": "3.0"}', *tl, lc)["count"]) == ["No Valid Response"]
    assert json.loads(answers.standard_fields('{"number_of_objects": 2}', *tl, lc)["localization"]) == []
    assert json.loads(answers.standard_fields("{'number_of_objects': 2, 'x': 'a\"b'}", *tl, lc)["count"]) == ["No Valid Response"]
    assert json.loads(answers.standard_fields("{'points': [(1,2),(3,4)]}", "Navigation", "FeasiblePath", {"path": True})["path"]) == ["No Valid Response"]
    assert answers.as_json("{'a': [True, None, Falsey]}") == '{"a": [true, null, Falsey]}'
    assert json.loads(answers.as_json("{'a': 'say \\\\ True', 'b': None}")) == {"a": "say \\ True", "b": None}
    assert answers.listed('{"points": [(1, 2), (3, 4)], "x": (5)}', "points") == '{"points": [[1, 2], [3, 4]], "x": (5)}'
    assert answers.standard_fields(None, "Elsewhere", None, {})["binary"] == '["Not Required"]'


def test_invalid_is_case_sensitive(spark):
    df = spark.createDataFrame([("GT mask is missing",), ("Missing pred_count or gt_count",), ("No path points parsed",), (None,)], "e string")
    assert [r[0] for r in df.select(scores.invalid(F.col("e"))).collect()] == [False, True, True, False]


def test_leaf_resolution(spark):
    df = spark.createDataFrame([("Navigation", "FeasiblePath", "/d/Navigation/FeasiblePath/FeasiblePath_Exo/1/a.json"), ("Navigation", "FeasiblePath", None), ("TargetLocalization", "BasicAttributes", "/d/BasicAttributes/Color/x"), ("Manipulation", "Placement", None), ("X", "Y", None)], "c string, k string, p string")
    got = [r[0] for r in df.select(catalog.resolve_leaf(F.col("c"), F.col("k"), F.col("p"))).collect()]
    assert got == ["FeasiblePath_Exo", None, "Color", "PlacementRegion", None]


def test_bootstrap_equals_python(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(40)], "i int, x double")
    mean = lambda v: sum(v) / len(v)
    got = metrics.bootstrap_stderr(df, "x", "i", mean, 2000).first()[0]
    values, all_ = [float(i % 7) for i in range(40)], []
    for c in range(2):
        rnd = random.Random(c)
        all_ += [mean(rnd.choices(values, k=40)) for _ in range(1000)]
    m = sum(all_) / 2000
    assert abs(got - math.sqrt(sum((a - m) ** 2 for a in all_) / 1999)) < 1e-12


def test_bootstrap_query_draws_from_all_labels(spark, tmp_path):
    n = 1200
    spark.createDataFrame([(i, int(i >= 600 and i % 3 > 0)) for i in range(n)], "doc_id long, quality int").repartition(3).write.parquet(f"{tmp_path}/labels.parquet")
    got = engine.queries()["bootstrap_stderr"](spark, str(tmp_path)).first()[0]
    values, means = [float(i >= 600 and i % 3 > 0) for i in range(n)], []
    for c in range(2):
        rnd = random.Random(c)
        means += [sum(rnd.choices(values, k=n)) / n for _ in range(1000)]
    m = sum(means) / 2000
    assert abs(got - math.sqrt(sum((a - m) ** 2 for a in means) / 1999)) < 1e-12


def test_path_score():
    area = [{"s": 0, "e": 40 * 30}]
    goal = [{"s": 38 * 30, "e": 40 * 30}]
    straight = [{"x": 20.0, "y": 29.0}, {"x": 26.0, "y": 24.0}, {"x": 32.0, "y": 19.0}, {"x": 38.0, "y": 15.0}]
    good, bad = path.score_path(straight, area, goal, 30, 40, False), path.score_path(straight[::-1], area, goal, 30, 40, False)
    assert 0 <= bad < good <= 1 and good > 0.95 and path.score_path(straight[:1], area, goal, 30, 40, False) == 0.0
    import numpy as np

    m = np.zeros((6, 9), bool)
    m[1, 1], m[2, 2], m[4, 7] = True, True, True
    from tests.test_regions import of_mask

    assert of_mask(m).components().max() == 2 and of_mask(np.ones((3, 3), bool)).components().max() == 0


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path / "r/fam/model.jsonl")
    os.makedirs(os.path.dirname(p))
    open(p, "w").write('{"a": 1}\nbroken\n[1]\n\n{"a": 2}\n')
    assert readers.json_records(spark, p).count() == 2 and readers.broken_lines(spark, p).count() == 2
    assert tuple(readers.json_records(spark, p).select(readers.run_info(F.col("file"))).first()[0])[1:] == ("fam", "model")
    q = str(tmp_path / "a.json")
    open(q, "w").write('[\n {"a": 1},\n {"a": 2}, 5]')
    assert readers.json_records(spark, q, whole=True).count() == 2
    open(q, "w").write('{"overall": 5, "by_type": {"x": 3}}')
    assert {tuple(r) for r in readers.expected_counts(spark, q).collect()} == {("overall", "overall", 5), ("type", "x", 3)}
    s, d = spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(0, 0.5), (1, 0.7)], "index long, score double")
    sinks.evaluation_log(s, d, str(tmp_path / "log"))
    summary, samples = readers.result_log(spark, str(tmp_path / "log"))
    assert summary.count() == 1 and samples.count() == 2


def test_windows_and_majority(spark):
    df = spark.createDataFrame([(["b", "a", "a", "b"], list(range(10)))], "r array<string>, t array<int>")
    r = df.select(text.majority(F.col("r")).alias("m"), relational.rolling_windows(F.col("t"), 4).alias("w"), relational.chunks(F.col("t"), 4).alias("c")).first()
    assert r.m == "b" and [x for w in r.w for x in w.target] == list(range(10)) and [len(c) for c in r.c] == [4, 4, 2]


def test_registry(spark):
    with pytest.raises(ValueError):
        filters.register(filters.FILTERS, "regex")(lambda r: r)
    assert filters.scorer("No", "such")() is not None


def test_package_reaches_workers(spark):
    import os

    from pyspark.sql import functions as F

    from evalloom.session import ship

    ship(ship(spark))
    assert spark.sparkContext._python_includes.count("evalloom.zip") == 1

    @F.pandas_udf("string")
    def where(x):
        import sys

        return x.map(lambda _: " ".join(map(os.path.basename, sys.path)))

    assert "evalloom.zip" in spark.range(1).select(where(F.col("id").cast("string"))).first()[0]


def test_spread_keeps_rows(spark):
    from evalloom.sources.readers import spread

    x = spark.range(0, 1000, 1, 1)
    assert spread(x, "id").rdd.getNumPartitions() == 4
    assert sorted(r.id for r in spread(x, "id").collect()) == list(range(1000))
    assert spread(x, "id", small=1).rdd.getNumPartitions() == 1


def test_rolling_windows_cover_every_token_once(spark):
    from pyspark.sql import functions as F

    from evalloom.operators import relational

    for n in (0, 1, 5, 6, 7, 23):
        w = spark.range(1).select(relational.rolling_windows(F.array(*map(F.lit, range(n))) if n else F.array().cast("array<int>"), 6, 2).alias("w")).first()[0]
        assert [t for x in w or [] for t in x["target"]] == list(range(n))
