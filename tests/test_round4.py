"""Work that is dealt by the size of the input, and done once a row."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom import queries
from evalloom.operators import path, relational
from evalloom.sources import readers


def test_costly_rows_are_dealt_whatever_the_size(spark):
    """One row group of a large file is one task; partitions grow with the listed size."""
    x = spark.range(100_000, numPartitions=1)
    assert readers.dealt(x, "id", part=20_000).rdd.getNumPartitions() == 40  # 800,000 bytes
    assert readers.dealt(x, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert readers.dealt(x, "id", part=20_000).agg(F.sum("id")).first()[0] == 99_999 * 50_000


@pytest.mark.parametrize("name", ["flagship_score_report", "score_details", "path_score", "answers_content", "mask_overlay"])
def test_rows_of_a_large_file_are_dealt_before_they_are_computed(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(readers.spread, "__defaults__", (1,))  # as if every file were large
    spark.range(400).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 50 AS user_id", "'view' AS event_type", "id * 0.5D AS value", "'{}' AS props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    plan = queries.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_evaluated_columns_stay_behind_the_shuffle(spark):
    """A filter on a costly column isn't moved before the exchange, where it would be evaluated in the tasks of the scan."""
    x = spark.range(1000).repartition(3, "id")
    y = relational.evaluated(x, v=F.sqrt(F.col("id") * 4.0), w=F.lit(1))
    assert y.columns == ["id", "v", "w"] and y.where("v >= 60").count() == 100
    plan = y.where("v >= 60").select("v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1 and plan.index("SQRT") < plan.index("RepartitionByExpression")


def test_paths_of_a_batch_as_of_rows():
    """Rows of arrays, with shared, empty and missing masks, score as they do one by one."""
    runs = lambda a, b, c, d: [{"s": x * 32 + b, "e": x * 32 + d} for x in range(a, c)]
    rows = []
    for k in range(120):
        points = [{"x": 5.0 + i * (3 + k % 3) + k / 7, "y": 30.0 - i * (2 + k % 4)} for i in range(k % 7)]
        goal = runs(k % 24, k % 16, k % 24 + 4, k % 16 + 3) + (runs(40, 20, 44, 25) if k % 3 == 0 else [])
        rows.append((None if k % 17 == 3 else points, None if k % 19 == 4 else runs(4, 4, 40, 30), None if k % 23 == 5 else goal if k % 11 else [], None if k % 29 == 6 else 32, 48, k % 2 == 0))
    rows.append(([{"x": 1.0, "y": None}, {"x": 30.0, "y": 2.0}], runs(4, 4, 40, 30), runs(0, 0, 2, 2), 32, 48, True))
    of = lambda *names, kind: pa.list_(pa.struct([(n, kind) for n in names]))
    kinds = [of("x", "y", kind=pa.float64()), of("s", "e", kind=pa.int32()), of("s", "e", kind=pa.int32()), pa.int32(), pa.int32(), pa.bool_()]
    for part in (rows[:-1], rows[3:90], rows):
        arrays = [pa.array([None] * 2 + list(c), t)[2:] for c, t in zip(zip(*part, strict=True), kinds, strict=True)]
        assert list(path._batch(*arrays)) == [path._one(*r) for r in part]


def test_pages_become_texts_a_few_at_a_time():
    """The texts of a batch of long pages aren't all Python objects at once; nulls, empty batches and slices stay."""
    import tracemalloc

    from evalloom.functions import text

    page = "<p>" + "é" * 20_000 + "</p><script>" + "x" * 60_000 + "</script>"
    pages = pa.array([None, *[page] * 1000, ""])
    tracemalloc.start()
    out = text.visible_text.func(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [None, *["é" * 20_000] * 1000, ""] and peak < 30 << 20
    assert text.visible_text.func(pages[:0]).to_pylist() == [] and text.visible_text.func(pages[1000:]).to_pylist() == ["é" * 20_000, ""]


def test_ngrams_of_pairs_are_dealt_by_size(spark, monkeypatch):
    """corpus_bleu_chrf: a task holds the n-grams of some hundred pairs, however many pairs there are."""
    from evalloom.functions import translation

    x = spark.range(1000).selectExpr("concat('a b c d ', id) AS p", "concat('a b d c ', id) AS r")
    whole = translation.statistics(x, "p", "r").agg(F.sum("m2"), F.sum("cm3")).first()
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(translation, "PART", 1000)
    assert translation.partitions_by_size(x, 1000) > few
    s = translation.statistics(x, "p", "r")
    assert f"hashpartitioning(i#" in (plan := s._jdf.queryExecution().executedPlan().toString()) and f", {translation.partitions_by_size(x, 1000)})" in plan.replace(", REPARTITION_BY_NUM", ")")
    assert s.agg(F.sum("m2"), F.sum("cm3")).first() == whole
