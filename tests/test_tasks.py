"""Records, counts and coresets of tasks."""

from __future__ import annotations

import numpy as np
import pytest

from evalloom.operators import media, tasks


def test_coresets_by_task(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"t{i % 3}", rng.normal(size=4).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "i long, task string, v array<double>")
    got = {(r.task, r.pick): r.key for r in tasks.coresets(df, "task", "i", "v", tasks.item_counts(["t0", "t2"], [5, 2])).collect()}
    for t, k in (("t0", 5), ("t2", 2)):
        mine = [(i, np.array(v)) for i, x, v in rows if x == t]
        far = np.full(len(mine), np.inf)
        for pick in range(k):
            best = int(far.argmax())
            assert got[t, pick] == mine[best][0]
            far = np.minimum(far, [((v - mine[best][1]) ** 2).sum() for _, v in mine])
    assert len(got) == 7 and tasks.item_counts(["a", "b"], [4]) == {"a": 4, "b": 4}
    with pytest.raises(ValueError, match="one number"):
        tasks.item_counts(["a", "b", "c"], [1, 2])
    assert tasks.open_tasks(["t0", "t9", "t2", "t8"], df) == ["t9", "t8"]


def test_records_of_missing_parts(spark):
    df = spark.createDataFrame([(None, None, "a</think> b"), ([("user", "q")], ["p"], None)], "m array<struct<role:string,content:string>>, i array<string>, r string")
    from pyspark.sql import functions as F

    a, b = df.select(tasks.generated_record(F.col("m"), F.col("i"), F.col("r")).alias("g"), tasks.question(F.col("m")).alias("q")).collect()
    assert [(m.role, m.content) for m in a.g.messages] == [("assistant", "b")] and a.g.images == [] and b.q == "q"
    assert [(m.role, m.content) for m in b.g.messages] == [("user", "q"), ("assistant", None)] and b.g.images[0].path == "p"


def test_video_suffixes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b.mp4"), (3, "c"), (4, None), (5, "d.MP4")], "i int, n string")
    files = spark.createDataFrame([("/v/a.MP4",), ("/v//b.mp4",), ("/v/d.MP4",)], "path string")
    assert {r.i: r.found for r in media.with_suffix(rows, files, "i", "n", "/v").collect()} == {1: "/v/a.MP4", 2: "/v/b.mp4", 3: None, 4: None, 5: "/v/d.MP4"}


def test_views_by_kind(spark):
    from evalloom.plans import views

    rows = [("TargetLocalization", "Color"), ("Navigation", "FeasiblePath"), ("Navigation", "FeasiblePath_Exo"), ("Manipulation", "ContactRelationship_TypeTwo"), ("Manipulation", "Placement"), ("Elsewhere", "x"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, category string, kind string")
    got = {r.i: [(x.role, x.field) for x in r.layers] for r in views.layers(df).collect()}
    path = [("primary", "masklet_path"), ("secondary", "masklet_target_area")]
    assert got == {0: [("primary", "masklet_target")], 1: path, 2: path, 3: [("reference", "masklet_reference_object"), ("primary", "masklet_contact_target")], 4: [("reference", "masklet_reference_object"), ("primary", "masklet_placement_region")], 5: [], 6: []}
    texts = {r.i: r.fields for r in views.key_texts(df).collect()}
    assert texts[3] == ["count_contact_target", "precise_count"] and texts[0][0] == "target_object_description_en" and texts[4] == texts[5] == texts[6] == [] and texts[1] == []


def test_array_files(spark, tmp_path):
    from evalloom.sources import readers

    rng = np.random.default_rng(2)
    one, two, three = rng.normal(size=(2500, 3)), rng.normal(size=(4, 1, 3)).astype("f4"), rng.normal(size=3)
    (tmp_path / "sub").mkdir()
    for name, x in (("a.npy", one), ("sub/b.npy", two), ("c.npy", three)):
        np.save(tmp_path / name, x)
    (tmp_path / "d.txt").write_text("no")
    got = {}
    for r in readers.npy_vectors(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], {})[r.row] = r.vector
    for name, x in (("a.npy", one), ("b.npy", two[:, 0]), ("c.npy", three[None])):
        assert np.allclose([got[name][i] for i in range(len(x))], x) and len(got[name]) == len(x)
