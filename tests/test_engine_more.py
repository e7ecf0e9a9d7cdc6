"""Brute force and traps of scoring, paths, masks, choices, roll-ups, sources, sinks, configuration and streams."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import choices, frames, masks, metrics, names, scores, text
from evalloom.operators import benchrows, converters, filters, instances, path, relational, report, rollup, scoring
from evalloom.plans import catalog, config
from evalloom.sources import readers, sinks
from evalloom.streaming import incremental


def slow_path(points, area, goal, h, w, exo):
    """The rules of a path's score, point by point and pixel by pixel."""
    diag = math.hypot(h, w)
    kept = []
    for p in points:
        if not kept or math.dist(p, kept[-1]) >= diag / 30:
            kept.append(p)
    n = len(kept)
    if n < 2:
        return 0.0
    cells = lambda m: [(x, y) for y in range(h) for x in range(w) if m[y][x]]

    def away(p, m):
        x, y = round(p[0]), round(p[1])
        if 0 <= x < w and 0 <= y < h and m[y][x]:
            return 0.0
        return min((math.dist(p, c) for c in cells(m)), default=math.inf)

    foot, start, end = (w / 2, h - 1.0), None, goal if any(map(any, goal)) else None
    if exo and end is not None:
        left, parts = set(cells(goal)), []
        for c in sorted(left, key=lambda c: (c[1], c[0])):
            if c in left:
                todo, part = [c], []
                left.discard(c)
                while todo:
                    x, y = todo.pop()
                    part.append((x, y))
                    for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                        if q in left:
                            left.discard(q)
                            todo.append(q)
                parts.append(part)
        if len(parts) > 1:
            mid = [(sum(x for x, _ in p) / len(p), sum(y for _, y in p) / len(p)) for p in parts]
            i, j = max(((i, j) for i in range(len(parts)) for j in range(len(parts))), key=lambda ij: (math.dist(mid[ij[0]], mid[ij[1]]), -ij[0], -ij[1]))
            one = [math.dist(m, mid[i]) <= math.dist(m, mid[j]) for m in mid]
            of = lambda side: [[any(o == side and (x, y) in p for p, o in zip(parts, one, strict=True)) for x in range(w)] for y in range(h)]
            a, b = of(True), of(False)
            start, end = (a, b) if away(kept[0], a) <= away(kept[0], b) else (b, a)
    gap = math.inf
    if end is not None:
        gap = away(foot, end) if start is None else min((math.dist(p, q) for p in cells(start) for q in cells(end)), default=math.inf)
    if not 0 < gap < math.inf:
        middle = lambda m: tuple(sum(v) / len(v) for v in zip(*cells(m), strict=True))
        gap = math.dist(middle(start) if start is not None else foot, middle(end) if end is not None else (w / 2, h / 2))
    to_start = [math.dist(p, foot) if start is None else away(p, start) for p in kept]
    to_end = [math.inf if end is None else away(p, end) for p in kept]
    near = lambda x: max(0.0, 1 - 3 * x / diag)
    total = near(to_start[0])
    for i in range(1, n):
        p, q, last = kept[i - 1], kept[i], i == n - 1
        inside = 0
        for k in range(50):
            t = (k + 0.5) / 50
            x, y = round(p[0] * (1 - t) + q[0] * t), round(p[1] * (1 - t) + q[1] * t)
            inside += 0 <= x < w and 0 <= y < h and bool(area[y][x])
        steady = diag / 30 <= math.dist(p, q) <= (gap * 2 / 3 if gap > 0 else diag)
        more, closer = to_start[i] > to_start[i - 1], to_end[i] < to_end[i - 1]
        if last:
            score = 0.3 * near(to_end[i]) + 0.4 * inside / 50 + 0.1 * more + 0.1 * closer
            total += (score + 0.1 * steady) / 1.0 if n >= 3 else score / 0.9
        else:
            total += 0.4 * inside / 50 + 0.2 * more + 0.2 * closer + 0.2 * steady
    return total / n


def runs_of(mask):
    flat = np.array(mask, np.int8).T.ravel()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flat, [0]])))
    return [{"s": int(a), "e": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def test_path_score_against_the_rules(spark):
    rnd, rows, want = random.Random(8), [], []
    for i in range(200):
        h, w = rnd.randrange(6, 18), rnd.randrange(6, 20)
        blob = lambda k: [[any(abs(x - cx) <= rx and abs(y - cy) <= ry for cx, cy, rx, ry in k) for x in range(w)] for y in range(h)]
        spots = lambda n: [(rnd.randrange(w), rnd.randrange(h), rnd.randrange(3), rnd.randrange(3)) for _ in range(n)]
        area, goal = blob(spots(4)), blob(spots(rnd.choice((0, 1, 2, 3))))
        points = [(rnd.randrange(4 * w) / 4, rnd.randrange(4 * h) / 4) for _ in range(rnd.randrange(1, 8))]
        exo = i % 2 == 0
        rows.append((i, [{"x": x, "y": y} for x, y in points], runs_of(area), runs_of(goal), h, w, exo))
        want.append(slow_path(points, area, goal, h, w, exo))
    kind = "i int, points array<struct<x:double,y:double>>, feasible array<struct<s:int,e:int>>, target array<struct<s:int,e:int>>, h int, w int, exo boolean"
    got = {r.i: r.score for r in path.path_scores(spark.createDataFrame(rows, kind), "i").collect()}
    assert all(abs(got[i] - x) < 1e-9 for i, x in enumerate(want))


def test_path_errors_are_told(spark):
    run = [{"s": 0, "e": 20}]
    rows = [(1, None, run, run, 5, 4, True), (2, [{"x": 1.0, "y": 1.0}], None, run, 5, 4, True), (3, [{"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 1.1}, {"x": 3.0, "y": 3.0}], run, None, 5, 4, False), (4, [], run, run, 5, 4, None)]
    df = spark.createDataFrame(rows, "i int, p array<struct<x:double,y:double>>, f array<struct<s:int,e:int>>, t array<struct<s:int,e:int>>, h int, w int, e boolean")
    got = {r.i: r for r in df.select("i", path.result("p", "f", "t", "h", "w", "e").alias("r"), path.score_only("p", "f", "t", "h", "w", "e").alias("s")).collect()}
    assert got[1].r.error == "No path points parsed" and "mask" in got[2].r.error and got[4].s.error is None and got[4].s.score == 0
    assert [p.used for p in got[3].r.points] == [True, False, True] and got[3].r.after == 2 and 0 < got[3].r.score < 1 and got[3].r.points[1].score is None


def test_box_iou_equals_runs(spark):
    rnd = random.Random(5)
    box = lambda: {"x1": (a := rnd.randrange(20)), "y1": (b := rnd.randrange(15)), "x2": a + rnd.randrange(6), "y2": b + rnd.randrange(6)}
    data = [(i, [box() for _ in range(rnd.randrange(4))], [box() for _ in range(rnd.choice((1, 1, 1, 2, 0)))]) for i in range(300)]
    kind = "array<struct<x1:int,y1:int,x2:int,y2:int>>"
    df = spark.createDataFrame(data, f"i int, p {kind}, t {kind}")
    h = F.lit(30)
    got = df.select(masks.box_iou(F.col("p"), F.col("t"), h).alias("a"), masks.iou(masks.box_runs(F.col("p"), h), masks.box_runs(F.col("t"), h)).alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-12 for r in got)


def test_masks_of_lists(spark):
    good, other = {"size": [3, 4], "counts": [2, 3, 7]}, {"size": [3, 4], "counts": [8, 2, 2]}
    cases = [([good, other], (3, 4, 5)), ([{"size": "x"}, good, {"size": [4, 3], "counts": [0, 12]}], (3, 4, 3)), (good, (3, 4, 3)), ([], None), ("x", None), ([{"size": [3, 4], "counts": [0, 99]}], (3, 4, 12))]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(98, "{"), (99, None)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", masks.decode("t").alias("m")).collect()}
    for i, (_, want) in enumerate(cases):
        covered = len({x for r in got[i].runs for x in range(r.s, r.e)}) if got[i] and got[i].h is not None else None
        assert (want is None and covered is None) or (got[i].h, got[i].w, covered) == want
    assert all(got[k] is None or got[k].h is None for k in (98, 99))


def test_compressed_masks_of_a_known_text():
    # a published example of the format: nine rows, ten columns
    assert masks.counts_of("61X13mN000`0") == [6, 1, 40, 4, 5, 4, 5, 4, 21]
    assert masks.mask_of({"size": [9, 10], "counts": "61X13mN000`0"})[2] == [(6, 7), (47, 51), (56, 60), (65, 69)]


def test_localization_traps(spark):
    full = '[{"size": [10, 10], "counts": [0, 100]}]'
    rows = [
        ("[]", "[]", None, 1.0, None), ("[]", full, None, 0.0, None), ("[]", full, 0, 1.0, None), ('[[0, 0, 5, 10]]', full, None, 0.5, None), ('[[0, 0, 5, 10, 0.9]]', full, None, 0.5, None),
        ('["No Valid Response"]', "[]", None, 1.0, None), ('"No Valid Response"', full, None, 0.0, "No Valid Response"), ('"not required "', full, None, 0.0, None), ("null", full, None, 0.0, "No Valid Response"),
        ('[[0, 0, 5, 10]]', "[]", None, 0.0, None), ('[[0, 0, 5, 10]]', '[{"size": [1]}]', None, 0.0, "Failed to decode GT mask or GT mask is missing"), ('[[0, 0, 0.5, 1]]', full, None, 0.5, None), ('[[0, 0, 500, 1000]]', full, None, 0.5, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, g string, n int, want double, error string")
    x = df.select("*", F.parse_json("v").alias("vv"), masks.decode("g").alias("gm"), masks.decode("v").alias("pm"))
    r = scores.localization_result(F.col("vv"), F.lit("bbox"), F.lit("auto"), F.col("g") != "[]", F.col("gm"), F.col("n"), F.col("pm"))
    for row in x.select("i", "want", "error", r.alias("r")).collect():
        assert row.r.score == row.want and row.r.error == row.error, row


def test_scorers_and_placeholders(spark):
    df = spark.createDataFrame([("Nowhere", "Thing", 1.0, 1.0, "Missing x"), ("Manipulation", "Placement", 1.0, 0.0, None), ("Navigation", "VisualMatching", 0.5, 1.0, "GT missing")], "category string, kind string, localization double, count double, localization_error string")
    for c in ("path", "binary"):
        df = df.withColumn(c, F.lit(1.0))
    for c in ("count", "path", "binary"):
        df = df.withColumn(f"{c}_error", F.lit(None).cast("string"))
    got = {r.kind: r for r in scoring.score_samples(df.withColumn("precise", F.lit(None).cast("boolean")).withColumn("described", F.lit(None).cast("boolean"))).collect()}
    assert got["Thing"].score == 0 and not got["Thing"].invalid and got["Thing"].error is None
    assert got["Placement"].score == 1.0 and got["VisualMatching"].score == 0.75 and not got["VisualMatching"].invalid
    assert ("Navigation", "FeasiblePath") in scoring.registered() and filters.scorer("Manipulation", "Affordance") is scoring.located
    calls = spark.createDataFrame([(1.0,), (0.0,)], "x double").select(scoring.guarded(lambda r: 1 / r["x"])(F.struct("x")).alias("r")).collect()
    assert calls[0].r.score == 1.0 and calls[1].r.score == 0.0 and calls[1].r.error.startswith("ZeroDivisionError: ")


def test_choices_and_boxes():
    assert choices.choose(["(C) is it", "plum", "x: B", "zzz"], ["apple", "plum", "fig"], r"\(([A-Z])\)") == ["C", "(B)", "(B)", "[invalid]"]
    assert choices.choose(["a (A) or (B)"], ["x", "y"], r"\(([A-Z])\)", group=-1) == ["B"]
    assert choices.choose_simply("It's B: two dogs!", "Q\nA. one cat\nB. two dogs") == "B" and choices.choose_simply("none!", "Q\nA. x y") == "none"
    assert choices.short_answer("The U.S. isn't two-faced, dont") == "us isn't 2 faced don't" and choices.short_answer("") == ""


def test_last_boxed(spark):
    rows = [("a \\boxed{1} \\boxed{\\frac{1}{2}} b",), ("\\fbox{x}",), ("\\boxed{y} \\fbox{z}",), ("none",), ("\\boxed{",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.last_boxed("t")).collect()]
    assert got == ["\\boxed{\\frac{1}{2}}", "\\fbox{x}", "\\boxed{y}", None, None, None]


def test_corpus_scores_against_definitions(spark):
    pairs = [("the cat sat on the mat", "the cat sat on a mat"), ("a dog", "a dog barks, loudly."), ("", "x y"), ("same text here now", "same text here now")]
    got = metrics.corpus_scores(spark.createDataFrame(pairs, "p string, r string"), "p", "r").first()
    grams = lambda s, n: [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]
    clip = lambda a, b: sum(min(a.count(g), b.count(g)) for g in set(a))
    tok = lambda s: s.replace(",", " , ").replace(".", " . ").split()
    logs = [math.log(sum(clip(grams(tok(p), n), grams(tok(r), n)) for p, r in pairs) / sum(len(grams(tok(p), n)) for p, _ in pairs)) for n in range(1, 5)]
    c, r_ = sum(len(tok(p)) for p, _ in pairs), sum(len(tok(r)) for _, r in pairs)
    assert abs(got.bleu - 100 * min(1, math.exp(1 - r_ / c)) * math.exp(sum(logs) / 4)) < 1e-6
    strip = lambda s: s.replace(" ", "")
    ps, rs = [], []
    for n in range(1, 7):
        m = sum(clip(grams(strip(p), n), grams(strip(r), n)) for p, r in pairs)
        ps.append(m / sum(len(grams(strip(p), n)) for p, _ in pairs))
        rs.append(m / sum(len(grams(strip(r), n)) for _, r in pairs))
    p, r = sum(ps) / 6, sum(rs) / 6
    assert abs(got.chrf - 100 * 5 * p * r / (4 * p + r)) < 1e-6
    assert abs(got.ter - 100 * (1 + 2 + 2 + 0) / (6 + 4 + 2 + 4)) < 1e-9


def test_visible_text(spark):
    page = "<html><head><title> T </title><style>x{}</style></head><body><p>One <b>two</b></p>\n<script>var a;</script> three &amp; four </body></html>"
    assert spark.createDataFrame([(page,), (None,)], "h string").select(text.visible_text("h")).collect()[0][0] == "T\nOne\ntwo\nthree & four"


def test_kcenter_by_rounds(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 5)), np.repeat(rng.normal(size=(3, 5)), 10, 0)])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (999, None)], "k long, v array<double>").repartition(4)
    picks, d = [], np.full(len(x), np.inf)
    for _ in range(40):
        picks.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[picks[-1]]) ** 2).sum(1))
    for many in (5, 40, 4096):
        got = relational.kcenter(df, "k", "v", 40, many).orderBy("pick").collect()
        assert [r.key for r in got] == picks, many
    assert relational.kcenter(df.where("k < 3"), "k", "v", 9).count() == 3 and relational.kcenter(df.where("k < 0"), "k", "v", 9).count() == 0


def test_rollup_rules(spark):
    assert rollup.stderr_rule("bleu", 1000) == ("bootstrap", 100) and rollup.stderr_rule("median", 1000) == ("bootstrap", 1000)
    assert rollup.stderr_rule("acc", 1000) == ("formula", 0) and rollup.stderr_rule("acc", 0) is None and rollup.stderr_rule("custom", 5) is None
    with pytest.raises(KeyError, match="no metric"):
        filters.aggregation("unheard of")
    assert filters.higher_is_better("ter") is False and filters.higher_is_better("unheard of") is None
    one = rollup.task_metrics(spark.createDataFrame([("t", "acc", "none", 1.0)], "task string, metric string, filter string, value double")).first()
    assert one.stderr is None and one.value == 1.0


def test_order_and_batches(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice((5, 5, 5, rnd.randrange(100)))) for i in range(500)]
    got = instances.longest_first(spark.createDataFrame(rows, "seq long, n int"), "n", 7).collect()
    assert [r.seq for r in sorted(got, key=lambda r: r.place)] == [s for s, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] and all(r.batch == r.place // 7 for r in got)
    assert instances.longest_first(spark.createDataFrame([], "seq long, n int"), "n", 7).count() == 0
    half = rollup.median_of(spark.createDataFrame([("a", i, i * 7 % 31) for i in range(31)] + [("b", 1, 5)], "g string, s long, v long"), ["g"], "v", "s")
    assert {tuple(r) for r in half.collect()} == {("a", 15 * 7 % 31), ("b", 5)}


def test_frames(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c).first()[0]
    for total, count in ((10, 4), (3, 8), (1, 5), (100, 1)):
        want = np.linspace(0, total - 1, min(total, count), dtype=int).tolist()
        assert ask(frames.stream_frames(F.lit(total), F.lit(count))) == want
    assert ask(frames.stream_frames(F.lit(9), F.lit(1), with_last=True)) == [8] and ask(frames.packet_frames(F.lit(9), F.lit(1))) == [0, 8]
    assert ask(frames.viewport_offsets(F.lit(25), F.lit(10))) == [0, 10, 20] and ask(frames.squeezed(F.array(F.array(F.lit(1))))) == [1]


def test_names_and_configuration(tmp_path):
    assert names.arguments(" a=1,b=x,c=TRUE,d=2.5,") == {"a": 1, "b": "x", "c": True, "d": 2.5} and names.arguments("") == {}
    base, own, group = tmp_path / "base.json", tmp_path / "own.json", tmp_path / "sub"
    base.write_text('{"dataset": "d", "num_fewshot": 5, "tag": ["easy"]}')
    own.write_text('{"include": "base.json", "task": "mine", "num_fewshot": 0}')
    group.mkdir()
    (group / "g.json").write_text('{"group": "all", "task": ["mine", {"task": "other"}, "easy"]}')
    (group / "broken.json").write_text("{")
    c = config.load(str(own))
    assert c == {"dataset": "d", "num_fewshot": 0, "tag": ["easy"], "task": "mine"}
    full = config.complete(c)
    assert full["metric_list"] == [{"metric": "exact_match"}] and config.overridden(full, "bypass")["metric_list"][0]["metric"] == "bypass"
    with pytest.raises(ValueError, match="doc_to_choice"):
        config.complete({"output_type": "multiple_choice"})
    rows = config.entries(str(tmp_path))
    assert ("all", "group", None, str(group / "g.json")) in rows and ("easy", "tag", None, "") in rows
    assert config.resolved(["a*", "mine"], rows) == {"all": ["mine", "other", "mine"], "mine": ["mine"]} and config.matching(["m*", "e?sy"], ["mine", "easy", "x"]) == ["easy", "mine"]
    with pytest.raises(KeyError):
        config.resolved(["nothing"], rows)
    assert config.function("math.sqrt")(9) == 3 and config.sample_size(10, 0.25) == 3 and config.sample_size(10, None) is None
    assert config.cache_modes("refresh") == {"cache_requests": True, "rewrite_requests_cache": True, "delete_requests_cache": False}
    assert config.for_model({"model_specific_kwargs": {"default": {"a": 1}}}, "m") == {"a": 1} and config.fewshot_split({"test_split": "t", "training_split": "r"}) == "r"
    assert [e for *_, e in config.isolated([{"n": 1}, {"n": 0}], lambda c: 1 / c["n"])] == [None, "ZeroDivisionError: division by zero"]


def test_discovery(spark, tmp_path):
    for f in ("r1/Qwen/a.jsonl", "r1/Own/b.jsonl", "r2/Qwen/c.jsonl", "skip/Qwen/d.jsonl"):
        os.makedirs(os.path.dirname(tmp_path / f), exist_ok=True)
        (tmp_path / f).write_text('{"response": [["x", "y"]]}\n')
    got = readers.result_files(spark, str(tmp_path), ["r1", "skip"], ["Qwen"], ("skip",)).collect()
    assert [(r["round"], r.family, r.model) for r in got] == [("r1", "Qwen", "a")]
    assert readers.first_found(spark, [f"{tmp_path}/none*", f"{tmp_path}/r*/Qwen/*.jsonl"]).endswith("r1/Qwen/a.jsonl") and readers.first_found(spark, [f"{tmp_path}/no"]) is None
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x_samples_1.json").write_text('{"response": [["x", "y"]]}\nbad\n{"response": null}\n')
    assert sorted(r.response for r in readers.merged_samples(spark, f"{tmp_path}/m").collect()) == ["", "x"]
    spark.createDataFrame([(1, b"x", ("p", b"y"))], "i int, b binary, s struct<path:string,bytes:binary>").write.parquet(f"{tmp_path}/t.parquet")
    assert readers.media_free(readers.any_table(spark, f"{tmp_path}/t.parquet")).columns == ["i"]
    docs = spark.sql("""select parse_json('{"text_annotation": {"a": 1}, "mask_annotation": {"a": 2, "b": [3]}}') d, parse_json('{"b": 9, "c": 4, "gt_json_path": ["p.json"]}') o""")
    one = docs.select(readers.truth_field(F.col("d"), F.col("o"), "a").cast("string"), readers.truth_field(F.col("d"), F.col("o"), "x", "c").cast("string"), readers.truth_file(F.col("o"))).first()
    assert tuple(one) == ("1", "4", "p.json")


def test_truth_flags(spark):
    rows = [('"Yes"', True), ("[false]", False), ("2", True), ('"maybe"', False), ("null", False)]
    got = spark.createDataFrame(rows, "t string, w boolean").select("w", scores.truth_flag(F.parse_json("t")).alias("f")).collect()
    assert all(r.f == r.w for r in got)


def test_sinks(spark, tmp_path):
    rows = [("TargetLocalization", "Color", "a/b", "a", 1.0, False), ("Navigation", "GroundDetection", None, None, 0.5, True)]
    scored = spark.createDataFrame(rows, "category string, leaf string, by_type string, by_group string, score double, invalid boolean")
    sinks.evaluation_json(report.score_report(scored), scored, str(tmp_path / "eval"), "std.jsonl")
    head = spark.read.json(f"{tmp_path}/eval/summary").first()
    assert head.std_response_jsonl == "std.jsonl" and head.summary.overall.average_score == 0.75 and head.summary.by_category.Navigation.num_invalid_response == 1
    assert spark.read.json(f"{tmp_path}/eval/samples").count() == 2
    sinks.json_array(spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"), str(tmp_path / "arr"))
    assert readers.json_records(spark, f"{tmp_path}/arr", whole=True).count() == 2
    sinks.sample_log(spark.createDataFrame([("t1", 1), ("t2", 2)], "task string, v int"), str(tmp_path / "log"))
    sinks.sample_log(spark.createDataFrame([("t1", 3)], "task string, v int"), str(tmp_path / "log"))
    assert spark.read.json(f"{tmp_path}/log/task=t1").count() == 2
    assert sinks.mirrored_name("/a/b/c.json", "/a", "std_") == "b/std_c.jsonl" and "0.5000 & N/A" in sinks.latex_table(spark.createDataFrame([("a_b", "acc", 0.5, None)], "task string, metric string, value double, stderr double"))
    a = sinks.request_cache(spark.range(3), str(tmp_path / "cache"))
    assert a.count() == 3 and sinks.request_cache(spark.range(9), str(tmp_path / "cache")).count() == 3 and sinks.request_cache(spark.range(9), str(tmp_path / "cache"), refresh=True).count() == 9


def test_prompts_and_messages(spark):
    assert converters.prompt_table(spark).count() == 7 * 2 * 6
    m = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("content")) for r, t in (("system", "S."), ("user", "U"))])
    x = spark.range(1).select(converters.question(m).alias("q"), F.size(converters.answered(m, F.lit("A"))).alias("n")).first()
    assert x.q == "S.U" and x.n == 3
    with pytest.raises(KeyError):
        converters.filled("{{missing}}", {})
    assert benchrows.page_information(F.lit("a")) is not None and len(catalog.leaves()) == 23


def test_incremental(spark, tmp_path):
    asked = []
    r = spark.createDataFrame([(i, f"k{i}", i % 2 == 0) for i in range(6)], "seq int, key string, free boolean")
    cache = spark.createDataFrame([("k0", "old"), ("k1", "old")], "key string, response string")
    out = incremental.answered(r, cache, lambda x: x.withColumn("response", F.lit("new")), sampled=F.col("free"), seq="seq").collect()
    assert [(x.seq, x.response) for x in out] == [(0, "new"), (1, "old"), (2, "new"), (3, "new"), (4, "new"), (5, "new")]

    def respond(x):
        asked.append(x.count())
        return x.withColumn("response", F.concat(F.lit("r"), F.col("key")))

    p = str(tmp_path / "cache")
    assert incremental.answered_through(r.where("seq < 3"), p, respond).count() == 3
    assert {x.response for x in incremental.answered_through(r, p, respond).collect()} == {f"rk{i}" for i in range(6)} and asked == [3, 3]
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "k int, ts string").selectExpr("k", "timestamp(ts) ts").write.parquet(src)
    stream = lambda: spark.readStream.schema("k int, ts timestamp").parquet(src)
    q = incremental.score_stream(stream(), lambda x: x.withColumn("score", F.lit(1.0)), "k", str(tmp_path / "out"), str(tmp_path / "c1"), at="ts")
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = incremental.append_stream(stream(), lambda x: x.withColumn("error", F.when(F.col("k") == 2, "failed")), str(tmp_path / "cap"), str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/cap/rows").count() == 2 and spark.read.parquet(f"{tmp_path}/cap/errors").count() == 1
