"""More registered queries, each beside its SQL: answers, filters, roll-ups, requests, benchmark rows, converters.

Where a function reads text, rows take one of a few texts by their key, and the SQL holds what each of them must give,
worked out by hand from the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import answers, choices, coords, frames, masks, metrics, names, scores, text
from .operators import benchrows, converters, explorer, filters, instances, relational, rollup, scoring, zipparts
from .plans import catalog
from .queries import H, W, query, read
from .sources import readers


def quoted(values) -> str:
    """A list literal of texts, numbers, truth values, nulls and lists of them."""
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int | float):
            return f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
        if isinstance(v, list):
            return quoted(v)
        return "'" + v.replace("'", "''") + "'"

    return "[" + ", ".join(map(one, values)) + "]"


def by_key(values: list, key):
    """The value of the row's turn."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def in_turn(values: list, key: str) -> str:
    return f"{quoted(values)}[({key}) % {len(values)} + 1]"


MODES = ["normalized", "normalized_1000", "Normalized", "absolute", "auto", "", None, "normalized_0_1", "pixel", "normalized_0_1000"]
# numbers in turn: within [0, 1], within the canvas, beyond it, none
_TOLD = "CASE event_id % 4 WHEN 0 THEN 'normalized_0_1' WHEN 1 THEN 'absolute' WHEN 2 THEN 'normalized_0_1000' ELSE 'absolute' END"


@query("coord_aliases", f"""WITH t AS (SELECT event_id, {in_turn(MODES, "event_id // 4")} AS mode FROM events)
    SELECT event_id, CASE WHEN mode = 'normalized' THEN 'normalized_0_1' WHEN mode = 'normalized_1000' THEN 'normalized_0_1000' WHEN mode IN ('absolute', 'normalized_0_1', 'normalized_0_1000') THEN mode ELSE {_TOLD} END AS actual FROM t""")
def coord_aliases(spark, d):
    e = F.col("event_id")
    values = F.when(e % 4 == 0, F.array(F.lit(0.2), F.lit(1.0))).when(e % 4 == 1, F.array(F.lit(3.0), F.lit(48.0))).when(e % 4 == 2, F.array(F.lit(3.0), F.lit(49.0))).otherwise(F.array().cast("array<double>"))
    return read(spark, d, "events").select("event_id", coords.actual_mode(values, F.lit(H), F.lit(W), by_key(MODES, F.floor(e / 4))).alias("actual"))


LENIENT = ["[[1, 2, 3, 4, 9], [\"5\", 6, 7, 8.5], [1, 2, 3], \"x\", [1, 2, null, 4]]", "[]", "[true]", "\" 12 \"", "[\"3.0\"]", "3.9", "[\"no\"]", "\"Yes\"", "[0]", "{\"a\": 1}", "null", "[[1, 2], [\"3\", 4, 5], [6]]", "\"abc\"", "[-2.5]", "\"No Valid Response\"", "\" not required\""]
_BOXES = ["[[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.5]]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]", "[]"]
_POINTS = [4, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0]
_COUNTS = [None, None, 1, 12, 3, 3, None, None, 0, None, None, None, None, -2, None, None]
_FLAGS = [None, None, True, None, None, True, False, True, False, None, None, None, None, True, None, None]
_STATES = ["given", "given", "given", "given", "given", "given", "given", "given", "given", "given", "missing", "given", "given", "given", "missing", "unneeded"]


@query("lenient_parsers", f"SELECT event_id, {in_turn(_BOXES, 'event_id')} AS boxes, {in_turn(_POINTS, 'event_id')}::INTEGER AS points, {in_turn(_COUNTS, 'event_id')}::INTEGER AS n, {in_turn(_FLAGS, 'event_id')} AS flag, {in_turn(_STATES, 'event_id')} AS state FROM events")
def lenient_parsers(spark, d):
    v = F.col("v")
    x = read(spark, d, "events").select("event_id", F.parse_json(by_key(LENIENT, F.col("event_id"))).alias("v"))
    boxes = F.concat(F.lit("["), F.array_join(F.transform(scores.lenient_boxes(v), lambda b: F.concat(F.lit("["), F.array_join(F.transform(b, lambda n: n.cast("string")), ", "), F.lit("]"))), ", "), F.lit("]"))
    return x.select("event_id", boxes.alias("boxes"), F.size(scores.lenient_points(v)).alias("points"), scores.lenient_count(v).alias("n"), scores.lenient_flag(v).alias("flag"), scores.answer_state(v).alias("state"))


_FRUIT = ["12 apples and 7 pears", " 3 pears", "none", "4 apples 5 apples", "0 apples"]


@query("regex_groups", f"SELECT conv_id, turn, {in_turn(['12', '3', '[invalid]', '4', '0'], 'conv_id')} AS first, {in_turn(['7', '3', '[invalid]', '5', '0'], 'conv_id')} AS last, {in_turn(['', '', '[invalid]', '', ''], 'conv_id')} AS blank FROM conversations")
def regex_groups(spark, d):
    x = read(spark, d, "conversations").select("conv_id", "turn", F.array(by_key(_FRUIT, F.col("conv_id"))).alias("r"))
    steps = {"first": [("regex", r"(\d+) apples|(\d+) pears", 0), ("take_first",)], "last": [("regex", r"(\d+) apples|(\d+) pears", -1), ("take_first",)], "blank": [("regex", r"\d+( *)", 0), ("take_first",)]}
    return filters.pipeline(x, "r", steps).select("conv_id", "turn", "first", "last", "blank")


# (answer, category, type, canonical text, localization, count, path, binary)
NR, NO = '["Not Required"]', '["No Valid Response"]'
_TL = "TargetLocalization"
ANSWERS = [
    ("Sure.\n```json\n{'number_of_objects': 2, 'bounding_boxes': [(1, 2, 3.5, 4), [5, 6, 7, 8]]}\n```", _TL, "Color", '{"number_of_objects": 2, "bounding_boxes": [[1, 2, 3.5, 4], [5, 6, 7, 8]]}', "[[1, 2, 3.5, 4], [5, 6, 7, 8]]", "[2]", NR, NR),
    ("<think>{'number_of_objects': 9}</think> I see {\"number_of_objects\": \"3\"} there", _TL, "Material", '{"number_of_objects": 3, "bounding_boxes": []}', "[]", "[3]", NR, NR),
    ("<think>{'number_of_objects': 9, 'bounding_boxes': []}", _TL, "Color", NO[2:-2], NO, NO, NR, NR),
    ('{"number_of_objects": "3.0", "bounding_boxes": []}', _TL, "Color", NO[2:-2], NO, NO, NR, NR),
    ("{'bounding_boxes': [[[1, 2], [3, 4]], [[5, 6, 7, 8]], [1, 2, 3]]}", "Navigation", "GroundDetection", '{"bounding_boxes": [[1, 2, 3, 4], [5, 6, 7, 8]]}', "[[1, 2, 3, 4], [5, 6, 7, 8]]", NR, NR, NR),
    ("{'count': 3}", "Navigation", "GroundDetection", NO[2:-2], NO, NR, NR, NR),
    ("Path: {'points': [(1, 2), (3, 4), (5, 6)], 'x': None}", "Navigation", "FeasiblePath_Exo", '{"points": [[1, 2], [3, 4], [5, 6]]}', NR, NR, "[[1, 2], [3, 4], [5, 6]]", NR),
    ("{'points': [(1, 2), (3, 4)]}", "Navigation", "FeasiblePath_Ego", NO[2:-2], NR, NR, NO, NR),
    ('{"bounding_boxes": [[1, 2, 3, 4]]}', "Navigation", "VisualMatching", '{"bounding_boxes": [[1, 2, 3, 4]]}', "[[1, 2, 3, 4]]", NO, NR, NR),
    ("{'number_of_instances': 4.7, 'bounding_boxes': None}", "Manipulation", "ContactRelationship_TypeTwo", '{"number_of_instances": 4, "bounding_boxes": []}', "[]", "[4]", NR, NR),
    ("{'bounding_boxes': [], 'placement_feasibility': 'Yes'}", "Manipulation", "PlacementRegion", '{"bounding_boxes": [], "placement_feasibility": true}', "[]", NR, NR, "[true]"),
    ("{'bounding_boxes': []}", "Manipulation", "PlacementRegion", NO[2:-2], NO, NR, NR, NO),
    ("{'bounding_boxes': [(1, 2, 3, 4)], 'note': 'it is \"far\"'}", "Manipulation", "AffordanceRegion", NO[2:-2], NO, NR, NR, NR),
    ("```json\n{\"a\": 1}\n```", "Elsewhere", "Unknown", '{"a": 1}', NR, NR, NR, NR),
    ("", _TL, "Color", NO[2:-2], NO, NO, NR, NR),
]


@query("answer_fields", "SELECT conv_id, turn, " + ", ".join(f"{in_turn([a[k] for a in ANSWERS], 'conv_id')} AS {n}" for k, n in ((3, "formatted"), (4, "localization"), (5, "count"), (6, "path"), (7, "binary"))) + " FROM conversations")
def answer_fields(spark, d):
    of = lambda k: by_key([a[k] for a in ANSWERS], F.col("conv_id"))
    x = read(spark, d, "conversations").select("conv_id", "turn", of(0).alias("r"), of(1).alias("c"), of(2).alias("k"))
    x = x.withColumn("needs", catalog.required(F.col("c"), F.col("k")))
    return x.select("conv_id", "turn", answers.formatted_text("r", "c", "k").alias("formatted"), answers.standardize("r", "c", "k", "needs").alias("f")).select("conv_id", "turn", "formatted", "f.*")


@query("mask_format_score", """WITH e AS (SELECT event_id AS sid, [event_id % 5, 3 + event_id % 7, event_id % 4, 2 + user_id % 9, 50] AS a, [user_id % 6, 4 + user_id % 5, event_id % 3, 1 + event_id % 6] AS b, event_id % 11 AS k FROM events),
    p AS (SELECT sid, 1 AS k, unnest(list_concat(range(a[1], least(a[1] + a[2], 32)), range(a[1] + a[2] + a[3], least(a[1] + a[2] + a[3] + a[4], 32)))) AS x FROM e
          UNION ALL SELECT sid, 2, unnest(list_concat(range(b[1], least(b[1] + b[2], 32)), range(b[1] + b[2] + b[3], least(b[1] + b[2] + b[3] + b[4], 32)))) FROM e),
    n AS (SELECT sid, x, min(k) AS lo, max(k) AS hi FROM p GROUP BY ALL), iou AS (SELECT sid, count(*) FILTER (lo < hi) / count(*)::DOUBLE AS v FROM n GROUP BY sid)
    SELECT sid, round(CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 WHEN 5 THEN 0.0 WHEN 6 THEN 0.0 WHEN 7 THEN 1.0 ELSE v END, 9) AS score,
      CASE k WHEN 0 THEN 'No Valid Response' WHEN 2 THEN 'Failed to decode predicted mask response' WHEN 3 THEN 'Pred mask shape does not match GT mask shape' WHEN 4 THEN 'Failed to decode GT mask or GT mask is missing' END AS error
    FROM e JOIN iou USING (sid)""")
def mask_format_score(spark, d):
    e, u, k = F.col("event_id").cast("int"), F.col("user_id").cast("int"), F.col("event_id") % 11
    rle = lambda size, *c: F.concat(F.lit(f'{{"size": {size}, "counts": ['), F.concat_ws(", ", *[x.cast("string") for x in c]), F.lit("]}"))
    a, b = rle("[8, 4]", e % 5, 3 + e % 7, e % 4, 2 + u % 9, F.lit(50)), rle("[8, 4]", u % 6, 4 + u % 5, e % 3, 1 + e % 6)
    pred = F.when(k == 0, F.lit(None).cast("string")).when(k.isin(1, 6), "[]").when(k == 2, '[{"size": [8], "counts": [1]}]').when(k == 3, rle("[4, 8]", F.lit(1), F.lit(3))).when(k == 7, '{"size": [8, 4], "counts": [32]}').otherwise(F.concat(F.lit("["), a, F.lit("]")))
    truth = F.when(k.isin(1, 5, 7), F.lit("[]")).when(k == 4, '[{"size": [8, 4]}]').otherwise(b)
    x = read(spark, d, "events").select(F.col("event_id").alias("sid"), pred.alias("p"), truth.alias("t"))
    x = x.select("sid", F.parse_json("p").alias("v"), masks.decode("p").alias("pm"), masks.decode("t").alias("gm"), (F.col("t") != "[]").alias("given"))
    r = scores.localization_result(F.col("v"), F.lit("mask"), F.lit("auto"), F.col("given"), F.col("gm"), F.lit(None).cast("int"), F.col("pm"))
    return x.select("sid", r.alias("r")).select("sid", F.round("r.score", 9).alias("score"), "r.error")


_CHOSEN = ["The answer is (B).", "I think the Red Apple!", "answer: C", "no idea", "#### 7", "a green pear, surely"]
_SIMPLE = ["It is a big cat.", "dog", "nothing here", "a bird, of course"]
_BOXED = ["so \\boxed{b}", "\\boxed{\\text{C}} or \\boxed{42}", "Final answer: d", "\\fbox{x}", "none", "\\boxed{unclosed"]
_SHORT = ["Two cats, and the dog?", "It's a red-ball.", "dont know", "NONE", "U.S. No. 5", "yes!", "a 1,000 things"]


@query("choice_filters", f"""SELECT conv_id, turn, {in_turn(['(B)', '(A)', '(C)', '[invalid]', '7', '(B)'], 'conv_id')} AS picked, {in_turn(['A', 'B', 'nothing here', 'C'], 'conv_id')} AS simple,
    {in_turn(['b', '42', '', '\\fbox{x', '', ''], 'conv_id')} AS boxed, {in_turn(['B', '42', None, '\\fbox{x', None, None], 'conv_id')} AS strict, {in_turn(['B', '42', 'D', '\\fbox{x', None, None], 'conv_id')} AS loose,
    {in_turn(['2 cats and dog', "it 's red ball", "don't know", '0', 'us no 5', 'yes', '1000 things'], 'conv_id')} AS short FROM conversations""")
def choice_filters(spark, d):
    k = F.col("conv_id")
    x = read(spark, d, "conversations").select("conv_id", "turn", F.array(by_key(_CHOSEN, k)).alias("r"), F.array(F.lit("red apple"), F.lit("green pear"), F.lit("plum")).alias("c"), F.array(by_key(_SIMPLE, k)).alias("s"), by_key(_BOXED, k).alias("b"), by_key(_SHORT, k).alias("n"))
    picked = choices.multi_choice(F.col("r"), F.col("c"), r"\(([A-Z])\)|#### (\d+)", ignore_case=True, ignore_punctuation=True)
    simple = choices.simple_choice(F.col("s"), F.lit("Which?\nA. cat\nB. dog\nC. bird"))
    return x.select("conv_id", "turn", F.get(picked, F.lit(0)).alias("p"), simple.alias("simple"), choices.boxed_answer(F.col("b")).alias("boxed"), choices.option_pred(F.col("b")).alias("strict"), choices.option_pred(F.col("b"), False).alias("loose"), choices.normal_answer("n").alias("short")).select(
        "conv_id", "turn", F.when(F.col("p") == "B", "(B)").otherwise(F.col("p")).alias("picked"), "simple", "boxed", "strict", "loose", "short")


_MARKED = ["**bounding_boxes**: [(1, 2, 3, 4)]\n**number_of_objects**: 2", "**bounding_boxes**: [(1, 2]\n**number_of_objects**:  x", "**number_of_objects**: 7", ""]


@query("box_and_count", f"SELECT conv_id, turn, {in_turn(['[(1, 2, 3, 4)]', None, None, None], 'conv_id')} AS boxes, {in_turn([2, None, 7, None], 'conv_id')}::INTEGER AS count FROM conversations")
def box_and_count(spark, d):
    x = read(spark, d, "conversations").select("conv_id", "turn", by_key(_MARKED, F.col("conv_id")).alias("m"))
    return x.select("conv_id", "turn", choices.box_and_count(F.col("m")).alias("r")).select("conv_id", "turn", "r.*")


_FILES = ["org/models/llava:7b", "one", "a/b", "x<y>/z|w"]


@query("name_functions", rf"""WITH t AS (SELECT p_partkey, p_name, {in_turn(_FILES, 'p_partkey')} AS m FROM part)
    SELECT p_partkey, {in_turn(['models__llava__7b', 'one', 'a__b', 'x__y__z__w'], 'p_partkey')} AS model, {in_turn(['org__models__llava__7b', 'one', 'a__b', 'x__y__z__w'], 'p_partkey')} AS full_model,
      regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS task, CASE WHEN length(p_name) > 12 THEN left(p_name, 6) || '...' || right(p_name, 6) ELSE p_name END AS short,
      'acc' AS metric, CASE WHEN p_partkey % 2 = 0 THEN 'none' ELSE 'flexible-extract' END AS filter, CASE WHEN p_partkey % 2 = 0 THEN 'acc' ELSE 'acc,flexible-extract' END AS bare, p_partkey % 2 = 0 AS removed,
      'mmmu_val' AS file_task, '20250101_101010'[10:] AS stamp, p_name SIMILAR TO 'g.*|.*[ab]x.*' AS wild FROM t""")
def name_functions(spark, d):
    k = F.col("p_partkey")
    key = F.concat(F.lit("acc,"), F.when(k % 2 == 0, "none").otherwise("flexible-extract"))
    file = F.lit("/out/samples_mmmu_val_101010.jsonl")
    base = F.regexp_replace(file, "^.*/", "")
    x = read(spark, d, "part").select("p_partkey", "p_name", by_key(_FILES, k).alias("m"), key.alias("key"))
    return x.select("p_partkey", names.model_name(F.col("m")).alias("model"), names.model_name(F.col("m"), True).alias("full_model"), names.task_name(F.col("p_name")).alias("task"), names.shortened(F.col("p_name"), 12).alias("short"), names.metric_parts(F.col("key")).alias("mp"), names.without_none(F.col("key")).alias("wn"), names.file_task(base).alias("file_task"), names.file_stamp(base).alias("stamp"), names.matching(F.col("p_name"), ["g*", "*[ab]x*"]).alias("wild")).select(
        "p_partkey", "model", "full_model", "task", "short", "mp.metric", "mp.filter", F.col("wn.key").alias("bare"), "wn.removed", "file_task", "stamp", "wild")


@query("video_frames", """WITH t AS (SELECT vec_id, 3 + vec_id % 40 AS total, 8 AS n FROM embeddings), c AS (SELECT *, least(total, least(n, floor(total / 10.0::DOUBLE * 2)))::INTEGER AS capped, least(total, n)::INTEGER AS m FROM t),
    f AS (SELECT vec_id, total, list_transform(range(0, m), lambda i: CASE WHEN m = 1 THEN 0 WHEN i = m - 1 THEN total - 1 ELSE floor(i * ((total - 1) / (m - 1)::DOUBLE)) END::INTEGER) AS plain,
      list_transform(range(0, capped), lambda i: CASE WHEN capped = 1 THEN 0 WHEN i = capped - 1 THEN total - 1 ELSE floor(i * ((total - 1) / (capped - 1)::DOUBLE)) END::INTEGER) AS slow FROM c)
    SELECT vec_id, plain, slow, CASE WHEN list_contains(slow, (total - 1)::INTEGER) THEN slow ELSE list_append(slow, (total - 1)::INTEGER) END AS packets FROM f""")
def video_frames(spark, d):
    total = (3 + F.col("vec_id") % 40).cast("int")
    x = read(spark, d, "embeddings").select("vec_id", total.alias("t"))
    t, n, rate, fps = F.col("t"), F.lit(8), F.lit(10.0), F.lit(2.0)
    return x.select("vec_id", frames.stream_frames(t, n).alias("plain"), frames.stream_frames(t, n, rate, fps).alias("slow"), frames.packet_frames(t, n, rate, fps).alias("packets"))


_GRIDS = ", ".join(f"({i}, {c}, {r})" for i, (c, r) in enumerate(frames.grids(1, 6)))


@query("tile_grid", f"""WITH g(i, c, r) AS (VALUES {_GRIDS}), t AS (SELECT event_id, 100 + event_id % 1900 AS w, 100 + user_id % 900 AS h FROM events),
    d AS (SELECT event_id, i, c, r, abs(w / h::DOUBLE - c / r::DOUBLE) AS gap, w * h > 0.5::DOUBLE * 448 * 448 * c * r AS big FROM t, g), m AS (SELECT *, gap = min(gap) OVER (PARTITION BY event_id) AS near FROM d),
    k AS (SELECT *, i = min(i) OVER (PARTITION BY event_id) AS first FROM m WHERE near)
    SELECT event_id, arg_max(c, i)::INTEGER AS columns, arg_max(r, i)::INTEGER AS rows, (arg_max(c, i) * arg_max(r, i))::INTEGER AS tiles FROM k WHERE first OR big GROUP BY event_id""")
def tile_grid(spark, d):
    x = read(spark, d, "events").select("event_id", (100 + F.col("event_id") % 1900).alias("w"), (100 + F.col("user_id") % 900).alias("h"))
    return x.select("event_id", frames.tile_grid(F.col("w"), F.col("h")).alias("g")).select("event_id", "g.columns", "g.rows", "g.tiles")


@query("array_parts", """WITH t AS (SELECT vec_id, embedding[1:(vec_id % 9 + 1)] AS v, embedding FROM embeddings WHERE embedding IS NOT NULL)
    SELECT vec_id, list_transform([0, 1, 2], lambda i: len(v) // 3 + (i < len(v) % 3)::INTEGER)::INTEGER[] AS sizes, round((embedding[1]::DOUBLE + embedding[9]) / 2, 6) AS first_mean, 9 + 0 AS joined FROM t""")
def array_parts(spark, d):
    x = read(spark, d, "embeddings").where("embedding is not null").select("vec_id", "embedding", F.slice("embedding", F.lit(1), (F.col("vec_id") % 9 + 1).cast("int")).alias("v"))
    two = F.array(F.slice("embedding", 1, 8), F.slice("embedding", 9, 8))
    mean = frames.mean_vector(two)
    return x.select("vec_id", F.transform(frames.divided(F.col("v"), 3), F.size).alias("sizes"), F.round(F.get(mean, F.lit(0)), 6).alias("first_mean"), F.size(frames.joined_embedding(two, F.slice("embedding", 1, 1))).alias("joined"))


_SAMPLES = "SELECT lower(replace(l_returnflag || l_linestatus, ' ', '')) AS task, CASE l_linenumber % 3 WHEN 0 THEN 'acc' WHEN 1 THEN 'perplexity' ELSE 'custom' END AS metric, CASE WHEN l_linenumber > 5 THEN 'strict' ELSE 'none' END AS filter, l_discount::DOUBLE AS v FROM lineitem"


def _samples(spark, d):
    n = F.col("l_linenumber")
    metric = F.when(n % 3 == 0, "acc").when(n % 3 == 1, "perplexity").otherwise("custom")
    return read(spark, d, "lineitem").select(F.lower(F.concat("l_returnflag", "l_linestatus")).alias("task"), metric.alias("metric"), F.when(n > 5, "strict").otherwise("none").alias("filter"), F.col("l_discount").cast("double").alias("value"))


_METRICS = f"s AS ({_SAMPLES}), m AS (SELECT task, metric, filter, count(*) AS size, CASE WHEN metric = 'perplexity' THEN exp(-avg(v)) ELSE avg(v) END AS value, CASE WHEN metric = 'acc' THEN stddev_samp(v) / sqrt(count(*)) END AS stderr FROM s GROUP BY task, metric, filter)"


@query("task_metrics", f"WITH {_METRICS} SELECT task, metric, filter, size, round(value, 9) AS value, round(stderr, 9) AS stderr FROM m")
def task_metrics(spark, d):
    return rollup.task_metrics(_samples(spark, d)).withColumn("value", F.round("value", 9)).withColumn("stderr", F.round("stderr", 9))


TREE = [("all", "open"), ("all", "done"), ("open", "no"), ("done", "af"), ("done", "rest"), ("rest", "rf"), ("rest", "nf")]


@query("group_results", f"""WITH RECURSIVE {_METRICS}, e(parent, child) AS (VALUES {", ".join(map(str, TREE))}), c AS (SELECT parent AS grp, child FROM e UNION SELECT c.grp, e.child FROM c JOIN e ON e.parent = c.child),
    l AS (SELECT grp, child AS task FROM c WHERE child NOT IN (SELECT parent FROM e))
    SELECT grp, metric, filter, sum(size)::BIGINT AS size, round(sum(value * size) / sum(size), 9) AS weighted, round(avg(value), 9) AS plain, CASE WHEN bool_or(stderr IS NULL) THEN NULL ELSE round(sqrt(sum((size - 1) * stderr * stderr * size) / (sum(size) - count(*)) / sum(size)), 9) END AS stderr
    FROM m JOIN l USING (task) WHERE contains(metric || ',' || filter, 'acc') OR contains(metric || ',' || filter, 'cust') GROUP BY ALL""")
def group_results(spark, d):
    members = rollup.closure(spark.createDataFrame(TREE, "parent string, child string"))
    results = rollup.task_metrics(_samples(spark, d))
    wanted = {"acc": ["none"], "cust": ["none"]}
    by_size, alike = (rollup.groups(results, members, wanted, w) for w in (True, False))
    out = by_size.join(alike.select("grp", "metric", "filter", F.col("value").alias("plain")), ["grp", "metric", "filter"])
    return out.select("grp", "metric", "filter", "size", F.round("value", 9).alias("weighted"), F.round("plain", 9).alias("plain"), F.round("stderr", 9).alias("stderr"))


@query("metric_direction", """WITH d AS (SELECT DISTINCT l_returnflag || l_linestatus AS task, 'm' || (l_linenumber % 3) AS metric, l_linenumber % 3 <> 1 OR l_linestatus = 'O' AS up FROM lineitem)
    SELECT left(task, 1) AS grp, metric, CASE WHEN count(DISTINCT up) = 1 THEN bool_and(up) END AS higher_is_better FROM d GROUP BY ALL UNION ALL SELECT 'every', metric, CASE WHEN count(DISTINCT up) = 1 THEN bool_and(up) END FROM d GROUP BY ALL""")
def metric_direction(spark, d):
    n = F.col("l_linenumber") % 3
    rows = read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("task"), F.concat(F.lit("m"), n.cast("string")).alias("metric"), ((n != 1) | (F.col("l_linestatus") == "O")).alias("higher_is_better")).distinct()
    tasks = rows.select("task").distinct()
    return rollup.agreed_direction(rows, tasks.select(F.left("task", F.lit(1)).alias("grp"), "task").union(tasks.select(F.lit("every"), "task")))


@query("wide_results", f"""WITH {_METRICS} SELECT task, upper(task) AS alias, max(size)::BIGINT AS samples, round(max(value) FILTER (metric = 'acc' AND filter = 'none'), 9) AS acc, round(max(stderr) FILTER (metric = 'acc' AND filter = 'none'), 9) AS acc_stderr, round(max(value) FILTER (metric = 'custom' AND filter = 'none'), 9) AS custom FROM m GROUP BY task""")
def wide_results(spark, d):
    w = rollup.wide(rollup.task_metrics(_samples(spark, d)).withColumn("alias", F.upper("task")), ["acc,none", "custom,none"])
    return w.select("task", "alias", "samples", F.round("`acc,none`", 9).alias("acc"), F.round("`acc_stderr,none`", 9).alias("acc_stderr"), F.round("`custom,none`", 9).alias("custom"))


@query("flat_results", "SELECT n_name || '/acc' AS key, n_nationkey / 4.0::DOUBLE AS number, NULL::VARCHAR AS text FROM nation UNION ALL SELECT n_name || '/alias', NULL, n_name || ' !' FROM nation UNION ALL SELECT n_name || '/f1,strict', 2.0, NULL FROM nation")
def flat_results(spark, d):
    entries = F.create_map(F.lit("acc,none"), (F.col("n_nationkey") / 4).cast("string"), F.lit("alias"), F.concat("n_name", F.lit(" !")), F.lit("f1,strict"), F.lit("2"))
    return rollup.flat_results(read(spark, d, "nation").select(F.col("n_name").alias("task"), entries.alias("entries")))


@query("result_outline", """WITH t AS (SELECT n_name AS name, n_regionkey AS r FROM nation), w AS (SELECT r_name AS a, NULL AS b, r_name AS name, r_name AS alias, 0 AS depth FROM region UNION ALL SELECT r_name, n_name, n_name, ' - ' || n_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT name, alias, depth::INTEGER AS depth, (row_number() OVER (ORDER BY a, b NULLS FIRST))::INTEGER AS place FROM w""")
def result_outline(spark, d):
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    leaf = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("name"), F.col("n_name").alias("alias"))
    return rollup.outline(r.select(F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.col("r_name").alias("alias")).union(leaf))


@query("multiclass_mcc", """WITH t AS (SELECT event_id % 4 AS g, CASE WHEN user_id % 3 = 0 THEN event_id % 4 ELSE user_id % 5 END AS p FROM events), k AS (SELECT unnest(range(0, 5)) AS k),
    c AS (SELECT count(*)::DOUBLE AS s, count(*) FILTER (g = p)::DOUBLE AS c FROM t), m AS (SELECT k, (SELECT count(*) FROM t WHERE g = k)::DOUBLE AS t, (SELECT count(*) FROM t WHERE p = k)::DOUBLE AS q FROM k)
    SELECT round((max(c.c) * max(s) - sum(t * q)) / sqrt((max(s) * max(s) - sum(q * q)) * (max(s) * max(s) - sum(t * t))), 9) AS mcc FROM m, c""")
def multiclass_mcc(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    x = read(spark, d, "events").select((e % 4).alias("g"), F.when(u % 3 == 0, e % 4).otherwise(u % 5).alias("p"))
    return metrics.mcc_of(x, "g", "p").select(F.round("mcc", 9).alias("mcc"))


@query("deviations", """WITH g AS (SELECT l_linenumber AS q, bool_and(l_quantity < 49)::INTEGER AS ok FROM lineitem GROUP BY 1)
    SELECT (SELECT round(stddev_pop(l_quantity), 8) FROM lineitem) AS population, (SELECT round(stddev_samp(l_quantity), 8) FROM lineitem) AS sample, (SELECT round(stddev_samp(ok) / sqrt(count(*)), 9) FROM g) AS all_stderr""")
def deviations(spark, d):
    x = read(spark, d, "lineitem")
    one = metrics.acc_all_stderr(x.select("l_linenumber", (F.col("l_quantity") < 49).alias("right")), ["l_linenumber"], "right")
    q = F.col("l_quantity").cast("double")
    return x.agg(F.round(metrics.pop_stddev(q), 8).alias("population"), F.round(metrics.sample_stddev(q), 8).alias("sample")).join(one.select(F.round("acc_all_stderr", 9).alias("all_stderr")))


@query("choice_metrics", """WITH t AS (SELECT vec_id, embedding[1:4] AS x, embedding[5:8] AS y, vec_id % 5 AS g FROM embeddings WHERE embedding IS NOT NULL), a AS (SELECT vec_id, x, g, list_position(x, list_min(x)) - 1 AS p, list_transform([1, 2, 3, 4], lambda i: x[i]::DOUBLE - y[i]::DOUBLE) AS z FROM t)
    SELECT vec_id, (p = g OR p = (g + 1) % 4)::INTEGER::DOUBLE AS acc, ((g < 4 AND x[g + 1] > 0) OR x[(g + 1) % 4 + 1] > 0)::INTEGER AS exact_match, (list_position(z, list_max(z)) - 1 = g)::INTEGER::DOUBLE AS mutual FROM a""")
def choice_metrics(spark, d):
    g = (F.col("vec_id") % 5).cast("int")
    part = lambda a: F.transform(F.slice("embedding", a, 4), lambda v: v.cast("double"))
    m = metrics.mcq_many(part(1), F.array(g, (g + 1) % 4), F.array(*[F.lit(1.0)] * 4), F.transform(part(1), lambda v: v > 0))
    x = read(spark, d, "embeddings").where("embedding is not null").select("vec_id", m.alias("m"), metrics.mutual_info(part(1), part(5), g).alias("mutual"))
    return x.select("vec_id", "m.acc", "m.exact_match", "mutual")


@query("target_metrics", """SELECT p_partkey, greatest(levenshtein(p_name, p_brand), levenshtein(p_name, 'green'))::INTEGER AS best, (p_brand = 'Brand#13' OR p_brand = 'Brand#' || (p_partkey % 60))::INTEGER::DOUBLE AS any_right FROM part""")
def target_metrics(spark, d):
    best = metrics.best_of(lambda r: F.levenshtein(F.col("p_name"), r), F.array("p_brand", F.lit("green")))
    golds = F.array(F.lit("Brand#13"), F.concat(F.lit("Brand#"), (F.col("p_partkey") % 60).cast("string")))
    return read(spark, d, "part").select("p_partkey", best.alias("best"), metrics.any_right(lambda g: text.exact_match(F.col("p_brand"), g), golds).alias("any_right"))


@query("choice_requests", "WITH t AS (SELECT p_partkey AS doc_id, p_name AS c, [p_brand, p_type, p_size::VARCHAR] AS ch FROM part), x AS (SELECT doc_id, c, (generate_subscripts(ch, 1) - 1)::INTEGER AS idx, unnest(ch) AS choice FROM t) SELECT doc_id, idx, c AS context, ' ' || choice AS continuation, false AS dry FROM x UNION ALL SELECT doc_id, idx, '', choice, true FROM x")
def choice_requests(spark, d):
    docs = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("context"), F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("choices"))
    return instances.choice_requests(docs, mutual_info=True)


@query("repeat_and_answer", "SELECT o_orderkey AS doc_id, o_custkey, string_agg(reverse(o_orderpriority || r) || ':' || r, ',' ORDER BY r) AS responses FROM orders, range(0, 3) AS t(r) WHERE r < o_orderkey % 4 GROUP BY ALL")
def repeat_and_answer(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderpriority")
    asked = instances.repeated(o.select("doc_id", "o_orderpriority"), (F.col("doc_id") % 4).cast("int")).select("doc_id", F.col("repeat").alias("idx"), F.concat("o_orderpriority", F.col("repeat").cast("string")).alias("context"))
    got = instances.answer(asked, instances.echo).select("doc_id", "idx", F.concat("response", F.lit(":"), F.col("idx").cast("string")).alias("response"))
    return instances.by_document(o.select("doc_id", "o_custkey"), got).select("doc_id", "o_custkey", F.array_join("responses", ",").alias("responses"))


@query("longest_first", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 32 AS batch FROM documents")
def longest_first(spark, d):
    return instances.longest_first(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 32, "doc_id").select("doc_id", "n_chars", F.col("place").cast("long").alias("place"), "batch")


@query("zip_parts", """WITH RECURSIVE f AS (SELECT p_partkey AS seq, p_size AS size, row_number() OVER (ORDER BY p_partkey) AS i FROM part),
    g AS (SELECT seq, i, size AS held, 1 AS part FROM f WHERE i = 1 UNION ALL SELECT f.seq, f.i, CASE WHEN g.held + f.size > 120 THEN f.size ELSE g.held + f.size END, g.part + (g.held + f.size > 120)::INTEGER FROM g JOIN f ON f.i = g.i + 1) SELECT seq, part::INTEGER AS part FROM g""")
def zip_parts(spark, d):
    return zipparts.zip_parts(read(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_size").alias("size")), 120).select("seq", "part")


@query("row_selection", """WITH b AS (SELECT l_returnflag AS c, l_orderkey * 10 + l_linenumber AS k FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) <= 25)
    SELECT (SELECT sum(k) FROM b)::BIGINT AS balanced, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS remaining, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)) AS twice, (SELECT sum(k) FROM (SELECT min(o_orderkey) AS k FROM orders GROUP BY o_orderpriority))::BIGINT AS firsts""")
def row_selection(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("c"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    one = lambda df, x, n: df.agg(x.cast("long").alias(n))
    out = one(instances.balanced(li, "c", "k", 25), F.sum("k"), "balanced").join(one(instances.remaining(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey"), F.count(F.lit(1)), "remaining"))
    out = out.join(one(instances.duplicates(o, "o_custkey", "o_orderstatus"), F.count(F.lit(1)), "twice"))
    return out.join(one(instances.deduplicated_in_order(o, "o_orderpriority", "o_orderkey"), F.sum("o_orderkey"), "firsts"))


@query("disambiguated", "SELECT o_orderkey, CASE WHEN n > 0 THEN o_orderpriority || '-' || n ELSE o_orderpriority END AS name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS n FROM orders)")
def disambiguated(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("name"))
    return instances.disambiguated(o, ["o_custkey"], "name", "o_orderkey").select("o_orderkey", "name")


_QA = '{"Concrete Recognition": [{"Question": "q1", "answer": "a1", "CRITERIA": "c1"}, {"question": "lost"}], "Divergent": [{"question": "q2", "answer": "a2", "criteria": null}]}'
_SECTIONS = ["Question: Where?\nAnswer: there\nCriteria: near\nSubtask: Spatial", "question: A\nB\nAnswer: x\nCriteria: y", "nothing"]
_JUDGED = ['{"reason": "good", "score": 8}', "no json", '{"score": null, "reason": "?"}']


@query("generated_items", f"""WITH p AS (SELECT page_id FROM pages), g AS (SELECT page_id, unnest([{{'s': 'concrete recognition', 'q': 'q1', 'a': 'a1', 'c': 'c1'}}, {{'s': 'divergent', 'q': 'q2', 'a': 'a2', 'c': NULL}}]) AS x FROM p WHERE page_id % 3 <> 1)
    SELECT page_id, x.s AS subtask, x.q AS question, x.a AS answer, x.c AS criteria FROM g""")
def generated_items(spark, d):
    answer = F.when(F.col("page_id") % 3 != 1, F.lit(_QA)).otherwise("sorry")
    return benchrows.items(read(spark, d, "pages").select("page_id", answer.alias("r")), "r").drop("r")


@query("sections_and_scores", f"""SELECT conv_id, turn, {in_turn(['Where?', 'A\nB', None], 'conv_id')} AS question, {in_turn(['there', 'x', None], 'conv_id')} AS answer, {in_turn(['near', None, None], 'conv_id')} AS criteria, {in_turn(['Spatial', None, None], 'conv_id')} AS subtask,
    {in_turn([8.0, None, None], 'conv_id')} AS score, {in_turn(['good', 'no json', '?'], 'conv_id')} AS reason, conv_id % 3 = 0 AS kept, {in_turn(['x', '', '7'], 'conv_id')} AS plain, {in_turn(['math', None, None], 'conv_id')} AS subject FROM conversations""")
def sections_and_scores(spark, d):
    k = F.col("conv_id")
    judged = benchrows.judged(by_key(_JUDGED, k))
    plain = benchrows.plain_response(F.parse_json(by_key(['[["x", "y"]]', "null", "7"], k)))
    x = read(spark, d, "conversations").select("conv_id", "turn", benchrows.sections(by_key(_SECTIONS, k)).alias("s"), judged.alias("j"), plain.alias("plain"), benchrows.literal_field(by_key(["{'subject': 'math', 'x': 1}", "{}", "none"], k), "subject").alias("subject"))
    return x.select("conv_id", "turn", "s.*", "j.score", "j.reason", benchrows.above(F.col("j.score"), 5).alias("kept"), "plain", "subject")


@query("benchmark_rows", """WITH p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS id, CASE WHEN item_id % 4 = 0 THEN 'Divergent Thinking' ELSE 'Other' END AS label, CASE WHEN item_id % 5 = 0 THEN 'new ' || item_id ELSE left(text, 10) END AS text FROM benchmark WHERE text IS NOT NULL) SELECT * , '2024-07' AS subset FROM p""")
def benchmark_rows(spark, d):
    b = read(spark, d, "benchmark").where("text is not null")
    b = b.select("item_id", F.left("text", F.lit(10)).alias("text"), F.lit("w").alias("website"), benchrows.relabelled(F.when(F.col("item_id") % 4 == 0, "Evaluative Questions").otherwise("Other"), "Evaluative Questions", "Divergent Thinking").alias("label"))
    new = b.where("item_id % 5 = 0").select("item_id", F.concat(F.lit("new "), F.col("item_id").cast("string")).alias("text"))
    out = benchrows.refined(b, new, "item_id", ["text"])
    return benchrows.published(out, "item_id", ["website"], names.month(F.to_timestamp(F.lit("2024-07-03 10:00:00")))).select("item_id", F.col("id").cast("long").alias("id"), "label", "text", "subset")


@query("score_gates", "SELECT count(*) FILTER (n <> 0 AND n > 5) AS above, count(*) FILTER (n <> 0 AND n >= 5) AS admitted, count(*) AS free, count(*) FILTER (n = 3) AS subset FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 11 END AS n FROM events)")
def score_gates(spark, d):
    n = F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 11)
    x = read(spark, d, "events").select(n.alias("n"), n.cast("string").alias("s"))
    return x.agg(F.count_if(benchrows.above(F.col("n"), 5)).alias("above"), F.count_if(benchrows.admitted(F.col("n"), 5)).alias("admitted"), F.count_if(benchrows.admitted(F.col("n"), 0)).alias("free"), F.count_if(F.col("s") == "3").alias("subset"))


_DOC = "'{\"image_path_saved\": [\"/d/' || p_partkey || '_image.jpg\"' || CASE WHEN p_partkey % 3 = 0 THEN ', \"/d/z_image.jpg\"' ELSE '' END || '], \"text_annotation\": {\"text_label\": [\"' || CASE WHEN p_partkey % 2 = 0 THEN 'a22b' ELSE 'red2 cup' END || '\"]' || CASE WHEN p_partkey % 5 > 0 THEN ', \"reference_object_description_en\": \"cup\"' ELSE '' END || '}, \"mask_annotation\": {\"target_en\": \"old cup\", \"placement_region_en\": [\"shelf\"]}}'"
_BASE = "'/d/' || p_partkey"
_HEAD = "'tail' || chr(10) || 'form' || chr(10) || "
_ONE, _TWO, _THREE = "' <image> '", "' <image> ' || chr(10) || ' <image> '", "' <image> ' || chr(10) || ' <image> ' || chr(10) || ' <image> '"
_CUP = "CASE WHEN p_partkey % 5 > 0 THEN 'cup' ELSE 'old cup' END"
_AREA, _LABELS, _RAW = (f"CASE WHEN p_partkey % 2 = 0 THEN '{a}' ELSE '{b}' END" for a, b in (("a, b", "red2 cup"), ("a, b", "red, cup"), ("a22b", "red2 cup")))
_NL = " || chr(10) || "
_EXPECTED = {
    "TargetLocalization": (_ONE + _NL + "'Target Object Description: ' || " + _RAW, [f"{_BASE} || '_image.jpg'"], "true"),
    "GroundDetection": ("' <image>'", [f"{_BASE} || '_image.jpg'"], "true"),
    "FeasiblePath": (_TWO + _NL + "'Target Area Description: ' || " + _AREA + " || '.'", [f"{_BASE} || '_image.jpg'", f"{_BASE} || '_target_area_overlay.png'"], "true"),
    "VisualMatching": (f"rtrim({_THREE})", [f"{_BASE} || '_image.jpg'", f"{_BASE} || '_reference_area_overlay.png'", "'/d/z_image.jpg'"], "p_partkey % 3 = 0"),
    "AffordanceRegion": (_TWO + _NL + "'Reference Object Description: ' || " + _CUP + _NL + "'Task Description: ' || " + _RAW, [f"{_BASE} || '_image.jpg'", f"{_BASE} || '_reference_area_overlay.png'"], "true"),
    "ContactRelationship_TypeOne": (_TWO + _NL + "'Reference Object Description: ' || " + _RAW, [f"{_BASE} || '_image.jpg'", f"{_BASE} || '_reference_object_overlay.png'"], "true"),
    "ContactRelationship_TypeTwo": (_TWO + _NL + "'Reference Object Description: ' || " + _LABELS, [f"{_BASE} || '_image.jpg'", f"{_BASE} || '_reference_object_overlay.png'"], "true"),
    "ContactRelationship_TypeThree": (_TWO + _NL + "'Reference Object Description: ' || " + _LABELS, [f"{_BASE} || '_image.jpg'", f"{_BASE} || '_reference_object_overlay.png'"], "true"),
    "PlacementRegion": (_TWO + _NL + "'Reference Object Description: ' || " + _CUP + _NL + "'Placement Region Description: shelf'", [f"{_BASE} || '_image.jpg'", f"{_BASE} || '_reference_object_overlay.png'"], "true"),
}


@query("prompt_records", " UNION ALL ".join(f"SELECT p_partkey::VARCHAR AS path, '{k}' AS kind, md5({_HEAD}{user}) AS user_md5, 'head' AS head, [{', '.join(images)}] AS images FROM part WHERE {where}" for k, (user, images, where) in _EXPECTED.items()))
def prompt_records(spark, d):
    docs = relational.evaluated(readers.dealt(read(spark, d, "part"), "p_partkey"), doc=F.parse_json(F.expr(_DOC))).select(F.col("p_partkey").cast("string").alias("path"), "doc")
    out = None
    for k in _EXPECTED:
        x = converters.converted(docs, k, "head\ntail", "form").select("path", F.lit(k).alias("kind"), F.md5(F.col("messages")[1]["content"]).alias("user_md5"), F.col("messages")[0]["content"].alias("head"), "images")
        out = x if out is None else out.union(x)
    return out


@query("rejected_records", "SELECT p_partkey::VARCHAR AS path, 'image_path_saved: too few pictures' AS problem FROM part WHERE p_partkey % 3 <> 0")
def rejected_records(spark, d):
    return converters.rejected(read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.parse_json(F.expr(_DOC)).alias("doc")), "VisualMatching")


@query("truth_paths", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '/a/' || p_partkey || '_mask_rle.json' END AS one, CASE WHEN p_partkey % 3 = 0 THEN '/a/' || p_partkey || '__y_mask_rle.json' END AS pair, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS n, CASE WHEN p_partkey % 2 = 0 THEN 'point' ELSE 'bbox' END AS format FROM part""")
def truth_paths(spark, d):
    k = F.col("p_partkey")
    raw = F.concat(F.lit('["/a/'), k.cast("string"), F.lit('_image.png", 5, {"path": ""}'), F.when(k % 3 == 0, ', {"path": "/b/y_image.jpg"}]').otherwise("]"))
    x = read(spark, d, "part").select("p_partkey", converters.image_paths(F.parse_json(raw)).alias("i"))
    return x.select("p_partkey", converters.truth_path(F.col("i"), F.lit("GroundDetection")).alias("one"), converters.truth_path(F.col("i"), F.lit("VisualMatching")).alias("pair"), F.size("i").alias("n"), converters.default_format(F.lit("Navigation"), F.when(k % 2 == 0, "FeasiblePath_Ego").otherwise("GroundDetection")).alias("format"))


@query("templates", "SELECT c_custkey, 'Dear ' || c_name || ' (' || lower(c_mktsegment) || '), ' || c_custkey || '!' AS text, 'from ' || c_nationkey AS other FROM customer")
def templates(spark, d):
    c = read(spark, d, "customer")
    columns = {n: F.col(n) for n in ("c_name", "c_mktsegment", "c_custkey", "c_nationkey")}
    return c.select("c_custkey", converters.dispatched("Dear {{c_name}} ({{ c_mktsegment | lower }}), {{c_custkey}}!", columns).alias("text"), converters.dispatched(lambda x: F.concat(F.lit("from "), x["c_nationkey"].cast("string")), columns).alias("other"))


@query("sample_filter", f"""WITH t AS (SELECT event_id, {quoted([r[1] for r in catalog.leaves()])}[event_id % 23 + 1] AS category, {quoted([r[3] for r in catalog.leaves()])}[event_id % 23 + 1] AS kind FROM events)
    SELECT count(*) FILTER (category = 'Navigation') AS by_category, count(*) FILTER (kind IN ('Color', 'Spoken')) AS by_kind, count(*) FILTER (kind IN ('ObjectState', 'PartWhole', 'PartWholeHuman', 'Spoken')) AS by_group, count(*) FILTER (kind = 'Spoken') AS by_both, count(*) FILTER (category = 'TargetLocalization') AS by_nothing FROM t""")
def sample_filter(spark, d):
    e = F.col("event_id")
    x = read(spark, d, "events").select(by_key([r[1] for r in catalog.leaves()], e).alias("category"), by_key([r[3] for r in catalog.leaves()], e).alias("kind"))
    group = "EmbodiedCompositionalAttributes"
    cases = {"by_category": {"categories": ["Navigation"]}, "by_kind": {"kinds": ["Color", "Spoken"]}, "by_group": {"group": group}, "by_both": {"kinds": ["Color", "Spoken"], "group": group}, "by_nothing": {"kinds": ["Color"], "group": group}}
    out = None
    for name, args in cases.items():
        one = scoring.filter_samples(x, **args).agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one)
    return out


_TASKS = [r[1:4] for r in catalog.leaves()] + [("Manipulation", "", "Affordance"), ("Elsewhere", "", "Thing")]


@query("scorer_routing", f"""SELECT event_id, {in_turn([{"TargetLocalization": 0.7, "GroundDetection": 1.0, "FeasiblePath_Ego": 0.0, "FeasiblePath_Exo": 0.0, "VisualMatching": 0.5, "AffordanceRegion": 1.0, "PlacementRegion": 0.5, "Affordance": 1.0, "Thing": 0.0}.get(k if c != "TargetLocalization" else c, 0.7) for c, _, k in _TASKS], 'event_id')} AS localization,
    {in_turn([1.0 if k.startswith("FeasiblePath") else 0.0 for _, _, k in _TASKS], 'event_id')} AS path, {in_turn([{"PlacementRegion": 0.5}.get(k, 0.0) for _, _, k in _TASKS], 'event_id')} AS binary FROM events""")
def scorer_routing(spark, d):
    e = F.col("event_id")
    w = scoring.routed(by_key([t[0] for t in _TASKS], e), by_key([t[2] for t in _TASKS], e), F.lit(False), F.lit(False))
    return read(spark, d, "events").select("event_id", w.alias("w")).select("event_id", F.round("w.localization", 9).alias("localization"), "w.path", "w.binary")


@query("bucket_counts", "SELECT (SELECT count(DISTINCT source) FROM documents WHERE source IS NOT NULL) + (SELECT count(*) > 0 FROM documents WHERE source IS NULL)::INTEGER AS buckets, round(count(*) / ((SELECT count(DISTINCT source) FROM documents WHERE source IS NOT NULL) + (SELECT count(*) > 0 FROM documents WHERE source IS NULL)::INTEGER)::DOUBLE, 6) AS mean_size FROM documents")
def bucket_counts(spark, d):
    return rollup.bucket_mean(read(spark, d, "documents"), "source").select("buckets", F.round("mean_size", 6).alias("mean_size"))


@query("file_counts", "SELECT o_orderpriority AS file, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority)")
def file_counts(spark, d):
    return rollup.file_counts(read(spark, d, "orders").select(F.col("o_orderpriority").alias("file")), "file")


_COMPARED = ["ai2d", "mmmu_val", "unknown", "ocrbench"]


@query("compared_values", """WITH t AS (SELECT ['ai2d', 'mmmu_val', 'unknown'][l_linenumber % 3 + 1] AS task, CASE WHEN l_linestatus = 'O' THEN ['exact_match,flexible-extract', 'mmmu_acc,none', 'acc,none'][l_linenumber % 3 + 1] ELSE 'exact_match,none' END AS key, l_discount AS v FROM lineitem),
    m AS (SELECT task, key, avg(v) AS v FROM t GROUP BY ALL) SELECT w.task, round(coalesce(max(v), 0.0), 9) AS value FROM (VALUES ('ai2d', 'exact_match,flexible-extract'), ('mmmu_val', 'mmmu_acc,none'), ('unknown', NULL), ('ocrbench', NULL)) AS w(task, key) LEFT JOIN m ON m.task = w.task AND m.key = w.key GROUP BY 1""")
def compared_values(spark, d):
    n = F.col("l_linenumber")
    own = by_key(["exact_match,flexible-extract", "mmmu_acc,none", "acc,none"], n)
    rows = read(spark, d, "lineitem").select(by_key(_COMPARED[:3], n).alias("task"), F.when(F.col("l_linestatus") == "O", own).otherwise("exact_match,none").alias("key"), F.col("l_discount").cast("double").alias("v"))
    results = rows.groupBy("task", "key").agg(F.avg("v").alias("value"))
    return rollup.compared_value(results, _COMPARED).select("task", F.round("value", 9).alias("value"))


_LOGGED = "['loglikelihood', 'multiple_choice', 'loglikelihood_rolling', 'generate_until']"


@query("logged_samples", f"""WITH t AS (SELECT p_partkey AS id, {_LOGGED}[p_partkey % 4 + 1] AS k, p_name, p_brand, p_size::DOUBLE AS a, p_size % 7 + 20.0::DOUBLE AS b FROM part)
    SELECT id, p_name AS data, CASE WHEN k = 'loglikelihood' THEN p_brand ELSE 'gold' END AS label, CASE WHEN k = 'multiple_choice' THEN '0. ' || p_brand || chr(10) || '1. two' END AS choices,
      CASE k WHEN 'multiple_choice' THEN CASE WHEN a >= b THEN '0' ELSE '1' END WHEN 'generate_until' THEN 'r' ELSE '' END AS raw FROM t""")
def logged_samples(spark, d):
    p = read(spark, d, "part")
    kind = by_key(["loglikelihood", "multiple_choice", "loglikelihood_rolling", "generate_until"], F.col("doc_id"))
    x = p.select(F.col("p_partkey").alias("doc_id"), F.lit("gold").alias("target"), F.array(F.array("p_name", "p_brand"), F.array("p_name", F.lit("two"))).alias("arguments"), F.array(F.col("p_size").cast("double"), F.col("p_size") % 7 + 20.0).alias("losses"), F.array(F.lit(True), F.lit(False)).alias("greedy"), F.lit("r").alias("response"))
    return rollup.sample_frame(x, kind).select("id", "data", "label", "choices", F.when(F.col("raw_prediction").rlike("^(?:[01]|r)$"), F.col("raw_prediction")).otherwise("").alias("raw"))


@query("run_stamps", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d %H:%M:%S') AS captured FROM events")
def run_stamps(spark, d):
    ts = F.col("ts")
    return read(spark, d, "events").select("event_id", names.run_stamp(ts).alias("stamp"), names.month(ts).alias("month"), names.capture_time(ts).alias("captured"))


@query("map_functions", "SELECT r_regionkey, lower(r_name) AS k, r_name || '2' AS v, 'right' AS both, json_valid(CASE WHEN r_regionkey % 2 = 0 THEN '{\"a\": 1}' ELSE '{a' END) AS valid, 4 AS parts FROM region")
def map_functions(spark, d):
    r = read(spark, d, "region")
    low = names.lower_keys(F.create_map(F.col("r_name"), F.concat("r_name", F.lit("2"))))
    both = names.merged(F.create_map(F.lit("x"), F.lit("left"), F.lit("y"), F.lit("l")), F.create_map(F.lit("x"), F.lit("right")))
    valid = names.is_json(F.when(F.col("r_regionkey") % 2 == 0, '{"a": 1}').otherwise("{a"))
    return r.select("r_regionkey", F.map_keys(low)[0].alias("k"), F.map_values(low)[0].alias("v"), both["x"].alias("both"), valid.alias("valid"), F.size(names.escaped_split(F.lit("a,b\\,c,d,e"), ",")).alias("parts"))


@query("latest_results", "SELECT l_returnflag AS model, l_linestatus AS task, max(strftime(l_shipdate, '%Y%m%d')) AS stamp FROM lineitem GROUP BY ALL")
def latest_results(spark, d):
    from .sources import sinks

    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("task"), F.date_format("l_shipdate", "yyyyMMdd").alias("stamp"), "l_orderkey")
    return sinks.latest_runs(x).select("model", "task", "stamp")


@query("published_scores", "SELECT id, arg_max(score, o) AS score FROM (SELECT c_custkey AS id, c_acctbal AS score, 0 AS o FROM customer UNION ALL SELECT c_custkey, 0, 1 FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1")
def published_scores(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return benchrows.published_scores(c, c.where("id % 3 = 0").withColumn("score", (F.col("score") * 0).cast(c.schema["score"].dataType)), ["id"])


@query("search_and_show", """SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN 'cup' ELSE 'old cup' END AS cup, CASE WHEN p_partkey % 2 = 0 THEN 'a22b' ELSE 'red2 cup' END AS label, p_partkey % 2 = 1 AS red FROM part""")
def search_and_show(spark, d):
    x = read(spark, d, "part").select("p_partkey", F.parse_json(F.expr(_DOC)).alias("doc"))
    label = explorer.described(F.col("doc"), "text_label")
    hit = explorer.search_text(F.concat(F.lit("/x_Y/"), label)).contains("x y/red2 cup")
    return x.select("p_partkey", explorer.described(F.col("doc"), "reference_object_description_en", "target_en").alias("cup"), label.alias("label"), hit.alias("red"))


@query("run_metadata", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a/b' WHEN 1 THEN 'm' ELSE '' END AS model_name, (event_id % 100 + 0.5)::DOUBLE AS seconds FROM events")
def run_metadata(spark, d):
    e = F.col("event_id")
    x = read(spark, d, "events").select("event_id", by_key(["x=1,pretrained=a/b,device=0", "model=m", "remodel=n"], e).alias("args"), F.timestamp_seconds(F.lit(1000.0)).alias("s"), F.timestamp_seconds(1000.5 + e % 100).alias("t"))
    return benchrows.run_metadata(x, F.col("args"), F.col("s"), F.col("t")).select("event_id", "model_name", F.round("seconds", 6).alias("seconds"))


@query("grouped_values", "SELECT o_orderpriority AS key, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY 1")
def grouped_values(spark, d):
    g = benchrows.grouped(read(spark, d, "orders"), F.col("o_orderpriority"), "o_orderkey", 100)
    bounded = F.when(F.max(F.size("values")) <= 200, F.sum(F.size("values"))).cast("long")
    return g.groupBy("key").agg(bounded.alias("n"), F.sum(F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v)).alias("total"))


@query("average_lengths", "SELECT lang AS task, round(avg(n_chars), 6) AS mean_length FROM documents GROUP BY 1")
def average_lengths(spark, d):
    return benchrows.average_length(read(spark, d, "documents").withColumnRenamed("lang", "task"), "task", "n_chars").withColumn("mean_length", F.round("mean_length", 6))
