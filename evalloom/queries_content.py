"""Registered queries whose texts, masks and paths are made of the tables' columns, so that their SQL depends on every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import answers, bootstrap, choices, drawing, masks, metrics, names, scores, text, translation
from .operators import filters, media, relational, tasks
from .plans import catalog, views
from .queries import H, TAXONOMY, W, query, read
from .sources import readers


def said(*parts):
    """A text of literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- translations: each turn against itself without some words, and with its first word moved to its end -----------------

_PAIRS = r"""SELECT conv_id, turn, text AS r, regexp_replace(text, '\b(the|la|der|of|and) ', '', 'g') AS p FROM conversations"""
_ENTITIES = "replace(replace(replace(replace(replace(replace(replace({}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
_APART = r"'([\x20-\x26\x28-\x2B\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])', ' \1 ', 'g'"


def _tokens(c: str) -> str:
    spaced = f"regexp_replace(' ' || {_ENTITIES.format(c)} || ' ', {_APART})"
    for pattern, new in (("([^0-9])([.,])", r"\1 \2 "), ("([.,])([^0-9])", r" \1 \2"), ("([0-9])(-)", r"\1 \2 ")):
        spaced = f"regexp_replace({spaced}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split_regex({spaced}, '\\s+'), lambda w: w <> '')"


@query("corpus_bleu_chrf", rf"""WITH t AS ({_PAIRS}), s AS (SELECT row_number() OVER () AS i, {_tokens("p")} AS p, {_tokens("r")} AS r, regexp_replace(p, '\s+', '', 'g') AS cp, regexp_replace(r, '\s+', '', 'g') AS cr FROM t),
    w AS (SELECT i, side, n, array_to_string(x[k:k + n - 1], ' ') AS g FROM (SELECT i, side, n, x, unnest(range(1, len(x) - n + 2)) AS k FROM (SELECT i, 1 AS side, p AS x FROM s UNION ALL SELECT i, 2, r FROM s), range(1, 5) AS o(n))),
    c AS (SELECT i, side, n, substr(x, k, n) AS g FROM (SELECT i, side, n, x, unnest(range(1, length(x) - n + 2)) AS k FROM (SELECT i, 1 AS side, cp AS x FROM s UNION ALL SELECT i, 2, cr FROM s), range(1, 7) AS o(n))),
    wm AS (SELECT n, sum(least(a, b)) AS m, sum(a) AS t FROM (SELECT i, n, g, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM w GROUP BY ALL) GROUP BY n),
    cm AS (SELECT n, sum(least(a, b)) AS m, sum(a) AS p, sum(b) AS r FROM (SELECT i, n, g, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM c GROUP BY ALL) GROUP BY n),
    size AS (SELECT sum(len(p))::DOUBLE AS c, sum(len(r))::DOUBLE AS r FROM s),
    f AS (SELECT avg(m / p::DOUBLE) AS p, avg(m / r::DOUBLE) AS r FROM cm)
    SELECT round(100 * least(1.0::DOUBLE, exp(1 - (SELECT r / c FROM size))) * exp((SELECT avg(ln(m / t::DOUBLE)) FROM wm)), 6) AS bleu, round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM f""")
def corpus_bleu_chrf(spark, d):
    x = readers.dealt(read(spark, d, "conversations"), "conv_id").select(F.col("text").alias("r"), F.regexp_replace("text", r"\b(the|la|der|of|and) ", "").alias("p"))
    s = translation.statistics(x, "p", "r")
    sums = s.agg(*[F.sum(n).cast("double").alias(n) for n in s.columns])
    col = {n: F.col(n) for n in s.columns}
    return sums.select(F.round(translation.bleu(col), 6).alias("bleu"), F.round(translation.chrf(col), 6).alias("chrf"))


def _moved(spark, d):
    t = F.col("text")
    head = F.substring_index(t, " ", 1)
    return readers.dealt(read(spark, d, "conversations"), "conv_id").select("conv_id", "turn", "text", F.concat(F.substring(t, F.length(head) + 2, F.length(t)), F.lit(" "), head).alias("pred"))


@query("corpus_scores")
def corpus_scores(spark, d):
    return metrics.corpus_scores(_moved(spark, d), "pred", "text")


@query("bootstrap_scores")
def bootstrap_scores(spark, d):
    """Standard errors of BLEU, F1 and the correlation by resampling, over blocks of pairs."""
    pairs = _moved(spark, d)
    s = translation.statistics(pairs, "pred", "text").withColumn("i", F.monotonically_increasing_id())
    words = ["cl", "rl", *[f"{k}{n}" for n in range(1, 5) for k in "mt"]]
    labels = read(spark, d, "labels").where("quality is not null and toxic is not null")
    one = lambda name, df, value, fold: bootstrap.resampled(df, value, ["i"], fold, 200).agg(F.stddev_samp("s").alias("stderr")).select(F.lit(name).alias("metric"), "stderr")
    both = labels.select(F.col("doc_id").alias("i"), F.array("quality", "toxic").alias("v"))
    return one("bleu", s, F.array(*words), bootstrap.BLEU).union(one("f1", both, F.col("v"), bootstrap.F1)).union(one("mcc", both, F.col("v"), bootstrap.MCC))


# --- masks -----------------------------------------------------------------------------------------------------------

_RUNS = f"""e AS (SELECT event_id AS sid, [event_id % 200, 100 + event_id % 300, event_id % 150, 50 + user_id % 400] AS a, [user_id % 100, 200 + user_id % 300, event_id % 90, 80 + event_id % 500] AS b, 5 + event_id % 40 AS nh, 5 + user_id % 60 AS nw FROM events),
    r AS (SELECT *, a[1] AS s1, a[1] + a[2] AS e1, least(a[1] + a[2] + a[3], {W * H}) AS s2, least(a[1] + a[2] + a[3] + a[4], {W * H}) AS e2, b[1] AS t1, b[1] + b[2] AS f1, least(b[1] + b[2] + b[3], {W * H}) AS t2, least(b[1] + b[2] + b[3] + b[4], {W * H}) AS f2 FROM e)"""


def _masked(spark, d):
    e, u = F.col("event_id").cast("int"), F.col("user_id").cast("int")
    a, b = F.array(e % 200, 100 + e % 300, e % 150, 50 + u % 400), F.array(u % 100, 200 + u % 300, e % 90, 80 + e % 500)
    runs = lambda c: masks.rle_runs(c, F.lit(W * H))
    return readers.dealt(read(spark, d, "events"), "event_id").select(F.col("event_id").alias("sid"), runs(a).alias("a"), runs(b).alias("b"), (5 + e % 40).alias("nh"), (5 + u % 60).alias("nw"))


@query("mask_resize", f"""WITH {_RUNS}, x AS (SELECT sid, nh, nw, s1, e1, s2, e2, unnest(range(0, nw)) AS x FROM r), p AS (SELECT *, unnest(range(0, nh)) AS y FROM x),
    q AS (SELECT sid, x * nh + y AS px, ((2 * x + 1) * {W} // (2 * nw)) * {H} + (2 * y + 1) * {H} // (2 * nh) AS old, s1, e1, s2, e2 FROM p)
    SELECT sid, count(*) FILTER (WHERE old >= s1 AND old < e1 OR old >= s2 AND old < e2) AS n, coalesce(sum(px) FILTER (WHERE old >= s1 AND old < e1 OR old >= s2 AND old < e2), 0)::BIGINT AS places FROM q GROUP BY sid""")
def mask_resize(spark, d):
    r = drawing.resized(F.col("a"), F.lit(H), F.lit(W), F.col("nh"), F.col("nw"))
    total = lambda f: F.aggregate("r", F.lit(0).cast("long"), lambda t, q: t + f(q["s"].cast("long"), q["e"].cast("long")))
    return _masked(spark, d).select("sid", r.alias("r")).select("sid", total(lambda s, e: e - s).alias("n"), total(lambda s, e: F.call_function("div", (s + e - 1) * (e - s), F.lit(2))).alias("places"))


@query("mask_overlay", f"""WITH {_RUNS}, p AS (SELECT sid, unnest(range(0, {W * H})) AS px, s1, e1, s2, e2, t1, f1, t2, f2 FROM r),
    q AS (SELECT sid, (px >= s1 AND px < e1 OR px >= s2 AND px < e2) AS a, (px >= t1 AND px < f1 OR px >= t2 AND px < f2) AS b FROM p)
    SELECT sid, count(*) AS n, round(sum(CASE WHEN a THEN 0.75::DOUBLE ELSE 1 END * CASE WHEN b THEN 0.5::DOUBLE ELSE 1 END), 6) AS kept,
      round(sum(CASE WHEN a THEN 0.25::DOUBLE * 240 ELSE 0 END * CASE WHEN b THEN 0.5::DOUBLE ELSE 1 END), 6) AS red, round(sum(CASE WHEN b THEN 0.5::DOUBLE * 200 ELSE 0 END), 6) AS green FROM q WHERE a OR b GROUP BY sid""")
def mask_overlay(spark, d):
    x = _masked(spark, d).select("sid", drawing.blended(F.array(drawing.layer(F.col("a"), 240, 0, 0, 0.25), drawing.layer(F.col("b"), 0, 200, 0, 0.5))).alias("p"))
    total = lambda c: F.round(F.aggregate("p", F.lit(0.0), lambda t, q: t + (q["e"] - q["s"]) * q[c]), 6)
    return x.select("sid", F.aggregate("p", F.lit(0).cast("long"), lambda t, q: t + (q["e"] - q["s"])).alias("n"), total("keep").alias("kept"), total("r").alias("red"), total("g").alias("green"))


# --- media -----------------------------------------------------------------------------------------------------------

_PLACE = "'/data/' || source || '/d' || (doc_id % 7)"


@query("media_paths", f"""SELECT doc_id, CASE WHEN doc_id % 20 = 2 THEN '/elsewhere/img' || doc_id || '.png' WHEN doc_id % 6 = 0 THEN {_PLACE} || '/deep/img' || doc_id || '.png'
      WHEN doc_id % 3 = 0 THEN {_PLACE} || '/img' || doc_id || '.png' WHEN doc_id % 3 = 1 THEN '/data/' || source || '/img' || doc_id || '.png' END AS found FROM documents""")
def media_paths(spark, d):
    k, img = F.col("doc_id"), said("img", F.col("doc_id"), ".png")
    source, folder = said("/data/", F.col("source")), said("/data/", F.col("source"), "/d", F.col("doc_id") % 7)
    docs = read(spark, d, "documents").select("doc_id", "source")
    stored = F.when(k % 4 == 0, img).when(k % 4 == 1, said("d", k % 7, "/", img)).when(k % 4 == 2, said("/elsewhere/", img)).otherwise(said("../d", k % 7, "//./", img))
    rows = docs.select("doc_id", stored.alias("stored"), said(folder, "/deep/gt.json").alias("annotation"))
    paths = F.array(F.when(k % 20 == 2, said("/elsewhere/", img)), F.when(k % 6 == 0, said(folder, "/deep/", img)), F.when(k % 3 == 0, said(folder, "/", img)), F.when(k % 3 == 1, said(source, "/", img)))
    files = docs.select(F.explode(F.filter(paths, lambda p: p.isNotNull())).alias("path"))
    return media.resolved(rows, files, "doc_id", "stored", "annotation").select("doc_id", "found")


# --- answers ---------------------------------------------------------------------------------------------------------

_NUMBERS = "n AS (SELECT event_id, event_id % 40 AS a, user_id % 30 AS b, event_id % 40 + 5 AS c, user_id % 30 + 4 AS d, user_id % 9 AS n, event_id % 3 AS k, event_type FROM events)"


def _numbers(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    return readers.dealt(read(spark, d, "events"), "event_id").select("event_id", (e % 40).alias("a"), (u % 30).alias("b"), (e % 40 + 5).alias("c"), (u % 30 + 4).alias("d"), (u % 9).alias("n"), (e % 3).alias("k"), "event_type")


@query("answers_content", f"""WITH {_NUMBERS}, t AS (SELECT event_id, k, n, '[[' || a || ', ' || b || ', ' || c || ', ' || d || '], [' || b || ', ' || a || ', ' || d || ', ' || c || ']]' AS boxes FROM n)
    SELECT event_id, CASE k WHEN 0 THEN '{{"number_of_objects": ' || n || ', "bounding_boxes": ' || boxes || '}}' WHEN 1 THEN '{{"number_of_objects": ' || n || ', "bounding_boxes": []}}' ELSE 'No Valid Response' END AS formatted,
      CASE k WHEN 0 THEN boxes WHEN 1 THEN '[]' ELSE '["No Valid Response"]' END AS localization, CASE WHEN k < 2 THEN '[' || n || ']' ELSE '["No Valid Response"]' END AS count, '["Not Required"]' AS path FROM t""")
def answers_content(spark, d):
    a, b, c, e, n, k = (F.col(x) for x in ("a", "b", "c", "d", "n", "k"))
    full = said("I count.\n```json\n{'number_of_objects': ", n, ", 'bounding_boxes': [(", a, ", ", b, ", ", c, ", ", e, "), [", b, ", ", a, ", ", e, ", ", c, "]]}\n```")
    thought = said("<think>{'number_of_objects': 99}</think> then {\"number_of_objects\": \"", n, "\"} it is")
    r = F.when(k == 0, full).when(k == 1, thought).otherwise(said("there are ", n, " of ", F.col("event_type")))
    x = _numbers(spark, d).select("event_id", r.alias("r"), F.lit("TargetLocalization").alias("c"), F.lit("Color").alias("k"))
    x = x.withColumn("needs", catalog.required(F.col("c"), F.col("k")))
    return x.select("event_id", answers.formatted_text("r", "c", "k").alias("formatted"), answers.standardize("r", "c", "k", "needs").alias("f")).select("event_id", "formatted", "f.localization", "f.count", "f.path")


@query("lenient_content", f"""WITH {_NUMBERS} SELECT event_id, 2 AS boxes, (2 * (a + b + c + d))::DOUBLE AS total, CASE k WHEN 0 THEN n WHEN 1 THEN a ELSE NULL END::INTEGER AS n FROM n""")
def lenient_content(spark, d):
    a, b, c, e, n, k = (F.col(x) for x in ("a", "b", "c", "d", "n", "k"))
    boxes = said("[[", a, ", ", b, ", ", c, ", ", e, ", 9], [", b, ", ", a, "], [\"", b, "\", ", a, ", ", e, ", \"", c, "\"], \"", F.col("event_type"), "\"]")
    count = F.when(k == 0, said('" ', n, ' "')).when(k == 1, said("[", a, ".7, ", b, "]")).otherwise(said('"', F.col("event_type"), '"'))
    x = _numbers(spark, d).select("event_id", scores.lenient_boxes(F.parse_json(boxes)).alias("x"), scores.lenient_count(F.parse_json(count)).alias("n"))
    return x.select("event_id", F.size("x").alias("boxes"), F.aggregate(F.flatten("x"), F.lit(0.0), lambda t, v: t + v).alias("total"), "n")


@query("boxes_content", f"WITH {_NUMBERS} SELECT event_id, CASE WHEN k < 2 THEN '[(' || a || ', ' || b || ', ' || c || ', ' || d || ')]' END AS boxes, CASE WHEN k <> 1 THEN n END::INTEGER AS count FROM n")
def boxes_content(spark, d):
    a, b, c, e, n, k = (F.col(x) for x in ("a", "b", "c", "d", "n", "k"))
    boxes = F.when(k < 2, said("**bounding_boxes**: [(", a, ", ", b, ", ", c, ", ", e, ")]\n")).otherwise(said("**bounding_boxes**: [(", a, "\n"))
    x = _numbers(spark, d).select("event_id", F.concat(boxes, F.when(k != 1, said("**number_of_objects**: ", n)).otherwise(said("**number_of_objects**: x", n))).alias("m"))
    return x.select("event_id", choices.box_and_count(F.col("m")).alias("r")).select("event_id", "r.*")


@query("choices_content", """SELECT p_partkey, chr(65 + (p_partkey % 3)::INTEGER) AS picked, p_size::VARCHAR AS boxed, p_size::VARCHAR AS first, (p_partkey % 50)::VARCHAR AS last, lower(p_name) || ' ' || p_size AS short FROM part""")
def choices_content(spark, d):
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    letter = F.char(65 + k % 3)
    x = read(spark, d, "part").select("p_partkey", F.array(said("The answer is (", letter, ").")).alias("r"), F.array(F.lit("one thing"), F.lit("another"), F.lit("none of them")).alias("c"), said("so \\boxed{", size, "}").alias("b"), F.array(said(size, " apples and ", k % 50, " pears")).alias("f"), said("The ", F.initcap(name), ", ", size, "!").alias("s"))
    picked = choices.multi_choice(F.col("r"), F.col("c"), r"\(([A-Z])\)", ignore_case=True, ignore_punctuation=True)
    x = x.select("p_partkey", "f", F.regexp_replace(F.get(picked, F.lit(0)), "[()]", "").alias("picked"), choices.boxed_answer(F.col("b")).alias("boxed"), choices.normal_answer("s").alias("short"))
    fruit = r"(\d+) apples|(\d+) pears"
    return filters.pipeline(x, "f", {"first": [("regex", fruit, 0), ("take_first",)], "last": [("regex", fruit, -1), ("take_first",)]}).select("p_partkey", "picked", "boxed", "first", "last", "short")


@query("names_content", r"""WITH t AS (SELECT p_partkey, p_type, p_brand, p_size, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS task FROM part)
    SELECT p_partkey, p_type || '__' || p_brand AS model, 'org__' || p_type || '__' || p_brand AS full_model, task, 'm' || (p_size % 7) AS metric, CASE WHEN p_partkey % 2 = 0 THEN 'none' ELSE 'f' || (p_size % 3) END AS filter,
      task AS file_task, (100000 + p_partkey)::VARCHAR AS stamp, contains(p_brand, '1') AS wild FROM t""")
def names_content(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    model = said("org/", F.col("p_type"), "/", F.col("p_brand"))
    x = read(spark, d, "part").select("p_partkey", "p_brand", model.alias("m"), names.task_name(F.col("p_name")).alias("task"), said("m", size % 7, ",", F.when(k % 2 == 0, "none").otherwise(said("f", size % 3))).alias("key"))
    x = x.withColumn("file", said("samples_", F.col("task"), "_", 100000 + k, ".jsonl"))
    return x.select("p_partkey", names.model_name(F.col("m")).alias("model"), names.model_name(F.col("m"), True).alias("full_model"), "task", names.metric_parts(F.col("key")).alias("mp"), names.file_task(F.col("file")).alias("file_task"), names.file_stamp(F.col("file")).alias("stamp"), names.matching(F.col("p_brand"), ["*1*"]).alias("wild")).select(
        "p_partkey", "model", "full_model", "task", "mp.metric", "mp.filter", "file_task", "stamp", "wild")


@query("windows_content", r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w), 64)) AS s FROM t),
    b AS (SELECT *, least(n, s + 64) AS e FROM n) SELECT doc_id, s::INTEGER AS start, (e - s)::INTEGER AS targets, md5(array_to_string(w[(CASE WHEN s = 0 THEN 0 ELSE greatest(0, e - 65) END + 1):s], ' ') || '|' || array_to_string(w[s + 1:e], ' ')) AS content FROM b""")
def windows_content(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    x = readers.spread(read(spark, d, "documents"), "doc_id").where("text is not null").select("doc_id", words.alias("w"))
    x = x.select("doc_id", F.posexplode(relational.rolling_windows(F.col("w"), 64)).alias("i", "v"))
    return x.select("doc_id", (F.col("i") * 64).cast("int").alias("start"), F.size("v.target").alias("targets"), F.md5(F.concat(F.array_join("v.context", " "), F.lit("|"), F.array_join("v.target", " "))).alias("content"))


@query("think_content", """SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN trim(text || ' ' || role) ELSE trim(text) END AS answer FROM conversations WHERE text IS NOT NULL""")
def think_content(spark, d):
    x = read(spark, d, "conversations").where("text is not null")
    t = F.when(F.col("conv_id") % 2 == 0, said("<think>", F.col("role"), " {1} ", F.col("turn"), "</think>", F.col("text"), " ", F.col("role"))).otherwise(F.col("text"))
    return x.select("conv_id", "turn", F.trim(text.remove_think(t)).alias("answer"))


@query("catalogue_rows", f"WITH {TAXONOMY} SELECT category, count(DISTINCT leaf) AS leaves, count(DISTINCT grp) AS groups, count(*) AS samples FROM events JOIN tax ON event_id % 23 = ord GROUP BY category")
def catalogue_rows(spark, d):
    x = read(spark, d, "events").select((F.col("event_id") % 23).cast("int").alias("ord"))
    return x.join(F.broadcast(catalog.taxonomy(spark)), "ord").groupBy("category").agg(F.count_distinct("leaf").alias("leaves"), F.count_distinct("group").alias("groups"), F.count(F.lit(1)).alias("samples"))


@query("video_files", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/videos/' || source || '/v' || doc_id || '.mp4' WHEN 1 THEN '/videos/' || source || '/v' || doc_id || '.MP4' WHEN 2 THEN '/videos/' || source || '/v' || doc_id || '.mp4' END AS found FROM documents""")
def video_files(spark, d):
    k = F.col("doc_id")
    docs = read(spark, d, "documents").select("doc_id", said(F.col("source"), "/v", k, F.when(k % 4 == 2, ".mp4").otherwise("")).alias("name"))
    base = said("/videos/", F.regexp_replace("name", r"\.mp4$", ""))
    files = docs.select(F.explode(F.filter(F.array(F.when(k % 4 != 3, F.when(k % 4 == 1, said(base, ".MP4")).otherwise(said(base, ".mp4"))), F.when(k % 8 == 0, said(base, ".MP4"))), lambda p: p.isNotNull())).alias("path"))
    return media.with_suffix(docs, files, "doc_id", "name", "/videos").select("doc_id", "found")


@query("generated_records", """SELECT conv_id, turn, role || ': ' || text AS question, 4 AS messages, role || ' ' || turn || 's' AS answer, 'img' || conv_id || '.png' AS image, true AS open FROM conversations WHERE text IS NOT NULL""")
def generated_records(spark, d):
    x = read(spark, d, "conversations").where("text is not null")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(turn("user", F.col("text")), turn("system", said(F.col("role"), ": ")), turn("user", F.lit("later")))
    r = x.select("conv_id", "turn", messages.alias("m"), F.array(said("img", F.col("conv_id"), ".png")).alias("i"), said("<think>", F.col("text"), "</think> ", F.col("role"), " ", F.col("turn"), "s").alias("r"))
    r = r.select("conv_id", "turn", tasks.question(F.col("m")).alias("question"), tasks.generated_record(F.col("m"), F.col("i"), F.col("r")).alias("g"))
    last = F.element_at("g.messages", -1)
    return r.select("conv_id", "turn", "question", F.size("g.messages").alias("messages"), last["content"].alias("answer"), F.get("g.images", F.lit(0))["path"].alias("image"), F.forall("g.messages", lambda m: m["loss"].isNull()).alias("open"))


@query("decontamination_queries", "SELECT p_partkey, p_name || ' ' || p_size AS whole, p_brand AS by_column, p_type || '?' AS by_rule, NULL::VARCHAR AS unwanted FROM part")
def decontamination_queries(spark, d):
    p = read(spark, d, "part")
    whole, of = said(F.col("p_name"), " ", F.col("p_size")), tasks.decontamination_query
    return p.select("p_partkey", of(p, whole, True).alias("whole"), of(p, whole, True, "p_brand").alias("by_column"), of(p, whole, True, said(F.col("p_type"), "?")).alias("by_rule"), of(p, whole, False, "p_brand").alias("unwanted"))


@query("task_coresets")
def task_coresets(spark, d):
    x = read(spark, d, "embeddings").select("vec_id", "embedding", said("task", F.col("label")).alias("task"))
    names = [f"task{k}" for k in range(10)]
    return tasks.coresets(x, "task", "vec_id", "embedding", tasks.item_counts(names, [3]))


@query("shown_layers", f"""WITH {TAXONOMY}, e AS (SELECT event_id, CASE WHEN category = 'TargetLocalization' THEN '*' ELSE leaf END AS kind FROM events JOIN tax ON event_id % 23 = ord)
    SELECT event_id, CASE WHEN kind = '*' OR kind = 'GroundDetection' THEN 1 ELSE 2 END::INTEGER AS layers, CASE WHEN kind = '*' THEN 'masklet_target' WHEN kind = 'GroundDetection' THEN 'masklet_ground' WHEN kind LIKE 'FeasiblePath%' THEN 'masklet_path'
      WHEN kind = 'VisualMatching' OR kind = 'AffordanceRegion' THEN 'masklet_reference_area' ELSE 'masklet_reference_object' END AS first,
      CASE WHEN kind = '*' OR kind LIKE 'Placement%' THEN 3 WHEN kind LIKE 'Contact%' OR kind = 'VisualMatching' OR kind = 'AffordanceRegion' THEN 2 ELSE 0 END::INTEGER AS texts FROM e""")
def shown_layers(spark, d):
    x = read(spark, d, "events").select("event_id", (F.col("event_id") % 23).cast("int").alias("ord")).join(F.broadcast(catalog.taxonomy(spark)), "ord")
    x = views.key_texts(views.layers(x.select("event_id", "category", F.col("leaf").alias("kind"))))
    return x.select("event_id", F.size("layers").alias("layers"), F.get("layers", F.lit(0))["field"].alias("first"), F.size("fields").alias("texts"))
