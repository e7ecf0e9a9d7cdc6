"""Registered queries of the engine over the driver's tables, each beside its SQL.

Samples are derived from ``events`` by integer arithmetic that Spark and DuckDB evaluate alike: a 48 x 32 canvas, one true
box and one or two answered ones, in one of five coordinate modes (two of them older names); every 17th sample has no
truth, every 19th no answer, every 29th no truth for its flag. Path tasks have points over a fixed feasible box.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bootstrap, coords, masks, metrics, scores, text
from .operators import explorer, filters, instances, path, prompts, relational, report, rollup, scoring
from .plans import catalog
from .sources import readers
from .streaming import incremental

W, H = 48, 32
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_content, queries_more  # noqa: F401  register the others

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event, with answers as a standard sample has them."""
    e, u = F.col("event_id"), F.col("user_id")
    gx, gy = (e * 7) % 24, (e * 5) % 16
    mode = F.element_at(F.array(*map(F.lit, ("absolute", "normalized_1000", "normalized", "auto"))), (e % 4 + 1).cast("int"))
    sx = F.when(e % 4 == 1, 1000.0 / W).when(e % 4 == 2, 1.0 / W).otherwise(1.0)
    sy = F.when(e % 4 == 1, 1000.0 / H).when(e % 4 == 2, 1.0 / H).otherwise(1.0)
    box = lambda a, b, c, d: F.array(a * sx, b * sy, c * sx, d * sy)
    one = box(gx + u % 7 - 3, gy + u % 5 - 2, gx + 4 + e % 16 + e % 5 - 2, gy + 3 + u % 12 + u % 3 - 1)
    two = box((e * 3) % 40, (u * 3) % 26, (e * 3) % 40 + 6, (u * 3) % 26 + 5)
    boxes = F.when(e % 19 == 0, F.array().cast("array<array<double>>")).when(e % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    truth = F.array(F.struct(*[c.cast("int").alias(n) for n, c in (("x1", gx), ("y1", gy), ("x2", gx + 4 + e % 16), ("y2", gy + 3 + u % 12))]))
    return readers.dealt(read(spark, sf_dir, "events"), "event_id").select(
        F.col("event_id").alias("sid"), "user_id", "event_type", "value", "ts", (e % 23).cast("int").alias("ord"), mode.alias("mode"), boxes.alias("boxes"), truth.alias("truth"), (e % 17 == 0).alias("gt_empty"), (e % 19 == 0).alias("no_answer"),
        (e % 5).cast("int").alias("gt_count"), F.when(e % 19 != 0, 1 + u % 4).cast("int").alias("pred_count"), (e % 2 == 0).alias("precise"), (e % 3 == 0).alias("described"),
        F.when(e % 29 != 0, u % 2 == 0).alias("gt_flag"), F.when(e % 19 != 0, e % 2 == 0).alias("pred_flag"),
    )


def path_points(e, u):
    """Integer points of a path; every fifth has steps so short that each other point is left out."""
    dx, dy = F.when(e % 5 == 0, 1).otherwise(3 + u % 3), F.when(e % 5 == 0, 1).otherwise(2 + e % 4)
    return F.transform(F.sequence(F.lit(0), (3 + e % 4).cast("int")), lambda i: F.struct((5 + i * dx).cast("double").alias("x"), (30 - i * dy).cast("double").alias("y")))


# the same samples in SQL; boxes are rows of b, the truth is in s
SAMPLES = f"""s AS (SELECT event_id AS sid, user_id AS u, event_type, value, ts, (event_id % 23)::INTEGER AS ord, event_id % 4 AS m,
      (event_id * 7) % 24 AS gx, (event_id * 5) % 16 AS gy, (event_id * 7) % 24 + 4 + event_id % 16 AS gx2, (event_id * 5) % 16 + 3 + user_id % 12 AS gy2,
      event_id % 17 = 0 AS gt_empty, event_id % 19 = 0 AS no_answer, (event_id % 5)::INTEGER AS gt_count, CASE WHEN event_id % 29 <> 0 THEN user_id % 2 = 0 END AS gt_flag, CASE WHEN event_id % 19 <> 0 THEN event_id % 2 = 0 END AS pred_flag,
      CASE WHEN event_id % 19 <> 0 THEN (1 + user_id % 4)::INTEGER END AS pred_count, event_id % 2 = 0 AS precise, event_id % 3 = 0 AS described,
      CASE event_id % 4 WHEN 1 THEN 1000.0::DOUBLE / {W} WHEN 2 THEN 1.0::DOUBLE / {W} ELSE 1.0::DOUBLE END AS kx, CASE event_id % 4 WHEN 1 THEN 1000.0::DOUBLE / {H} WHEN 2 THEN 1.0::DOUBLE / {H} ELSE 1.0::DOUBLE END AS ky FROM events),
    raw AS (SELECT sid, m, (gx + u % 7 - 3) * kx AS a, (gy + u % 5 - 2) * ky AS b, (gx2 + sid % 5 - 2) * kx AS c, (gy2 + u % 3 - 1) * ky AS d FROM s WHERE NOT no_answer
      UNION ALL SELECT sid, m, ((sid * 3) % 40) * kx, ((u * 3) % 26) * ky, ((sid * 3) % 40 + 6) * kx, ((u * 3) % 26 + 5) * ky FROM s WHERE NOT no_answer AND sid % 3 = 0),
    told AS (SELECT sid, max(greatest(a, b, c, d)) AS top, min(least(a, b, c, d)) AS low FROM raw GROUP BY sid),
    act AS (SELECT s.sid, CASE s.m WHEN 0 THEN 'absolute' WHEN 1 THEN 'normalized_0_1000' WHEN 2 THEN 'normalized_0_1'
        ELSE CASE WHEN top IS NULL THEN 'absolute' WHEN top <= 1 AND low >= 0 THEN 'normalized_0_1' WHEN top > {max(W, H)} THEN 'normalized_0_1000' ELSE 'absolute' END END AS actual FROM s LEFT JOIN told USING (sid)),
    scl AS (SELECT sid, CASE actual WHEN 'normalized_0_1' THEN {W}::DOUBLE WHEN 'normalized_0_1000' THEN {W} / 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS sx,
        CASE actual WHEN 'normalized_0_1' THEN {H}::DOUBLE WHEN 'normalized_0_1000' THEN {H} / 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS sy FROM act),
    nb AS (SELECT sid, greatest(0.0, least(least(a * sx, c * sx), {W}.0)) AS x1, greatest(0.0, least(least(b * sy, d * sy), {H}.0)) AS y1, greatest(0.0, least(greatest(a * sx, c * sx), {W}.0)) AS x2, greatest(0.0, least(greatest(b * sy, d * sy), {H}.0)) AS y2 FROM raw JOIN scl USING (sid)),
    box AS (SELECT sid, trunc(x1)::INTEGER AS x1, trunc(y1)::INTEGER AS y1, trunc(x2)::INTEGER AS x2, trunc(y2)::INTEGER AS y2 FROM nb WHERE x2 > x1 AND y2 > y1),
    px AS (SELECT DISTINCT sid, x, y FROM (SELECT sid, x1, y1, y2, unnest(range(x1, x2)) AS x, y1 AS ya FROM box) AS t, LATERAL (SELECT unnest(range(t.y1, t.y2)) AS y) AS l),
    it AS (SELECT px.sid, count(*) AS n, count(*) FILTER (px.x >= gx AND px.x < gx2 AND px.y >= gy AND px.y < gy2) AS hit FROM px JOIN s USING (sid) GROUP BY px.sid),
    counted AS (SELECT sid, ord BETWEEN 0 AND 13 OR ord IN (17, 19, 20, 21) AS counted FROM s),
    loc AS (SELECT s.sid, CASE WHEN no_answer THEN (gt_empty OR (counted AND gt_count = 0))::INTEGER::DOUBLE WHEN gt_empty OR (counted AND gt_count = 0) THEN 0.0
        ELSE coalesce(hit, 0)::DOUBLE / (coalesce(n, 0) + (gx2 - gx) * (gy2 - gy) - coalesce(hit, 0)) END AS loc FROM s JOIN counted USING (sid) LEFT JOIN it USING (sid)),
    cs AS (SELECT sid, CASE WHEN pred_count IS NULL THEN 0.0 WHEN precise OR described THEN (pred_count = gt_count)::INTEGER::DOUBLE WHEN gt_count = 0 THEN (pred_count = 0)::INTEGER::DOUBLE ELSE 1.0::DOUBLE - least(1.0::DOUBLE, abs(gt_count - pred_count) / gt_count::DOUBLE) END AS cnt,
        CASE WHEN described THEN 0.1::DOUBLE WHEN precise THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS cw, CASE WHEN pred_flag IS NULL OR gt_flag IS NULL THEN 0.0 ELSE (pred_flag = gt_flag)::INTEGER::DOUBLE END AS flag FROM s),
    pp AS (SELECT sid, i, (5 + i * CASE WHEN sid % 5 = 0 THEN 1 ELSE 3 + u % 3 END)::DOUBLE AS x, (30 - i * CASE WHEN sid % 5 = 0 THEN 1 ELSE 2 + sid % 4 END)::DOUBLE AS y FROM s, range(0, 7) AS r(i) WHERE ord IN (15, 16) AND NOT no_answer AND i <= 3 + sid % 4),
    th AS (SELECT sid, i, x, y, true AS far FROM pp WHERE i = 0 UNION ALL SELECT p.sid, p.i, CASE WHEN l.far THEN p.x ELSE th.x END, CASE WHEN l.far THEN p.y ELSE th.y END, l.far
      FROM th JOIN (SELECT * FROM pp) p ON p.sid = th.sid AND p.i = th.i + 1, LATERAL (SELECT sqrt(pow(p.x - th.x, 2) + pow(p.y - th.y, 2)) >= sqrt({H * H + W * W}) / 30 AS far) l),
    kp AS (SELECT th.sid, x, y, row_number() OVER k - 1 AS k, count(*) OVER (PARTITION BY th.sid) AS n, lag(x) OVER k AS px, lag(y) OVER k AS py, sqrt({H * H + W * W}) AS diag,
        sqrt(pow(x - {W} / 2.0, 2) + pow(y - {H - 1}, 2)) AS ds, sqrt(pow(x - greatest(gx, least(x, gx2 - 1)), 2) + pow(y - greatest(gy, least(y, gy2 - 1)), 2)) AS de,
        sqrt(pow({W} / 2.0 - greatest(gx, least({W} / 2.0, gx2 - 1)), 2) + pow({H - 1} - greatest(gy, least({H - 1}, gy2 - 1)), 2)) AS gap FROM th JOIN s USING (sid) WHERE far WINDOW k AS (PARTITION BY th.sid ORDER BY i)),
    kq AS (SELECT *, lag(ds) OVER (PARTITION BY sid ORDER BY k) AS pds, lag(de) OVER (PARTITION BY sid ORDER BY k) AS pde, sqrt(pow(x - px, 2) + pow(y - py, 2)) AS step,
        len(list_filter(range(0, 50), lambda j: round_even(px * (1 - (j + 0.5::DOUBLE) / 50) + x * ((j + 0.5::DOUBLE) / 50), 0) BETWEEN 4 AND 39 AND round_even(py * (1 - (j + 0.5::DOUBLE) / 50) + y * ((j + 0.5::DOUBLE) / 50), 0) BETWEEN 4 AND 29)) / 50.0::DOUBLE AS fea FROM kp),
    ps AS (SELECT sid, n, k, CASE WHEN k = 0 THEN greatest(0.0, 1 - 3.0::DOUBLE * ds / diag)
        WHEN k < n - 1 THEN 0.4::DOUBLE * fea + 0.2::DOUBLE * (ds > pds)::INTEGER + 0.2::DOUBLE * (de < pde)::INTEGER + 0.2::DOUBLE * (step BETWEEN diag / 30 AND gap * 2 / 3.0::DOUBLE)::INTEGER
        ELSE (0.3::DOUBLE * greatest(0.0, 1 - 3.0::DOUBLE * de / diag) + 0.4::DOUBLE * fea + 0.1::DOUBLE * (ds > pds)::INTEGER + 0.1::DOUBLE * (de < pde)::INTEGER
          + CASE WHEN n >= 3 THEN 0.1::DOUBLE * (step BETWEEN diag / 30 AND gap * 2 / 3.0::DOUBLE)::INTEGER ELSE 0 END) / CASE WHEN n >= 3 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END END AS p FROM kq),
    pth AS (SELECT sid, CASE WHEN max(n) < 2 THEN 0.0 ELSE avg(p) END AS path FROM ps GROUP BY sid),
    sc AS (SELECT s.*, round(loc, 9) AS loc, cnt, cw, flag, coalesce(path, 0.0) AS path, CASE WHEN ord IN (15, 16) THEN coalesce(path, 0.0) WHEN ord = 17 THEN 0.5::DOUBLE * loc.loc + 0.5::DOUBLE * cnt WHEN ord = 22 THEN 0.5::DOUBLE * loc.loc + 0.5::DOUBLE * flag
          WHEN counted THEN (1.0::DOUBLE - cw) * loc.loc + cw * cnt ELSE loc.loc END AS score,
        (no_answer AND (counted OR ord IN (15, 16, 22))) OR (ord = 22 AND gt_flag IS NULL) AS bad FROM s JOIN loc USING (sid) JOIN cs USING (sid) JOIN counted USING (sid) LEFT JOIN pth USING (sid))"""
_VALUES = ", ".join(f"({o}, '{c}', '{g}', '{leaf}', '{t}', '{bg}')" for o, c, g, leaf, t, bg in catalog.leaves())
TAXONOMY = f"tax(ord, category, grp, leaf, by_type, by_group) AS (VALUES {_VALUES})"


FEASIBLE = ((4, 4), (40, 30))  # corners of the area in which paths are feasible


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the scores of all metrics and the combined one; the scorer is chosen by the leaf."""
    s = samples(spark, sf_dir).join(F.broadcast(catalog.taxonomy(spark)), "ord").withColumn("kind", F.col("leaf"))
    need = catalog.required(F.col("category"), F.col("leaf"))
    s = s.withColumn("need", need)
    empty = F.col("gt_empty") | (F.col("need.count") & (F.col("gt_count") == 0))
    loc = scores.localization(F.col("boxes"), F.col("truth"), empty, F.lit(H), F.lit(W), F.col("mode"))
    cnt = scores.count(F.col("pred_count"), F.col("gt_count"), scores.exact_count(F.col("precise"), F.col("described")))
    flag = F.coalesce(scores.binary(F.col("pred_flag"), F.col("gt_flag")), F.lit(0.0))
    s = relational.evaluated(s, loc=loc, cnt=F.coalesce(cnt, F.lit(0.0)), cw=scores.count_weight(F.col("precise"), F.col("described")), binary=flag)
    s = s.withColumn("localization", F.col("loc")).withColumn("count", F.col("cnt"))
    area = masks.one_box_runs(F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*FEASIBLE[0], *FEASIBLE[1]), strict=True)]), F.lit(H))
    # only rows of paths go through the path function
    points = F.when(~F.col("no_answer"), path_points(F.col("sid"), F.col("user_id")))
    paths = s.where("need.path").withColumns({"points": points, "area": area, "goal": masks.one_box_runs(F.col("truth")[0], F.lit(H))})  # arguments of the function can't hold nested lambdas
    paths = paths.withColumn("p", path.score_only("points", "area", "goal", F.lit(H), F.lit(W), F.col("leaf") == "FeasiblePath_Exo")).drop("points", "area", "goal")
    others = s.where("not need.path").withColumn("p", F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("error")))
    s = others.unionByName(paths).withColumn("path", F.col("p.score")).withColumn("path_error", F.col("p.error")).drop("p")
    told = lambda a, b, name: F.when(a.isNull() | b.isNull(), f"Missing pred_{name} or gt_{name}")
    s = s.withColumn("localization_error", F.lit(None).cast("string")).withColumn("count_error", told(F.col("pred_count"), F.col("gt_count"), "count")).withColumn("binary_error", told(F.col("pred_flag"), F.col("gt_flag"), "binary"))
    return scoring.score_samples(s)


def _grain(g: str, key: str, o: str, extra: str = "") -> str:
    return f"SELECT '{g}' AS grain, {key} AS key, {o} AS ord, count(*) AS total_expected, count(*) AS total_processed, sum(bad::INTEGER)::BIGINT AS num_invalid, round(avg(score), 9) AS mean_score FROM t {extra} GROUP BY ALL"


REPORT = f"""WITH RECURSIVE {SAMPLES}, {TAXONOMY}, t AS (SELECT sc.*, category, by_type, by_group FROM sc JOIN tax USING (ord)),
    cats AS (SELECT category AS c, (row_number() OVER (ORDER BY min(ord)) - 1)::INTEGER AS co FROM tax GROUP BY 1), grps AS (SELECT by_group AS g, (row_number() OVER (ORDER BY min(ord)) - 1)::INTEGER AS go FROM tax GROUP BY 1)
    {_grain("overall", "'overall'", "-1")} UNION ALL {_grain("category", "category", "co", "JOIN cats ON c = category")} UNION ALL {_grain("type", "by_type", "ord")} UNION ALL {_grain("group", "by_group", "go", "JOIN grps ON g = by_group")}"""


@query("flagship_score_report", REPORT)
def flagship(spark, d):
    return report.score_report(scored(spark, d)).withColumn("mean_score", F.round("mean_score", 9))


@query("iou_box_union", f"WITH RECURSIVE {SAMPLES} SELECT sid, round(loc, 9) AS iou FROM sc WHERE NOT gt_empty AND NOT no_answer")
def iou_box_union(spark, d):
    return scored(spark, d).where("not gt_empty and not no_answer").select("sid", F.round("loc", 9).alias("iou"))


@query("iou_rle_runs", """WITH e AS (SELECT event_id AS sid, [event_id % 5, 3 + event_id % 7, event_id % 4, 2 + user_id % 9, 50] AS a, [user_id % 6, 4 + user_id % 5, event_id % 3, 1 + event_id % 6] AS b FROM events),
    p AS (SELECT sid, 1 AS k, unnest(list_concat(range(a[1], least(a[1] + a[2], 32)), range(a[1] + a[2] + a[3], least(a[1] + a[2] + a[3] + a[4], 32)))) AS x FROM e
          UNION ALL SELECT sid, 2, unnest(list_concat(range(b[1], least(b[1] + b[2], 32)), range(b[1] + b[2] + b[3], least(b[1] + b[2] + b[3] + b[4], 32)))) FROM e),
    n AS (SELECT sid, x, min(k) AS lo, max(k) AS hi FROM p GROUP BY ALL)
    SELECT sid, round(count(*) FILTER (lo < hi) / count(*)::DOUBLE, 9) AS iou FROM n GROUP BY sid""")
def iou_rle_runs(spark, d):
    e, u = F.col("event_id").cast("int"), F.col("user_id").cast("int")
    a, b = F.array(e % 5, 3 + e % 7, e % 4, 2 + u % 9, F.lit(50)), F.array(u % 6, 4 + u % 5, e % 3, 1 + e % 6)
    x = read(spark, d, "events").select(F.col("event_id").alias("sid"), masks.rle_runs(a, F.lit(32)).alias("a"), masks.rle_runs(b, F.lit(32)).alias("b"))
    return x.select("sid", F.round(masks.iou(F.col("a"), F.col("b")), 9).alias("iou"))


@query("coord_auto_resolution", f"WITH RECURSIVE {SAMPLES} SELECT s.sid, actual, count(box.sid) AS n_boxes, coalesce(sum((x2 - x1) * (y2 - y1)), 0)::BIGINT AS area FROM s JOIN act USING (sid) LEFT JOIN box USING (sid) GROUP BY ALL")
def coord_auto_resolution(spark, d):
    s = samples(spark, d).withColumn("actual", coords.actual_mode(F.flatten("boxes"), F.lit(H), F.lit(W), F.col("mode")))
    s = s.withColumn("n", coords.normal_boxes(F.col("boxes"), F.lit(H), F.lit(W), F.col("actual")))
    return s.select("sid", "actual", F.size("n").cast("long").alias("n_boxes"), F.aggregate("n", F.lit(0).cast("long"), lambda t, b: t + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).alias("area"))


@query("count_score_modes", f"WITH RECURSIVE {SAMPLES} SELECT cw, precise, described, count(*) AS n, round(avg(cnt), 9) AS mean_count FROM cs JOIN s USING (sid) GROUP BY ALL")
def count_score_modes(spark, d):
    return scored(spark, d).groupBy("cw", "precise", "described").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cnt"), 9).alias("mean_count"))


@query("placement_binary_score", f"WITH RECURSIVE {SAMPLES} SELECT sid, round(score, 9) AS score, flag, bad AS invalid FROM sc WHERE ord = 22")
def placement_binary_score(spark, d):
    return scored(spark, d).where("leaf = 'PlacementRegion'").select("sid", F.round("score", 9).alias("score"), F.col("score_details.binary_score").alias("flag"), "invalid")


@query("visual_matching_score", f"WITH RECURSIVE {SAMPLES} SELECT sid, round(score, 9) AS score, cnt, bad AS invalid FROM sc WHERE ord = 17")
def visual_matching_score(spark, d):
    return scored(spark, d).where("leaf = 'VisualMatching'").select("sid", F.round("score", 9).alias("score"), F.col("score_details.count_score").alias("cnt"), "invalid")


@query("feasible_path_score", f"WITH RECURSIVE {SAMPLES} SELECT sid, round(score, 9) AS score, bad AS invalid FROM sc WHERE ord IN (15, 16)")
def feasible_path_score(spark, d):
    return scored(spark, d).where("category = 'Navigation' and `group` = 'FeasiblePath'").select("sid", F.round("score", 9).alias("score"), "invalid")


@query("score_details", f"""WITH RECURSIVE {SAMPLES} SELECT sid, ord, CASE WHEN ord IN (15, 16) THEN 0.0::DOUBLE ELSE round(l.loc, 9) END AS loc, CASE WHEN counted THEN cnt ELSE 0.0::DOUBLE END AS cnt, CASE WHEN ord IN (15, 16) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS wp,
    round(CASE WHEN ord IN (15, 16) THEN 0.0::DOUBLE WHEN ord IN (17, 22) THEN 0.5::DOUBLE WHEN counted THEN 1 - cw ELSE 1.0::DOUBLE END, 9) AS wl, CASE WHEN ord = 17 THEN 0.5::DOUBLE WHEN counted THEN cw ELSE 0.0::DOUBLE END AS wc, CASE WHEN ord = 22 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS wb
    FROM sc JOIN counted USING (sid) JOIN loc AS l ON l.sid = sc.sid""")
def score_details(spark, d):
    c = "score_details."
    pick = {"loc": F.round(f"{c}localization_score", 9), "cnt": F.col(f"{c}count_score"), "wp": F.col(f"{c}weight_path"), "wl": F.round(f"{c}weight_localization", 9), "wc": F.col(f"{c}weight_count"), "wb": F.col(f"{c}weight_binary")}
    return scored(spark, d).select("sid", "ord", *[x.alias(n) for n, x in pick.items()])


@query("invalid_flagging", f"WITH RECURSIVE {SAMPLES}, {TAXONOMY} SELECT leaf, count(*) AS n, sum(bad::INTEGER)::BIGINT AS n_invalid, sum((no_answer AND gt_empty AND loc = 1.0)::INTEGER)::BIGINT AS n_credited FROM sc JOIN tax USING (ord) GROUP BY leaf")
def invalid_flagging(spark, d):
    credited = F.col("no_answer") & F.col("gt_empty") & (F.col("loc") == 1.0)
    return scored(spark, d).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("invalid").cast("long")).alias("n_invalid"), F.sum(credited.cast("long")).alias("n_credited"))


@query("report_expected_counts", f"""WITH RECURSIVE {SAMPLES}, {TAXONOMY}, t AS (SELECT sc.*, category, by_type FROM sc JOIN tax USING (ord) WHERE ord <> 3),
    f AS (SELECT 'type' AS grain, by_type AS key, count(*) AS p, round(avg(score), 9) AS m FROM t GROUP BY ALL UNION ALL SELECT 'category', category, count(*), round(avg(score), 9) FROM t GROUP BY ALL),
    w(grain, key, n) AS (VALUES ('type', 'TargetLocalization/BasicAttributes/Material', 7), ('type', 'Navigation/GroundDetection', 100), ('category', 'Nowhere', 5))
    SELECT coalesce(f.grain, w.grain) AS grain, coalesce(f.key, w.key) AS key, coalesce(n, p)::BIGINT AS total_expected, coalesce(p, 0) AS total_processed, coalesce(m, 0) AS mean_score
    FROM f FULL JOIN w ON f.grain = w.grain AND f.key = w.key WHERE p IS NOT NULL OR w.grain = 'type'""")
def report_expected_counts(spark, d):
    want = spark.createDataFrame([("type", "TargetLocalization/BasicAttributes/Material", 7), ("type", "Navigation/GroundDetection", 100), ("category", "Nowhere", 5)], "grain string, key string, n long")
    out = report.score_report(scored(spark, d).where("ord <> 3"), want).where("grain in ('type', 'category')")
    return out.select("grain", "key", "total_expected", "total_processed", F.round("mean_score", 9).alias("mean_score"))


@query("filter_category_group", f"WITH RECURSIVE {SAMPLES}, {TAXONOMY} SELECT sid, leaf FROM s JOIN tax USING (ord) WHERE category = 'TargetLocalization' AND grp = 'BasicAttributes' AND leaf IN ('Color', 'Material')")
def filter_category_group(spark, d):
    s = samples(spark, d).join(F.broadcast(catalog.taxonomy(spark)), "ord").withColumn("kind", F.col("leaf"))
    return scoring.filter_samples(s, kinds=["Color", "Material", "Spoken"], group="BasicAttributes").select("sid", "leaf")


@query("explorer_filter_sort", f"WITH RECURSIVE {SAMPLES}, {TAXONOMY} SELECT sid, round(score, 9) AS score, (row_number() OVER (ORDER BY round(coalesce(score, 0), 9) DESC, sid))::INTEGER AS place FROM sc JOIN tax USING (ord) WHERE category = 'Navigation' AND NOT bad AND round(score, 9) BETWEEN 0.2 AND 0.9 AND contains(lower(replace(event_type || ' ' || leaf, '_', ' ')), 'path') QUALIFY place <= 200")
def explorer_filter_sort(spark, d):
    s = scored(spark, d).withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    hits = explorer.found(explorer.filtered(s, "Navigation", valid=True, low=0.2, high=0.9), "path", F.col("event_type"), F.col("leaf"))
    top = explorer.ordered(hits, "score_down", "sid").limit(200)
    return top.select("sid", "score", F.row_number().over(Window.orderBy(F.desc("score"), "sid")).alias("place"))


@query("coord_override_by_family", "SELECT event_id AS sid, CASE event_id % 4 WHEN 0 THEN 'absolute' WHEN 1 THEN 'normalized_0_1' WHEN 2 THEN 'normalized_0_1000' ELSE ['absolute', 'normalized_1000', 'normalized', 'auto'][event_id % 4 + 1] END AS mode FROM events")
def coord_override_by_family(spark, d):
    family = F.element_at(F.array(*map(F.lit, ("Claude", "LLaVA", "Gemini", "Own"))), (F.col("sid") % 4 + 1).cast("int"))
    return samples(spark, d).select("sid", F.coalesce(catalog.lookup(catalog.COORD_MODES, family), F.col("mode")).alias("mode"))


@query("model_compare_delta", "WITH a AS (SELECT user_id AS id, round(sum(value), 6) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS id, round(sum(value), 6) AS s FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT id, a.s AS score_1, b.s AS score_2, round(a.s - b.s, 6) AS delta FROM a JOIN b USING (id)")
def model_compare_delta(spark, d):
    e = read(spark, d, "events")
    run = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("id")).agg(F.round(F.sum("value"), 6).alias("s"))
    return relational.compare_models(run(0), run(1), "id", "s").withColumn("delta", F.round("delta", 6))


@query("topk_per_subtask", "SELECT event_type, event_id, value, (row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id))::INTEGER AS rank FROM events QUALIFY rank <= 50")
def topk_per_subtask(spark, d):
    return relational.top_k(read(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.col("event_id")], 50)


@query("keep_last_upsert", "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def keep_last_upsert(spark, d):
    return relational.keep_last(read(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


_SUB = "CASE event_id % 5 WHEN 0 THEN 'a concrete recognition task' WHEN 1 THEN 'ANALYTICAL questions' WHEN 2 THEN 'divergent thinking' WHEN 3 THEN '' ELSE 'else' END"


@query("subtask_score_rollup", f"""WITH t AS (SELECT {_SUB} AS x, CASE WHEN event_id % 7 = 0 THEN -1 ELSE user_id % 11 END AS score FROM events),
    u AS (SELECT CASE WHEN trim(x) = '' THEN 'Not Specified' WHEN contains(lower(x), 'concrete recognition') THEN 'Concrete Recognition' WHEN contains(lower(x), 'analytical questions') THEN 'Analytical Questions' WHEN contains(lower(x), 'divergent thinking') THEN 'Divergent Thinking' ELSE 'Further Insights' END AS subtask, score FROM t WHERE score <> -1)
    SELECT coalesce(subtask, 'Total') AS subtask, count(*) AS n, round(avg(score) * 10, 9) AS score FROM u GROUP BY ROLLUP (subtask)""")
def subtask_score_rollup(spark, d):
    e = read(spark, d, "events").select(relational.subtask(F.expr(_SUB)).alias("subtask"), F.expr("CASE WHEN event_id % 7 = 0 THEN -1 ELSE user_id % 11 END").alias("score"))
    return relational.subtask_rollup(e, "subtask", "score").withColumn("score", F.round("score", 9))


@query("run_diff", """WITH a AS (SELECT event_type AS task, round(avg(value), 9) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS task, round(avg(value), 9) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1)
    SELECT task, a.v AS before, b.v AS after, round(b.v - a.v, 9) AS delta, round(100 * (b.v - a.v) / nullif(a.v, 0), 7) AS percent FROM a FULL JOIN b USING (task)""")
def run_diff(spark, d):
    e = read(spark, d, "events")
    run = lambda k: e.where(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("task")).agg(F.round(F.avg("value"), 9).alias("v"))
    return relational.run_diff(run(0), run(1), "task", "v").withColumn("delta", F.round("delta", 9)).withColumn("percent", F.round("percent", 7))


@query("weighted_perplexity_bits", """WITH t AS (SELECT lang, -(n_chars % 100)::DOUBLE AS ll, strlen(coalesce(text, '')) AS n FROM documents)
    SELECT lang, round(exp(-sum(ll) / sum(n)), 9) AS byte_perplexity, round(-(sum(ll) / sum(n)) / ln(2), 9) AS bits_per_byte, round(sum(ll) / sum(n), 9) AS weighted, round(exp(-avg(ll / 100)), 9) AS perplexity FROM t GROUP BY lang""")
def weighted_perplexity_bits(spark, d):
    t = read(spark, d, "documents").select("lang", (-(F.col("n_chars") % 100)).cast("double").alias("ll"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    a, b = F.col("ll"), F.col("n")
    return t.groupBy("lang").agg(*[F.round(x, 9).alias(n) for n, x in (("byte_perplexity", metrics.weighted_perplexity(a, b)), ("bits_per_byte", metrics.bits_per_byte(a, b)), ("weighted", metrics.weighted_mean(a, b)), ("perplexity", metrics.perplexity(a / 100)))])


_TASKS = "SELECT l_returnflag AS grp, l_returnflag || l_linestatus AS task, count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL"


@query("mean_stderr_pooled", f"WITH t AS ({_TASKS}) SELECT grp, sum(n)::BIGINT AS size, round(sum(m * n) / sum(n), 8) AS value, round(sqrt(sum((n - 1) * se * se * n) / (sum(n) - count(*)) / sum(n)), 9) AS stderr FROM t GROUP BY grp")
def mean_stderr_pooled(spark, d):
    x = F.col("l_quantity")
    t = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.concat("l_returnflag", "l_linestatus").alias("task")).agg(F.count(x).alias("size"), metrics.mean(x).alias("value"), metrics.stderr(x).alias("stderr"))
    pairs = t.select("grp", "task").distinct()
    out = report.group_rollup(t.drop("grp").withColumn("metric", F.lit("quantity")), pairs)
    return out.select("grp", "size", F.round("value", 8).alias("value"), F.round("stderr", 9).alias("stderr"))


@query("combined_stderr_fold", f"""WITH RECURSIVE t AS ({_TASKS}), o AS (SELECT *, row_number() OVER (ORDER BY task) AS k FROM t),
    f AS (SELECT k, n::DOUBLE AS n, m, se * se * n AS v FROM o WHERE k = 1
      UNION ALL SELECT o.k, f.n + o.n, (f.m * f.n + o.m * o.n) / (f.n + o.n), ((f.n - 1) * f.v + (o.n - 1) * o.se * o.se * o.n) / (f.n + o.n - 1) + f.n * o.n * (f.m - o.m) * (f.m - o.m) / ((f.n + o.n) * (f.n + o.n - 1)) FROM f JOIN o ON o.k = f.k + 1)
    SELECT round(sqrt(v / n), 9) AS stderr FROM f ORDER BY k DESC LIMIT 1""")
def combined_stderr_fold(spark, d):
    x = F.col("l_quantity")
    t = read(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("task")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), metrics.stderr(x).alias("se"))
    return t.agg(F.round(metrics.combined_stderr(F.col("task"), F.col("se"), F.col("n"), F.col("m")), 9).alias("stderr"))


@query("f1_mcc", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS fp, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS fn, count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS tn FROM labels)
    SELECT round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc FROM c""")
def f1_mcc(spark, d):
    return read(spark, d, "labels").agg(F.round(metrics.f1(F.col("quality"), F.col("toxic")), 9).alias("f1"), F.round(metrics.mcc(F.col("quality"), F.col("toxic")), 9).alias("mcc"))


@query("brier", "SELECT round(avg(pow((1 - n_chars % 100 / 100.0::DOUBLE) - (quality = 0)::INTEGER, 2) + pow(n_chars % 100 / 100.0::DOUBLE - (quality = 1)::INTEGER, 2)), 9) AS brier FROM labels JOIN documents USING (doc_id)")
def brier(spark, d):
    p = F.col("n_chars") % 100 / F.lit(100.0)
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.agg(F.round(metrics.brier(F.col("quality"), F.array(1 - p, p)), 9).alias("brier"))


@query("acc_all", "SELECT round(avg(ok::INTEGER), 9) AS acc_all FROM (SELECT bool_and(l_quantity < 45) AS ok FROM lineitem GROUP BY l_orderkey)")
def acc_all(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") < 45).alias("right"))
    return metrics.acc_all(x, ["l_orderkey"], "right").select(F.round("acc_all", 9).alias("acc_all"))


@query("median_unsorted", "SELECT o_orderpriority, list(o_totalprice ORDER BY o_orderkey)[count(*) // 2 + 1] AS median FROM orders GROUP BY 1")
def median_unsorted(spark, d):
    return rollup.median_of(read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey")


@query("mcq_argmin", """WITH t AS (SELECT vec_id, embedding[1:4] AS x, label % 5 AS g FROM embeddings), a AS (SELECT vec_id, g, list_position(x, list_min(x)) - 1 AS p, list_transform([1, 2, 3, 4], lambda i: x[i]::DOUBLE / i) AS y FROM t)
    SELECT vec_id, p::INTEGER AS pred, (list_position(y, list_min(y)) - 1)::INTEGER AS pred_norm, (p = CASE WHEN g >= 4 THEN -100 ELSE g END)::INTEGER::DOUBLE AS acc FROM a""")
def mcq_argmin(spark, d):
    x = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    m = metrics.mcq(x, F.col("label") % 5, F.array(*[F.lit(float(i)) for i in (1, 2, 3, 4)]))
    return read(spark, d, "embeddings").select("vec_id", m.alias("m")).select("vec_id", "m.pred", "m.pred_norm", "m.acc")


@query("exact_match_options", """WITH t AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN p_name || '7' ELSE p_name || ' x' END AS b FROM part)
    SELECT p_partkey, (a = b)::INTEGER::DOUBLE AS plain, (translate(lower(a), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~0123456789', '') = translate(lower(b), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~0123456789', ''))::INTEGER::DOUBLE AS loose FROM t""")
def exact_match_options(spark, d):
    b = F.expr("CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN p_name || '7' ELSE p_name || ' x' END")
    return read(spark, d, "part").select("p_partkey", text.exact_match(F.col("p_name"), b).alias("plain"), text.exact_match(F.col("p_name"), b, True, True, True).alias("loose"))


@query("anls", """WITH t AS (SELECT p_partkey, p_name AS a, [p_brand, upper(p_name) || ' ' || (p_partkey % 100)] AS refs FROM part),
    r AS (SELECT p_partkey, a, unnest(refs) AS r FROM t), c AS (SELECT p_partkey, levenshtein(lower(trim(regexp_replace(r, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(a, '\\s+', ' ', 'g')))) / greatest(length(a), length(r))::DOUBLE AS x FROM r)
    SELECT p_partkey, round(CASE WHEN min(x) < 0.5 THEN 1.0 - min(x) ELSE 0.0 END, 9) AS anls FROM c GROUP BY 1""")
def anls(spark, d):
    refs = F.array("p_brand", F.concat(F.upper("p_name"), F.lit(" "), (F.col("p_partkey") % 100).cast("string")))
    return read(spark, d, "part").select("p_partkey", F.round(text.anls(F.col("p_name"), refs), 9).alias("anls"))


@query("regex_filter", "SELECT conv_id, turn, coalesce(nullif(trim(regexp_extract_all(text, '[A-Z][a-z]+')[1]), ''), '[invalid]') AS first, coalesce(nullif(trim(regexp_extract_all(text, '[A-Z][a-z]+')[-1]), ''), '[invalid]') AS last FROM conversations")
def regex_filter(spark, d):
    x = read(spark, d, "conversations").withColumn("r", F.array("text"))
    x = filters.pipeline(x, "r", {"a": [("regex", "[A-Z][a-z]+", 0), ("take_first",)], "b": [("regex", "[A-Z][a-z]+", -1), ("take_first",)]})
    return x.select("conv_id", "turn", F.col("a").alias("first"), F.col("b").alias("last"))


@query("map_filter", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE '?' END AS code, upper(role) AS shout FROM conversations")
def map_filter(spark, d):
    x = filters.pipeline(read(spark, d, "conversations").withColumn("r", F.array("role")), "r", {"code": [("map", {"user": "U", "assistant": "A"}, "?"), ("take_first",)], "shout": [("uppercase",), ("take_first",)]})
    return x.select("conv_id", "turn", "code", "shout")


@query("take_k", "SELECT vec_id, len(embedding[1:3])::INTEGER AS n, embedding[1] AS first FROM embeddings")
def take_k(spark, d):
    x = filters.pipeline(read(spark, d, "embeddings"), "embedding", {"k3": [("take_first_k", 3)], "first": [("take_first",)]})
    return x.select("vec_id", F.size("k3").alias("n"), "first")


@query("majority_vote", """WITH t AS (SELECT event_id AS sid, [event_id % 3, user_id % 3, (event_id + user_id) % 3, event_id % 2, user_id % 2] AS r FROM events), u AS (SELECT sid, unnest(r) AS v, generate_subscripts(r, 1) AS p FROM t),
    c AS (SELECT sid, v, count(*) AS n, min(p) AS p FROM u GROUP BY ALL) SELECT sid, arg_max(v, n * 10 - p)::VARCHAR AS vote FROM c GROUP BY sid""")
def majority_vote(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    r = F.transform(F.array(e % 3, u % 3, (e + u) % 3, e % 2, u % 2), lambda x: x.cast("string"))
    return read(spark, d, "events").select(e.alias("sid"), text.majority(r).alias("vote"))


_TAGGED = "CASE conv_id % 4 WHEN 0 THEN '<think>' || text || '</think> done' WHEN 1 THEN '<think>' || text WHEN 2 THEN text || '</think> end' ELSE text END"


@query("think_strip", f"""WITH t AS (SELECT conv_id, turn, {_TAGGED} AS x FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, md5(CASE WHEN contains(x, '<think>') AND contains(x, '</think>') THEN trim(regexp_replace(x, '<think>.*?</think>', '', 'gs')) WHEN contains(x, '<think>') THEN '' ELSE x END) AS stripped,
      contains(x, '<think>') AND NOT contains(x, '</think>') AS think_only, md5(trim(regexp_replace(x, '^.*?</think>', '', 's'))) AS removed FROM t""")
def think_strip(spark, d):
    x = read(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.expr(_TAGGED).alias("x"))
    s = text.strip_think(F.col("x"))
    return x.select("conv_id", "turn", F.md5(s["text"]).alias("stripped"), s["think_only"].alias("think_only"), F.md5(text.remove_think(F.col("x"))).alias("removed"))


@query("task_from_path", f"""WITH {TAXONOMY}, t AS (SELECT page_id, leaf, category, grp FROM pages JOIN tax ON ord = page_id % 23)
    SELECT page_id, leaf, CASE WHEN category = 'TargetLocalization' THEN 'TargetLocalization' ELSE grp END AS base FROM t""")
def task_from_path(spark, d):
    t = read(spark, d, "pages").withColumn("ord", (F.col("page_id") % 23).cast("int")).join(F.broadcast(catalog.taxonomy(spark)), "ord")
    kind = F.when(F.col("category") == "TargetLocalization", F.col("group")).when(F.col("group").isin("FeasiblePath", "ContactRelationship"), F.col("group")).otherwise(F.col("leaf"))
    file = F.concat_ws("/", F.lit("/data"), "category", "group", "leaf", F.col("page_id").cast("string"), F.lit("gt.json"))
    leaf = catalog.resolve_leaf(F.col("category"), kind, file)
    return t.select("page_id", leaf.alias("leaf"), catalog.base_type(F.col("category"), F.col("leaf")).alias("base"))


@query("prompt_build", """WITH t AS (SELECT conv_id, max(text) FILTER (turn = 0) AS a, max(text) FILTER (turn = 1) AS b FROM conversations GROUP BY 1)
    SELECT conv_id, md5(concat_ws(chr(10), nullif(trim(a), ''), nullif(trim(b), ''))) AS user_md5, trim(split_part(a, chr(10), 1)) AS head, replace('dir_image/' || conv_id || '_image.png', conv_id || '_image.png', conv_id || '_target_area_overlay.png') AS overlay FROM t WHERE a IS NOT NULL""")
def prompt_build(spark, d):
    t = read(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b")).where("a is not null")
    image = F.concat(F.lit("dir_image/"), F.col("conv_id").cast("string"), F.lit("_image.png"))
    return t.select("conv_id", F.md5(prompts.user_text(F.col("a"), F.col("b"))).alias("user_md5"), prompts.split_system(F.col("a"))["head"].alias("head"), prompts.overlay(image, "target_area").alias("overlay"))


@query("fewshot_context", """WITH e AS (SELECT item_id, text FROM benchmark WHERE text IS NOT NULL ORDER BY item_id LIMIT 4),
    j AS (SELECT b.item_id, e.item_id AS k, e.text, row_number() OVER (PARTITION BY b.item_id ORDER BY e.item_id) AS r FROM benchmark b JOIN e ON e.item_id <> b.item_id)
    SELECT item_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY k)) AS context FROM j WHERE r <= 3 GROUP BY 1""")
def fewshot_context(spark, d):
    b = read(spark, d, "benchmark")
    x = prompts.fewshot(b.select("item_id"), b.where("text is not null").select("item_id", "text", F.col("item_id").alias("seq")), "item_id", 3)
    return x.select("item_id", F.md5("context").alias("context"))


@query("shard_stride", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 3 AND (o_orderkey - 3) % 8 = 0")
def shard_stride(spark, d):
    return relational.shard(read(spark, d, "orders"), "o_orderkey", 3, 8).select("o_orderkey")


@query("rolling_windows", """WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, n::INTEGER AS n_tokens, CASE WHEN n = 0 THEN 0 WHEN n <= 64 THEN 1 ELSE 1 + ceil((n - 64) / 64.0)::INTEGER END::INTEGER AS n_windows, n::INTEGER AS n_predicted FROM t""")
def rolling_windows(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    x = readers.spread(read(spark, d, "documents"), "doc_id").where("text is not null").select("doc_id", F.size(words).alias("n_tokens"))
    x = x.select("*", relational.rolling_windows(F.sequence(F.lit(1), F.greatest("n_tokens", F.lit(1))), 64).alias("w"))
    some = lambda c: F.when(F.col("n_tokens") == 0, 0).otherwise(c)
    return x.select("doc_id", "n_tokens", some(F.size("w")).alias("n_windows"), some(F.aggregate("w", F.lit(0), lambda a, y: a + F.size(y["target"]))).alias("n_predicted"))


@query("length_reorder_restore", "SELECT doc_id, source, max(n_chars) OVER (PARTITION BY (place - 1) // 16) AS padded FROM (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents)")
def length_reorder_restore(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("seq"), "source", "n_chars")
    batches = instances.longest_first(docs, "n_chars", 16)
    padded = batches.join(batches.groupBy("batch").agg(F.max("n_chars").alias("padded")), "batch")
    return instances.restored(padded).select(F.col("seq").alias("doc_id"), "source", "padded")


@query("html_visible_text")
def html_visible_text(spark, d):
    return read(spark, d, "pages").select("page_id", text.visible_text("html").alias("text"))


@query("kcenter_select", """WITH RECURSIVE e AS (SELECT vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    r AS (SELECT 0 AS i, k, v, 'inf'::DOUBLE AS d FROM e UNION ALL
      SELECT a.i + 1, a.k, a.v, least(a.d, list_sum(list_transform(list_zip(a.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) FROM r AS a, (SELECT v FROM r ORDER BY d DESC, k LIMIT 1) AS c WHERE a.i < 31)
    SELECT k AS key, i::INTEGER AS pick FROM r QUALIFY row_number() OVER (PARTITION BY i ORDER BY d DESC, k) = 1""")
def kcenter_select(spark, d):
    return relational.kcenter(read(spark, d, "embeddings"), "vec_id", "embedding", 32)


@query("bootstrap_stderr")
def bootstrap_stderr(spark, d):
    x = read(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("q"))
    return metrics.bootstrap_stderr(x, "q", "doc_id", bootstrap.MEAN, 2000)


@query("path_score", f"""WITH RECURSIVE {SAMPLES} SELECT sid, round(path, 9) AS score, max(n)::INTEGER AS kept, count(*)::INTEGER AS shown, round(avg(fea) FILTER (k > 0), 9) AS feasibility, round(max(p) FILTER (k = 0), 9) AS first_point
    FROM sc JOIN ps USING (sid) JOIN kq USING (sid, n, k) GROUP BY ALL""")
def path_score(spark, d):
    area = masks.one_box_runs(F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*FEASIBLE[0], *FEASIBLE[1]), strict=True)]), F.lit(H))
    s = samples(spark, d).where(F.col("ord").isin(15, 16) & ~F.col("no_answer"))
    s = s.select("sid", "ord", path_points(F.col("sid"), F.col("user_id")).alias("points"), area.alias("area"), masks.one_box_runs(F.col("truth")[0], F.lit(H)).alias("goal"))
    r = path.result("points", "area", "goal", F.lit(H), F.lit(W), F.col("ord") == 16)
    used = F.filter("r.points", lambda p: p["used"])
    return s.select("sid", r.alias("r")).select("sid", F.round("r.score", 9).alias("score"), F.col("r.after").alias("kept"), F.size(used).alias("shown"), F.round("r.feasibility", 9).alias("feasibility"), F.round(used[0]["score"], 9).alias("first_point"))


@query("nearby_filter", """WITH RECURSIVE p AS (SELECT event_id AS sid, i, ((event_id * i) % 7)::DOUBLE AS x, ((user_id + i * i) % 5)::DOUBLE AS y FROM events, range(1, 7) AS r(i)),
    f AS (SELECT sid, i, x, y, 1 AS n FROM p WHERE i = 1 UNION ALL SELECT p.sid, p.i, CASE WHEN far THEN p.x ELSE f.x END, CASE WHEN far THEN p.y ELSE f.y END, n + far::INTEGER
      FROM f JOIN (SELECT * FROM p) p ON p.sid = f.sid AND p.i = f.i + 1, LATERAL (SELECT sqrt(pow(p.x - f.x, 2) + pow(p.y - f.y, 2)) >= 2.5 AS far) l)
    SELECT sid, n AS kept FROM f WHERE i = 6""")
def nearby_filter(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    pts = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct(((e * i) % 7).cast("double").alias("x"), ((u + i * i) % 5).cast("double").alias("y")))
    return read(spark, d, "events").select(e.alias("sid"), F.size(coords.filter_nearby(pts, F.lit(2.5))).alias("kept"))


@query("latest_run", "SELECT user_id, event_type, max(strftime(ts, '%Y%m%d_%H%M%S')) AS stamp, arg_max(event_id, strftime(ts, '%Y%m%d_%H%M%S') || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM events GROUP BY ALL")
def latest_run(spark, d):
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(stamp).alias("stamp"), F.max_by("event_id", F.struct(stamp, F.col("event_id"))).alias("event_id"))


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return explorer.value_counts(read(spark, d, "events"), "event_type")


@query("facets", "SELECT DISTINCT lang, source FROM documents")
def facets(spark, d):
    return explorer.facets(read(spark, d, "documents"), "lang", "source")


@query("cache_remainder", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'cached' ELSE 'fresh' END AS response FROM events")
def cache_remainder(spark, d):
    r = read(spark, d, "events").select(F.col("event_id").alias("id")).withColumn("key", incremental.request_key("id"))
    cache = r.where("id % 3 = 0").select("key", F.lit("cached").alias("response"))
    return incremental.answered(r, cache, lambda x: x.withColumn("response", F.lit("fresh"))).select("id", "response")


@query("event_windows_extra", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows_extra(spark, d):
    return incremental.event_windows(read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("option_answers", """SELECT conv_id, turn, ['B', 'X', 'D', NULL][conv_id % 4 + 1] AS letter FROM conversations""")
def option_answers(spark, d):
    t = F.element_at(F.array(F.lit("The answer is: well. Answer is: b"), F.lit("x\n C "), F.lit("I think (d) fits"), F.lit("none 12")), (F.col("conv_id") % 4 + 1).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", text.option(t).alias("letter"))


@query("semi_anti_sets", "SELECT count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)) AS without FROM customer")
def semi_anti_sets(spark, d):
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    done, left = instances.finished(c, o, "c_custkey"), instances.remaining(c, o, "c_custkey")
    return done.agg(F.count(F.lit(1)).alias("with_orders")).join(F.broadcast(left.agg(F.count(F.lit(1)).alias("without"))))


@query("segment_frame_index", "SELECT vec_id, list_transform(range(0, 4), lambda i: round_even((vec_id % 50 + 9) / 4.0 / 2 + (vec_id % 50 + 9) / 4.0 * i, 0)::INTEGER) AS frames FROM embeddings")
def segment_frame_index(spark, d):
    return read(spark, d, "embeddings").select("vec_id", relational.segment_frames(F.lit(0), F.col("vec_id") % 50 + 9, 4).alias("frames"))
