"""Evaluation end to end: standard answer files and annotations in, scored samples and a report out; and the steps before it.

``evaluate`` scores standard records, ``standard_records`` makes them from raw responses. All files of a run are one job; a
sample's failure is its result, so no file needs a process of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, masks, scores
from ..operators import converters, path, report, scoring
from ..sources import readers, sinks
from . import catalog

FIELDS = tuple(f"formatted_response_{m}" for m in scoring.METRICS)


@dataclass
class Evaluation:
    samples: DataFrame
    report: DataFrame

    def write(self, target: str, source: str, mode: str | None = None, lines: bool = False) -> None:
        """A folder with summary and samples, or, with ``lines``, one log of JSON lines."""
        shown = self.samples.select("file", "index", F.col("category").alias("task_category"), F.col("kind").alias("task_type"), "score", "score_details", "response_details", "error", "invalid")
        if lines:
            head = sinks.summary(self.report).select(F.lit(source).alias("std_response_jsonl"), F.lit(mode).cast("string").alias("coord_override"), F.struct("overall", "by_category", "by_type", "by_group").alias("summary"))
            sinks.evaluation_log(head, shown, target)
        else:
            sinks.evaluation_json(self.report, shown, target, source, mode)


def _first_text(record: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(scores.first_of(F.try_variant_get(record, f"$.{name}", "variant")), "$", "string"), F.lit(""))


def records(samples: DataFrame) -> DataFrame:
    """file, index, category, kind, format_type, mode, fields, truth and truth_path of standard records (file, record)."""
    r = F.col("record")
    x = samples.select(
        "file", F.monotonically_increasing_id().alias("index"), _first_text(r, "task_category").alias("category"), _first_text(r, "task_type").alias("kind"), _first_text(r, "format_type").alias("format_type"),
        F.coalesce(F.nullif(_first_text(r, "coordinate_system"), F.lit("")), F.lit("auto")).alias("mode"), *[F.try_variant_get(r, f"$.{f}", "variant").alias(f) for f in FIELDS], F.try_variant_get(r, "$.ground_truth", "variant").alias("truth"),
    )
    return x.withColumn("truth_path", readers.truth_file(F.col("truth")))


def _masks(x: DataFrame, name: str, v: Column) -> DataFrame:
    """A mask field's decoded form, and whether there is any annotation."""
    text = F.to_json(v)
    x = x.withColumn(f"{name}_text", F.when(v.isNotNull(), text))
    return x.withColumn(name, masks.decode(f"{name}_text")).withColumn(f"{name}_given", F.col(f"{name}_text").isNotNull() & ~F.col(f"{name}_text").isin("null", "[]", "{}")).drop(f"{name}_text")


def scored(x: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Standard records with the scores of their metrics; documents: path and doc (VARIANT) of annotations."""
    if documents is not None:
        x = x.join(documents.select(F.col("path").alias("truth_path"), F.col("doc")), "truth_path", "left")
    else:
        x = x.withColumn("doc", F.lit(None).cast("variant"))
    base = catalog.base_type(F.col("category"), F.col("kind"))

    def by_task(names: dict[str, str]) -> Column:
        out = None
        for t, n in names.items():
            v = readers.truth_field(F.col("doc"), F.col("truth"), n)
            out = F.when(base == t, v) if out is None else out.when(base == t, v)
        return out

    field = lambda *n: readers.truth_field(F.col("doc"), F.col("truth"), *n)
    x = _masks(x, "gt", by_task({t: n for t, n in catalog.MASKS.items() if t != "FeasiblePath"}))
    x = _masks(x, "area", F.when(base == "FeasiblePath", field(catalog.PATH_FIELDS["path_mask"])))
    x = _masks(x, "goal", F.when(base == "FeasiblePath", field(catalog.PATH_FIELDS["target_area_mask"])))
    x = _masks(x, "pred", F.when(F.col("format_type") == "mask", F.col(FIELDS[0])))
    x = x.withColumn("gt_count", scores.lenient_count(by_task(catalog.COUNTS)))
    counted = base.isin(*catalog.COUNTS)
    x = x.withColumn("precise", counted & scores.truth_flag(field(*catalog.PRECISE_FIELDS))).withColumn("described", counted & scores.truth_flag(field(catalog.DESCRIBED_FIELD)))
    x = x.withColumn("gt_flag", F.when(base == "PlacementRegion", scores.lenient_flag(field(*catalog.FEASIBLE_FIELDS))))
    loc = scores.localization_result(F.col(FIELDS[0]), F.col("format_type"), F.col("mode"), F.col("gt_given"), F.col("gt"), F.col("gt_count"), F.col("pred"))
    x = x.withColumn("loc", loc).withColumn("localization", F.col("loc.score")).withColumn("localization_error", F.col("loc.error")).withColumn("actual_mode", F.col("loc.actual_mode"))

    def told(v: Column, pred: Column, gold: Column, name: str) -> Column:
        """Error text of a count or a flag."""
        return F.when(scores.answer_state(v) == "missing", "No Valid Response").when((scores.answer_state(v) == "given") & (pred.isNull() | gold.isNull()), f"Missing pred_{name} or gt_{name}")

    n, b, given = F.col(FIELDS[1]), F.col(FIELDS[3]), lambda v: scores.answer_state(v) == "given"
    pred_count, pred_flag = scores.lenient_count(n), scores.lenient_flag(b)
    exact = scores.exact_count(F.col("precise"), F.col("described"))
    x = x.withColumn("count", F.when(given(n), scores.count(pred_count, F.col("gt_count"), exact))).withColumn("count_error", told(n, pred_count, F.col("gt_count"), "count"))
    x = x.withColumn("binary", F.when(given(b), scores.binary(pred_flag, F.col("gt_flag")))).withColumn("binary_error", told(b, pred_flag, F.col("gt_flag"), "binary"))
    x = _paths(x, base)
    x = scoring.score_samples(x)
    fields = F.struct(*FIELDS)
    return x.withColumn("response_details", scoring.response_details(F.col("format_type"), F.col("mode"), F.col("actual_mode"), fields))


def _paths(x: DataFrame, base: Column) -> DataFrame:
    """Path scores; of rows of other tasks 0 without an error."""
    from ..functions import coords

    v, h, w = F.col(FIELDS[2]), F.col("area.h"), F.col("area.w")
    raw = scores.lenient_points(v)
    # a table of its own keeps the numbers out of the Arrow function's arguments
    x = x.withColumn("path_state", F.when(base == "FeasiblePath", scores.answer_state(v))).withColumn("raw_points", F.when((base == "FeasiblePath") & F.col("area.h").isNotNull(), raw))
    x = x.withColumn("path_mode", coords.actual_mode(F.flatten("raw_points"), h, w, F.col("mode")))
    x = x.withColumn("points", coords.normal_points(F.col("raw_points"), h, w, F.col("path_mode")))
    x = x.withColumn("exo", F.when(F.col("path_state") == "given", F.col("kind") == "FeasiblePath_Exo"))
    p = path.score_only("points", "area.runs", "goal.runs", "area.h", "area.w", "exo")
    x = x.withColumn("p", p).withColumn("path", F.when(F.col("path_state") == "given", F.col("p.score")).otherwise(0.0))
    error = F.when(F.col("path_state") == "missing", "No Valid Response").when(F.col("path_state") == "given", F.col("p.error"))
    x = x.withColumn("path_error", error).withColumn("actual_mode", F.when(F.col("path_state") == "given", F.coalesce("path_mode", F.lit("absolute"))).otherwise(F.col("actual_mode")))
    return x.drop("p", "raw_points", "path_mode", "points", "exo", "path_state", "area", "goal", "area_given", "goal_given", "loc", "pred", "pred_given")


def evaluate(spark: SparkSession, source: str | list[str], annotations: str | None = None, categories: list[str] | None = None, kinds: list[str] | None = None, group: str | None = None, mode: str | None = None, expected: str | None = None, whole: bool = False) -> Evaluation:
    """Scores the standard records of all files of ``source`` (JSON lines; ``whole``: JSON arrays) against their annotations."""
    x = scoring.filter_samples(records(readers.json_records(spark, source, whole)), categories, kinds, group)
    if mode:
        x = x.withColumn("mode", F.lit(mode))
    docs = readers.annotation_tree(spark, annotations).withColumn("path", F.regexp_replace("path", "^file:/*", "/")) if annotations else None
    x = scored(x, docs).withColumn("leaf", catalog.resolve_leaf(F.col("category"), F.col("kind"), F.col("truth_path")))
    keys = F.broadcast(catalog.taxonomy(spark).select("leaf", "by_type", "by_group"))
    x = x.join(keys, "leaf", "left")
    return Evaluation(x, report.score_report(x, readers.expected_counts(spark, expected) if expected else None))


def by_file(e: Evaluation) -> DataFrame:
    """file, samples, invalid, failed (samples whose scoring raised), mean_score."""
    failed = F.coalesce(F.col("error").rlike(r"\b\w+(?:Error|Exception): "), F.lit(False))
    return e.samples.groupBy("file").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("invalid").cast("long")).alias("invalid"), F.sum(failed.cast("long")).alias("failed"), F.avg("score").alias("mean_score"))


def standard_records(raw: DataFrame, format_type: str | None = None, mode: str = "auto") -> DataFrame:
    """Standard records of raw ones (record with images and response): task by path, fields by the task's rules."""
    r = F.col("record")
    images = converters.image_paths(F.try_variant_get(r, "$.images", "variant"))
    x = raw.select("file", images.alias("images"), F.coalesce(F.try_variant_get(r, "$.response", "string"), F.lit("")).alias("response"))
    x = x.withColumn("task", task_of(F.col("images"))).withColumn("category", F.col("task.category")).withColumn("kind", F.col("task.kind")).withColumn("needs", catalog.required(F.col("category"), F.col("kind")))
    x = x.withColumn("f", answers.standardize("response", "category", "kind", "needs"))
    one = lambda c: F.array(c)
    kept = converters.default_format(F.col("category"), F.col("kind")) if format_type is None else F.lit(format_type)
    return x.select(
        "file", one(F.col("category")).alias("task_category"), one(F.col("kind")).alias("task_type"), one(kept).alias("format_type"), one(F.lit(mode)).alias("coordinate_system"), "images", one(F.col("response")).alias("response"),
        *[F.parse_json(f"f.{m}").alias(f) for m, f in zip(scoring.METRICS, FIELDS, strict=True)], F.struct(one(converters.truth_path(F.col("images"), F.col("kind"))).alias("gt_json_path")).alias("ground_truth"),
    )


def task_of(images: Column) -> Column:
    """struct<category, kind> of the first picture whose path names a category; kind is null where it can't be told."""
    categories = F.array(*map(F.lit, catalog.TAXONOMY))

    def one(p):
        parts = F.split(p, "/")
        at = F.array_min(F.filter(F.transform(parts, lambda x, i: F.when(F.array_contains(categories, x), i)), lambda i: i.isNotNull()))
        c, group, leaf = F.get(parts, at), F.get(parts, at + 1), F.get(parts, at + 2)
        group = F.when(group == "Affordance", "AffordanceRegion").when(group == "Placement", "PlacementRegion").otherwise(group)
        tl = [r[3] for r in catalog.leaves() if r[1] == "TargetLocalization"]
        sub = {g: names for c_, gs in catalog.TAXONOMY.items() if c_ != "TargetLocalization" for g, names in gs.items()}
        kind = F.when(c == "TargetLocalization", F.when(leaf.isin(*tl), leaf))
        for g, names in sub.items():
            home = next(c_ for c_, gs in catalog.TAXONOMY.items() if g in gs)
            own = F.lit(g) if names == [g] else F.when(leaf.isin(*names), leaf).otherwise(F.lit(g))
            kind = kind.when((c == home) & (group == g), own)
        return F.when(at.isNotNull(), F.struct(c.alias("category"), kind.alias("kind")))

    return F.get(F.filter(F.transform(images, one), lambda t: t.isNotNull()), F.lit(0))
