"""Sample scores as column expressions: localization, count, binary, weights, invalid flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import coords, masks


# Texts that stand for an answer that isn't needed or isn't there, in lower case.
UNNEEDED = "not required"
MISSING = ("no valid response", "no_valid_response", "invalid response", "no response", "")


def answer_state(v: Column) -> Column:
    """``unneeded``, ``missing`` or ``given`` of an answer field (VARIANT). Only a text by itself is a mark; a list is given."""
    kind = F.schema_of_variant(v)
    text = F.when(kind == "STRING", F.lower(F.trim(F.try_variant_get(v, "$", "string"))))
    return F.when(v.isNull() | (kind == "VOID") | F.coalesce(text.isin(*MISSING), F.lit(False)), "missing").when(text == UNNEEDED, "unneeded").otherwise("given")


def localization(boxes: Column, truth: Column, gt_empty: Column, h: Column, w: Column, mode: Column) -> Column:
    """Score of box answers: no boxes is right only for empty ground truth; boxes for empty ground truth are wrong."""
    actual = coords.actual_mode(F.flatten(F.transform(boxes, lambda b: F.slice(b, 1, 4))), h, w, mode)
    found = coords.let(actual, lambda m: coords.let(coords.normal_boxes(boxes, h, w, m), lambda p: masks.box_iou(p, truth, h)))
    none = F.coalesce(F.size(boxes), F.lit(0)) <= 0
    return F.when(none, F.when(gt_empty, 1.0).otherwise(0.0)).when(gt_empty, 0.0).otherwise(found)


def localization_result(v: Column, format_type: Column, mode: Column, gt_given: Column, gt: Column, gt_count: Column, pred: Column) -> Column:
    """struct<score, error, actual_mode> of an answer field (VARIANT) in box or mask format.

    gt and pred: ``masks.decode`` structs of the ground truth and, for mask answers, of the answer; gt_given: whether there
    is any annotation. A count of 0 makes the ground truth empty, whatever its mask.
    """
    state, kind, boxes = answer_state(v), F.schema_of_variant(v), lenient_boxes(v)
    empty = ~F.coalesce(gt_given, F.lit(False)) | F.coalesce(gt_count == 0, F.lit(False))
    out = lambda score, error=None, actual=None: F.struct(score.cast("double").alias("score"), F.lit(error).cast("string").alias("error"), (F.lit(None) if actual is None else actual).cast("string").alias("actual_mode"))
    nothing = F.when(empty, 1.0).otherwise(0.0)
    blank = (F.to_json(v) == "[]") | (F.to_json(v) == "{}")
    in_mask = (
        F.when(blank, out(nothing, None, F.lit("n/a"))).when(pred.isNull() | pred["h"].isNull(), out(F.lit(0.0), "Failed to decode predicted mask response", F.lit("n/a")))
        .when(F.size(pred["runs"]) == 0, out(nothing, None, F.lit("n/a"))).when(empty, out(F.lit(0.0), None, F.lit("n/a")))
        .when((pred["h"] != gt["h"]) | (pred["w"] != gt["w"]), out(F.lit(0.0), "Pred mask shape does not match GT mask shape", F.lit("n/a"))).otherwise(out(masks.iou(pred["runs"], gt["runs"]), None, F.lit("n/a")))
    )
    h, w = F.when(empty, 1).otherwise(gt["h"]), F.when(empty, 1).otherwise(gt["w"])
    actual = coords.actual_mode(F.flatten(boxes), h, w, mode)
    iou = lambda m: masks.iou(masks.box_runs(coords.normal_boxes(boxes, h, w, m), h), gt["runs"])
    in_boxes = coords.let(actual, lambda m: F.when(F.size(boxes) == 0, out(nothing, None, m)).when(empty, out(F.lit(0.0), None, m)).otherwise(out(iou(m), None, m)))
    return (
        F.when(state == "unneeded", out(F.lit(0.0))).when(state == "missing", out(F.lit(0.0), "No Valid Response"))
        .when(~empty & (gt.isNull() | gt["h"].isNull()), out(F.lit(0.0), "Failed to decode GT mask or GT mask is missing"))
        .when(format_type == "mask", in_mask).otherwise(in_boxes)
    )


def count(pred: Column, gold: Column, exact: Column) -> Column:
    """Exact match, or 1 less the relative miss (only 0 matches 0 or less); null if a side is missing."""
    near = F.when(gold <= 0, (pred == 0).cast("double")).otherwise(1.0 - F.least(F.lit(1.0), F.abs(gold - pred) / F.greatest(F.lit(1), gold).cast("double")))
    return F.when(pred.isNull() | gold.isNull(), F.lit(None).cast("double")).when(exact, (pred == gold).cast("double")).otherwise(near)


def exact_count(precise: Column, described: Column) -> Column:
    return F.coalesce(precise, F.lit(False)) | F.coalesce(described, F.lit(False))


def count_weight(precise: Column, described: Column) -> Column:
    """A count given in the description outranks a precise one."""
    return F.when(F.coalesce(described, F.lit(False)), 0.1).when(F.coalesce(precise, F.lit(False)), 0.5).otherwise(0.3)


def binary(pred: Column, gold: Column) -> Column:
    return F.when(pred.isNull() | gold.isNull(), F.lit(None).cast("double")).otherwise((pred == gold).cast("double"))


def join_errors(*errors: Column) -> Column:
    text = F.concat_ws("; ", *errors)
    return F.when(text != "", text)


# What an error must hold, in this case, to make a response invalid.
INVALID = ("No Valid Response", "No path points parsed", "Missing")


def invalid(error: Column) -> Column:
    out = F.lit(False)
    for mark in INVALID:
        out = out | F.coalesce(error.contains(mark), F.lit(False))
    return out


def lenient_boxes(v: Column) -> Column:
    """Of lists of four numbers or more (numeric texts too) in a VARIANT the first four; others are skipped."""
    rows = F.try_variant_get(v, "$", "array<variant>")
    numbers = F.transform(F.coalesce(rows, F.array().cast("array<variant>")), lambda r: F.transform(F.slice(F.coalesce(F.try_variant_get(r, "$", "array<variant>"), F.array().cast("array<variant>")), 1, 4), lambda x: F.try_variant_get(x, "$", "double")))
    return F.filter(numbers, lambda b: (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull()))


def lenient_points(v: Column) -> Column:
    """Of lists of two numbers or more in a VARIANT the first two; others are skipped."""
    rows = F.try_variant_get(v, "$", "array<variant>")
    numbers = F.transform(F.coalesce(rows, F.array().cast("array<variant>")), lambda r: F.transform(F.slice(F.coalesce(F.try_variant_get(r, "$", "array<variant>"), F.array().cast("array<variant>")), 1, 2), lambda x: F.try_variant_get(x, "$", "double")))
    return F.filter(numbers, lambda p: (F.size(p) == 2) & ~F.exists(p, lambda x: x.isNull()))


def first_of(v: Column) -> Column:
    """The first entry of a VARIANT list that has one, else the value itself."""
    return F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)


def lenient_count(v: Column) -> Column:
    """A number without its fraction, a numeric text or a truth value, also as a list's first entry; "3.0" counts as 3."""
    def one(x):
        kind = F.schema_of_variant(x)
        number = F.try_variant_get(x, "$", "double")
        return F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("int")).when((kind == "VOID") | F.isnan(number), F.lit(None).cast("int")).otherwise(F.when(F.abs(number) < 2147483648.0, number).cast("int"))

    return coords.let(first_of(v), one)


# Texts that mean yes and no.
YES, NO = ("true", "yes", "1"), ("false", "no", "0")


def lenient_flag(v: Column) -> Column:
    """A truth value, a number other than 0, or a text that means yes or no, also as a list's first entry; else null."""
    def one(x):
        kind, text = F.schema_of_variant(x), F.lower(F.trim(F.try_variant_get(x, "$", "string")))
        by_text = F.when(text.isin(*YES), True).when(text.isin(*NO), False)
        return F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean")).when(kind == "STRING", by_text).when(kind != "VOID", F.try_variant_get(x, "$", "double") != 0)

    return coords.let(first_of(v), one)


def truth_flag(v: Column) -> Column:
    """A ground-truth flag: as ``lenient_flag``, but whatever means neither is no, and so is a missing one."""
    return F.coalesce(lenient_flag(v), F.lit(False))


def details(loc: Column, cnt: Column, path: Column, flag: Column, weights: Column) -> Column:
    """The four scores and four weights of a sample."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    names = ("localization", "count", "path", "binary")
    return F.struct(*[zero(c).alias(f"{n}_score") for c, n in zip((loc, cnt, path, flag), names, strict=True)], *[weights[n].alias(f"weight_{n}") for n in names])
