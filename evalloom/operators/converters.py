"""Annotations to prompt records, for every kind of task: which fields, pictures and descriptions, and in which order.

A converter is a row of ``RULES``; the wording of system prompts and response formats is a table of our own. Annotations are
VARIANT documents. A record without what its task needs is null: ``converted`` keeps the good, ``rejected`` says why.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prompts
from .relational import evaluated

# Paths of a described field, newer layouts first.
_LABEL = ("$.text_annotation.text_label", "$.text_label")


@dataclass(frozen=True)
class Rule:
    """overlay: the derived picture; pictures: how many saved ones are needed; lines: (title, paths, normal form, end)."""

    overlay: str | None
    pictures: int
    lines: tuple[tuple[str, tuple[str, ...], str, str], ...]


# Titles of described fields, where they stand in annotations, and the pictures of each task.
RULES = {
    "TargetLocalization": Rule(None, 1, (("Target Object Description", _LABEL, "", ""),)),
    "GroundDetection": Rule(None, 1, ()),
    "FeasiblePath": Rule("target_area", 1, (("Target Area Description", _LABEL, "area", "."),)),
    "VisualMatching": Rule("reference_area", 2, ()),
    "AffordanceRegion": Rule("reference_area", 1, (
        ("Reference Object Description", ("$.text_annotation.reference_object_description_en", "$.mask_annotation.target_en"), "", ""),
        ("Task Description", ("$.text_annotation.text_label", "$.text_annotation.task_description_en", "$.text_label"), "", ""),
    )),
    "ContactRelationship_TypeOne": Rule("reference_object", 1, (("Reference Object Description", _LABEL, "", ""),)),
    "ContactRelationship_TypeTwo": Rule("reference_object", 1, (("Reference Object Description", _LABEL, "label", ""),)),
    "ContactRelationship_TypeThree": Rule("reference_object", 1, (("Reference Object Description", _LABEL, "label", ""),)),
    "PlacementRegion": Rule("reference_object", 1, (
        ("Reference Object Description", ("$.text_annotation.reference_object_description_en", "$.mask_annotation.target_en"), "", ""),
        ("Placement Region Description", ("$.text_annotation.placement_region_description_en", "$.mask_annotation.placement_region_en"), "", ""),
    )),
}
NORMAL = {"": lambda x: x, "area": prompts.normal_area, "label": prompts.normal_label}
_TASK = {
    "TargetLocalization": "Find every object that the description fits, and count them.",
    "GroundDetection": "Find the ground on which one can walk.",
    "FeasiblePath": "Draw a path over free ground to the target area.",
    "VisualMatching": "Find the marked area of the first view in the other view, and count its instances.",
    "AffordanceRegion": "Find the part of the object that the task needs.",
    "ContactRelationship": "Find the objects that touch the reference object, and count them.",
    "PlacementRegion": "Find the region where the object can be put, and say whether it can.",
}
_FORMS = {"base": "", "json": "Explain, then answer in JSON.", "json_only": "Answer in JSON only.", "norm1": "Coordinates are shares of width and height, from 0 to 1.", "norm1000": "Coordinates are thousandths of width and height.", "absolute": "Coordinates are pixels."}


def prompt_table(spark: SparkSession) -> DataFrame:
    """task, style, form, system, response_format: our wording of all prompts."""
    rows = []
    for task, text in _TASK.items():
        for style in ("base", "cot"):
            think = "\nThink step by step within think tags first." if style == "cot" else ""
            rows += [(task, style, form, f"You look at pictures of rooms and say where things are.\n{text}{think}", end) for form, end in _FORMS.items()]
    return spark.createDataFrame(rows, "task string, style string, form string, system string, response_format string")


def first_text(doc: Column, paths: tuple[str, ...]) -> Column:
    """The first path that is there, of a list its first entry; null if none is, or the list is empty."""
    def one(p):
        v = F.try_variant_get(doc, p, "variant")
        is_list = F.schema_of_variant(v).startswith("ARRAY")
        return F.when(v.isNotNull() & (F.schema_of_variant(v) != "VOID"), F.struct(F.when(is_list, F.try_variant_get(doc, f"{p}[0]", "string")).otherwise(F.try_variant_get(doc, p, "string")).alias("t")))

    return F.coalesce(*[one(p) for p in paths])["t"]


def record(doc: Column, kind: str, system: Column, response_format: Column, with_system: bool = True) -> Column:
    """struct<record: struct<messages, images>, problem>: one of the two is null."""
    rule = RULES[kind]
    saved = F.coalesce(F.try_variant_get(doc, "$.image_path_saved", "array<string>"), F.array().cast("array<string>"))
    parts = prompts.split_system(F.trim(F.coalesce(system, F.lit(""))))
    lines = [(t, NORMAL[form](first_text(doc, paths)), end) for t, paths, form, end in rule.lines]
    shown = rule.pictures + (rule.overlay is not None)
    marks = " \n ".join(["<image>"] * shown)
    described = [F.concat(F.lit(f"{t}: "), x, F.lit(end)) for t, x, end in lines]
    head = F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in (parts["tail"], response_format)])
    user = F.trim(F.concat_ws("\n", F.nullif(head, F.lit("")), F.lit(f" {marks} "), *described))
    first = F.get(saved, F.lit(0))
    others = ([prompts.overlay(first, rule.overlay)] if rule.overlay else []) + [F.get(saved, F.lit(i)) for i in range(1, rule.pictures)]
    problem = F.when(F.size(saved) < rule.pictures, F.lit("image_path_saved: too few pictures"))
    if rule.overlay:
        problem = problem.when(~first.contains("_image"), F.lit("no _image in the picture's name"))
    for t, x, _ in lines:
        problem = problem.when(x.isNull(), F.lit(f"missing: {t}"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.filter(F.array(F.when(F.lit(with_system) & (parts["head"] != ""), message("system", parts["head"])), message("user", user)), lambda m: m.isNotNull())
    good = F.struct(messages.alias("messages"), F.array(first, *others).alias("images"))
    return F.struct(F.when(problem.isNull(), good).alias("record"), problem.alias("problem"))


def converted(docs: DataFrame, kind: str, system: str, response_format: str = "") -> DataFrame:
    """path, messages, images of the annotations (path, doc) that have what the task needs."""
    r = evaluated(docs.select("path", "doc"), r=record(F.col("doc"), kind, F.lit(system), F.lit(response_format)))
    return r.where("r.problem is null").select("path", "r.record.messages", "r.record.images")


def rejected(docs: DataFrame, kind: str) -> DataFrame:
    """path, problem of the others."""
    r = evaluated(docs.select("path", "doc"), r=record(F.col("doc"), kind, F.lit(""), F.lit("")))
    return r.where("r.problem is not null").select("path", "r.problem")


def answered(messages: Column, response: Column) -> Column:
    """Messages with the assistant's answer at the end."""
    return F.concat(messages, F.array(F.struct(F.lit("assistant").alias("role"), response.alias("content"))))


def question(messages: Column) -> Column:
    """The system's text and the user's, one after the other; a missing one is empty."""
    of = lambda role: F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))
    return F.concat(of("system"), of("user"))


def image_paths(images: Column) -> Column:
    """Paths of pictures given as texts or as objects with a path (VARIANT list); others are left out."""
    every = F.coalesce(F.try_variant_get(images, "$", "array<variant>"), F.array().cast("array<variant>"))
    path = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.nullif(F.try_variant_get(v, "$.path", "string"), F.lit("")))
    return F.filter(F.transform(every, path), lambda p: p.isNotNull())


def truth_path(images: Column, kind: Column) -> Column:
    """Path of the ground truth that belongs to a sample's pictures.

    Just one picture's name may end in ``_image``; of matched views the first and the last such picture name it together.
    """
    stem = lambda p: F.regexp_replace(F.substring_index(p, "/", -1), r"(?<=.)\.[^.]*$", "")
    folder = lambda p: F.when(p.contains("/"), F.regexp_replace(p, r"[^/]*$", "")).otherwise("")
    fit = F.filter(images, lambda p: stem(p).endswith("_image"))
    name = lambda p: F.regexp_replace(stem(p), "_image$", "")
    first, last = F.get(fit, F.lit(0)), F.try_element_at(fit, F.lit(-1))
    pair = F.when(F.size(fit) >= 2, F.concat(folder(first), name(first), F.lit("__"), name(last), F.lit("_mask_rle.json")))
    return F.when(kind == "VisualMatching", pair).otherwise(F.when(F.size(fit) == 1, F.concat(folder(first), name(first), F.lit("_mask_rle.json"))))


def default_format(category: Column, kind: Column) -> Column:
    """Paths are points, everything else boxes."""
    return F.when((category == "Navigation") & kind.isin("FeasiblePath", "FeasiblePath_Ego", "FeasiblePath_Exo"), "point").otherwise("bbox")


def filled(template: str, columns: dict[str, Column]) -> Column:
    """A template's ``{{name}}`` replaced by columns, ``{{name|lower}}`` and ``|upper`` applied; an unknown name is an error."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*(?:\|\s*(\w+)\s*)?\}\}", template):
        if m[1] not in columns:
            raise KeyError(f"the template needs {m[1]}")
        value = columns[m[1]].cast("string")
        parts += [F.lit(template[at : m.start()]), {None: lambda x: x, "lower": F.lower, "upper": F.upper, "trim": F.trim}[m[2]](value)]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def dispatched(spec, columns: dict[str, Column]) -> Column:
    """A document's text, target or choices by configuration: a function of the columns, a column's name, or a template."""
    if callable(spec):
        return spec(columns)
    return columns[spec] if spec in columns else filled(spec, columns)
