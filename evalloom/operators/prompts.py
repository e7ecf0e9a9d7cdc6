"""Prompt records and few-shot contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_system(prompt: Column) -> Column:
    """struct<head, tail>: the text around the first line end, trimmed."""
    parts = F.split(prompt, "\n", 2)
    return F.struct(F.trim(parts[0]).alias("head"), F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("tail"))


def user_text(*parts: Column) -> Column:
    """The parts that are there, one a line."""
    return F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def record(system: Column, user: Column, images: Column) -> Column:
    """struct<messages, images>; null if the user text is missing."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.when(user.isNotNull() & (user != ""), F.struct(F.array(message("system", system), message("user", user)).alias("messages"), images.alias("images")))


def _listed(text: Column) -> Column:
    """Commas with one blank after them, and white space as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*,\s*", ", "), r"\s+", " "))


def normal_area(text: Column) -> Column:
    """Runs of two or more ``2`` separate the parts of a target area; no comma stays at either end."""
    return F.trim(F.regexp_replace(_listed(F.regexp_replace(F.trim(text), "2{2,}", ",")), r"^(?:,\s*)+|(?:\s*,)+$", ""))


def normal_label(text: Column) -> Column:
    """Runs of one or more ``2`` separate labels."""
    return _listed(F.regexp_replace(F.trim(text), "2+", ", "))


# Suffix of the overlay image that belongs to each kind of picture.
OVERLAYS = {"reference_object": "_reference_object_overlay.png", "reference_area": "_reference_area_overlay.png", "target_area": "_target_area_overlay.png"}


def overlay(image: Column, kind: str) -> Column:
    """The overlay's path: the part before the last ``_image`` with the overlay's suffix."""
    return F.regexp_replace(image, r"(?s)_image(?!.*_image).*$", OVERLAYS[kind])


def fewshot(docs: DataFrame, examples: DataFrame, key: str, k: int, seq: str = "seq") -> DataFrame:
    """``docs`` with ``context``: the first ``k`` examples other than the document itself, by ``seq``.

    ``examples`` needs text and a key; only its first k + 1 rows are read, so they are broadcast.
    """
    first = examples.orderBy(seq).limit(k + 1).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(key).alias("k"), F.col("text").alias("t")))).alias("shots"))
    own = lambda shots: F.slice(F.filter(shots, lambda x: x["k"] != F.col(key)), 1, k)
    return docs.join(F.broadcast(first)).withColumn("context", F.array_join(F.transform(own(F.col("shots")), lambda x: x["t"]), "\n\n")).drop("shots")
