"""Media files of annotations: a stored path is found by walking up from the annotation's folder.

The candidates of a row, in order, are the path as it is (if absolute), then for the annotation's folder and each folder above
it the path below that folder and the bare name in it, then the same in a working folder. All candidates of all rows meet one
listing of files by one join, and the first that is there wins: no file is asked for on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import let

LEVELS = 80  # folders above the annotation's that are tried


def normal_path(path: Column) -> Column:
    """Without empty and ``.`` parts; ``..`` takes the part before it away. Links aren't followed."""
    none = F.array().cast("array<string>")

    def step(parts, p):
        return F.when((p == "") | (p == "."), parts).when(p == "..", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.concat(parts, F.array(p)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))


def candidates(stored: Column, annotation: Column, working: Column, levels: int = LEVELS) -> Column:
    """Array of normal paths in the order in which they are tried; earlier ones of equal paths count."""
    s = F.trim(stored)
    name = F.element_at(F.filter(F.split(s, "/"), lambda p: (p != "") & (p != ".")), -1)
    below = lambda folder: F.array(F.when(s.startswith("/"), s).otherwise(F.concat(folder, F.lit("/"), s)), F.concat(folder, F.lit("/"), name))

    def upward(way):
        folders = F.transform(F.sequence(F.lit(0), F.least(F.size(way), F.lit(levels))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(way, F.lit(1), F.size(way) - k), "/")))
        return F.flatten(F.transform(folders, below))

    parts = F.filter(F.split(normal_path(annotation), "/"), lambda p: p != "")
    way = F.when(annotation.isNotNull() & (annotation != ""), let(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), upward)).otherwise(F.array().cast("array<string>"))
    own = F.when(s.startswith("/"), F.array(s)).otherwise(F.array().cast("array<string>"))
    every = F.concat(own, way, F.when(working.isNotNull(), below(working)).otherwise(F.array().cast("array<string>")))
    return F.when(stored.isNotNull() & (s != ""), F.array_distinct(F.transform(F.filter(every, lambda p: p.isNotNull()), normal_path))).otherwise(F.array().cast("array<string>"))


def resolved(rows: DataFrame, files: DataFrame, key: str, stored: str, annotation: str, working: str | None = None, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``found``: the file (of ``files``, column path) that a stored path means; null if there is none.

    ``key`` must tell rows apart. Only keys and candidates move to the join.
    """
    tried = rows.select(F.col(key), F.posexplode(candidates(F.col(stored), F.col(annotation), F.lit(working).cast("string"), levels)).alias("__place", "__path"))
    there = files.select(normal_path(F.col("path")).alias("__path")).distinct()
    hits = tried.join(there, "__path").groupBy(key).agg(F.min_by("__path", "__place").alias("found"))
    return rows.join(hits, key, "left")


def with_suffix(rows: DataFrame, files: DataFrame, key: str, name: str, prefix: str, suffix: str = "mp4") -> DataFrame:
    """``rows`` with ``found``: the video below ``prefix`` whose name ends in the suffix as given, in capitals, or in small letters."""
    n = F.col(name).cast("string")
    tries = [normal_path(F.concat(F.lit(f"{prefix}/"), F.when(n.endswith(s), n).otherwise(F.concat(n, F.lit(f".{s}"))))) for s in dict.fromkeys((suffix, suffix.upper(), suffix.lower()))]
    tried = rows.select(F.col(key), F.posexplode(F.array(*tries)).alias("__place", "__path")).where("__path is not null")
    there = files.select(normal_path(F.col("path")).alias("__path")).distinct()
    return rows.join(tried.join(there, "__path").groupBy(key).agg(F.min_by("__path", "__place").alias("found")), key, "left")
