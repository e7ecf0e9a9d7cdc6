"""Coordinates of boxes and points: mode resolution, scaling, clipping. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


# The names of modes that are resolved already, and older names for two of them.
MODES = ("absolute", "normalized_0_1", "normalized_0_1000")
ALIASES = {"normalized": "normalized_0_1", "normalized_1000": "normalized_0_1000"}


def canonical_mode(mode: Column) -> Column:
    """Older names as present ones; null and empty mean auto; other names stay, case and all."""
    out = F.when(mode.isNull() | (mode == ""), "auto")
    for old, new in ALIASES.items():
        out = out.when(mode == old, new)
    return out.otherwise(mode)


def actual_mode(values: Column, h: Column, w: Column, mode: Column) -> Column:
    """A resolved mode stays; any other one is told from all numbers of a sample together.

    Within [0, 1], beyond the canvas, or else (also without numbers) absolute.
    """
    top, low = F.array_max(values), F.array_min(values)
    told = F.when(top.isNull(), "absolute").when((top <= 1) & (low >= 0), "normalized_0_1").when(top > F.greatest(h, w), "normalized_0_1000").otherwise("absolute")
    return let(canonical_mode(mode), lambda m: F.when(m.isin(*MODES), m).otherwise(told))


def scale(mode: Column, size: Column) -> Column:
    return F.when(mode == "normalized_0_1", size.cast("double")).when(mode == "normalized_0_1000", size / F.lit(1000.0)).otherwise(F.lit(1.0))


def normal_boxes(boxes: Column, h: Column, w: Column, mode: Column) -> Column:
    """array<struct<x1,y1,x2,y2: int>>: scaled, corners ordered, clipped, empty ones dropped, then truncated."""
    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top.cast("double")))

    def all_of(k):
        scaled = F.transform(boxes, lambda b: F.struct((b[0] * k["x"]).alias("a"), (b[1] * k["y"]).alias("b"), (b[2] * k["x"]).alias("c"), (b[3] * k["y"]).alias("d")))
        clipped = F.transform(scaled, lambda b: F.struct(clip(F.least(b["a"], b["c"]), w).alias("x1"), clip(F.least(b["b"], b["d"]), h).alias("y1"), clip(F.greatest(b["a"], b["c"]), w).alias("x2"), clip(F.greatest(b["b"], b["d"]), h).alias("y2")))
        kept = F.filter(clipped, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
        return F.transform(kept, lambda b: F.struct(*[b[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]))

    return let(F.struct(scale(mode, w).alias("x"), scale(mode, h).alias("y")), all_of)


def normal_points(points: Column, h: Column, w: Column, mode: Column) -> Column:
    """Scaled and clipped to the last pixel; not truncated."""
    sx, sy = scale(mode, w), scale(mode, h)
    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(v, (top - 1).cast("double")))
    return F.transform(points, lambda p: F.struct(clip(p[0] * sx, w).alias("x"), clip(p[1] * sy, h).alias("y")))


def filter_nearby(points: Column, least: Column) -> Column:
    """Greedy: a point stays if it is at least ``least`` away from the last one that stayed."""
    def step(kept, p):
        last = F.element_at(kept, -1)
        far = F.sqrt(F.pow(p["x"] - last["x"], 2) + F.pow(p["y"] - last["y"], 2)) >= least
        return F.when(F.size(kept) == 0, F.array(p)).when(far, F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(points, F.slice(points, 1, 0), step)
