"""What is shown over a picture, as runs of its column-major pixels: resized masks, outlines of boxes, marks, and blends.

No picture and no canvas is needed: a mask is resized by its runs, and layers are blended for each stretch of pixels that
they cover alike. All of it is column expressions within a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coords import let
from .masks import RUN, box_runs

OUTLINE, RADIUS, LINE = 3, 6, 2  # pixels: width of an outline, half width of a mark, width of a line


def _range(low: Column, high: Column) -> Column:
    """low, low + 1, ... below high; empty if there is none."""
    return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<long>"))


def resized(runs: Column, h: Column, w: Column, new_h: Column, new_w: Column) -> Column:
    """Runs of the mask at another size; each new pixel is the one that its middle falls on.

    Column X shows the old column floor((X + 1/2) w / W), so an old column goes to one range of new ones, and the rows of a run
    in it likewise. A run that spans columns is cut at them.
    """
    h, w, new_h, new_w = (x.cast("long") for x in (h, w, new_h, new_w))
    # the first new place that shows an old place of at least ``at``
    first = lambda at, old, new: F.call_function("div", 2 * at * new + old - 1, 2 * old)

    def of_run(r):
        s, e = r["s"].cast("long"), r["e"].cast("long")
        columns = F.when(e > s, F.sequence(F.call_function("div", s, h), F.call_function("div", e - 1, h))).otherwise(F.array().cast("array<long>"))

        def of_column(x):
            top, end = F.greatest(s - x * h, F.lit(0)), F.least(e - x * h, h)
            low, high = first(top, h, new_h), first(end, h, new_h)
            shown = F.transform(_range(first(x, w, new_w), first(x + 1, w, new_w)), lambda c: F.struct((c * new_h + low).cast("int").alias("s"), (c * new_h + high).cast("int").alias("e")))
            return F.filter(shown, lambda q: q["e"] > q["s"])

        return F.flatten(F.transform(columns, of_column))

    return F.flatten(F.transform(runs, of_run))


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])


def outlines(boxes: Column, h: Column, w: Column, width: int = OUTLINE) -> Column:
    """Runs of the outlines of boxes (x1, y1, x2, y2), cut at the picture; the four sides of one overlap at its corners."""

    def sides(b):
        x1, y1 = F.greatest(b["x1"].cast("int"), F.lit(0)), F.greatest(b["y1"].cast("int"), F.lit(0))
        x2, y2 = F.least(b["x2"].cast("int"), w), F.least(b["y2"].cast("int"), h)
        four = F.array(
            _box(x1, y1, x2, F.least(y1 + width, h)), _box(x1, F.greatest(y2 - width, F.lit(0)), x2, y2),
            _box(x1, y1, F.least(x1 + width, w), y2), _box(F.greatest(x2 - width, F.lit(0)), y1, x2, y2),
        )
        return F.when((x2 > x1) & (y2 > y1), four).otherwise(F.filter(four, lambda _: F.lit(False)))

    return box_runs(F.flatten(F.transform(boxes, sides)), h)


def _within(x: Column, n: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), n - 1)


def marks(points: Column, h: Column, w: Column, radius: int = RADIUS) -> Column:
    """Runs of a square around each point (x, y)."""

    def square(p):
        x, y = _within(p["x"].cast("int"), w), _within(p["y"].cast("int"), h)
        return _box(F.greatest(x - radius, F.lit(0)), F.greatest(y - radius, F.lit(0)), F.least(x + radius + 1, w), F.least(y + radius + 1, h))

    return box_runs(F.transform(points, square), h)


def lines(points: Column, h: Column, w: Column, width: int = LINE) -> Column:
    """Runs of the lines between points that follow each other; each step along the longer side has a dot."""
    half = width // 2
    at = lambda p: F.struct(_within(p["x"].cast("int"), w).alias("x"), _within(p["y"].cast("int"), h).alias("y"))

    def dots(i):
        a, b = at(F.element_at(points, i)), at(F.element_at(points, i + 1))
        return let(F.struct(a.alias("a"), b.alias("b")), lambda t: along(t["a"], t["b"]))

    def along(a, b):
        n = F.greatest(F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"]))

        def dot(k):
            one = lambda c: F.when(k == n, b[c]).otherwise((k * ((b[c] - a[c]).cast("double") / F.greatest(n, F.lit(1))) + a[c]).cast("int"))
            x, y = one("x"), one("y")
            return _box(_within(x - half, w), _within(y - half, h), _within(x + half, w) + 1, _within(y + half, h) + 1)

        return F.transform(F.sequence(F.lit(0), n), dot)

    steps = F.when(F.size(points) >= 2, F.sequence(F.lit(1), F.size(points) - 1)).otherwise(F.array().cast("array<int>"))
    return box_runs(F.flatten(F.transform(steps, dots)), h)


def layer(runs: Column, r: int, g: int, b: int, alpha: float = 0.4) -> Column:
    return F.struct(runs.cast(RUN).alias("runs"), *[F.lit(float(v)).alias(n) for n, v in (("r", r), ("g", g), ("b", b), ("alpha", alpha))])


def blended(layers: Column) -> Column:
    """Stretches of pixels (s, e, keep, r, g, b), in order and disjoint, that layers, one over the other, change alike.

    A pixel of the picture with value v becomes ``keep * v`` plus the stretch's colour; pixels that no layer covers aren't there.
    """
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform(layers, lambda x: F.concat(F.transform(x["runs"], lambda q: q["s"]), F.transform(x["runs"], lambda q: q["e"]))))))
    start = F.struct(F.lit(1.0).alias("keep"), *[F.lit(0.0).alias(c) for c in "rgb"])

    def of(points, i):
        s, e = F.element_at(points, i), F.element_at(points, i + 1)

        def over(t, x):
            a = F.when(F.exists(x["runs"], lambda q: (q["s"] <= s) & (q["e"] >= e)), x["alpha"]).otherwise(0.0)
            return F.struct((t["keep"] * (1 - a)).alias("keep"), *[(t[c] * (1 - a) + x[c] * a).alias(c) for c in "rgb"])

        return F.aggregate(layers, start, over, lambda t: F.struct(s.alias("s"), e.alias("e"), *[t[c].alias(c) for c in ("keep", "r", "g", "b")]))

    def pieces(points):
        places = F.when(F.size(points) >= 2, F.sequence(F.lit(1), F.size(points) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(places, lambda i: of(points, i)), lambda p: p["keep"] < 1)

    return let(ends, pieces)
