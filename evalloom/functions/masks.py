"""Masks as runs: half-open intervals of the column-major pixel index x * h + y. No pixel array is made."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coords import let

RUN = "array<struct<s:int,e:int>>"


def one_box_runs(b: Column, h: Column) -> Column:
    """One run for each column of a box."""
    columns = F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), F.sequence(b["x1"], b["x2"] - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(columns, lambda x: F.struct((x * h + b["y1"]).cast("int").alias("s"), (x * h + b["y2"]).cast("int").alias("e")))


def box_runs(boxes: Column, h: Column) -> Column:
    """One run for each column of each box."""
    return F.flatten(F.transform(boxes, lambda b: one_box_runs(b, h)))


def rle_runs(counts: Column, total: Column) -> Column:
    """Runs of an uncompressed column-major RLE that begins with zeros; counts beyond the canvas are clamped."""
    def step(acc, c):
        end = F.least(acc["at"] + c, total).cast("int")
        run = F.struct(acc["at"].alias("s"), end.alias("e"))
        return F.struct(end.alias("at"), (~acc["on"]).alias("on"), F.when(acc["on"] & (end > acc["at"]), F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]).alias("runs"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("on"), F.array().cast(RUN).alias("runs"))
    return F.aggregate(counts, start, step, lambda a: a["runs"])


def counts_of(text: str) -> list[int] | None:
    """Counts of a compressed RLE text: five bits a character, low first, sign in the last, deltas from the third on."""
    out: list[int] = []
    at = 0
    while at < len(text):
        value = shift = 0
        while True:
            if at >= len(text) or not 0 <= (c := ord(text[at]) - 48) < 64:
                return None
            value |= (c & 31) << shift
            at, shift = at + 1, shift + 5
            if not c & 32:
                break
        if c & 16:
            value -= 1 << shift
        out.append(value + (out[-2] if len(out) > 2 else 0))
    return out if all(0 <= x < 1 << 31 for x in out) else None


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decode_counts(text: pd.Series) -> pd.Series:
    """``counts_of`` a column; null or broken text gives null."""
    return text.map(lambda s: None if s is None else counts_of(s), na_action="ignore")


def mask_of(item) -> tuple[int, int, list[tuple[int, int]]] | None:
    """(height, width, runs) of one RLE object, compressed or not; None where it can't be decoded."""
    try:
        h, w = (int(x) for x in item["size"])
        counts = item["counts"]
        counts = counts_of(counts) if isinstance(counts, str) else [int(x) for x in counts]
    except (TypeError, ValueError, KeyError):
        return None
    if counts is None or h <= 0 or w <= 0 or min(counts, default=0) < 0:
        return None
    runs, at = [], 0
    for i, n in enumerate(counts):
        end = min(at + n, h * w)
        if i % 2 and end > at:
            runs.append((at, end))
        at = end
    return h, w, runs


MASK = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))])


def union_of(text: str | None) -> dict | None:
    """The union of an RLE object or of a list of them: the first that decodes fixes the canvas, others of it join."""
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return None
    found = [m for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict) and (m := mask_of(x))]
    if not found:
        return None
    h, w, _ = found[0]
    return {"h": h, "w": w, "runs": [{"s": a, "e": b} for y, x, runs in found if (y, x) == (h, w) for a, b in runs]}


@F.pandas_udf(MASK)
def decode(text: pd.Series) -> pd.DataFrame:
    """struct<h, w, runs> of JSON texts of RLE objects or lists of them; null where nothing decodes."""
    found = [union_of(t) for t in text]
    return pd.DataFrame({c: pd.Series([f and f[c] for f in found], dtype=object if c == "runs" else "Int32") for c in ("h", "w", "runs")})


def box_iou(pred: Column, truth: Column, h: Column) -> Column:
    """IoU of the unions of two box lists; up to two boxes against one need no runs, by inclusion and exclusion."""
    size = lambda b: F.greatest(b["x2"] - b["x1"], F.lit(0)).cast("long") * F.greatest(b["y2"] - b["y1"], F.lit(0))
    both = lambda a, b: F.struct(F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"), F.least(a["x2"], b["x2"]).alias("x2"), F.least(a["y2"], b["y2"]).alias("y2"))

    def few(p):
        t, one = F.get(truth, F.lit(0)), p["one"]
        two = p["two"]
        shared = p["shared"]
        area = size(one) + F.coalesce(size(two) - size(shared), F.lit(0))
        hit = size(both(one, t)) + F.coalesce(size(both(two, t)) - size(both(shared, t)), F.lit(0))
        return hit / (area + size(t) - hit)

    pair = let(F.struct(F.get(pred, F.lit(0)).alias("one"), F.get(pred, F.lit(1)).alias("two")), lambda p: F.struct(p["one"].alias("one"), p["two"].alias("two"), F.when(p["two"].isNotNull(), both(p["one"], p["two"])).alias("shared")))
    simple = (F.size(pred) >= 1) & (F.size(pred) <= 2) & (F.size(truth) == 1)
    return F.when(simple & (size(F.get(truth, F.lit(0))) > 0), let(pair, few)).otherwise(iou(box_runs(pred, h), box_runs(truth, h)))


def coverage(a: Column, b: Column) -> Column:
    """struct<both, any: long>: pixels in both and in either of two run lists, by one ordered sweep over run ends.

    Overlapping runs of one list count once, so unions need no step of their own. It stays within the row: no shuffle.
    An event is one long, position times 4 plus its kind, which sorts as a primitive.
    """
    at = lambda r, field, kind: r[field].cast("long") * 4 + kind
    ends = lambda runs, field, kind: F.transform(runs, lambda r: at(r, field, kind))
    events = F.sort_array(F.concat(ends(a, "s", 0), ends(a, "e", 1), ends(b, "s", 2), ends(b, "e", 3)))

    def step(t, x):
        place, kind = F.shiftright(x, 2).cast("int"), x.bitwiseAND(F.lit(3).cast("long"))
        size = (place - t["p"]).cast("long")
        both, either = (t["a"] > 0) & (t["b"] > 0), (t["a"] > 0) | (t["b"] > 0)
        da, db = F.when(kind == 0, 1).when(kind == 1, -1).otherwise(0), F.when(kind == 2, 1).when(kind == 3, -1).otherwise(0)
        return F.struct(place.alias("p"), (t["a"] + da).alias("a"), (t["b"] + db).alias("b"), (t["both"] + F.when(both, size).otherwise(0)).alias("both"), (t["any"] + F.when(either, size).otherwise(0)).alias("any"))

    zero = F.struct(F.lit(0).alias("p"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("both"), F.lit(0).cast("long").alias("any"))
    return F.aggregate(events, zero, step, lambda t: F.struct(t["both"].alias("both"), t["any"].alias("any")))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two run lists; two empty masks give 1."""
    return let(coverage(a, b), lambda c: F.when(c["any"] == 0, 1.0).otherwise(c["both"] / c["any"]))
