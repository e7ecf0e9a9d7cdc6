"""Path scoring: how well an ordered point path leads over a feasible area from a start to an end region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import regions

# Weights of (start/end, feasibility, away, toward, continuity) by place in the path, and limits.
FIRST, LAST, MIDDLE = (1.0, 0.0, 0.0, 0.0, 0.0), (0.3, 0.4, 0.1, 0.1, 0.1), (0.0, 0.4, 0.2, 0.2, 0.2)
DISTANCE_K, NEAR_RATIO, FAR_RATIO, SAMPLES = 3.0, 1 / 30, 2 / 3, 50


def of_runs(runs, h: int, w: int) -> regions.Region:
    """The region of runs [{s, e}, ...] of a column-major pixel index."""
    if runs is None or not len(runs):
        return regions.region(np.zeros(0, np.int64), np.zeros(0, np.int64), h, w)
    flat = np.array([(r["s"], r["e"]) for r in runs], np.int64)
    return regions.region(flat[:, 0], flat[:, 1], h, w)


def split_target(area: regions.Region) -> tuple[regions.Region, regions.Region | None]:
    """Two regions: the components whose centres are farthest apart, others joined to the nearer (ties to the first)."""
    label = area.components()
    n = int(label.max()) + 1 if len(label) else 0
    if n < 2:
        return area, None
    many = area.end - area.top
    size = np.bincount(label, many)
    c = np.stack([np.bincount(label, area.x * many), np.bincount(label, (area.top + area.end - 1) * many) / 2]) / size
    # the pair of components farthest apart, a block of them against all at a time
    best, pair = -1.0, (0, 1)
    for i in range(0, n, 512):
        d = np.hypot(*(c[:, i : i + 512, None] - c[:, None, :]))
        if d.max() > best:
            best, pair = d.max(), tuple(int(k) for k in np.unravel_index(d.argmax(), d.shape))
            pair = (pair[0] + i, pair[1])
    one = np.hypot(*(c - c[:, pair[0], None])) <= np.hypot(*(c - c[:, pair[1], None]))
    return area.part(one[label]), area.part(~one[label])


def point_distance(p, area: regions.Region | None, other=None) -> float:
    """0 inside (nearest pixel, halves to even), else the least distance to a pixel; infinite for no region."""
    if area is None:
        return float(np.hypot(p[0] - other[0], p[1] - other[1])) if other is not None else float("inf")
    if area.inside(np.rint([p[0]]).astype(np.int64), np.rint([p[1]]).astype(np.int64))[0]:
        return 0.0
    return area.distance(*p)


def region_distance(a: regions.Region | None, b: regions.Region | None, start) -> float:
    """Least pixel distance, exact on all pixels."""
    if b is None or not len(b):
        return float("inf")
    if a is None:
        return point_distance(start, b) if start is not None else float("inf")
    return a.gap(b)


def inside_ratio(p, q, area: regions.Region) -> float:
    """Share of midpoints of equal parts of a segment that lie in the region."""
    return float(_inside_ratios(np.array([p[0], q[0]], float), np.array([p[1], q[1]], float), area)[0])


def _inside_ratios(x: np.ndarray, y: np.ndarray, area: regions.Region) -> np.ndarray:
    """``inside_ratio`` of each step of a path."""
    t = (np.arange(SAMPLES) + 0.5) / SAMPLES
    px, py = (np.rint(v[:-1, None] * (1 - t) + v[1:, None] * t).astype(np.int64).ravel() for v in (x, y))
    return area.inside(px, py).reshape(-1, SAMPLES).sum(1) / SAMPLES


def _distances(x: np.ndarray, y: np.ndarray, area: regions.Region | None, other=None) -> list[float]:
    """``point_distance`` of each point."""
    if area is None:
        return np.hypot(x - other[0], y - other[1]).tolist() if other is not None else [float("inf")] * len(x)
    out = np.zeros(len(x))
    far = np.flatnonzero(~area.inside(np.rint(x).astype(np.int64), np.rint(y).astype(np.int64)))
    out[far] = area.distances(x[far], y[far])
    return out.tolist()


def kept_places(points: list, least: float) -> list[int]:
    """Places of the points that are at least ``least`` away from the last kept one; the first is kept."""
    kept: list[int] = []
    for i, p in enumerate(points):
        if not kept or np.hypot(p[0] - points[kept[-1]][0], p[1] - points[kept[-1]][1]) >= least:
            kept.append(i)
    return kept


def judged(points, feasible, target, h: int, w: int, exo: bool) -> dict:
    """Score of a path with its components, and what each point adds.

    Points too near the last kept one take no part. The score is the mean of the points' weighted scores; 0 for fewer than
    two. Without two regions to go between, a path starts from the middle of the lower edge.
    """
    goal = of_runs(target, h, w)
    return _judged([(float(p["x"]), float(p["y"])) for p in points], lambda: of_runs(feasible, h, w), goal, lambda: split_target(goal), h, w, exo)


def _judged(every: list, feasible, target: regions.Region, halves, h: int, w: int, exo: bool) -> dict:
    """``judged`` of points (x, y) and a target's region; ``feasible`` and ``halves`` give regions when they are needed."""
    diag = float(np.hypot(h, w))
    used = kept_places(every, diag * NEAR_RATIO)
    pts, n = [every[i] for i in used], len(used)
    out = {"score": 0.0, "before": len(every), "after": n, "start_end": None, "feasibility": None, "away": None, "toward": None, "continuity": None}
    empty = {k: None for k in ("score", "start_end", "feasibility", "away", "toward", "continuity", "to_start", "to_end", "weight")}
    kept = set(used)
    out["points"] = [{"x": x, "y": y, "used": i in kept, **empty} for i, (x, y) in enumerate(every)]
    if n < 2:
        return out
    area, goal = feasible(), target if len(target) else None
    start, end, foot = None, goal, (w / 2, h - 1.0)
    if exo and goal is not None:
        a, b = halves()
        if b is not None:
            start, end = (a, b) if point_distance(pts[0], a) <= point_distance(pts[0], b) else (b, a)
    gap = region_distance(start, end, foot)
    if not 0 < gap < float("inf"):
        s = start.centre() if start is not None else foot
        e = end.centre() if end is not None else (w / 2, h / 2)
        gap = float(np.hypot(s[0] - e[0], s[1] - e[1]))
    low, high = diag * NEAR_RATIO, gap * FAR_RATIO if gap > 0 else diag
    x, y = (np.array(v) for v in zip(*pts, strict=True))
    to_start, to_end, steps, ratios = _distances(x, y, start, foot), _distances(x, y, end), np.hypot(np.diff(x), np.diff(y)).tolist(), _inside_ratios(x, y, area).tolist()
    ends = [max(0.0, 1 - DISTANCE_K * d / diag) if d < float("inf") else 0.0 for d in (to_start[0], to_end[-1])]
    rows = [[ends[0], 0.0, 0.0, 0.0, 0.0]]
    for i in range(1, n):
        rows.append([ends[1] if i == n - 1 else 0.0, ratios[i - 1], float(to_start[i] > to_start[i - 1]), float(to_end[i] < to_end[i - 1]), float(low <= steps[i - 1] <= high)])
    names = ("start_end", "feasibility", "away", "toward", "continuity")
    total = 0.0
    for i, (at, row) in enumerate(zip(used, rows, strict=True)):
        last = i == n - 1
        weights = FIRST if i == 0 else LAST if last else MIDDLE
        counts = [i == 0 or last, i > 0, i > 0, i > 0, 0 < i and (not last or n >= 3)]
        weight = sum(x for x, c in zip(weights, counts, strict=True) if c)
        score = sum(x * p for x, p, c in zip(weights, row, counts, strict=True) if c) / weight
        total += score
        shown = {k: x if c else 0.0 for k, x, c in zip(names, row, counts, strict=True)}
        out["points"][at] |= shown | {"score": score, "to_start": to_start[i], "to_end": to_end[i], "weight": weight}
    mean = lambda k, part: sum(r[k] for r in part) / len(part) if part else None
    out |= {"score": total / n, "start_end": sum(ends) / 2, "feasibility": mean(1, rows[1:]), "away": mean(2, rows[1:]), "toward": mean(3, rows[1:]), "continuity": mean(4, rows[1:-1])}
    return out


def score_path(points, feasible, target, h: int, w: int, exo: bool) -> float:
    return judged(points, feasible, target, h, w, exo)["score"]


_number = lambda n: T.StructField(n, T.DoubleType())
_POINT = T.StructType([_number("x"), _number("y"), T.StructField("used", T.BooleanType()), *map(_number, ("score", "start_end", "feasibility", "away", "toward", "continuity", "to_start", "to_end", "weight"))])
RESULT = T.StructType([_number("score"), T.StructField("error", T.StringType()), T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()), *map(_number, ("start_end", "feasibility", "away", "toward", "continuity")), T.StructField("points", T.ArrayType(_POINT))])


def _one(points, feasible, target, h, w, exo) -> dict:
    """The result of a row; errors are told, never raised."""
    none = dict.fromkeys(RESULT.names) | {"score": 0.0}
    if h is None or w is None or h != h or feasible is None:
        return none | {"error": "Failed to decode feasible area mask or mask is missing"}
    if points is None or not len(points):
        return none | {"error": "No path points parsed"}
    try:
        return judged(points, feasible, target, int(h), int(w), bool(exo)) | {"error": None}
    except (TypeError, ValueError, KeyError) as e:
        return none | {"error": f"{type(e).__name__}: {e}"}


class _Regions:
    """Regions of the runs in a batch; equal runs share one, with its halves."""

    def __init__(self):
        self.known: dict[tuple, list] = {}

    def of(self, s: np.ndarray, e: np.ndarray, h: int, w: int) -> list:
        key = (h, w, s.tobytes(), e.tobytes())
        if key not in self.known:
            self.known[key] = [regions.region(s.astype(np.int64), e.astype(np.int64), h, w), None]
        return self.known[key]

    def halves(self, entry: list) -> tuple:
        if entry[1] is None:
            entry[1] = split_target(entry[0])
        return entry[1]


def _fields(lists: pa.Array, *names: str) -> tuple | None:
    """Offsets and fields of the structs of a list array; None if any of them has nulls or isn't a number."""
    if not isinstance(lists, pa.ListArray) or not pa.types.is_struct(lists.type.value_type):
        return None
    flat = lists.values
    if flat.null_count or any(lists.type.value_type.get_field_index(n) < 0 for n in names):
        return None
    columns = [flat.field(n) for n in names]
    if any(c.null_count or not (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)) for c in columns):
        return None
    return lists.offsets.to_numpy(), *[c.to_numpy() for c in columns]


def _batch(points: pa.Array, feasible: pa.Array, target: pa.Array, h: pa.Array, w: pa.Array, exo: pa.Array) -> Iterator[dict]:
    """The result of each row, straight from the arrays; rows with nulls go through ``_one``."""
    p, f, t, seen = _fields(points, "x", "y"), _fields(feasible, "s", "e"), _fields(target, "s", "e"), _Regions()
    plain = [p is not None and f is not None and t is not None] * len(points)
    for x in (points, feasible, target, h, w, exo):
        plain = [a and b for a, b in zip(plain, x.is_valid().to_pylist(), strict=True)] if x.null_count else plain
    for i, (rows, cols, other) in enumerate(zip(h.to_pylist(), w.to_pylist(), exo.to_pylist(), strict=True)):
        if not plain[i] or p[0][i] == p[0][i + 1]:
            yield _one(points[i].as_py(), feasible[i].as_py(), target[i].as_py(), rows, cols, other)
            continue
        at = [slice(c[0][i], c[0][i + 1]) for c in (p, f, t)]
        every = list(zip(p[1][at[0]].astype(float).tolist(), p[2][at[0]].astype(float).tolist(), strict=True))
        goal = seen.of(t[1][at[2]], t[2][at[2]], rows, cols)
        yield _judged(every, lambda i=i, k=at[1], y=rows, x=cols: seen.of(f[1][k], f[2][k], y, x)[0], goal[0], lambda g=goal: seen.halves(g), rows, cols, bool(other)) | {"error": None}


@F.arrow_udf(RESULT)
def result(points: pa.Array, feasible: pa.Array, target: pa.Array, h: pa.Array, w: pa.Array, exo: pa.Array) -> pa.Array:
    """Score, error text, components and points of each row; a row without points isn't a path row or has no answer."""
    return pa.array(list(_batch(points, feasible, target, h, w, exo)), to_arrow_type(RESULT))


@F.arrow_udf(T.StructType(RESULT.fields[:2]))
def score_only(points: pa.Array, feasible: pa.Array, target: pa.Array, h: pa.Array, w: pa.Array, exo: pa.Array) -> pa.Array:
    """Score and error text; 0 and no error where ``exo`` is null, for rows of other tasks."""
    rows = [(0.0, None) if e is None else (r["score"], r["error"]) for e, r in zip(exo.to_pylist(), _batch(points, feasible, target, h, w, exo), strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.string())], ["score", "error"])


def path_scores(df: DataFrame, key: str) -> DataFrame:
    """key, score from columns points, feasible, target, h, w, exo; Arrow batches, one pass."""
    return df.select(key, result("points", "feasible", "target", "h", "w", "exo").alias("r")).select(key, "r.score")
