"""Free-text answers as the four standard fields, by the rules of each task.

A snippet is found by the keys that a task's answers have, read as JSON after Python literals are made JSON, and its values
are brought to one form. Text with a scan state of its own (quotes, braces) is Python's work, in Arrow batches.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_REQUIRED, NO_RESPONSE = "Not Required", "No Valid Response"
BOXES, POINTS, OBJECTS, INSTANCES, FEASIBLE = "bounding_boxes", "points", "number_of_objects", "number_of_instances", "placement_feasibility"
# By base type the keys that a snippet should hold all of, and those of which one will do.
KEYS = {
    "TargetLocalization": ((OBJECTS, BOXES), (OBJECTS,)),
    "GroundDetection": ((), (BOXES,)),
    "AffordanceRegion": ((), (BOXES,)),
    "PlacementRegion": ((BOXES, FEASIBLE), (FEASIBLE,)),
    "FeasiblePath": ((), (POINTS,)),
    "VisualMatching": ((INSTANCES, BOXES), (INSTANCES, BOXES)),
    "ContactRelationship": ((INSTANCES, BOXES), (INSTANCES, BOXES)),
}
LEAST_POINTS = 3
_FENCE = re.compile(r"```(?:json|python)?\s*\n?(.*?)\n?```", re.S)
_ONE_FENCE = re.compile(r"^```(?:json)?\s*\n?(.*?)\n?```\s*$", re.S)
_WORDS = {"True": "true", "False": "false", "None": "null"}
_TOKEN = re.compile(r"""\\.|["']|True(?![^\W_])|False(?![^\W_])|None(?![^\W_])""", re.S)


def base_type(category: str | None, kind: str | None) -> str | None:
    """The key of ``KEYS`` for a task, or None."""
    kind = "TargetLocalization" if category == "TargetLocalization" else kind or ""
    for base in ("FeasiblePath", "ContactRelationship"):
        if kind.startswith(f"{base}_"):
            kind = base
    home = {"TargetLocalization": "TargetLocalization", "GroundDetection": "Navigation", "FeasiblePath": "Navigation", "VisualMatching": "Navigation"}.get(kind, "Manipulation")
    return kind if kind in KEYS and home == category else None


def without_think(text: str) -> str | None:
    """The text without closed think blocks; None if one never ends."""
    if "<think>" not in text:
        return text
    return re.sub(r"<think>.*?</think>", "", text, flags=re.S).strip() if "</think>" in text else None


def as_json(text: str) -> str:
    """A Python literal as JSON text: quotes, and True, False, None outside of strings.

    A double quote within a single-quoted string stays as it is, so such a text is no valid JSON.
    """
    quote, out, at = "", [], 0
    text = text.replace("\\'", "'")
    while m := _TOKEN.search(text, at):
        out.append(text[at : m.start()])
        x, at = m[0], m.end()
        if x[0] == "\\" and not quote:  # an escape is one within strings only
            x, at = "\\", m.start() + 1
        if x in _WORDS and not quote:
            x = _WORDS[x]
        elif x in ("'", '"') and x == (quote or x):
            quote, x = "" if quote else x, '"'
        out.append(x)
    return "".join([*out, text[at:]])


def listed(text: str, field: str) -> str:
    """Tuples within the list of one field as lists."""
    span = re.compile(rf'"{re.escape(field)}"\s*:\s*\[(.*?)\]\s*[,}}]', re.S)
    inner = lambda m: re.sub(r"\(([^)]*)\)", r"[\1]", m[1])
    return span.sub(lambda m: m.string[m.start() : m.start(1)] + inner(m) + m.string[m.end(1) : m.end()], text)


def snippet(text: str, must: tuple[str, ...], some: tuple[str, ...]) -> str | None:
    """The fenced block with all keys of ``must``, or else with one of ``some``; without one, the braces around a key."""
    blocks = [b.strip() for b in _FENCE.findall(text)]
    for fits in ((lambda t: must and all(k in t for k in must)), (lambda t: any(k in t for k in some))):
        if found := next((b for b in blocks if fits(b)), None):
            return found
    key = next((text.find(k) for k in (*must, *some) if k in text), -1)
    start = text.rfind("{", 0, key) if key >= 0 else -1
    if start < 0:
        return None
    depth = 0
    for m in re.compile("[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            found = text[start : m.end()]
            complete = all(k in found for k in must)
            return found if (must and complete) or any(k in found for k in some) else None
    return None


def number(x) -> int | float | None:
    """A finite number, whole ones below 10^15 as int; None for anything else."""
    try:
        v = float(x)
        return None if not math.isfinite(v) else int(v) if v == int(v) and abs(v) < 1e15 else v
    except (TypeError, ValueError, OverflowError):
        return None


def _numbers(*values) -> list | None:
    out = [number(v) for v in values]
    return None if None in out else out


def box(x) -> list | None:
    """Four numbers, or two corners, or a list of one box; None for anything else."""
    if not isinstance(x, list):
        return None
    lists = all(isinstance(p, list) for p in x)
    if len(x) == 4:
        return _numbers(*x)
    if len(x) == 2 and lists and all(len(p) >= 2 for p in x):
        return _numbers(*x[0][:2], *x[1][:2])
    return _numbers(*x[0][:4]) if len(x) == 1 and lists and len(x[0]) >= 4 else None


def point(x) -> list | None:
    """Two numbers, or a list of one point; None for anything else."""
    if not isinstance(x, list):
        return None
    if len(x) == 2:
        return _numbers(*x)
    return _numbers(*x[0][:2]) if len(x) == 1 and isinstance(x[0], list) and len(x[0]) >= 2 else None


def _each(form, values) -> list:
    return [y for x in values if (y := form(x)) is not None] if isinstance(values, list) else []


def _whole(x) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError, OverflowError):
        return None


def _yes(x) -> bool:
    return x if isinstance(x, bool) else str(x).strip().lower() in ("true", "1", "yes")


def read(base: str, data: dict) -> dict | None:
    """A task's values of a parsed snippet; None where what the task needs isn't there."""
    boxes, counter = data.get(BOXES), {"TargetLocalization": OBJECTS, "VisualMatching": INSTANCES, "ContactRelationship": INSTANCES}.get(base)
    if base == "FeasiblePath":
        points = _each(point, data.get(POINTS))
        return {POINTS: points} if len(points) >= LEAST_POINTS else None
    if counter:
        told = data.get(counter)
        count = None if told is None else _whole(told)
        # a localised target needs its number; of instances one of number and boxes will do
        if (told is None and (base == "TargetLocalization" or boxes is None)) or (told is not None and count is None):
            return None
        return ({} if count is None else {counter: count}) | {BOXES: _each(box, boxes)}
    if boxes is None or (base == "PlacementRegion" and data.get(FEASIBLE) is None):
        return None
    return {BOXES: _each(box, boxes)} | ({FEASIBLE: _yes(data[FEASIBLE])} if base == "PlacementRegion" else {})


def formatted(response: str | None, category: str | None, kind: str | None) -> str:
    """The answer as canonical JSON text, or ``No Valid Response``; of other tasks the text without its one fence."""
    text, base = (response or "").strip(), base_type(category, kind)
    if base is None:
        m = _ONE_FENCE.match(text)
        return m[1].strip() if m else text
    content = without_think(text) if text else None
    found = snippet(content, *KEYS[base]) if content else None
    if not found:
        return NO_RESPONSE
    try:
        data = json.loads(listed(as_json(found), POINTS if base == "FeasiblePath" else BOXES))
    except (ValueError, RecursionError):
        return NO_RESPONSE
    out = read(base, data) if isinstance(data, dict) else None
    return NO_RESPONSE if out is None else json.dumps(out, ensure_ascii=False)


FIELDS = ("localization", "count", "path", "binary")


def standard_fields(response: str | None, category: str | None, kind: str | None, needs: dict) -> dict[str, str]:
    """The four answer fields as JSON texts; each is a value list or a list of one mark. Never raises."""
    try:
        data = json.loads(formatted(response, category, kind))
    except ValueError:
        data = None
    data = data if isinstance(data, dict) else {}
    count = next((data[k] for k in (INSTANCES, OBJECTS) if data.get(k) is not None), None)
    values = {
        "localization": _each(box, data[BOXES]) if data.get(BOXES) is not None else None,
        "count": None if count is None or _whole(count) is None else [_whole(count)],
        "path": _each(point, data[POINTS]) if data.get(POINTS) is not None else None,
        "binary": [_yes(data[FEASIBLE])] if data.get(FEASIBLE) is not None else None,
    }
    return {k: json.dumps([NOT_REQUIRED] if not needs.get(k) else [NO_RESPONSE] if values[k] is None else values[k]) for k in FIELDS}


@F.pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in FIELDS]))
def standardize(response: pd.Series, category: pd.Series, kind: pd.Series, needs: pd.DataFrame) -> pd.DataFrame:
    """Arrow form of ``standard_fields``; needs is the struct of ``catalog.required``."""
    return pd.DataFrame([standard_fields(*r) for r in zip(response, category, kind, needs.to_dict("records"), strict=True)], columns=list(FIELDS))


@F.pandas_udf(T.StringType())
def formatted_text(response: pd.Series, category: pd.Series, kind: pd.Series) -> pd.Series:
    """Arrow form of ``formatted``."""
    return pd.Series([formatted(*r) for r in zip(response, category, kind, strict=True)])
