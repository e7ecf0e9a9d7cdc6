"""Names, keys and small texts: sanitising, file names, wildcards, argument strings, run stamps."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNFIT = r'["<>:/|\\?*\[\]]+'


def model_name(name: Column, full: bool = False) -> Column:
    """A model's name for files: its last two parts (all, if ``full``), runs of unfit signs as ``__``."""
    return F.regexp_replace(name if full else F.substring_index(name, "/", -2), _UNFIT, "__")


def task_name(name: Column) -> Column:
    """Every sign that is no letter, digit or underscore as ``_``."""
    return F.regexp_replace(name, r"(?U)\W", "_")


def shortened(text: Column, most: int = 40) -> Column:
    """Texts longer than ``most`` by their first and last halves, with dots between."""
    n = F.length(text)
    tail = most - most // 2
    return F.when(n > most, F.concat(F.substring(text, 1, most // 2), F.lit("..."), text.substr(n - tail + 1, F.lit(tail)))).otherwise(text)


def without_none(key: Column) -> Column:
    """struct<key, removed>: a metric's key without the ``,none`` at its end."""
    return F.struct(F.regexp_replace(key, ",none$", "").alias("key"), key.endswith(",none").alias("removed"))


def metric_parts(key: Column) -> Column:
    """struct<metric, filter> of ``metric,filter``."""
    return F.struct(F.split_part(key, F.lit(","), F.lit(1)).alias("metric"), F.regexp_replace(key, "^[^,]*,?", "").alias("filter"))


def escaped_split(text: Column, sign: str) -> Column:
    """Parts between signs that no backslash precedes."""
    return F.split(text, r"(?<!\\)" + re.escape(sign))


def argument(text: str) -> bool | int | float | str:
    """A truth value, a whole number or a number where the text is one; else the text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.isnumeric():
        return int(text)
    try:
        return float(text)
    except ValueError:
        return text


def arguments(text: str) -> dict:
    """``a=1,b=x`` as a dict; parts without a value are errors."""
    return {k: argument(v) for k, v in (part.split("=") for part in text.strip().split(",") if part)}


def arguments_map(text: Column) -> Column:
    """``a=1,b=x`` as a map of texts."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def texts(values: Column) -> Column:
    """Every entry as text."""
    return F.transform(values, lambda x: x.cast("string"))


def matching(name: Column, patterns: list[str]) -> Column:
    """Whether a name fits one of the shell patterns; case counts."""
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike("^" + fnmatch.translate(p).replace("\\Z", "$").replace("\\z", "$").replace("(?s:", "(?:(?s)"))
    return out


def file_task(name: Column) -> Column:
    """The task in ``..._<task>_<stamp>.jsonl``: what is between the first and the last underscore."""
    first, last = F.locate("_", name), F.length(name) - F.locate("_", F.reverse(name)) + 1
    return name.substr(first + 1, F.greatest(last - first - 1, F.lit(0)))


def file_stamp(name: Column) -> Column:
    """The stamp in a result file's name; stamps compare as texts."""
    return F.replace(F.substring_index(name, "_", -1), F.lit(".jsonl"), F.lit(""))


def is_results(name: Column) -> Column:
    return name.contains("results") & name.contains(".json")


def is_samples(name: Column) -> Column:
    return name.contains("/samples_") & name.contains(".json")


def run_stamp(at: Column, zone: str = "Asia/Singapore") -> Column:
    """A time (UTC) as the stamp of a run in a time zone."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyyMMdd_HHmmss")


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def capture_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def lower_keys(m: Column) -> Column:
    return F.transform_keys(m, lambda k, _: F.lower(k))


def merged(left: Column, right: Column) -> Column:
    """Both maps; the right one's values win."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)
