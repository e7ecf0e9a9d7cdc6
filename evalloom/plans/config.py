"""Task configuration and the catalogue of tasks and groups: small tables that the driver reads and plans join."""

from __future__ import annotations

import fnmatch
import importlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {"output_type": "generate_until", "num_fewshot": 0, "repeats": 1, "target_delimiter": " ", "fewshot_delimiter": "\n\n", "fewshot_seed": 1234, "test_split": "test"}
# The metrics that a task has by its kind of output, where its configuration names none.
METRICS = {"generate_until": ("exact_match",), "loglikelihood": ("perplexity", "acc"), "multiple_choice": ("acc", "acc_norm"), "loglikelihood_rolling": ("word_perplexity", "byte_perplexity", "bits_per_byte")}


def parse(text: str, path: str) -> dict:
    """A YAML or JSON mapping; YAML needs its library. A tagged function is ``{"function": name}``."""
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!function", lambda loader, node: {"function": loader.construct_scalar(node)})
    return yaml.load(text, Loader) or {}


def load(path: str) -> dict:
    """A configuration with those that it includes; of several the last named wins, and the file's own values over all."""
    with open(path, encoding="utf-8") as f:
        own = parse(f.read(), path)
    included = own.pop("include", [])
    out: dict = {}
    for other in [included] if isinstance(included, str) else included:
        out |= load(other if os.path.isabs(other) else os.path.join(os.path.dirname(path), other))
    return out | own


def function(name: str) -> Callable:
    """``module.function`` as a callable; only importable modules, no files."""
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


def complete(config: dict) -> dict:
    """A task's configuration with defaults and the metrics of its kind of output; contradictions are errors."""
    out = DEFAULTS | {k: v for k, v in config.items() if v is not None}
    if out["output_type"] not in METRICS:
        raise ValueError(f"unknown output_type: {out['output_type']}")
    if out["output_type"] == "multiple_choice" and not out.get("doc_to_choice"):
        raise ValueError("multiple_choice needs doc_to_choice")
    out.setdefault("metric_list", [{"metric": m} for m in METRICS[out["output_type"]]])
    return out


def overridden(config: dict, metric: str) -> dict:
    """The configuration with one metric only, as for a run that just keeps responses."""
    return config | {"metric_list": [{"metric": metric, "aggregation": metric}]}


def for_model(config: dict, model: str | None, key: str = "model_specific_kwargs") -> dict:
    """The part of a configuration that is for a model, else the default part, else nothing."""
    parts = config.get(key) or {}
    return parts.get(model) or parts.get("default") or {}


def shown(config: dict) -> dict:
    """The configuration as it is logged: without nulls, functions by name."""
    return {k: v.__name__ if callable(v) else v for k, v in config.items() if v is not None}


def fewshot_split(config: dict) -> str | None:
    """Where few-shot examples come from: the named split, else training, validation or test."""
    return next((config[k] for k in ("fewshot_split", "training_split", "validation_split", "test_split") if config.get(k)), None)


def entries(folder: str) -> list[tuple[str, str, str | None, str]]:
    """(name, kind, parent, file) of all tasks, groups and tags below a folder, in order of files.

    A file with ``task: [..]`` is a group of these, one with ``task: name`` a task, whose tags are groups of it.
    """
    out = []
    for where, _, files in sorted(os.walk(folder)):
        for f in sorted(files):
            path = os.path.join(where, f)
            if not f.endswith((".yaml", ".yml", ".json")):
                continue
            try:
                c = load(path)
            except (OSError, ValueError):
                continue
            task = c.get("task")
            if isinstance(task, list):
                group = c.get("group") or os.path.splitext(f)[0]
                out.append((group, "group", None, path))
                out += [(t if isinstance(t, str) else t.get("task", ""), "member", group, path) for t in task]
            elif isinstance(task, str):
                out.append((task, "python_task" if "class" in c else "task", None, path))
                tags = c.get("tag") or []
                out += [(task, "member", t, path) for t in ([tags] if isinstance(tags, str) else tags)]
    tags = {p for _, k, p, _ in out if k == "member"} - {n for n, k, _, _ in out if k == "group"}
    return out + [(t, "tag", None, "") for t in sorted(tags) if t]


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """name, kind, parent, file as a table."""
    return spark.createDataFrame(entries(folder), "name string, kind string, parent string, file string")


def matching(patterns: str | list[str], names: list[str]) -> list[str]:
    """Names that fit any of the shell patterns, sorted, once each."""
    return sorted({n for p in ([patterns] if isinstance(patterns, str) else patterns) for n in fnmatch.filter(names, p)})


def resolved(names: list[str], rows: list[tuple[str, str, str | None, str]]) -> dict[str, list[str]]:
    """Wanted names, patterns too, as groups of tasks; nested groups are opened. Unknown names and repeats are errors."""
    known = sorted({n for n, k, _, _ in rows if k != "member"})
    kinds = {n: k for n, k, _, _ in rows if k != "member"}
    members: dict[str, list[str]] = {}
    for n, k, p, _ in rows:
        if k == "member" and p:
            members.setdefault(p, []).append(n)

    def tasks(n: str, above: tuple[str, ...] = ()) -> list[str]:
        if n in above:
            raise ValueError(f"{n} is a part of itself")
        if kinds.get(n) in ("group", "tag"):
            return [t for m in members.get(n, []) for t in tasks(m, (*above, n))]
        return [n]

    out = {}
    for name in names:
        found = matching(name, known)
        if not found:
            raise KeyError(f"{name} is neither a task nor a group nor a tag")
        out |= {n: tasks(n) for n in found}
    return out


def flattened(tree: dict, way: tuple[str, ...] = ()) -> list[tuple[str, str | None, int]]:
    """(task, group, depth) rows of a nested dict of groups and tasks."""
    out = []
    for name, inner in tree.items():
        if isinstance(inner, dict):
            out += flattened(inner, (*way, name))
        else:
            out.append((name, way[-1] if way else None, len(way)))
    return out


def cache_modes(mode: str) -> dict[str, bool]:
    """What a mode of the request cache means: use, refresh, delete."""
    return {"cache_requests": mode in ("true", "refresh"), "rewrite_requests_cache": mode == "refresh", "delete_requests_cache": mode == "delete"}


def sample_size(n: int, limit: float | None) -> int | None:
    """A limit below 1 is a share of the rows, rounded up; none is none."""
    import math

    return None if limit is None else math.ceil(n * limit) if limit < 1 else int(limit)


def isolated(runs: list[dict], run: Callable[[dict], object]) -> list[tuple[dict, object, str | None]]:
    """(configuration, result, error) of several runs; one that fails doesn't end the others."""
    out = []
    for c in runs:
        try:
            out.append((c, run(c), None))
        except Exception as e:  # told in the result
            out.append((c, None, f"{type(e).__name__}: {e}"))
    return out
