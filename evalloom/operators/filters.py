"""Registries of filters, metrics and scorers, and pipelines of response filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import choices, metrics, text

FILTERS: dict[str, Callable[..., Column]] = {
    "regex": text.regex_extract,
    "remove_whitespace": text.drop_one_space,
    "lowercase": lambda r: F.transform(r, F.lower),
    "uppercase": lambda r: F.transform(r, F.upper),
    "map": text.map_values,
    "take_first": lambda r: F.try_element_at(r, F.lit(1)),
    "take_first_k": lambda r, k: F.slice(r, 1, k),
    "majority_vote": lambda r: F.array(text.majority(r)),
    "none": lambda r: r,
}
FILTERS["multi_choice"] = choices.multi_choice
AGGREGATIONS: dict[str, Callable[..., Column]] = {"mean": metrics.mean, "median": metrics.median, "bypass": metrics.bypass, "perplexity": metrics.perplexity, "weighted_perplexity": metrics.weighted_perplexity, "bits_per_byte": metrics.bits_per_byte, "f1": metrics.f1, "mcc": metrics.mcc, "brier_score": metrics.brier}
# Whether more of a metric is better.
HIGHER_IS_BETTER = {"acc": True, "acc_norm": True, "acc_all": True, "acc_mutual_info": True, "exact_match": True, "anls": True, "f1": True, "mcc": True, "bleu": True, "chrf": True, "mean": True, "ter": False, "brier_score": False, "perplexity": False, "word_perplexity": False, "byte_perplexity": False, "bits_per_byte": False}
OUTPUTS: dict[str, tuple[str, ...]] = {}
SCORERS: dict[tuple[str, str], Callable[..., Column]] = {}


def register(table: dict, name):
    """Decorator that adds a function under a name; names are unique."""
    def add(f):
        if name in table:
            raise ValueError(f"{name} is registered already")
        table[name] = f
        return f

    return add


def register_metric(name: str, higher_is_better: bool, outputs: str | tuple[str, ...], aggregation: Callable[..., Column]):
    """Decorator that adds a sample metric: whether more is better, for which kinds of output, and how it is aggregated."""
    def add(f):
        register(AGGREGATIONS, name)(aggregation)
        HIGHER_IS_BETTER[name], OUTPUTS[name] = higher_is_better, (outputs,) if isinstance(outputs, str) else tuple(outputs)
        return f

    return add


def aggregation(name: str) -> Callable[..., Column]:
    """The aggregate of a metric; an unknown one is an error, no library outside is asked."""
    if name not in AGGREGATIONS:
        raise KeyError(f"no metric is registered as {name}; known are {', '.join(sorted(AGGREGATIONS))}")
    return AGGREGATIONS[name]


def higher_is_better(name: str) -> bool | None:
    return HIGHER_IS_BETTER.get(name)


def scorer(category: str, kind: str) -> Callable[..., Column]:
    """Exact entry, then the category's ``*``, then a placeholder that scores 0."""
    return SCORERS.get((category, kind)) or SCORERS.get((category, "*")) or (lambda *_: F.lit(0.0))  # see operators/scoring


def pipeline(df: DataFrame, responses: str, pipelines: dict[str, list[tuple]]) -> DataFrame:
    """``df`` with a column for each pipeline: its filters, given as (name, arguments...), one after another."""
    for name, steps in pipelines.items():
        x = F.col(responses)
        for step in steps:
            x = FILTERS[step[0]](x, *step[1:])
        df = df.withColumn(name, x)
    return df
