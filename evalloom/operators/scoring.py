"""Scorers by task: which metrics a sample's score is made of, with which weights; registered by category and type.

A scorer gets the columns ``precise`` and ``described`` and returns a struct of four weights; the score is the weighted sum of
the metrics, and the errors are those of the metrics that it uses. All registered scorers are one CASE of a plan; a
task that none is registered for scores 0 and isn't invalid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..plans import catalog
from .filters import SCORERS, register

METRICS = ("localization", "count", "path", "binary")
Weigh = Callable[[Column, Column], Column]


def weights(**given: Column | float) -> Column:
    return F.struct(*[(given[m] if isinstance(given.get(m), Column) else F.lit(float(given.get(m, 0.0)))).alias(m) for m in METRICS])


def located(precise: Column, described: Column) -> Column:
    return weights(localization=1.0)


def located_and_counted(precise: Column, described: Column) -> Column:
    """The count weighs less where the description tells it, more where it must be exact."""
    w = scores.count_weight(precise, described)
    return weights(localization=1.0 - w, count=w)


def matched(precise: Column, described: Column) -> Column:
    return weights(localization=0.5, count=0.5)


def pathed(precise: Column, described: Column) -> Column:
    return weights(path=1.0)


def placed(precise: Column, described: Column) -> Column:
    return weights(localization=0.5, binary=0.5)


for _names, _category, _scorer in (
    ([r[3] for r in catalog.leaves() if r[1] == "TargetLocalization"] + list(catalog.TAXONOMY["TargetLocalization"]), "TargetLocalization", located_and_counted),
    (["GroundDetection"], "Navigation", located),
    (["FeasiblePath", "FeasiblePath_Ego", "FeasiblePath_Exo"], "Navigation", pathed),
    (["VisualMatching"], "Navigation", matched),
    (["AffordanceRegion", "Affordance"], "Manipulation", located),
    (["ContactRelationship", "ContactRelationship_TypeOne", "ContactRelationship_TypeTwo", "ContactRelationship_TypeThree"], "Manipulation", located_and_counted),
    (["PlacementRegion", "Placement"], "Manipulation", placed),
):
    for _name in _names:
        register(SCORERS, (_category, _name))(_scorer)


def registered() -> list[tuple[str, str]]:
    """The tasks that have a scorer, sorted."""
    return sorted(SCORERS)


def routed(category: Column, kind: Column, precise: Column, described: Column) -> Column:
    """Weights of each row's scorer: its own, else its category's ``*``, else none."""
    by: dict[Weigh, list[tuple[str, str]]] = {}
    for key, f in SCORERS.items():
        by.setdefault(f, []).append(key)
    cases = []
    for f, keys in by.items():
        exact = F.lit(False)
        for c in dict.fromkeys(c for c, _ in keys):
            exact = exact | ((category == c) & kind.isin(*[k for x, k in keys if x == c and k != "*"]))
        any_kind = category.isin(*[c for c, k in keys if k == "*"])
        cases.append((f(precise, described), exact, any_kind))
    out = None
    for w, exact, _ in cases:
        out = F.when(exact, w) if out is None else out.when(exact, w)
    for w, _, any_kind in cases:
        out = out.when(any_kind, w)
    return out.otherwise(weights())


def score_samples(df: DataFrame) -> DataFrame:
    """``df`` with score_details, score, error and invalid.

    df: category, kind, precise, described, and for each metric m its score ``m`` and error text ``m_error`` (null: none).
    """
    w = routed(F.col("category"), F.col("kind"), F.coalesce("precise", F.lit(False)), F.coalesce("described", F.lit(False)))
    x = df.withColumn("weights", w)
    score = sum((F.col(f"weights.{m}") * F.coalesce(m, F.lit(0.0)) for m in METRICS), F.lit(0.0))
    error = scores.join_errors(*[F.when(F.col(f"weights.{m}") > 0, F.col(f"{m}_error")) for m in METRICS])
    used = [F.when(F.col(f"weights.{m}") > 0, F.col(m)) for m in METRICS]
    x = x.withColumn("score_details", scores.details(*used, F.col("weights"))).withColumn("score", score).withColumn("error", error)
    return x.withColumn("invalid", scores.invalid(F.col("error"))).drop("weights")


def guarded(score: Callable[[dict], float]):
    """An Arrow function struct<score, error> of a row's struct: an exception becomes score 0 with ``Type: message``."""
    import pandas as pd

    def one(row: dict) -> tuple[float, str | None]:
        try:
            return float(score(row)), None
        except Exception as e:  # a sample's failure is its result
            return 0.0, f"{type(e).__name__}: {e}"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(r) for r in rows.to_dict("records")], columns=["score", "error"])

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.DataFrame}
    return F.pandas_udf(run, "score double, error string")


def response_details(fmt: Column, mode: Column, actual: Column, fields: Column) -> Column:
    """Format, the resolved coordinate mode (else the given one), and the answer fields of a sample."""
    return F.struct(F.coalesce(fmt, F.lit("")).alias("format_type"), F.coalesce(actual, mode, F.lit("")).alias("coordinate_system"), fields.alias("fields"))


def filter_samples(df: DataFrame, categories: list[str] | None = None, kinds: list[str] | None = None, group: str | None = None) -> DataFrame:
    """Rows of the wanted categories and types (columns category, kind).

    A group stands for its types, narrowed by ``kinds`` if there are any, and for its category where none is named. If
    nothing is left of the types, all pass.
    """
    wanted = set(kinds or ())
    if group is not None:
        of_group = set(catalog.TAXONOMY["TargetLocalization"].get(group, []))
        wanted = wanted & of_group if wanted else of_group
        categories = categories or ["TargetLocalization"]
    if categories:
        df = df.where(F.col("category").isin(*categories))
    return df.where(F.col("kind").isin(*sorted(wanted))) if wanted else df


def override_mode(df: DataFrame, mode: str | None, column: str = "coordinate_system") -> DataFrame:
    """All samples with one coordinate mode, or as they are."""
    return df.withColumn(column, F.array(F.lit(mode))) if mode else df
