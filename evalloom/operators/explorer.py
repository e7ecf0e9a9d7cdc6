"""Looking through scored samples: filters, search, orders, and what is shown of each kind of task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import catalog

ORDERS = ("index", "score_up", "score_down")
# By base type the mask that is shown, and the described fields that are searched; newer names first.
SHOWN = {t: {"mask": m} for t, m in catalog.MASKS.items()}
SEARCHED = {
    "TargetLocalization": ("text_label",), "GroundDetection": (), "FeasiblePath": ("text_label",), "VisualMatching": (), "AffordanceRegion": ("reference_object_description_en", "text_label"),
    "ContactRelationship": ("text_label",), "PlacementRegion": ("reference_object_description_en", "placement_region_description_en"),
}


def filtered(samples: DataFrame, category: str | None = None, kind: str | None = None, form: str | None = None, valid: bool | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Samples of a category, type and format, valid or not, with a score from ``low`` to ``high``; no score counts as 0."""
    for column, wanted in (("category", category), ("kind", kind), ("format_type", form)):
        if wanted is not None:
            samples = samples.where(F.col(column) == wanted)
    if valid is not None:
        samples = samples.where(F.coalesce("invalid", F.lit(False)) != valid)
    return samples.where(F.coalesce("score", F.lit(0.0)).between(low, high))


def described(doc: Column, *names: str) -> Column:
    """The first field that is there among an annotation's texts, else among its masks, else at its top; lists by their first entry."""
    every = []
    for n in names:
        for where in ("text_annotation.", "mask_annotation.", ""):
            every += [F.try_variant_get(doc, f"$.{where}{n}[0]", "string"), F.try_variant_get(doc, f"$.{where}{n}", "string")]
    return F.coalesce(*every)


def search_text(*parts: Column) -> Column:
    """Paths and texts as one text in lower case, underscores as blanks."""
    return F.lower(F.replace(F.concat_ws(" ", *parts), F.lit("_"), F.lit(" ")))


def found(samples: DataFrame, words: str, *parts: Column) -> DataFrame:
    """Samples whose texts hold the words, as they follow each other; no words find all."""
    wanted = words.strip().lower().replace("_", " ")
    return samples.where(search_text(*parts).contains(wanted)) if wanted else samples


def ordered(samples: DataFrame, order: str, index: str = "index") -> DataFrame:
    """By index, or by score up or down; no score counts as 0, and ties stay in order of the index."""
    if order not in ORDERS:
        raise ValueError(f"unknown order: {order}")
    score = F.coalesce("score", F.lit(0.0))
    return samples.orderBy(*([] if order == "index" else [score.asc() if order == "score_up" else score.desc()]), F.col(index).asc())


def facets(samples: DataFrame, *columns: str) -> DataFrame:
    """The different values of the columns, sorted."""
    return samples.select(*columns).distinct().orderBy(*columns)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Each combination of values with its number of rows, ``n``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
