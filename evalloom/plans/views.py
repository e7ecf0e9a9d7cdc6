"""What is shown of a sample by its category and kind: the masks over its picture, with colours, and the texts beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "*"
# Colours (red, green, blue) by role.
COLOURS = {"reference": (0, 120, 255), "primary": (255, 0, 0), "secondary": (0, 255, 0), "predicted": (255, 215, 0)}
# Fixed values: (category, kind): mask fields by role; the second picture of a matching task shows its primary one.
MASKS = {
    ("TargetLocalization", ANY): {"primary": "masklet_target"},
    ("Navigation", "GroundDetection"): {"primary": "masklet_ground"},
    ("Navigation", "FeasiblePath_Ego"): {"primary": "masklet_path", "secondary": "masklet_target_area"},
    ("Navigation", "FeasiblePath_Exo"): {"primary": "masklet_path", "secondary": "masklet_target_area"},
    ("Navigation", "VisualMatching"): {"reference": "masklet_reference_area", "primary": "masklet_matching_area"},
    ("Manipulation", "AffordanceRegion"): {"reference": "masklet_reference_area", "primary": "masklet_affordance_region"},
    ("Manipulation", "ContactRelationship_TypeOne"): {"reference": "masklet_reference_object", "primary": "masklet_contact_target"},
    ("Manipulation", "ContactRelationship_TypeTwo"): {"reference": "masklet_reference_object", "primary": "masklet_contact_target"},
    ("Manipulation", "ContactRelationship_TypeThree"): {"reference": "masklet_reference_object", "primary": "masklet_contact_target"},
    ("Manipulation", "PlacementRegion"): {"reference": "masklet_reference_object", "primary": "masklet_placement_region"},
}
# Fixed values: (category, kind): text fields of the first panel.
TEXTS = {
    ("TargetLocalization", ANY): ("target_object_description_en", "count_target_instance", "precise_count"),
    ("Navigation", "VisualMatching"): ("count_matching_area", "precise_count"),
    ("Manipulation", "AffordanceRegion"): ("task_description_en", "reference_object_description_en"),
    ("Manipulation", "ContactRelationship"): ("count_contact_target", "precise_count"),
    ("Manipulation", "PlacementRegion"): ("reference_object_description_en", "placement_region_description_en", "placement_feasibility"),
}
# Older names of kinds.
OLDER = {("Navigation", "FeasiblePath"): "FeasiblePath_Ego", ("Manipulation", "Affordance"): "AffordanceRegion", ("Manipulation", "Placement"): "PlacementRegion", ("Manipulation", "ContactRelationship"): "ContactRelationship_TypeOne"}


def _kind(category: Column, kind: Column, older: dict[tuple[str, str], str]) -> Column:
    out = kind
    for (c, k), new in older.items():
        out = F.when((category == c) & (kind == k), new).otherwise(out)
    return F.when(category == "TargetLocalization", ANY).otherwise(out)


def layers(samples: DataFrame) -> DataFrame:
    """``samples`` (category, kind, ...) with ``layers``: array of struct<role, field, r, g, b> of the masks to show; empty for unknown kinds."""
    rows = [(c, k, [(role, field, *COLOURS[role]) for role, field in fields.items()]) for (c, k), fields in MASKS.items()]
    table = samples.sparkSession.createDataFrame(rows, "category string, __kind string, layers array<struct<role:string,field:string,r:int,g:int,b:int>>")
    x = samples.withColumn("__kind", _kind(F.col("category"), F.col("kind"), OLDER))
    return x.join(F.broadcast(table), ["category", "__kind"], "left").drop("__kind").withColumn("layers", F.coalesce("layers", F.array().cast(table.schema["layers"].dataType)))


def key_texts(samples: DataFrame) -> DataFrame:
    """``samples`` with ``fields``: the names of the texts of the first panel; all kinds of contact share theirs."""
    rows = [(c, k, list(fields)) for (c, k), fields in TEXTS.items()]
    table = samples.sparkSession.createDataFrame(rows, "category string, __kind string, fields array<string>")
    contact = F.when((F.col("category") == "Manipulation") & F.col("kind").startswith("ContactRelationship"), "ContactRelationship").otherwise(F.col("kind"))
    x = samples.withColumn("__kind", _kind(F.col("category"), contact, {}))
    return x.join(F.broadcast(table), ["category", "__kind"], "left").drop("__kind").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))
