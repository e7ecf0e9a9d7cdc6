"""Task taxonomy, ground-truth fields and metric flags: small dimensions that plans join by broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category -> group -> leaves, in report order.
TAXONOMY = {
    "TargetLocalization": {
        "BasicAttributes": ["Category", "Color", "Geometry", "Material", "ObjectProjections", "RelativePerception"],
        "SpatialRelatedAttributes": ["Orientation", "OrientationHuman", "SpatialRelation", "SpatialRelationHuman"],
        "EmbodiedCompositionalAttributes": ["ObjectState", "PartWhole", "PartWholeHuman", "Spoken"],
    },
    "Navigation": {"GroundDetection": ["GroundDetection"], "FeasiblePath": ["FeasiblePath_Ego", "FeasiblePath_Exo"], "VisualMatching": ["VisualMatching"]},
    "Manipulation": {"AffordanceRegion": ["AffordanceRegion"], "ContactRelationship": ["ContactRelationship_TypeOne", "ContactRelationship_TypeTwo", "ContactRelationship_TypeThree"], "PlacementRegion": ["PlacementRegion"]},
}
# Base type -> mask field, count field.
MASKS = {"TargetLocalization": "masklet_target", "GroundDetection": "masklet_ground", "FeasiblePath": "masklet_path", "VisualMatching": "masklet_matching_area", "AffordanceRegion": "masklet_affordance_region", "ContactRelationship": "masklet_contact_target", "PlacementRegion": "masklet_placement_region"}
COUNTS = {"TargetLocalization": "count_target_instance", "VisualMatching": "count_matching_area", "ContactRelationship": "count_contact_target"}
# Model family -> coordinate mode of its answers.
COORD_MODES = {"Qwen2.5-VL": "absolute", "Qwen3-VL": "normalized_0_1000", "Qwen3.5-VL": "normalized_0_1000", "InternVL3": "normalized_0_1000", "InternVL3.5": "normalized_0_1000", "LLaVA": "normalized_0_1", "Claude": "absolute", "Gemini": "normalized_0_1000"}
# Base type -> metrics that its answers need.
METRICS = {
    "TargetLocalization": ("localization", "count"), "GroundDetection": ("localization",), "FeasiblePath": ("path",), "VisualMatching": ("localization", "count"),
    "AffordanceRegion": ("localization",), "ContactRelationship": ("localization", "count"), "PlacementRegion": ("localization", "binary"),
}
# Fields of ground truth by use; the second name of a pair is an older one.
PATH_FIELDS = {"path_mask": "masklet_path", "target_area_mask": "masklet_target_area"}
PRECISE_FIELDS, DESCRIBED_FIELD, FEASIBLE_FIELDS = ("precise_count", "Precise_Count"), "count_in_description", ("placement_feasibility", "placement_feasible")


def leaves() -> list[tuple[int, str, str, str, str, str]]:
    """(ord, category, group, leaf, by_type, by_group): a group of one leaf with its own name has no deeper key."""
    out = []
    for category, groups in TAXONOMY.items():
        for group, names in groups.items():
            for leaf in names:
                by_group = f"{category}/{group}"
                out.append((len(out), category, group, leaf, by_group if names == [group] else f"{by_group}/{leaf}", by_group))
    return out


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(leaves(), "ord int, category string, `group` string, leaf string, by_type string, by_group string")


def base_type(category: Column, kind: Column) -> Column:
    """Type without its suffix and with legacy names renewed; TargetLocalization is one type."""
    return (
        F.when(category == "TargetLocalization", F.lit("TargetLocalization"))
        .when(kind.startswith("FeasiblePath"), F.lit("FeasiblePath")).when(kind.startswith("ContactRelationship"), F.lit("ContactRelationship"))
        .when(kind == "Affordance", F.lit("AffordanceRegion")).when(kind == "Placement", F.lit("PlacementRegion")).otherwise(kind)
    )


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a constant map, null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def mask_field(category: Column, kind: Column) -> Column:
    return lookup(MASKS, base_type(category, kind))


def count_field(category: Column, kind: Column) -> Column:
    return lookup(COUNTS, base_type(category, kind))


def required(category: Column, kind: Column) -> Column:
    """Struct of four flags: which metrics a task uses."""
    base = base_type(category, kind)
    uses = lambda m: F.coalesce(base.isin(*[t for t, ms in METRICS.items() if m in ms]), F.lit(False))
    return F.struct(*[uses(m).alias(m) for m in ("localization", "count", "path", "binary")])


def leaf_from_path(path: Column, group: Column | None = None) -> Column:
    """The leaf after ``group`` in a path, else the first path part that names a leaf."""
    known = F.array(*[F.lit(r[3]) for r in leaves()])
    parts = F.split(path, "/")
    first = F.try_element_at(F.filter(parts, lambda p: F.array_contains(known, p)), F.lit(1))
    if group is None:
        return first
    at = F.array_position(parts, group)
    after = F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))
    return F.coalesce(F.when(F.array_contains(known, after), after), first)


def resolve_leaf(category: Column, kind: Column, path: Column) -> Column:
    """Leaf of a sample; null where it can't be told."""
    tl = [r[3] for r in leaves() if r[1] == "TargetLocalization"]
    rest = [r[3] for r in leaves() if r[1] != "TargetLocalization"]
    scanned = leaf_from_path(path)
    target = F.when(kind.isin(tl), kind).when(kind.isin(list(TAXONOMY["TargetLocalization"])), leaf_from_path(path, kind)).otherwise(scanned)
    inferred = (
        F.when((kind == "FeasiblePath") & scanned.startswith("FeasiblePath_"), scanned).when((kind == "ContactRelationship") & scanned.startswith("ContactRelationship_"), scanned)
        .when((category == "Manipulation") & (kind == "Affordance"), F.lit("AffordanceRegion")).when((category == "Manipulation") & (kind == "Placement"), F.lit("PlacementRegion")).otherwise(kind)
    )
    return F.when(category == "TargetLocalization", target).when(category.isin("Navigation", "Manipulation") & inferred.isin(rest), inferred)
