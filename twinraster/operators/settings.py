"""Layered settings: common values, overrides by class, direct class layers; aliases and morphology keys in one form."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other names of settings, in order of precedence for one setting, and the keys that belong to the morphology map.
ALIASES = [("min_component_area", "min_area"), ("min_positive_total_area", "min_pos_area"), ("min_total_area", "min_pos_area"), ("simplification_tolerance", "simplify_px")]
MORPHOLOGY = ["opening", "closing", "dilation", "erosion", "fill_holes"]
CLASS_THRESHOLD = {"new_building": "building_threshold", "tree_removal": "tree_threshold"}
DEFAULT_THRESHOLD = 0.5

#: A layer: plain settings and a nested morphology map; either may be null.
LAYER = "struct<settings: map<string, double>, morphology: map<string, double>>"


def _no_map() -> Column:
    return F.create_map().cast("map<string, double>")


def overlay(under: Column, over: Column) -> Column:
    """Both maps in one; where both have a key, ``over`` wins. A null map is empty."""
    under, over = F.coalesce(under, _no_map()), F.coalesce(over, _no_map())
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k)), over)


def _renamed(settings: Column, alias: str, name: str) -> Column:
    return F.transform_keys(F.map_filter(settings, lambda k, _: k == alias), lambda k, _: F.lit(name))


def canonical(layer: Column) -> Column:
    """A layer with aliases renamed and morphology keys moved into the morphology map, which the nested map overrides. A setting's
    own name wins over its aliases, an earlier alias over a later one."""
    settings = F.coalesce(layer["settings"], _no_map())
    aliased = [_renamed(settings, alias, name) for alias, name in reversed(ALIASES)]
    apart = F.array(*[F.lit(k) for k in [alias for alias, _ in ALIASES] + MORPHOLOGY])
    plain = F.map_filter(settings, lambda k, _: ~F.array_contains(apart, k))
    named = F.map_filter(settings, lambda k, _: k.isin(MORPHOLOGY))
    return F.struct(reduce(overlay, [*aliased, plain]).alias("settings"), overlay(named, layer["morphology"]).alias("morphology"))


def resolve_settings(rows: DataFrame, common: str, by_class: str, direct: str, classes: list[str] = tuple(CLASS_THRESHOLD)) -> DataFrame:
    """``rows`` by class with the resolved ``settings`` and ``morphology`` maps in place of the three layer columns.

    ``common`` is a layer, ``by_class`` and ``direct`` are maps from class to layer. Later layers override earlier ones key by key, in the morphology
    map too. Without a threshold the class's own common threshold holds, then one half. Null layers and maps are empty.
    """
    each = rows.withColumn("class_name", F.explode(F.array(*map(F.lit, classes))))
    layers = [canonical(F.col(common)), *[canonical(F.try_element_at(F.col(c), F.col("class_name"))) for c in (by_class, direct)]]
    settings, morphology = (reduce(overlay, [layer[part] for layer in layers]) for part in ("settings", "morphology"))
    own = F.create_map(*[F.lit(v) for c in classes for v in (c, CLASS_THRESHOLD[c])])[F.col("class_name")]
    found = each.withColumn("settings", settings).withColumn("morphology", morphology)
    fallback = F.create_map(F.lit("threshold"), F.coalesce(F.try_element_at("settings", own), F.lit(DEFAULT_THRESHOLD)))
    return found.withColumn("settings", overlay(fallback, F.col("settings"))).drop(common, by_class, direct)


def setting_conflicts(rows: DataFrame, common: str, by_class: str, direct: str) -> DataFrame:
    """One row per setting that a layer gives twice with different values: ``layer`` (common, or the class below which map), ``key``, the name it
    was ``dropped`` under, ``kept_value`` and ``dropped_value``. Morphology given plainly and in the nested map counts too."""
    keys = [c for c in rows.columns if c not in (common, by_class, direct)]
    named = lambda c: F.transform(F.map_entries(F.coalesce(F.col(c), F.create_map().cast(f"map<string, {LAYER}>"))), lambda e: F.struct(F.concat(F.lit(f"{c}."), e["key"]).alias("layer"), e["value"].alias("value")))
    layers = F.concat(F.array(F.struct(F.lit(common).alias("layer"), F.col(common).alias("value"))), named(by_class), named(direct))
    each = rows.select(*keys, F.inline(layers))
    final = canonical(F.col("value"))
    settings = F.coalesce(F.col("value.settings"), _no_map())
    doubles = F.concat(
        F.filter(F.array(*[F.struct(F.lit(name).alias("key"), F.lit(alias).alias("dropped"), final["settings"][name].alias("kept_value"), F.try_element_at(settings, F.lit(alias)).alias("dropped_value")) for alias, name in ALIASES]),
                 lambda s: s["dropped_value"] != s["kept_value"]),
        F.filter(F.array(*[F.struct(F.lit(m).alias("key"), F.lit(m).alias("dropped"), final["morphology"][m].alias("kept_value"), F.try_element_at(settings, F.lit(m)).alias("dropped_value")) for m in MORPHOLOGY]),
                 lambda s: s["dropped_value"] != s["kept_value"]))
    return each.select(*keys, "layer", F.inline(doubles))
