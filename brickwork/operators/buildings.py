"""Building rows: imputation, classification, feature projection, zones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.rounding import half_even
from brickwork.functions.text import derive, sql_list


@dataclass(frozen=True)
class Assumptions:
    """Values used where the data says nothing."""

    wwr_ratio: float = 0.2
    num_floors: int = 2
    f2f_height: float = 3.5
    exposed_basement_frac: float = 0.25


OCCUPIED = ("occupied_unconditioned", "occupied_conditioned")
CONDITIONED = ("occupied_conditioned", "unoccupied_conditioned")
CORE_EDGE = 15.0  # fixed value: metres, both edges longer -> core/perimeter zoning


def restore_truncated_names(df: DataFrame, expected: Sequence[str | None]) -> DataFrame:
    """Undo the ten-character column names of shape files."""
    have = set(df.columns)
    renames = {n[:10]: n for n in expected if n is not None and n[:10] in have and n not in have}
    return df.withColumnsRenamed(renames)


def impute_dimensions(df: DataFrame, a: Assumptions, height: str | None, floors: str | None, wwr: str | None) -> DataFrame:
    """``height``, ``num_floors``, ``wwr`` and a flag for ratios outside [0, 1]."""
    if height is None and floors is None:
        raise ValueError("a height or a floor count column is required")
    h = F.col(height) if height else F.lit(a.f2f_height) * F.col(floors)
    n = F.col(floors) if floors else F.greatest(F.lit(1), F.floor(F.col(height) / F.lit(a.f2f_height))).cast("int")
    w = F.coalesce(F.col(wwr), F.lit(a.wwr_ratio)) if wwr else F.lit(a.wwr_ratio)
    return df.withColumns({"height": h, "num_floors": n, "wwr": w}).withColumn(
        "wwr_out_of_range", (F.col("wwr") < 0) | (F.col("wwr") > 1)
    )


def floors_of(heights: Column, f2f: float) -> Column:
    return F.transform(heights, lambda h: F.floor(h / F.lit(f2f)))


def weather_uri(path: Column, prefix: str = "https://climate.onebuilding.org/") -> Column:
    return F.concat(F.lit(prefix), path)


def age_bracket(year: str) -> str:
    return f"CASE WHEN {year} < 1975 THEN 'pre_1975' WHEN {year} <= 2003 THEN 'btw_1975_2003' ELSE 'post_2003' END"


def size_class(typology: str, floors: str, footprint: str) -> str:
    t = f"lower({typology})"
    multi = f"(contains({t}, 'multi') OR contains({t}, 'mf')) AND NOT contains({t}, '4 units') AND NOT contains({t}, '3 units')"
    return f"CASE WHEN ({multi}) OR {floors} > 3 OR {footprint} > 1000 THEN 'MF' ELSE 'SF' END"


def add_typology(df: DataFrame, typology: str = "typology", year: str = "year_built", floors: str = "num_floors", footprint: str = "footprint_area") -> DataFrame:
    """Residential flag, size and age classes, template and window names."""
    df = derive(
        df,
        {
            "is_residential": f"contains(lower({typology}), 'residential')",
            "size_key": size_class(typology, floors, footprint),
            "age_key": age_bracket(year),
        },
    )
    return derive(
        df, {"template_name": "concat_ws('_', 'MA', size_key, age_key)", "window_name": "concat('Template_', age_key)"}
    )


def retrofit_name(retrofit: str, size_key: str) -> str:
    """NULL for the baseline; deep retrofits carry the size class."""
    return (
        f"CASE WHEN {retrofit} IS NULL OR lower({retrofit}) = 'baseline' THEN NULL "
        f"WHEN startswith(lower({retrofit}), 'deep') THEN concat({retrofit}, ' ', {size_key}) ELSE {retrofit} END"
    )


def retrofits_without_library(df: DataFrame, retrofit: str = "retrofit", library: str = "retrofit_lib_uri") -> DataFrame:
    bad = f"{retrofit} IS NOT NULL AND {retrofit} <> 'Baseline' AND {retrofit} <> '' AND {library} IS NULL"
    return df.selectExpr(f"count_if({bad}) AS n_without_library")


def add_areas(df: DataFrame) -> DataFrame:
    """Zoning rule, space flags, conditioned and occupied floors and areas."""
    flags = {"zoning": f"CASE WHEN long_edge > {CORE_EDGE}D AND short_edge > {CORE_EDGE}D THEN 'core/perim' ELSE 'by_storey' END"}
    for s in ("basement", "attic"):
        flags[f"has_{s}"] = f"{s} <> 'none'"
        flags[f"{s}_is_occupied"] = f"{s} IN ({sql_list(OCCUPIED)})"
        flags[f"{s}_is_conditioned"] = f"{s} IN ({sql_list(CONDITIONED)})"
    df = derive(df, flags)
    df = derive(
        df,
        {
            f"n_{k}_floors": f"num_floors + int(basement_is_{k}) + int(attic_is_{k})"
            for k in ("conditioned", "occupied")
        },
    )
    return derive(df, {f"energy_model_{k}_area": f"n_{k}_floors * long_edge * short_edge" for k in ("conditioned", "occupied")})


def feature_projection(df: DataFrame, semantic: Sequence[str], passthrough: Sequence[str] = ()) -> DataFrame:
    """The feature vector of each building.

    Columns ``shading_mask_…`` become geometry features and ``weather__…`` columns are
    features already, so whatever of them was joined is part of the vector.
    """
    yes = lambda c: f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END"
    cols = {
        "geometry__long_edge": "long_edge", "geometry__short_edge": "short_edge",
        "geometry__orientation": "long_edge_angle", "geometry__orientation__cos": "cos(long_edge_angle)",
        "geometry__orientation__sin": "sin(long_edge_angle)", "geometry__aspect_ratio": "long_edge / short_edge",
        "geometry__wwr": "wwr", "geometry__num_floors": "num_floors", "geometry__f2f_height": "f2f_height",
        "geometry__zoning": "zoning", "geometry__energy_model_conditioned_area": "energy_model_conditioned_area",
        "geometry__energy_model_occupied_area": "energy_model_occupied_area",
    }
    for s in ("basement", "attic"):
        cols[f"extra_spaces__{s}__exists"] = yes(f"has_{s}")
        cols[f"extra_spaces__{s}__occupied"] = yes(f"{s}_is_occupied")
        cols[f"extra_spaces__{s}__conditioned"] = yes(f"{s}_is_conditioned")
    cols |= {f"semantic__{f}": f"`{f}`" for f in semantic}
    cols |= {f"geometry__{c}": f"`{c}`" for c in df.columns if c.startswith("shading_mask_")}
    cols |= {c: f"`{c}`" for c in df.columns if c.startswith("weather__") and c not in passthrough}
    return df.selectExpr(*[f"`{c}`" for c in passthrough], *[f"{e} AS `{n}`" for n, e in cols.items()])


def building_specs(df: DataFrame, experiment_id: str, semantic: Sequence[str], a: Assumptions, uris: Mapping[str, str]) -> DataFrame:
    """Spec rows: field map, defaults for absent spaces, experiment identity."""
    have = set(df.columns)
    context = ", ".join(f"'{f}', string(`{f}`)" for f in semantic)
    made = {
        "experiment_id": f"'{experiment_id}'",
        **{k: f"'{v}'" for k, v in uris.items()},
        "semantic_field_context": f"map({context})",
        "f2f_height": "f2f_height" if "f2f_height" in have else f"{a.f2f_height!r}D",
        "basement": "coalesce(basement, 'none')" if "basement" in have else "'none'",
        "attic": "coalesce(attic, 'none')" if "attic" in have else "'none'",
        "exposed_basement_frac": (
            f"coalesce(exposed_basement_frac, {a.exposed_basement_frac!r}D)" if "exposed_basement_frac" in have else f"{a.exposed_basement_frac!r}D"
        ),
    }
    return derive(df, made)


# ---- zones ---------------------------------------------------------------------------


def orientation(azimuth: Column) -> Column:
    az = F.pmod(azimuth, F.lit(360.0))
    return (
        F.when((az >= 315) | (az < 45), "North").when(az < 135, "East").when(az < 225, "South").when(az < 315, "West").otherwise("Unknown")
    )


ZONE_PATTERN = r"(?i)^FLR(\d+)_([A-Z]+BLDG)_(\d+)_FLOOR\d+_ROOM(\d+)"


def normalize_zone(name: Column) -> Column:
    """``FLR2_OFFICEBLDG_3_FLOOR1_ROOM2`` -> ``Officebldg_3_Floor2_Room2``; others as they are."""
    part = lambda i: F.regexp_extract(name, ZONE_PATTERN, i)
    kind = F.concat(F.upper(F.substring(part(2), 1, 1)), F.lower(F.substring(part(2), 2, 1000)))
    made = F.concat(kind, F.lit("_"), part(3), F.lit("_Floor"), part(1), F.lit("_Room"), part(4))
    return F.when(name.rlike(ZONE_PATTERN), made).otherwise(name)


def floor_number(name: Column) -> Column:
    digits = F.regexp_extract(name, r"(?i)(?:Floor|Flr)(\d+)", 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("int"))


def zone_table(surfaces: DataFrame, building: str = "building", zone: str = "zone") -> DataFrame:
    """One row per (building, zone): mean outdoor-wall azimuth, floor, floor class.

    Zones without an outdoor wall face nowhere and are ``core``.  The building's
    lowest and highest floor come from an aggregation joined back, not from a
    window over all its zones.
    """
    wall = F.coalesce((F.lower("surface_type") == "wall") & (F.lower("boundary") == "outdoors"), F.lit(False))
    az = F.coalesce(F.col("azimuth").cast("double"), F.lit(0.0))
    z = surfaces.withColumn("zone_name", normalize_zone(F.col(zone)))
    per_zone = z.groupBy(building, "zone_name").agg(
        F.avg(F.when(wall, az)).alias("__az"), F.count_if(wall).alias("n_walls")
    ).withColumn("floor_number", floor_number(F.col("zone_name")))
    ends = per_zone.groupBy(building).agg(F.min("floor_number").alias("__lo"), F.max("floor_number").alias("__hi"))
    n = F.col("floor_number")
    return per_zone.join(ends, building).select(
        building, "zone_name",
        half_even(F.coalesce("__az", F.lit(0.0)), 1).alias("avg_azimuth"),
        F.when(F.col("n_walls") == 0, "core").otherwise(orientation(F.col("__az"))).alias("orientation"),
        "floor_number",
        F.when((F.col("__lo") == F.col("__hi")) | (n == F.col("__lo")), "ground").when(n == F.col("__hi"), "top").otherwise("middle").alias("floor_assignment"),
    )
