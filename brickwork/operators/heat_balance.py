"""Hourly heat balance of option grids: loads per variant and station."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.text import derive, sql_value

AIR_DENSITY, AIR_HEAT = 1.225, 1005.0  # fixed values: kg/m3, J/(kg K)
# Option levels of the study grid.
ROOF_U = {"UninsulatedRoof": 0.54, "InsulatedRoof": 0.19, "HighlyInsulatedRoof": 0.103}
WALL_U = {"SomeInsulationWalls": 0.47, "FullInsulationWallsCavity": 0.204, "FullInsulationWallsCavityExterior": 0.14}
WINDOWS = {"SinglePane": (5.894, 0.905), "DoublePaneLowE": (2.72, 0.764), "TriplePaneLowE": (1.493, 0.373)}
LEAKAGE = {"LeakyEnvelope": 0.5, "SomewhatLeakyEnvelope": 0.2, "TightEnvelope": 0.1}
DEFAULTS = {
    "length": 10.0, "width": 10.0, "num_floors": 8.0, "f2f_height": 2.8, "wwr": 0.12,
    "epd": 3.1, "lpd": 2.2, "wall_absorptance": 0.7, "roof_absorptance": 0.7,
    "wall_hext": 10.0, "roof_hext": 10.0, "heat_set": 20.0, "cool_set": 20.0, "heat_cop": 1.0, "cool_cop": 1.0,
}


def option_grid(df: DataFrame, options: Mapping[str, Sequence[str] | Column]) -> DataFrame:
    """Every combination of option labels for every row, by explosion of literals or array columns."""
    for name, labels in options.items():
        df = df.withColumn(name, F.explode(labels if isinstance(labels, Column) else F.array(*[F.lit(x) for x in labels])))
    return df


def full_grid(df: DataFrame) -> DataFrame:
    return option_grid(df, {"roof": list(ROOF_U), "wall": list(WALL_U), "window": list(WINDOWS), "leakage": list(LEAKAGE)})


def _level(column: str, table: Mapping[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in table.items()) + " END"


def building_columns(df: DataFrame) -> DataFrame:
    """Areas, conductances and coefficients of a variant row; absent inputs get defaults."""
    df = derive(df, {k: sql_value(v) for k, v in DEFAULTS.items() if k not in df.columns})
    df = derive(
        df,
        {
            "u_roof": _level("roof", ROOF_U), "u_wall": _level("wall", WALL_U),
            "u_window": _level("window", {k: v[0] for k, v in WINDOWS.items()}),
            "shgc": _level("window", {k: v[1] for k, v in WINDOWS.items()}),
            "ach": _level("leakage", LEAKAGE),
            "gfa": "length * width * num_floors",
            "side_long": "length * f2f_height * num_floors", "side_short": "width * f2f_height * num_floors",
        },
    )
    return derive(
        df,
        {
            "ua": "u_wall * 2D * (side_long + side_short) * (1D - wwr) + u_roof * length * width + u_window * 2D * (side_long + side_short) * wwr",
            "leak": f"ach * length * width * f2f_height * num_floors / 3600D * {AIR_DENSITY}D * {AIR_HEAT}D",
            "sun_window": "wwr * shgc",
            "sun_wall": "(1D - wwr) * u_wall / (wall_hext + u_wall) * wall_absorptance",
            "sun_roof": "length * width * roof_absorptance * u_roof / (roof_hext + u_roof)",
        },
    )


def hourly_gain(temp: str = "dry_bulb_c") -> str:
    """SQL of the net gain [W] of one hour; irradiances and schedules are columns."""
    dt = f"(least({temp} - heat_set, 0D) + greatest({temp} - cool_set, 0D))"
    facade = "((i_east + i_west) * side_long + (i_north + i_south) * side_short)"
    return (
        f"{facade} * (sun_window + sun_wall) + i_roof * sun_roof + (ua + leak) * {dt} "
        "+ gfa * (equip_frac * epd + light_frac * lpd)"
    )


def annual_loads(hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Heating, cooling, equipment and lighting intensity per key [kWh/m2].

    ``hourly`` holds variant columns and hourly inputs on one row.  The sum is
    partially aggregated, so each task ships one record per key.
    """
    q = derive(hourly, {"q": hourly_gain()})
    return q.groupBy(*keys).agg(
        F.expr("sum(abs(least(q, 0D)) / gfa / heat_cop) / 1000D").alias("heating_eui"),
        F.expr("sum(greatest(q, 0D) / gfa / cool_cop) / 1000D").alias("cooling_eui"),
        F.expr("sum(equip_frac * epd) / 1000D").alias("equipment_eui"),
        F.expr("sum(light_frac * lpd) / 1000D").alias("lighting_eui"),
    )


def compare_methods(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, names: tuple[str, str] = ("sim", "fp")) -> DataFrame:
    """Two methods side by side, each scaled by its own maximum."""
    parts = []
    for df, name in ((a, names[0]), (b, names[1])):
        parts.append(df.select(*keys, F.lit(name).alias("method"), F.col(value).alias("v")))
    both = parts[0].unionByName(parts[1])
    wide = both.groupBy(*keys).pivot("method", list(names)).agg(F.max("v"))
    top = wide.agg(*[F.max(n).alias(n) for n in names]).first()
    return wide.withColumns({n: F.col(n) / F.lit(top[n]) for n in names})


def r_squared(df: DataFrame, truth: str, estimate: str) -> DataFrame:
    """1 - residual sum of squares over total sum of squares."""
    return df.agg(
        (F.lit(1.0) - F.sum((F.col(truth) - F.col(estimate)) ** 2) / F.nullif(F.var_pop(truth) * F.count(truth), F.lit(0.0))).alias("r2")
    )
