"""Loads to end uses, fuels, photovoltaic offsets, costs and emissions.

Works on the wide ensemble (one row per draw).  Each step is one projection;
nothing is joined, exploded or shuffled.  A scenario is a column suffix: a
feature that a scenario overrides is read from ``<feature><suffix>``, all others
from the shared column, so both scenarios of a study live on the same row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from brickwork.functions.text import derive, sql_list, sql_sum
from brickwork.names import FUELS, RAW_END_USES, SEGMENTS, UPGRADED_SOLAR

MAX_LOCAL_PV_KW = 25.0  # fixed value: largest system considered
SYSTEM_OF = {"Heating": "heat", "Cooling": "cool", "DomesticHotWater": "dhw"}
BURNED = ("Electricity", "NaturalGas", "Oil")
NET_FUELS = ("NetElectricity", "NaturalGas", "Oil")


def reader(df: DataFrame, suffix: str) -> Callable[[str], str]:
    """Quoted name of a feature as the scenario sees it."""
    have = set(df.columns)
    return lambda name: f"`{name + suffix}`" if name + suffix in have else f"`{name}`"


def cooling_for_prediction(df: DataFrame, suffix: str = "") -> DataFrame:
    """Buildings without cooling are predicted as if they had central cooling."""
    c = reader(df, suffix)("semantic__Cooling")
    return derive(df, {"predict__Cooling": f"CASE WHEN {c} = 'none' THEN 'ACCentral' ELSE {c} END"})


def feasible_coverage(roof: str, utilization: str, density: str, yield_: str, demand: str) -> str:
    """Largest share of the demand that the roof can generate, within [0, 1]."""
    capacity = f"least({roof} * {utilization} * {density} / 1000.0D, {MAX_LOCAL_PV_KW}D)"
    return f"greatest(0.0D, least(1.0D, {capacity} * {yield_} / greatest({demand}, 1.0D)))"


def target_coverage(onsite: str, planned: str, feasible: str) -> str:
    """The planned share, replaced by the feasible one for the maximal choice."""
    return f"CASE WHEN {onsite} = 'MaxSolarPV' THEN {feasible} ELSE {planned} END"


def system_size_kw(demand: str, target: str, feasible: str, yield_: str) -> str:
    return f"{demand} * least({target}, {feasible}) / {yield_}"


def apply_cops(df: DataFrame, suffix: str = "") -> DataFrame:
    """End-use energy: delivered load over the effective efficiency."""
    c = reader(df, suffix)
    out = {}
    for use in RAW_END_USES:
        cop = f" / {c(f'factors__system__{SYSTEM_OF[use]}__effective_cop')}" if use in SYSTEM_OF else ""
        out[f"EndUse_{use}{suffix}"] = c(f"Raw_{use}") + cop
    return derive(df, out)


def split_by_fuel(df: DataFrame, suffix: str = "") -> DataFrame:
    """Per end use and fuel: ``use_<fuel>_<end use>``; appliances are electric."""
    c = reader(df, suffix)
    out = {}
    for use in RAW_END_USES:
        for fuel in BURNED:
            amount = f"EndUse_{use}{suffix}"
            if use in SYSTEM_OF:
                kind = c(f"factors__system__{SYSTEM_OF[use]}__fuel")
                amount = f"CASE WHEN {kind} = '{fuel}' THEN {amount} ELSE 0.0D END"
            elif fuel != "Electricity":
                amount = f"{amount} * 0.0D"
            out[f"use_{fuel}_{use}{suffix}"] = amount
    df = derive(df, out)
    return derive(
        df, {f"Fuel_{f}{suffix}": sql_sum([f"use_{f}_{u}{suffix}" for u in RAW_END_USES]) for f in BURNED}
    )


def unknown_fuel_count(df: DataFrame, suffix: str = "") -> DataFrame:
    """Rows whose system fuel is none of the three burned fuels, per system."""
    c = reader(df, suffix)
    return df.selectExpr(
        *[
            f"count_if(NOT coalesce({c(f'factors__system__{s}__fuel')} IN ({sql_list(BURNED)}), false)) AS n_unknown_{s}"
            for s in SYSTEM_OF.values()
        ]
    )


def offset_with_solar(df: DataFrame, suffix: str = "", area: str = "area_m2", current_kw: str = "current_solar_kw") -> DataFrame:
    """Net electricity: an existing system offsets intensity, a new one gross use."""
    c = reader(df, suffix)
    onsite, yield_ = c("semantic__OnsiteSolar"), c("solar__yield_kWh_per_kW_year")
    planned, elec, demand = c("solar__upgraded_coverage"), f"Fuel_Electricity{suffix}", f"demand_kwh{suffix}"
    feasible, size, share = f"feasible_cov{suffix}", f"pv_kw{suffix}", f"net_share{suffix}"
    upgraded = f"{onsite} IN ({sql_list(UPGRADED_SOLAR)})"
    df = derive(df, {demand: f"{elec} * {area}"})
    df = derive(
        df,
        {
            feasible: feasible_coverage(
                c("geometry__computed__roof_surface_area"), c("solar__max_roof_utilization"),
                c("solar__panel_power_density_w_per_m2"), yield_, demand,
            )
        },
    )
    target = target_coverage(onsite, planned, feasible)
    df = derive(
        df, {size: f"CASE WHEN {upgraded} THEN {system_size_kw(demand, target, feasible, yield_)} ELSE 0.0D END"}
    )
    df = derive(
        df,
        {
            f"pv_offset{suffix}": (
                f"CASE WHEN {onsite} = 'ExistingSolarPV' AND {current_kw} > 0 "
                f"THEN least({current_kw} * {yield_} / {area}, {elec}) "
                f"WHEN {upgraded} THEN least({size} * {yield_}, {demand}) ELSE 0.0D END"
            ),
            f"pv_base{suffix}": f"CASE WHEN {onsite} = 'ExistingSolarPV' THEN {elec} ELSE {demand} END",
        },
    )
    df = derive(
        df,
        {
            share: (
                f"CASE WHEN {onsite} <> 'NoSolarPV' AND pv_offset{suffix} > 0 AND pv_base{suffix} > 0 "
                f"THEN 1.0D - pv_offset{suffix} / pv_base{suffix} ELSE 1.0D END"
            )
        },
    ).drop(f"pv_offset{suffix}", f"pv_base{suffix}")
    df = derive(
        df, {f"use_NetElectricity_{u}{suffix}": f"use_Electricity_{u}{suffix} * {share}" for u in RAW_END_USES}
    )
    net = f"Fuel_NetElectricity{suffix}"
    df = derive(df, {net: sql_sum([f"use_NetElectricity_{u}{suffix}" for u in RAW_END_USES])})
    return derive(df, {f"EndUse_Solar{suffix}": f"{net} - {elec}"})


def price_fuels(df: DataFrame, suffix: str = "") -> DataFrame:
    """Costs and emissions per fuel and per end use, solar as a (negative) use."""
    c = reader(df, suffix)
    out = {}
    for dataset, table in (("Cost", "price"), ("Emissions", "emissions")):
        rate = {f: c(f"fuels__{table}__{f}") for f in BURNED}
        rate["NetElectricity"] = rate["Electricity"]
        for fuel in FUELS:
            out[f"Fuel{dataset}_{fuel}{suffix}"] = f"Fuel_{fuel}{suffix} * {rate[fuel]}"
        for use in RAW_END_USES:
            out[f"EndUse{dataset}_{use}{suffix}"] = sql_sum([f"use_{f}_{use}{suffix} * {rate[f]}" for f in BURNED])
        out[f"EndUse{dataset}_Solar{suffix}"] = f"EndUse_Solar{suffix} * {rate['Electricity']}"
    return derive(df, out)


def dataset_totals(df: DataFrame, suffix: str = "") -> DataFrame:
    """``Total_<dataset>``; fuel cost and emissions count net electricity once.

    The plain fuel total adds gross and net electricity, as published results
    do; ``fuel_net_total`` is the single-count alternative.
    """
    out = {}
    for dataset, segments in SEGMENTS.items():
        used = NET_FUELS if dataset in ("FuelCost", "FuelEmissions") else segments
        out[f"Total_{dataset}{suffix}"] = sql_sum([f"{dataset}_{s}{suffix}" for s in used])
    out[f"fuel_net_total{suffix}"] = sql_sum([f"Fuel_{f}{suffix}" for f in NET_FUELS])
    return derive(df, out)


def result_columns() -> list[str]:
    """Every normalized result column, segments first, then totals."""
    segs = [f"{d}_{s}" for d, ss in SEGMENTS.items() for s in ss]
    return segs + [f"Total_{d}" for d in SEGMENTS]


def add_results(df: DataFrame, suffix: str = "") -> DataFrame:
    """The full set of normalized results of one scenario from its raw loads."""
    absent = [u for u in RAW_END_USES if f"Raw_{u}{suffix}" not in df.columns]
    if absent:
        df = derive(df, {f"Raw_{u}{suffix}": f"Raw_{u}" for u in absent})
    df = apply_cops(df, suffix)
    df = split_by_fuel(df, suffix)
    df = offset_with_solar(df, suffix)
    df = price_fuels(df, suffix)
    return dataset_totals(df, suffix)


def long_results(df: DataFrame, keys: list[str], suffix: str = "", area: str = "area_m2") -> DataFrame:
    """(keys, normalization, dataset, segment, value), normalized and gross."""
    items = [
        f"struct('{label}' AS normalization, '{d}' AS dataset, '{s}' AS segment, `{d}_{s}{suffix}`{scale} AS value)"
        for d, segments in SEGMENTS.items()
        for s in segments
        for label, scale in (("Normalized", ""), ("Gross", f" * {area}"))
    ]
    return df.selectExpr(*keys, f"inline(array({', '.join(items)}))")


def sum_over(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Totals of a long result table over the levels not in ``keys``."""
    return df.groupBy(*keys).agg({value: "sum"}).withColumnRenamed(f"sum({value})", value)
