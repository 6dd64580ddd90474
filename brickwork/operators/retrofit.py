"""Retrofit features, net costs and paybacks on the wide ensemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.rng import Keyed
from brickwork.functions.text import derive, sql_list, sql_value
from brickwork.names import (
    COOLING_SYSTEMS, COUNTIES, GAS_HEATING, HEATING_SIZES_KW, INCOME_BRACKETS, OIL_HEATING,
    UPGRADED_SOLAR, WALL_UPGRADES, WINDOW_UPGRADES,
)
from brickwork.operators.energy import reader
from brickwork.operators.quantities import Lookup, RuleSet, add_quantities, factor_metadata

SAFETY_FACTOR = 1.2  # fixed value: heating sizing margin
SMALLEST_SAVING = 0.01  # fixed value: floor of the payback divisor


def next_size(value: str, sizes: tuple[float, ...] = HEATING_SIZES_KW) -> str:
    """Smallest available size that is large enough; larger values pass through."""
    fits = " ".join(f"WHEN {value} <= {sql_value(s)} THEN {sql_value(s)}" for s in sorted(sizes))
    return f"CASE {fits} ELSE {value} END"


def _among(column: str, values: tuple[str, ...]) -> str:
    return f"coalesce({column} IN ({sql_list(values)}), false)"


def add_cost_features(df: DataFrame, suffix: str = "", peak: str = "Peak_Heating", area_m2: str | None = None) -> DataFrame:
    """Heating capacity, county indicators, availability flags and PV size."""
    c = reader(df, suffix)
    capacity = f"({c(peak)} * 1000.0D * {SAFETY_FACTOR}D" + (f" * {area_m2})" if area_m2 else ")")
    gas = _among(c("semantic__Heating"), GAS_HEATING)
    cool = _among(c("semantic__Cooling"), COOLING_SYSTEMS)
    solar = _among(c("semantic__OnsiteSolar"), UPGRADED_SOLAR)
    made = {
        f"calculated__heating_capacity_kW{suffix}": next_size(capacity),
        f"system__has_gas__true{suffix}": gas,
        f"system__has_gas__false{suffix}": f"NOT {gas}",
        f"system__has_cooling__true{suffix}": cool,
        f"system__has_cooling__false{suffix}": f"NOT {cool}",
        f"upgrade__solar_pv_kW{suffix}": f"CASE WHEN {solar} THEN pv_kw{suffix} ELSE 0.0D END",
    }
    made |= {f"location__in_county__{k}": f"coalesce(location__county = '{k}', false)" for k in COUNTIES}
    return derive(df, made)


def rows_without_county(df: DataFrame) -> DataFrame:
    """How many rows name none of the known counties."""
    return df.selectExpr(f"count_if(NOT {_among('location__county', COUNTIES)}) AS n_without_county")


def add_incentive_features(df: DataFrame, suffix: str = "") -> DataFrame:
    """Region, fuel flags and the window-and-wall combination."""
    c = reader(df, suffix)
    windows = _among(c("semantic__Windows"), WINDOW_UPGRADES)
    walls = _among(c("semantic__Walls"), WALL_UPGRADES)
    return derive(
        df,
        {
            f"location__region{suffix}": "'MA'",
            f"fuel__electricity{suffix}": "true",
            f"fuel__natural_gas{suffix}": _among(c("semantic__Heating"), GAS_HEATING),
            f"fuel__oil{suffix}": _among(c("semantic__Heating"), OIL_HEATING),
            f"eligibility__window_wall_combo{suffix}": f"{windows} AND {walls}",
        },
    )


def bracket_indicator(df: DataFrame, bracket: str, suffix: str = "") -> Lookup:
    """Feature lookup in which only ``bracket`` is switched on."""
    c = reader(df, suffix)

    def look(name: str) -> str:
        if name.startswith("homeowner__in_bracket__"):
            return "1.0D" if name.endswith(f"__{bracket}") else "0.0D"
        return c(name)

    return look


def payback_years(cost: str, saving: str) -> str:
    """Cost over annual saving; the saving is at least one cent, below zero is never."""
    years = f"{cost} / greatest({saving}, {SMALLEST_SAVING}D)"
    return f"CASE WHEN {years} < 0 THEN double('Infinity') ELSE {years} END"


def add_retrofit_economics(
    df: DataFrame,
    costs: RuleSet,
    incentives: RuleSet,
    *,
    suffix: str = "_new",
    saving: str = "saving_usd",
    keyed: Keyed | None = None,
    brackets: tuple[str, ...] = INCOME_BRACKETS,
) -> DataFrame:
    """Costs, incentives per bracket, net costs and paybacks as columns."""
    c = reader(df, suffix)
    old: Lookup = lambda t: f"`semantic__{t}`"
    new: Lookup = lambda t: c(f"semantic__{t}")
    df = add_quantities(df, costs, old, new, indicator=c, keyed=keyed)
    for b in brackets:
        df = add_quantities(
            df, incentives, old, new, indicator=bracket_indicator(df, b, suffix),
            cost_prefix="cost_", keyed=keyed, tail=f"_{b}",
        )
    made = {"payback": payback_years("cost_Total", saving)}
    for b in brackets:
        for t in _netted(costs, incentives):
            made[f"net_cost_{t}_{b}"] = f"cost_{t} - incentive_{t}_{b}"
        made[f"net_cost_Total_{b}"] = f"greatest(cost_Total - incentive_Total_{b}, 0.0D)"
    df = derive(df, made)
    return derive(df, {f"payback_{b}": payback_years(f"net_cost_Total_{b}", saving) for b in brackets})


def _netted(costs: RuleSet, incentives: RuleSet) -> list[str]:
    return [t for t in incentives.triggers if t in costs.triggers]


def economics_columns(costs: RuleSet, incentives: RuleSet, brackets: tuple[str, ...] = INCOME_BRACKETS) -> list[str]:
    cols = [f"cost_{t}" for t in costs.triggers] + ["cost_Total", "payback"]
    for b in brackets:
        cols += [f"incentive_{t}_{b}" for t in incentives.triggers] + [f"incentive_Total_{b}"]
        cols += [f"net_cost_{t}_{b}" for t in _netted(costs, incentives)] + [f"net_cost_Total_{b}", f"payback_{b}"]
    return cols


def incentive_programs(
    df: DataFrame, incentives: RuleSet, keys: list[str], bracket: str, *, suffix: str = "_new", keyed: Keyed | None = None
) -> DataFrame:
    """Programs and mean amounts of one bracket, per group."""
    c = reader(df, suffix)
    return factor_metadata(
        df, incentives, lambda t: f"`semantic__{t}`", lambda t: c(f"semantic__{t}"), keys,
        indicator=bracket_indicator(df, bracket, suffix), cost_prefix="cost_", keyed=keyed,
    )


def changed_fields(old: Column, new: Column) -> Column:
    """Entries of the new field map that differ from the old one."""
    return F.map_filter(new, lambda k, v: ~v.eqNullSafe(F.try_element_at(old, k)))


def matched_difference(
    original: DataFrame, upgraded: DataFrame, keys: list[str], value: str = "value"
) -> DataFrame:
    """original - upgraded of two long result tables on the same draws."""
    right = upgraded.select(*keys, F.col(value).alias("__u"))
    return original.select(*keys, value).join(right, keys).select(
        *keys, (F.col(value) - F.col("__u")).alias("delta")
    )



def matched_difference_wide(original: DataFrame, upgraded: DataFrame, keys: list[str], columns: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """original - upgraded of wide tables with one row per draw, joined once for all ``columns``.

    A draw is one row on each side, whatever the number of results; stack the
    differences afterwards.  Draws without a counterpart are left out.
    """
    right = upgraded.selectExpr(*[f"`{k}`" for k in keys], *[f"`{c}` AS `__u_{c}`" for c in columns])
    both = original.select(*keys, *carry, *columns).join(right, keys)
    return both.selectExpr(*[f"`{c}`" for c in (*keys, *carry)], *[f"`{c}` - `__u_{c}` AS `{c}`" for c in columns])
