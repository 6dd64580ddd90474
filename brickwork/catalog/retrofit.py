"""Costs, incentives, net costs and paybacks of the customer portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.catalog.base import Registry, sql_fixed, table
from brickwork.catalog.ensembles import N, PRIORS, _TWO, _stack_sql
from brickwork.catalog.portfolio import CHANGED, portfolio, portfolio_sql, predict
from brickwork.functions.rounding import fixed
from brickwork.functions.text import derive, fence
from brickwork.names import COUNTIES, HEATING_SIZES_KW, INCOME_BRACKETS
from brickwork.operators import quantities as rules_op
from brickwork.operators.retrofit import changed_fields, incentive_programs, rows_without_county
from brickwork.operators.summary import distribution_summary, exact_percentiles
from brickwork.plans import inference as plan
from brickwork.sources.rules import LEGACY_COSTS, factor_rows_from_wide, legacy_costs, standard_incentives
from brickwork.session import cut_lineage

REGISTRY = Registry()
COSTS, INCENTIVES = legacy_costs(), standard_incentives()

# ---- the same algebra as SQL text -------------------------------------------------
_QTY = {
    "per_facade_area": "geometry__computed__whole_bldg_facade_area*geometry__est_uniform_linear_scaling_factor",
    "per_window_area": "geometry__computed__window_area*geometry__est_uniform_linear_scaling_factor",
    "per_total_linear_facade_distance": "geometry__computed__total_linear_facade_distance*geometry__est_uniform_linear_scaling_factor",
    "per_gross_floor_area": "geometry__energy_model_conditioned_area*geometry__est_fp_ratio",
    "per_footprint_area": "geometry__computed__footprint_area*geometry__est_fp_ratio",
    "fixed_cost": "1.0::DOUBLE",
}
_CAN_CHANGE = set(CHANGED)
_TRIGGERS = sorted({r[0] for r in LEGACY_COSTS})


def _economics_chain():
    ch = _TWO
    cost = {}
    for t in _TRIGGERS:
        terms = []
        for trig, initial, final, rates in LEGACY_COSTS:
            if trig != t or t not in _CAN_CHANGE:
                continue
            amount = "+".join(f"{v!r}::DOUBLE*{_QTY[c]}" for c, v in rates.items())
            init = f" AND semantic__{t}='{initial}'" if initial else ""
            terms.append(
                f"CASE WHEN semantic__{t}_new='{final}' AND semantic__{t} IS DISTINCT FROM semantic__{t}_new{init} THEN {amount} ELSE 0.0::DOUBLE END"
            )
        cost[f"cost_{t}"] = "+".join(terms) or "0.0::DOUBLE"
    ch.add(cost)
    ch.add({"cost_Total": "+".join(f"cost_{t}" for t in _TRIGGERS), "saving_usd": "(Total_FuelCost - Total_FuelCost_new)*area_m2"})
    rebate = {
        ("Heating", "ASHPHeating"): (10000, 15000, 2000), ("Heating", "GSHPHeating"): (15000, 25000, 2000),
        ("DHW", "HPWH"): (750, 1200, None), ("Thermostat", "Controls"): (100, 200, None),
        ("Windows", "DoublePaneLowE"): (0, 0, 600), ("Windows", "TriplePaneLowE"): (0, 0, 600),
    }
    for bi, b in enumerate(("AllCustomers", "IncomeEligible")):
        inc = {}
        for t in ("DHW", "Heating", "Thermostat", "Windows"):
            terms = []
            for (trig, final), (everyone, eligible, cap) in rebate.items():
                if trig != t or t not in _CAN_CHANGE:
                    continue
                amount = f"{float((everyone, eligible)[bi])!r}::DOUBLE"
                if cap:
                    amount += f" + least(cost_{t}*0.3::DOUBLE, {float(cap)!r}::DOUBLE)"
                init = " AND semantic__DHW='ElectricResistanceDHW'" if t == "DHW" else ""
                terms.append(
                    f"least(CASE WHEN semantic__{t}_new='{final}' AND semantic__{t} IS DISTINCT FROM semantic__{t}_new{init} THEN {amount} ELSE 0.0::DOUBLE END, cost_{t})"
                )
            inc[f"incentive_{t}_{b}"] = "+".join(terms) or "0.0::DOUBLE"
        ch.add(inc)
        ch.add({f"incentive_Total_{b}": "+".join(f"incentive_{t}_{b}" for t in ("DHW", "Heating", "Thermostat", "Windows"))})
    net = {}
    for b in INCOME_BRACKETS:
        for t in ("DHW", "Heating", "Thermostat", "Windows"):
            net[f"net_cost_{t}_{b}"] = f"cost_{t} - incentive_{t}_{b}"
        net[f"net_cost_Total_{b}"] = f"greatest(cost_Total - incentive_Total_{b}, 0.0::DOUBLE)"
    ch.add(net)
    pay = {"payback": "cost_Total/greatest(saving_usd, 0.01::DOUBLE)"}
    pay |= {f"payback_{b}": f"net_cost_Total_{b}/greatest(saving_usd, 0.01::DOUBLE)" for b in INCOME_BRACKETS}
    return ch.add(pay)


_CH = _economics_chain()
_MAIN = [
    "cost_Total", "payback",
    *[f"{q}_Total_{b}" for q in ("incentive", "net_cost") for b in INCOME_BRACKETS],
    *[f"payback_{b}" for b in INCOME_BRACKETS],
]
_Q = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
_STATS_SQL = {
    "mean": "avg(v)", "std": "stddev_samp(v)", "min": "min(v)", "max": "max(v)",
    **{k: f"quantile_cont(v, {p})" for k, p in _Q.items()},
}


def _savings(spark, sf_dir):
    return plan.infer_savings(portfolio(spark, sf_dir), N, predict, COSTS, INCENTIVES, PRIORS)


def _stacked(df, keys, cols):
    items = ", ".join(f"struct('{c}' AS quantity, double(`{c}`) AS v)" for c in cols)
    return df.selectExpr(*keys, f"inline(array({items}))")


@REGISTRY.add(
    _CH.then(
        "SELECT c_mktsegment, quantity, " + ", ".join(f"{sql_fixed(e, 2)} AS {k}" for k, e in _STATS_SQL.items())
        + " FROM (SELECT c_mktsegment, r.name AS quantity, r.v FROM (SELECT c_mktsegment, " + _stack_sql(_MAIN) + " AS r FROM {last})) GROUP BY ALL"
    )
)
def retrofit_net_cost_summary(spark, sf_dir):
    """Cost, incentive, net cost and payback percentiles per market segment.

    Five segments hold everything, so the exact any-size percentiles are used.
    """
    long = cut_lineage(_stacked(_savings(spark, sf_dir), ["c_mktsegment"], _MAIN))
    s = distribution_summary(long, ["c_mktsegment", "quantity"], "v")
    return s.select("c_mktsegment", "quantity", *[fixed(F.col(c), 2).alias(c) for c in _STATS_SQL])


_PER_DRAW = [f"cost_{t}" for t in ("DHW", "Heating", "Windows", "Walls")] + [
    f"{q}_{t}_{b}" for q in ("incentive", "net_cost") for t in ("DHW", "Heating", "Windows", "Total") for b in INCOME_BRACKETS
] + ["cost_Total", "payback", *[f"payback_{b}" for b in INCOME_BRACKETS]]


@REGISTRY.add(
    _CH.then(
        "SELECT building_id, sample_id::BIGINT AS sample_id, " + ", ".join(f"{sql_fixed(c, 3)} AS {c}" for c in _PER_DRAW) + " FROM {last}"
    )
)
def retrofit_economics_per_draw(spark, sf_dir):
    return _savings(spark, sf_dir).select(
        "building_id", F.col("sample_id").cast("bigint").alias("sample_id"), *[fixed(F.col(c), 3).alias(c) for c in _PER_DRAW]
    )


@REGISTRY.add(
    _CH.then(
        "SELECT building_id, quantity, CASE WHEN starts_with(quantity, 'payback') THEN 'years' ELSE 'USD' END AS units, "
        + ", ".join(f"{sql_fixed(e, 2)} AS {k}" for k, e in _STATS_SQL.items())
        + " FROM (SELECT building_id, r.name AS quantity, r.v FROM (SELECT building_id, "
        + _stack_sql(
            [f"cost_{t}" for t in _TRIGGERS] + ["cost_Total", "payback"]
            + [f"{q}_{t}_{b}" for b in INCOME_BRACKETS for q in ("incentive", "net_cost") for t in ("DHW", "Heating", "Thermostat", "Windows", "Total")]
            + [f"payback_{b}" for b in INCOME_BRACKETS]
        )
        + " AS r FROM {last})) GROUP BY ALL"
    )
)
def retrofit_views_per_building(spark, sf_dir):
    """Every cost, incentive, net cost and payback column summarized per building."""
    s = plan.summarize_economics(_savings(spark, sf_dir), N, COSTS, INCENTIVES)
    return s.select("building_id", "quantity", "units", *[fixed(F.col(c), 2).alias(c) for c in _STATS_SQL])


@REGISTRY.add(
    _CH.then(
        "SELECT " + ", ".join(f"{sql_fixed(f'quantile_cont(payback, {p})', 3)} AS {n}" for n, p in (("p10", 0.1), ("p90", 0.9)))
        + " FROM {last} WHERE saving_usd > 0 AND cost_Total > 0"
    )
)
def payback_cutoffs(spark, sf_dir):
    df = fence(_savings(spark, sf_dir), ["payback", "saving_usd", "cost_Total"]).filter("saving_usd > 0 AND cost_Total > 0")
    df = cut_lineage(df.select("payback"))  # three passes read the result, not the ensemble
    got = exact_percentiles(df, [], "payback", {"p10": 0.1, "p90": 0.9})
    return got.select(*[fixed(F.col(c), 3).alias(c) for c in ("p10", "p90")])


def _programs_sql() -> str:
    rows = [
        ("Heating", "ASHPHeating", "MassSave ASHP rebate for income eligible customers", "MassSave", "15000.0::DOUBLE", "LinearQuantity", ""),
        ("Heating", "ASHPHeating", "IRA 30% tax credit for ASHP, capped at $2000", "IRA", "least(cost_Heating*0.3::DOUBLE, 2000.0::DOUBLE)", "PercentQuantity", ""),
        ("Heating", "GSHPHeating", "MassSave GSHP rebate for income eligible customers", "MassSave", "25000.0::DOUBLE", "LinearQuantity", ""),
        ("Heating", "GSHPHeating", "IRA 30% tax credit for GSHP, capped at $2000", "IRA", "least(cost_Heating*0.3::DOUBLE, 2000.0::DOUBLE)", "PercentQuantity", ""),
        ("DHW", "HPWH", "MassSave HPWH rebate for income eligible customers", "MassSave", "1200.0::DOUBLE", "LinearQuantity", " AND semantic__DHW='ElectricResistanceDHW'"),
        ("Windows", "TriplePaneLowE", "IRA 30% tax credit for energy efficient windows, capped at $600", "IRA", "least(cost_Windows*0.3::DOUBLE, 600.0::DOUBLE)", "PercentQuantity", ""),
    ]
    parts = [
        f"SELECT building_id, '{t}' AS trigger, '{f}' AS final, '{d}' AS program_name, '{s}' AS source, {sql_fixed(f'avg({a})', 3)} AS amount_applied, '{k}' AS factor_type "
        f"FROM {{last}} WHERE semantic__{t}_new='{f}' AND semantic__{t} IS DISTINCT FROM semantic__{t}_new{x} GROUP BY building_id"
        for t, f, d, s, a, k, x in rows
    ]
    return " UNION ALL ".join(parts)


@REGISTRY.add(_CH.then(_programs_sql()))
def incentive_program_metadata(spark, sf_dir):
    """Programs applied per building for income-eligible owners."""
    got = incentive_programs(_savings(spark, sf_dir), INCENTIVES, ["building_id"], "IncomeEligible")
    return got.selectExpr("building_id", "inline(items)").withColumn("amount_applied", fixed(F.col("amount_applied"), 3))


_RESPONSE_SQL = (
    "SELECT q.*, 'years' AS payback_units, count(p.program_name) FILTER (WHERE p.amount_applied <> 0) AS n_programs, "
    f"{sql_fixed('coalesce(sum(p.amount_applied), 0)', 1)} AS amounts FROM (SELECT building_id, {sql_fixed('avg(cost_Total)', 2)} AS mean_cost, "
    f"{sql_fixed('quantile_cont(net_cost_Total_IncomeEligible, 0.5)', 2)} AS median_net_cost, {sql_fixed('max(incentive_Total_AllCustomers)', 2)} AS most_incentive "
    f"FROM {{last}} GROUP BY building_id) q LEFT JOIN ({_programs_sql()}) p USING (building_id) GROUP BY ALL"
)


@REGISTRY.add(_CH.then(_RESPONSE_SQL))
def retrofit_response_fields(spark, sf_dir):
    """Fields read back from every building's retrofit answer."""
    got = plan.respond_retrofit(_savings(spark, sf_dir), N, COSTS, INCENTIVES)
    at = lambda path: F.get_json_object("response", path)
    items = F.from_json(at("$.metadata.IncomeEligible.items"), "array<struct<amount_applied: double>>")
    amounts = F.aggregate(items, F.lit(0.0), lambda a, x: a + fixed(x["amount_applied"], 3))
    return got.select(
        "building_id", fixed(at("$.quantities.cost_Total.mean").cast("double"), 2).alias("mean_cost"),
        fixed(at("$.quantities.net_cost_Total_IncomeEligible.p50").cast("double"), 2).alias("median_net_cost"),
        fixed(at("$.quantities.incentive_Total_AllCustomers.max").cast("double"), 2).alias("most_incentive"),
        at("$.quantities.payback.units").alias("payback_units"), F.size(items).cast("bigint").alias("n_programs"), fixed(amounts, 1).alias("amounts"),
    )


def _size_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {s!r}::DOUBLE THEN {s!r}::DOUBLE" for s in HEATING_SIZES_KW) + f" ELSE {x} END"


_FLAGS = ["system__has_gas__true", "system__has_cooling__false", "fuel__natural_gas", "fuel__oil", "eligibility__window_wall_combo"]


@REGISTRY.add(
    _CH.then(
        "SELECT building_id, sample_id::BIGINT AS sample_id, "
        + sql_fixed(_size_sql("(Peak_Heating_new*1000.0::DOUBLE*1.2::DOUBLE)"), 4) + " AS heating_capacity_kw, "
        "coalesce(semantic__Heating_new IN ('NaturalGasHeating','NaturalGasCondensingHeating'), FALSE) AS system__has_gas__true, "
        "NOT coalesce(semantic__Cooling IN ('ACWindow','ACCentral','WindowASHP','ASHPCooling','GSHPCooling'), FALSE) AS system__has_cooling__false, "
        "coalesce(semantic__Heating_new IN ('NaturalGasHeating','NaturalGasCondensingHeating'), FALSE) AS fuel__natural_gas, "
        "coalesce(semantic__Heating_new = 'OilHeating', FALSE) AS fuel__oil, "
        "coalesce(semantic__Windows_new IN ('DoublePaneLowE','TriplePaneLowE'), FALSE) AND coalesce(semantic__Walls IN ('FullInsulationWallsCavity','FullInsulationWallsCavityExterior'), FALSE) AS eligibility__window_wall_combo, "
        + sql_fixed("CASE WHEN semantic__OnsiteSolar_new IN ('LowSolarPV','MedSolarPV','MaxSolarPV') THEN pv_kw_new ELSE 0.0::DOUBLE END", 4) + " AS solar_pv_kw, "
        + ", ".join(f"coalesce(location__county='{k}', FALSE) AS in_{k}" for k in COUNTIES) + " FROM {last}"
    )
)
def retrofit_rule_features(spark, sf_dir):
    """Heating capacity, county one-hot, availability flags, PV size, incentive flags."""
    df = _savings(spark, sf_dir)
    return df.select(
        "building_id", F.col("sample_id").cast("bigint").alias("sample_id"),
        fixed(F.col("calculated__heating_capacity_kW_new"), 4).alias("heating_capacity_kw"),
        *[F.col(f"{c}_new").alias(c) for c in _FLAGS],
        fixed(F.col("upgrade__solar_pv_kW_new"), 4).alias("solar_pv_kw"),
        *[F.col(f"location__in_county__{k}").alias(f"in_{k}") for k in COUNTIES],
    )


@REGISTRY.add(f"SELECT count(*) FILTER (WHERE location__county NOT IN ({', '.join(repr(c) for c in COUNTIES)})) AS n_without_county FROM ({portfolio_sql()})")
def rows_outside_known_counties(spark, sf_dir):
    return rows_without_county(portfolio(spark, sf_dir))


def _matches_sql() -> str:
    parts = []
    for t in ("DHW", "Heating", "Windows"):
        hits = "+".join(
            f"CASE WHEN semantic__{t}_new='{final}'" + (f" AND semantic__{t}='{initial}'" if initial else "") + " THEN 1 ELSE 0 END"
            for trig, initial, final, _ in LEGACY_COSTS if trig == t
        )
        parts.append(
            f"SELECT building_id, '{t}' AS trigger, CAST({hits} AS BIGINT) AS n_matches FROM p WHERE semantic__{t} IS DISTINCT FROM semantic__{t}_new AND ({hits}) <> 1"
        )
    return f"WITH p AS ({portfolio_sql()}) " + " UNION ALL ".join(parts)


@REGISTRY.add(_matches_sql())
def rule_match_report(spark, sf_dir):
    """Changed fields without a cost rule, or with several."""
    p = portfolio(spark, sf_dir)
    p = derive(p, {f"semantic__{t}_new": f"semantic__{t}" for t in COSTS.triggers if f"semantic__{t}_new" not in p.columns})
    got = rules_op.match_report(p, COSTS, lambda t: f"`semantic__{t}`", lambda t: f"`semantic__{t}_new`", ["building_id"])
    return got.withColumn("n_matches", F.col("n_matches").cast("bigint"))


_RULE_ROWS = [(i, t, a, b) for i, (t, a, b, _) in enumerate(LEGACY_COSTS)]


@REGISTRY.add(
    f"WITH p AS ({portfolio_sql()}), rules(rule_ix, trigger, initial, final) AS (VALUES "
    + ", ".join(f"({i}::BIGINT, '{t}', {repr(a) if a else 'NULL'}, '{b}')" for i, t, a, b in _RULE_ROWS)
    + "), ch AS ("
    + " UNION ALL ".join(f"SELECT building_id, '{t}' AS trigger, semantic__{t} AS old_value, semantic__{t}_new AS new_value FROM p" for t in CHANGED)
    + ") SELECT building_id, ch.trigger, old_value, new_value, rule_ix, initial FROM ch LEFT JOIN rules r ON ch.trigger=r.trigger AND ch.new_value=r.final AND (r.initial IS NULL OR r.initial=ch.old_value) WHERE old_value IS DISTINCT FROM new_value"
)
def rule_lookup_join(spark, sf_dir):
    """Rule lookup as a join: field and final equal, initial NULL or equal."""
    p = portfolio(spark, sf_dir)
    items = ", ".join(f"struct('{t}' AS trigger, semantic__{t} AS old_value, semantic__{t}_new AS new_value)" for t in CHANGED)
    rules = spark.createDataFrame(_RULE_ROWS, "rule_ix BIGINT, trigger STRING, initial STRING, final STRING")
    return rules_op.match_rules(p.selectExpr("building_id", f"inline(array({items}))"), rules)


@REGISTRY.add(
    f"WITH p AS ({portfolio_sql()}) SELECT building_id, trigger, new_value FROM ("
    + " UNION ALL ".join(f"SELECT building_id, '{t}' AS trigger, semantic__{t} AS old_value, semantic__{t}_new AS new_value FROM p" for t in CHANGED)
    + ") WHERE old_value IS DISTINCT FROM new_value"
)
def changed_context_fields(spark, sf_dir):
    """Difference of two semantic field maps."""
    p = portfolio(spark, sf_dir)
    old = F.create_map(*[x for t in CHANGED for x in (F.lit(t), F.col(f"semantic__{t}"))])
    new = F.create_map(*[x for t in CHANGED for x in (F.lit(t), F.col(f"semantic__{t}_new"))])
    return p.select("building_id", F.explode(changed_fields(old, new)).alias("trigger", "new_value"))


_RATES = {
    "per_facade_area": "CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_retailprice / 100 END",
    "per_footprint_area": "CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_retailprice / 50 END",
    "per_window_area": "CASE WHEN p_size % 5 = 0 THEN p_retailprice ELSE 0 END",
    "fixed_cost": "CASE WHEN p_size % 7 = 0 THEN p_size * 100 ELSE 0 END",
}
_FACTOR_SQL = " UNION ALL ".join(
    f"SELECT p_partkey, p_type, '{'FixedQuantity' if c == 'fixed_cost' else 'LinearQuantity'}' AS type, "
    + ("NULL::DOUBLE" if c == "fixed_cost" else "(round_even(r*100.0::DOUBLE, 0)/100.0::DOUBLE)") + " AS coefficient, "
    + ("CAST(r AS DOUBLE)" if c == "fixed_cost" else "NULL::DOUBLE") + " AS amount, "
    + ("NULL" if c == "fixed_cost" else f"'{_QTY[c].replace('*', '+')}'") + " AS indicator_cols, "
    + ("NULL" if c == "fixed_cost" else "'$/m2'") + " AS units, "
    + ("NULL" if c == "fixed_cost" else f"'{c[4:].replace('_', ' ')}'") + " AS per, 0.033::DOUBLE AS error_scale "
    + f"FROM (SELECT *, CAST({e} AS DOUBLE) AS r FROM part) WHERE r <> 0"
    for c, e in _RATES.items()
)


@REGISTRY.add(f"SELECT p_partkey, p_type, type, {sql_fixed('coefficient', 2)} AS coefficient, amount, indicator_cols, units, per, error_scale FROM ({_FACTOR_SQL})")
def wide_costs_to_factors(spark, sf_dir):
    """A wide rate table turned into factor rows, zero rates dropped."""
    wide = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_type", *[f"double({e}) AS {c}" for c, e in _RATES.items()])
    got = factor_rows_from_wide(wide, ["p_partkey", "p_type"])
    return got.withColumn("indicator_cols", F.array_join("indicator_cols", "+")).withColumn("coefficient", fixed(F.col("coefficient"), 2))
