"""Monte-Carlo ensembles over the customer portfolio."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brickwork.catalog.base import Chain, Registry, sql_draw, sql_fixed, sql_words
from brickwork.catalog.portfolio import CHANGED, SUPPLIERS_SQL, portfolio, portfolio_sql, predict, predict_sql, suppliers_as_customers
from brickwork.functions.rounding import fixed
from brickwork.names import FUELS, RAW_END_USES, SEGMENTS, UPGRADED_SOLAR
from brickwork.operators.energy import long_results, result_columns, sum_over, unknown_fuel_count
from brickwork.operators.priors import default_priors
from brickwork.operators.retrofit import matched_difference_wide
from brickwork.plans import inference as plan
from brickwork.session import checkpoint_root, partitions_for
from brickwork.sources.publish import publish, publish_bucketed
from brickwork.sources.rules import legacy_costs, standard_incentives

REGISTRY = Registry()
N = 4
MANY = 500
PRIORS = default_priors()
BURNED = ("Electricity", "NaturalGas", "Oil")
SYSTEMS = {"Heating": "heat", "Cooling": "cool", "DomesticHotWater": "dhw"}


def ensemble_chain(n: int = N, upgrade: bool = False, customers: str = "customer") -> Chain:
    ch = Chain(portfolio_sql(customers))
    ch.steps.append(f"SELECT *, unnest(range({n})) AS sample_id FROM s0")
    ch.steps.append(f"SELECT *, {sql_words(42, ['building_id', 'sample_id'], 'rk')} FROM s1")
    for layer in PRIORS.layers():
        ch.add({f: sql_draw(PRIORS.draws[f], f) for f in layer})
    if upgrade:
        fields = [f"semantic__{f}" for f in CHANGED]
        reach = {f: set(PRIORS.downstream([f]).draws) for f in fields}
        done: set[str] = set(f"{f}_new" for f in fields)
        for layer in PRIORS.downstream(fields).layers():
            made = {}
            for feat in layer:
                changed = " OR ".join(f"{f} IS DISTINCT FROM {f}_new" for f in fields if feat in reach[f])
                alt = lambda x: x + "_new" if x + "_new" in done else x
                made[f"{feat}_new"] = f"CASE WHEN {changed} THEN {sql_draw(PRIORS.draws[feat], feat, 'upgraded/', alt)} ELSE {feat} END"
            ch.add(made)
            done |= set(made)
        ch.changed = done
    return ch


def results_chain(ch: Chain, suffix: str = "", done: frozenset = frozenset()) -> Chain:
    s = suffix
    c = lambda x: x + s if x + s in done else x
    ch.steps.append(f"SELECT *, {predict_sql(s)} FROM s{len(ch.steps) - 1}")
    ch.add(
        {
            f"EndUse_{u}{s}": f"Raw_{u}{s}" + (f"/{c('factors__system__' + SYSTEMS[u] + '__effective_cop')}" if u in SYSTEMS else "")
            for u in RAW_END_USES
        }
    )
    use = {}
    for u in RAW_END_USES:
        for f in BURNED:
            if u in SYSTEMS:
                use[f"use_{f}_{u}{s}"] = f"CASE WHEN {c('factors__system__' + SYSTEMS[u] + '__fuel')} = '{f}' THEN EndUse_{u}{s} ELSE 0.0::DOUBLE END"
            else:
                use[f"use_{f}_{u}{s}"] = f"EndUse_{u}{s}" if f == "Electricity" else "0.0::DOUBLE"
    ch.add(use)
    ch.add({f"Fuel_{f}{s}": "+".join(f"use_{f}_{u}{s}" for u in RAW_END_USES) for f in BURNED})
    onsite, y = c("semantic__OnsiteSolar"), c("solar__yield_kWh_per_kW_year")
    elec, dem = f"Fuel_Electricity{s}", f"demand_kwh{s}"
    up = ", ".join(f"'{x}'" for x in UPGRADED_SOLAR)
    ch.add({dem: f"{elec}*area_m2"})
    ch.add(
        {
            f"feas{s}": "greatest(0.0::DOUBLE, least(1.0::DOUBLE, least("
            f"{c('geometry__computed__roof_surface_area')}*{c('solar__max_roof_utilization')}*{c('solar__panel_power_density_w_per_m2')}/1000.0::DOUBLE, 25.0::DOUBLE)"
            f"*{y}/greatest({dem}, 1.0::DOUBLE)))"
        }
    )
    ch.add(
        {
            f"pv_kw{s}": f"CASE WHEN {onsite} IN ({up}) THEN {dem}*least(CASE WHEN {onsite}='MaxSolarPV' THEN feas{s} ELSE {c('solar__upgraded_coverage')} END, feas{s})/{y} ELSE 0.0::DOUBLE END"
        }
    )
    ch.add(
        {
            f"offs{s}": f"CASE WHEN {onsite}='ExistingSolarPV' AND current_solar_kw>0 THEN least(current_solar_kw*{y}/area_m2, {elec}) WHEN {onsite} IN ({up}) THEN least(pv_kw{s}*{y}, {dem}) ELSE 0.0::DOUBLE END",
            f"bas{s}": f"CASE WHEN {onsite}='ExistingSolarPV' THEN {elec} ELSE {dem} END",
        }
    )
    ch.add({f"keep{s}": f"CASE WHEN {onsite}<>'NoSolarPV' AND offs{s}>0 AND bas{s}>0 THEN 1.0::DOUBLE-offs{s}/bas{s} ELSE 1.0::DOUBLE END"})
    ch.add({f"use_NetElectricity_{u}{s}": f"use_Electricity_{u}{s}*keep{s}" for u in RAW_END_USES})
    ch.add({f"Fuel_NetElectricity{s}": "+".join(f"use_NetElectricity_{u}{s}" for u in RAW_END_USES)})
    ch.add({f"EndUse_Solar{s}": f"Fuel_NetElectricity{s}-{elec}"})
    priced = {}
    for label, tab in (("Cost", "price"), ("Emissions", "emissions")):
        rate = lambda f: c(f"fuels__{tab}__{'Electricity' if f == 'NetElectricity' else f}")  # noqa: E731, B023
        for f in FUELS:
            priced[f"Fuel{label}_{f}{s}"] = f"Fuel_{f}{s}*{rate(f)}"
        for u in RAW_END_USES:
            priced[f"EndUse{label}_{u}{s}"] = "+".join(f"use_{f}_{u}{s}*{rate(f)}" for f in BURNED)
        priced[f"EndUse{label}_Solar{s}"] = f"EndUse_Solar{s}*{rate('Electricity')}"
    ch.add(priced)
    totals = {}
    for d, segs in SEGMENTS.items():
        used = ("NetElectricity", "NaturalGas", "Oil") if d in ("FuelCost", "FuelEmissions") else segs
        totals[f"Total_{d}{s}"] = "+".join(f"{d}_{x}{s}" for x in used)
    totals[f"fuel_net_total{s}"] = "+".join(f"Fuel_{x}{s}" for x in ("NetElectricity", "NaturalGas", "Oil"))
    return ch.add(totals)


def _features() -> list[str]:
    return [f for f in PRIORS.draws if not f.endswith(("__fuel", "__is_distributed"))]


def _stack_sql(cols: list[str]) -> str:
    items = ", ".join(f"{{'name': '{x}', 'v': {x}::DOUBLE}}" for x in cols)
    return f"unnest([{items}])"


_DRAWN = ensemble_chain().then(
    "SELECT building_id, sample_id::BIGINT AS sample_id, "
    + ", ".join(f"{sql_fixed(f, 5)} AS {f}" for f in _features())
    + ", factors__system__heat__fuel AS heat_fuel, factors__system__dhw__fuel AS dhw_fuel FROM {last}"
)


@REGISTRY.add(_DRAWN)
def prior_pack_draws(spark, sf_dir):
    df, _ = plan.draw_ensemble(portfolio(spark, sf_dir), N, PRIORS)
    return df.select(
        "building_id", F.col("sample_id").cast("bigint").alias("sample_id"),
        *[fixed(F.col(f), 5).alias(f) for f in _features()],
        F.col("factors__system__heat__fuel").alias("heat_fuel"),
        F.col("factors__system__dhw__fuel").alias("dhw_fuel"),
    )


_STATS = ("mean", "std", "min", "max", "p5", "p10", "p25", "p50", "p75", "p90", "p95")


def _summary_sql(key: str, value: str, places: int, extra: str = "") -> str:
    q = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    cols = {
        "mean": f"avg({value})", "std": f"stddev_samp({value})", "min": f"min({value})", "max": f"max({value})",
        **{k: f"quantile_cont({value}, {p})" for k, p in q.items()},
    }
    return f"SELECT {key}, {extra}" + ", ".join(f"{sql_fixed(e, places)} AS {k}" for k, e in cols.items())


def _dist_query() -> str:
    units = "CASE {d} " + " ".join(
        f"WHEN '{d}' THEN '{u}'" for d, u in {"Raw": "kWh", "EndUse": "kWh", "Fuel": "kWh", "EndUseCost": "USD", "EndUseEmissions": "tCO2e", "FuelCost": "USD", "FuelEmissions": "tCO2e"}.items()
    ) + " END"
    items = []
    for col in result_columns():
        total = col.startswith("Total_")
        d = col.split("_")[1] if total else col.split("_")[0]
        seg = "Total" if total else col.split("_")[1]
        for nrm, x in (("Normalized", col), ("Gross", f"{col}*area_m2")):
            items.append(f"{{'normalization':'{nrm}','dataset':'{d}','segment':'{seg}','v':({x})::DOUBLE}}")
    return (
        "SELECT building_id, normalization, dataset, segment, "
        + units.format(d="dataset") + " || CASE normalization WHEN 'Normalized' THEN '/m2' ELSE '' END AS units, "
        + _summary_sql("0", "v", 3).removeprefix("SELECT 0, ")
        + " FROM (SELECT building_id, r.* FROM (SELECT building_id, unnest([" + ", ".join(items) + "]) AS r FROM {last})) GROUP BY ALL"
    )


@REGISTRY.add(results_chain(ensemble_chain()).then(_dist_query()))
def inference_distribution_summary(spark, sf_dir):
    """Seven datasets, normalized and gross, with totals and percentiles per building."""
    ens = plan.infer(portfolio(spark, sf_dir), N, predict, PRIORS)
    s = plan.summarize_results(ens, N)
    return s.select("building_id", "normalization", "dataset", "segment", "units", *[fixed(F.col(x), 3).alias(x) for x in _STATS])


@REGISTRY.add(results_chain(ensemble_chain(MANY, customers=SUPPLIERS_SQL)).then(_dist_query()))
def many_draws_distribution_summary(spark, sf_dir):
    """The same summary of a smaller portfolio with hundreds of draws a building."""
    ens = plan.infer(portfolio(spark, sf_dir, suppliers_as_customers(spark, sf_dir)), MANY, predict, PRIORS)
    s = plan.summarize_results(ens, MANY)
    return s.select("building_id", "normalization", "dataset", "segment", "units", *[fixed(F.col(x), 3).alias(x) for x in _STATS])


_ENERGY_COLS = [c for c in result_columns() if not c.startswith("Raw_")] + ["fuel_net_total", "pv_kw"]


@REGISTRY.add(
    results_chain(ensemble_chain()).then(
        "SELECT building_id, sample_id::BIGINT AS sample_id, " + ", ".join(f"{sql_fixed(c, 5)} AS {c}" for c in _ENERGY_COLS) + " FROM {last}"
    )
)
def end_use_fuel_cost_emissions(spark, sf_dir):
    """Per draw: end uses, fuels, solar offset, costs, emissions, totals."""
    ens = plan.infer(portfolio(spark, sf_dir), N, predict, PRIORS)
    return ens.select(
        "building_id", F.col("sample_id").cast("bigint").alias("sample_id"), *[fixed(F.col(c), 5).alias(c) for c in _ENERGY_COLS]
    )


_TWO = ensemble_chain(upgrade=True)
_TWO_DONE = frozenset(_TWO.changed)
results_chain(results_chain(_TWO), "_new", _TWO_DONE)
_DELTAS = ["Total_EndUse", "Total_FuelCost", "Total_FuelEmissions", "EndUse_Heating", "EndUse_Solar", "Fuel_NetElectricity"]


@REGISTRY.add(
    _TWO.then(
        "SELECT building_id, sample_id::BIGINT AS sample_id, TRUE AS same_row, "
        + ", ".join(f"{sql_fixed(f'{c} - {c}_new', 5)} AS delta_{c}" for c in _DELTAS) + " FROM {last}"
    )
)
def matched_sample_savings(spark, sf_dir):
    """Original minus upgraded on the same draws; only reached features are redrawn."""
    df = plan.infer_savings(portfolio(spark, sf_dir), N, predict, legacy_costs(), standard_incentives(), PRIORS)
    # A feature that no change reaches has no column of its own in the upgraded scenario.
    same = F.lit(not any(f"{c}_new" in df.columns for c in ("geometry__wwr", "geometry__f2f_height", "extra_spaces__basement__use_fraction")))
    return df.select(
        "building_id", F.col("sample_id").cast("bigint").alias("sample_id"),
        same.alias("same_row"),
        *[fixed(F.col(f"Delta_{c}"), 5).alias(f"delta_{c}") for c in _DELTAS],
    )


@REGISTRY.add(
    _TWO.then(
        "SELECT building_id, normalization, dataset, segment, " + sql_fixed("sum(d)", 4) + " AS delta FROM (SELECT building_id, r.* FROM (SELECT building_id, unnest(["
        + ", ".join(
            f"{{'normalization':'{nrm}','dataset':'{d}','segment':'{s}','d':(({d}_{s} - {d}_{s}_new){'*area_m2' if nrm == 'Gross' else ''})::DOUBLE}}"
            for d, ss in SEGMENTS.items() for s in ss for nrm in ("Normalized", "Gross")
        )
        + "]) AS r FROM {last})) GROUP BY ALL"
    )
)
def matched_difference_join(spark, sf_dir):
    """The same difference from two stored scenarios, bucketed by draw, so that their join moves nothing."""
    df = plan.infer_savings(portfolio(spark, sf_dir), N, predict, legacy_costs(), standard_incentives(), PRIORS)
    keys, cols, run = ["building_id", "sample_id"], result_columns(), uuid.uuid4().hex
    root, buckets = f"{checkpoint_root(spark).rstrip('/')}/scenarios-{run}", partitions_for(spark)
    # The ensemble is computed once, with both scenarios on a row.
    once = spark.read.parquet(publish(df.select(*keys, "area_m2", *cols, *[f"{c}_new" for c in cols]), f"{root}/both"))
    sides = {"original": once.select(*keys, "area_m2", *cols), "upgraded": once.select(*keys, *[F.col(f"{c}_new").alias(c) for c in cols])}
    kept = {name: publish_bucketed(side, f"{name}_{run}", f"{root}/{name}", keys, buckets) for name, side in sides.items()}
    wide = matched_difference_wide(kept["original"], kept["upgraded"], keys, cols, ("area_m2",))
    # Draws meet as wide rows, once; the long rows of a building are made and summed where they are.
    here = ["building_id", "area_m2"]
    totals = wide.repartition("building_id").groupBy(*here).agg(*[F.sum(c).alias(c) for c in cols])
    diff = long_results(totals, here).withColumnRenamed("value", "delta")
    return sum_over(diff, ["building_id", "normalization", "dataset", "segment"], "delta").withColumn("delta", fixed(F.col("delta"), 4))


@REGISTRY.add(
    ensemble_chain().then(
        "SELECT " + ", ".join(
            f"count(*) FILTER (WHERE factors__system__{s}__fuel IS NULL OR factors__system__{s}__fuel NOT IN ('Electricity','NaturalGas','Oil')) AS n_unknown_{s}"
            for s in ("heat", "cool", "dhw")
        ) + " FROM {last}"
    )
)
def unknown_fuel_report(spark, sf_dir):
    df, _ = plan.draw_ensemble(portfolio(spark, sf_dir), N, PRIORS)
    return unknown_fuel_count(df)


@REGISTRY.add(
    ensemble_chain().then(
        "SELECT p.feature, p.n_null FROM (SELECT unnest(["
        + ", ".join(f"{{'feature':'{f}','n_null':count(*) FILTER (WHERE {f} IS NULL)}}" for f in PRIORS.draws)
        + "]) AS p FROM {last}) WHERE p.n_null > 0"
    )
)
def prior_null_report(spark, sf_dir):
    """Features some row left unmatched (none for a valid portfolio)."""
    df, _ = plan.draw_ensemble(portfolio(spark, sf_dir), N, PRIORS)
    return PRIORS.null_report(df)


@REGISTRY.add()
def nested_inference_response(spark, sf_dir):
    """The JSON response per building."""
    ens = plan.infer(portfolio(spark, sf_dir), N, predict, PRIORS)
    return plan.respond(plan.summarize_results(ens, N, nested=True))
