"""Cost and incentive rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwork.functions.rounding import half_even
from brickwork.operators.quantities import Factor, Rule, RuleSet

FACTOR = (
    "type STRING, coefficient DOUBLE, amount DOUBLE, percent DOUBLE, `limit` DOUBLE, "
    "limit_unit STRING, indicator_cols ARRAY<STRING>, error_scale DOUBLE, "
    "description STRING, source STRING, units STRING, per STRING"
)
SCHEMA = (
    "output_key STRING, raise_on_duplicate_trigger BOOLEAN, create_metadata BOOLEAN, "
    "metadata_aggregation STRING, quantities ARRAY<STRUCT<trigger_column: STRING, "
    "initial: STRING, final: STRING, `order`: ARRAY<STRING>, "
    f"quantity_factors: ARRAY<STRUCT<{FACTOR.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE').replace(' ARRAY', ': ARRAY')}>>>>"
)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """One row per (file, rule, factor)."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    rules = raw.select(
        "output_key", "raise_on_duplicate_trigger", "create_metadata", "metadata_aggregation",
        F.posexplode("quantities").alias("rule_ix", "q"),
    )
    return rules.select(
        "output_key", "raise_on_duplicate_trigger", "create_metadata", "metadata_aggregation",
        "rule_ix", "q.trigger_column", "q.initial", "q.final", "q.order",
        F.explode_outer("q.quantity_factors").alias("f"),
    ).select("*", "f.*").drop("f")


def load_rule_set(spark: SparkSession, path: str) -> RuleSet:
    """Rules as configuration: the factors of one hand-written file, compiled into the plan."""
    rows = read_rules(spark, path).collect()
    if not rows:
        raise ValueError(f"no rules in {path}")
    first = rows[0]
    return RuleSet.from_rows(
        [r for r in rows if r["type"] is not None], first["output_key"],
        raise_on_duplicate=bool(first["raise_on_duplicate_trigger"]),
        create_metadata=bool(first["create_metadata"]),
        metadata_aggregation=first["metadata_aggregation"],
    )


# Indicator features and unit of each rate column of a wide cost table.
RATE_COLUMNS = {
    "per_facade_area": ("geometry__computed__whole_bldg_facade_area", "geometry__est_uniform_linear_scaling_factor", "$/m2"),
    "per_window_area": ("geometry__computed__window_area", "geometry__est_uniform_linear_scaling_factor", "$/m2"),
    "per_total_linear_facade_distance": ("geometry__computed__total_linear_facade_distance", "geometry__est_uniform_linear_scaling_factor", "$/m"),
    "per_gross_floor_area": ("geometry__energy_model_conditioned_area", "geometry__est_fp_ratio", "$/m2"),
    "per_footprint_area": ("geometry__computed__footprint_area", "geometry__est_fp_ratio", "$/m2"),
    "per_roof_area": ("geometry__computed__roof_surface_area", "geometry__est_fp_ratio", "$/m2"),
}


def factor_rows_from_wide(wide: DataFrame, ids: list[str], error_scale: float = 0.033) -> DataFrame:
    """Turn a wide cost table (one rate per column) into factor rows.

    Zero rates vanish; each rate column brings its indicator features and unit;
    ``fixed_cost`` becomes a fixed factor.
    """
    rates = [c for c in RATE_COLUMNS if c in wide.columns]
    extra = ["fixed_cost"] if "fixed_cost" in wide.columns else []
    long = wide.unpivot(ids, rates + extra, "rate_column", "rate").filter("rate <> 0")
    name = F.col("rate_column")
    inds = F.when(F.lit(False), F.array(F.lit("")))
    units = F.when(F.lit(False), F.lit(""))
    for c, (a, b, u) in RATE_COLUMNS.items():
        inds = inds.when(name == c, F.array(F.lit(a), F.lit(b)))
        units = units.when(name == c, F.lit(u))
    fixed = name == "fixed_cost"
    return long.select(
        *ids,
        F.when(fixed, "FixedQuantity").otherwise("LinearQuantity").alias("type"),
        F.when(~fixed, half_even(F.col("rate"), 2)).alias("coefficient"),
        F.when(fixed, F.col("rate")).alias("amount"),
        inds.alias("indicator_cols"),
        units.alias("units"),
        F.when(~fixed, F.translate(F.regexp_replace(name, "^per_", ""), "_", " ")).alias("per"),
        F.lit(float(error_scale)).alias("error_scale"),
    )


# Shipped rebates (trigger, initial, final, feature, USD, text).
REBATES = (
    ("Heating", None, "ASHPHeating", "homeowner__in_bracket__AllCustomers", 10000, "MassSave ASHP rebate for all customers"),
    ("Heating", None, "ASHPHeating", "homeowner__in_bracket__IncomeEligible", 15000, "MassSave ASHP rebate for income eligible customers"),
    ("Heating", None, "GSHPHeating", "homeowner__in_bracket__AllCustomers", 15000, "MassSave GSHP rebate for all customers"),
    ("Heating", None, "GSHPHeating", "homeowner__in_bracket__IncomeEligible", 25000, "MassSave GSHP rebate for income eligible customers"),
    ("DHW", "ElectricResistanceDHW", "HPWH", "homeowner__in_bracket__AllCustomers", 750, "MassSave HPWH rebate for all customers"),
    ("DHW", "ElectricResistanceDHW", "HPWH", "homeowner__in_bracket__IncomeEligible", 1200, "MassSave HPWH rebate for income eligible customers"),
    ("Thermostat", None, "Controls", "homeowner__in_bracket__AllCustomers", 100, "MassSave smart thermostat rebate for all customers"),
    ("Thermostat", None, "Controls", "homeowner__in_bracket__IncomeEligible", 200, "MassSave smart thermostat rebate for income eligible customers"),
)

# Shipped tax credits (trigger, initial, final, share, USD at most, text).
CREDITS = (
    ("Heating", None, "ASHPHeating", 0.3, 2000, "IRA 30% tax credit for ASHP, capped at $2000"),
    ("Heating", None, "GSHPHeating", 0.3, 2000, "IRA 30% tax credit for GSHP, capped at $2000"),
    ("Windows", None, "DoublePaneLowE", 0.3, 600, "IRA 30% tax credit for energy efficient windows, capped at $600"),
    ("Windows", None, "TriplePaneLowE", 0.3, 600, "IRA 30% tax credit for energy efficient windows, capped at $600"),
)


def standard_incentives() -> RuleSet:
    """The shipped incentive programs: rebates are paid before credits."""
    factors: dict[tuple, list[Factor]] = {}
    for *change, feature, amount, text in REBATES:
        rebate = Factor("LinearQuantity", coefficient=amount, indicators=(feature,), error_scale=0.0, description=text, source="MassSave", units="$", per="rebate")
        factors.setdefault(tuple(change), []).append(rebate)
    for *change, share, limit, text in CREDITS:
        credit = Factor("PercentQuantity", percent=share, limit=limit, error_scale=0.0, description=text, source="IRA")
        factors.setdefault(tuple(change), []).append(credit)
    rules = [Rule(*change, tuple(own), tuple(dict.fromkeys(f.kind for f in own))) for change, own in factors.items()]
    return RuleSet(tuple(rules), "incentive", False, True, "bracket")


# Legacy retrofit rates (trigger, initial, final, {rate column: USD}).
LEGACY_COSTS = (
    ("Weatherization", "LeakyEnvelope", "TightEnvelope", {"per_gross_floor_area": 8.83}),
    ("Weatherization", "SomewhatLeakyEnvelope", "TightEnvelope", {"per_gross_floor_area": 6.35}),
    ("Walls", "UninsulatedWalls", "FullInsulationWallsCavity", {"per_facade_area": 7.21, "per_total_linear_facade_distance": 30.76}),
    ("Walls", "UninsulatedWalls", "FullInsulationWallsCavityExterior", {"per_facade_area": 188.90, "per_total_linear_facade_distance": 30.76}),
    ("Walls", "SomeInsulationWalls", "FullInsulationWallsCavity", {"per_facade_area": 14.42, "per_total_linear_facade_distance": 61.52}),
    ("Walls", "SomeInsulationWalls", "FullInsulationWallsCavityExterior", {"per_facade_area": 196.11, "per_total_linear_facade_distance": 61.52}),
    ("Walls", "FullInsulationWalls", "FullInsulationWallsCavityExterior", {"per_facade_area": 181.69}),
    ("AtticFloorInsulation", "NoInsulation", "HighlyInsulated", {"per_footprint_area": 16.58}),
    ("AtticFloorInsulation", "Insulated", "HighlyInsulated", {"per_footprint_area": 9.58}),
    ("Windows", None, "DoublePaneLowE", {"per_window_area": 538.2}),
    ("Windows", None, "TriplePaneLowE", {"per_window_area": 645.83}),
    ("Thermostat", None, "Controls", {"fixed_cost": 500.0}),
    ("Equipment", None, "HighEfficiencyEquipment", {"fixed_cost": 4250.0}),
    ("DHW", "ElectricResistanceDHW", "HPWH", {"fixed_cost": 3000.0}),
    ("DHW", "NaturalGasDHW", "HPWH", {"fixed_cost": 3200.0}),
    ("DHW", "NaturalGasHeatingDHWCombo", "HPWH", {"fixed_cost": 3200.0}),
    ("Heating", None, "ASHPHeating", {"fixed_cost": 18000.0}),
    ("Heating", None, "GSHPHeating", {"fixed_cost": 18000.0}),
    ("Cooling", None, "ASHPCooling", {"fixed_cost": 18000.0}),
    ("Cooling", None, "GSHPCooling", {"fixed_cost": 18000.0}),
    ("Distribution", "HotWaterUninsulated", "HotWaterInsulated", {"per_footprint_area": 6.46}),
    ("Distribution", "AirDuctsUninsulated", "AirDuctsInsulated", {"per_footprint_area": 32.29}),
    ("Distribution", "AirDuctsConditionedUninsulated", "AirDuctsInsulated", {"per_footprint_area": 32.29}),
)


def legacy_costs(error_scale: float = 0.0) -> RuleSet:
    """Retrofit costs from the legacy rate table."""
    rules = []
    for trigger, initial, final, rates in LEGACY_COSTS:
        factors = []
        for col, rate in rates.items():
            if col == "fixed_cost":
                factors.append(Factor("FixedQuantity", amount=rate, error_scale=error_scale))
            else:
                a, b, units = RATE_COLUMNS[col]
                factors.append(
                    Factor("LinearQuantity", coefficient=rate, indicators=(a, b), error_scale=error_scale, units=units, per=col[4:].replace("_", " "))
                )
        kinds = tuple(dict.fromkeys(f.kind for f in factors))
        rules.append(Rule(trigger, initial, final, tuple(factors), kinds))
    return RuleSet(tuple(rules), "cost")
