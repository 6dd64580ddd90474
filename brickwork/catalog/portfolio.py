"""Customers as a building portfolio, in both engines.

Every customer is a building; attributes come from its key, nation and market
segment, so the portfolio grows with the customer table.  Suppliers make a smaller
portfolio for studies with many draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwork.catalog.base import table
from brickwork.functions.text import derive
from brickwork.names import COUNTIES, SEMANTIC_OPTIONS
from brickwork.operators.energy import reader

FIELDS = (
    "DHW", "Walls", "Heating", "Windows", "Thermostat", "Age_bracket", "Distribution",
    "Weatherization", "AtticFloorInsulation", "Equipment",
)
COOLING = ("none", "ACCentral", "ACWindow", "ASHPCooling", "GSHPCooling", "WindowASHP")
SOLAR = ("NoSolarPV", "ExistingSolarPV", "NoSolarPV")
# field changed by each market segment
UPGRADES = {
    "BUILDING": ("Heating", "ASHPHeating"),
    "MACHINERY": ("Heating", "GSHPHeating"),
    "HOUSEHOLD": ("Windows", "TriplePaneLowE"),
    "AUTOMOBILE": ("DHW", "HPWH"),
    "FURNITURE": ("OnsiteSolar", "MaxSolarPV"),
}
CHANGED = ("Heating", "Windows", "DHW", "OnsiteSolar")
YES_NO = (
    ("extra_spaces__attic__exists", 2), ("extra_spaces__attic__occupied", 3),
    ("extra_spaces__attic__conditioned", 5), ("extra_spaces__basement__exists", 7),
    ("extra_spaces__basement__occupied", 4),
)


def options(field: str) -> tuple[str, ...]:
    return {"Cooling": COOLING, "OnsiteSolar": SOLAR}.get(field) or SEMANTIC_OPTIONS[field]


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def suppliers_as_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = pick(tuple(UPGRADES), F.col("s_suppkey") % len(UPGRADES))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), segment.alias("c_mktsegment"))


SUPPLIERS_SQL = (
    "(SELECT s_suppkey AS c_custkey, s_nationkey AS c_nationkey, "
    f"(list_value({', '.join(repr(s) for s in UPGRADES)}))[s_suppkey % {len(UPGRADES)} + 1] AS c_mktsegment FROM supplier)"
)


def portfolio(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    k = F.col("c_custkey")
    cols = {
        "geometry__short_edge": (F.lit(8.0) + (k % 7).cast("double")),
        "geometry__long_edge": (F.lit(15.0) + (k % 13).cast("double")),
        "geometry__num_floors": (F.lit(1) + k % 3).cast("double"),
        "current_solar_kw": (k % 6).cast("double"),
        "location__county": pick(COUNTIES, F.col("c_nationkey") % 14),
    }
    for i, f in enumerate((*FIELDS, "Cooling", "OnsiteSolar")):
        vals = options(f)
        cols[f"semantic__{f}"] = pick(vals, F.floor(k / F.lit(i + 1)).cast("bigint") % len(vals))
    for name, m in YES_NO:
        cols[name] = F.when(k % m == 0, "No").otherwise("Yes")
    df = (table(spark, sf_dir, "customer") if customers is None else customers).select(
        k.alias("building_id"), "c_mktsegment", *[c.alias(n) for n, c in cols.items()]
    )
    df = df.withColumn(
        "area_m2",
        F.col("geometry__short_edge") * F.col("geometry__long_edge") * F.col("geometry__num_floors")
        * (F.lit(0.9) + F.lit(0.05) * (F.col("building_id") % 5).cast("double")),
    )
    df = df.withColumn(
        "geometry__energy_model_conditioned_area",
        F.col("geometry__short_edge") * F.col("geometry__long_edge") * F.col("geometry__num_floors"),
    )
    for f in CHANGED:
        new = F.col(f"semantic__{f}")
        for segment, (field, value) in UPGRADES.items():
            if field == f:
                new = F.when(F.col("c_mktsegment") == segment, F.lit(value)).otherwise(new)
        df = df.withColumn(f"semantic__{f}_new", new)
    return df


def portfolio_sql(customers: str = "customer") -> str:
    def pick_sql(values, index):
        return f"(list_value({', '.join(repr(v) for v in values)}))[CAST({index} AS BIGINT)+1]"

    cols = [
        "c_custkey AS building_id", "c_mktsegment",
        "8.0::DOUBLE + c_custkey % 7 AS geometry__short_edge",
        "15.0::DOUBLE + c_custkey % 13 AS geometry__long_edge",
        "CAST(1 + c_custkey % 3 AS DOUBLE) AS geometry__num_floors",
        "CAST(c_custkey % 6 AS DOUBLE) AS current_solar_kw",
        f"{pick_sql(COUNTIES, 'c_nationkey % 14')} AS location__county",
    ]
    for i, f in enumerate((*FIELDS, "Cooling", "OnsiteSolar")):
        vals = options(f)
        cols.append(f"{pick_sql(vals, f'(c_custkey // {i + 1}) % {len(vals)}')} AS semantic__{f}")
    for name, m in YES_NO:
        cols.append(f"CASE WHEN c_custkey % {m} = 0 THEN 'No' ELSE 'Yes' END AS {name}")
    inner = f"SELECT {', '.join(cols)} FROM {customers}"
    gfa = "geometry__short_edge*geometry__long_edge*geometry__num_floors"
    news = []
    for f in CHANGED:
        whens = " ".join(
            f"WHEN c_mktsegment = '{s}' THEN '{v}'" for s, (fld, v) in UPGRADES.items() if fld == f
        )
        news.append(f"CASE {whens} ELSE semantic__{f} END AS semantic__{f}_new")
    return (
        f"SELECT *, {gfa}*(0.9::DOUBLE + 0.05::DOUBLE*(building_id % 5)) AS area_m2, "
        f"{gfa} AS geometry__energy_model_conditioned_area, {', '.join(news)} FROM ({inner})"
    )


# Stand-in surrogate: loads as plain functions of features, so that SQL can follow.
def predict(df: DataFrame, suffix: str) -> DataFrame:
    c = reader(df, suffix)
    glass = f"CASE WHEN {c('semantic__Windows')} = 'TriplePaneLowE' THEN 0.8D ELSE 1.0D END"
    wwr, height = c("geometry__wwr"), c("geometry__f2f_height")
    loads = {
        "Raw_Lighting": f"9.0D + {c('geometry__num_floors')}",
        "Raw_Equipment": f"14.0D + {height}",
        "Raw_DomesticHotWater": f"15.0D + 5.0D * {c('extra_spaces__basement__use_fraction')}",
        "Raw_Heating": f"(40.0D + 300.0D * {wwr} + 8.0D * {height}) * {glass}",
        "Raw_Cooling": f"(10.0D + 60.0D * {wwr}) * {glass}",
        "Peak_Heating": f"0.004D + 0.02D * {wwr}",
    }
    return derive(df, {k + suffix: v for k, v in loads.items()})


def predict_sql(suffix: str) -> str:
    w = f"semantic__Windows{suffix}" if suffix else "semantic__Windows"
    glass = f"CASE WHEN {w} = 'TriplePaneLowE' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"
    return ", ".join(
        f"{e} AS {n}{suffix}"
        for n, e in {
            "Raw_Lighting": "9.0::DOUBLE + geometry__num_floors",
            "Raw_Equipment": "14.0::DOUBLE + geometry__f2f_height",
            "Raw_DomesticHotWater": "15.0::DOUBLE + 5.0::DOUBLE*extra_spaces__basement__use_fraction",
            "Raw_Heating": f"(40.0::DOUBLE + 300.0::DOUBLE*geometry__wwr + 8.0::DOUBLE*geometry__f2f_height)*({glass})",
            "Raw_Cooling": f"(10.0::DOUBLE + 60.0::DOUBLE*geometry__wwr)*({glass})",
            "Peak_Heating": "0.004::DOUBLE + 0.02::DOUBLE*geometry__wwr",
        }.items()
    )
