"""Percentile summaries and result totals over tables of any group size."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.catalog.base import Registry, sql_fixed, table
from brickwork.functions.rounding import fixed
from brickwork.operators import summary as s
from brickwork.operators import surrogate as m

REGISTRY = Registry()
_Q = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
_SQL = {"mean": "avg({v})", "std": "stddev_samp({v})", "min": "min({v})", "max": "max({v})", **{k: f"quantile_cont({{v}}, {p})" for k, p in _Q.items()}}


def _sql(key: str, value: str, tab: str) -> str:
    return f"SELECT {key}, " + ", ".join(f"{sql_fixed(e.format(v=value), 5)} AS {k}" for k, e in _SQL.items()) + f" FROM {tab} GROUP BY {key}"


@REGISTRY.add(_sql("o_orderpriority", "o_totalprice", "orders"))
def distribution_by_group(spark, sf_dir):
    got = s.distribution_summary(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return got.select("o_orderpriority", *[fixed(F.col(c), 5).alias(c) for c in _SQL])


@REGISTRY.add(_sql("l_returnflag", "l_quantity", "lineitem"))
def distribution_with_ties(spark, sf_dir):
    """Few distinct values: the bracketed pass with a small sketch."""
    li = table(spark, sf_dir, "lineitem")
    got = s.exact_percentiles(li, ["l_returnflag"], "l_quantity", accuracy=1000)
    mom = li.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("std"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"))
    return mom.join(got, "l_returnflag").select("l_returnflag", *[fixed(F.col(c), 5).alias(c) for c in _SQL])


@REGISTRY.add(_sql("l_linestatus", "l_extendedprice", "lineitem"))
def distribution_bracketed(spark, sf_dir):
    """Large groups of mostly distinct values: ranks bracketed by the sketch."""
    li = table(spark, sf_dir, "lineitem")
    got = s.exact_percentiles(li, ["l_linestatus"], "l_extendedprice", accuracy=1000)
    mom = li.groupBy("l_linestatus").agg(F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("std"), F.min("l_extendedprice").alias("min"), F.max("l_extendedprice").alias("max"))
    return mom.join(got, "l_linestatus").select("l_linestatus", *[fixed(F.col(c), 5).alias(c) for c in _SQL])


@REGISTRY.add()
def distribution_approximate(spark, sf_dir):
    return s.distribution_summary(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", approximate=1000)


_METER = "SELECT l_orderkey AS run_id, CASE WHEN l_linestatus='F' THEN 'Energy' ELSE 'Peak' END AS measurement, l_returnflag AS meter, month(l_shipdate)::BIGINT AS month, l_quantity AS value FROM lineitem"


def meters(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS run_id", "CASE WHEN l_linestatus = 'F' THEN 'Energy' ELSE 'Peak' END AS measurement", "l_returnflag AS meter", "bigint(month(l_shipdate)) AS month", "l_quantity AS value"
    )


@REGISTRY.add(f"SELECT run_id, measurement, meter, CASE WHEN measurement='Peak' THEN max(value) ELSE sum(value) END AS value FROM ({_METER}) GROUP BY run_id, measurement, meter")
def annual_energy_and_peak(spark, sf_dir):
    return m.annual_targets(meters(spark, sf_dir), ["run_id"])


@REGISTRY.add(
    f"SELECT coalesce(meter, '*') AS meter, coalesce(measurement, '*') AS measurement, {sql_fixed('sum(value)', 3)} AS value FROM ({_METER}) GROUP BY GROUPING SETS ((meter), (measurement))"
)
def totals_over_levels(spark, sf_dir):
    """Sum over meters per measurement and over measurements per meter."""
    d = meters(spark, sf_dir)
    sets = [[F.col("meter")], [F.col("measurement")]]
    got = d.groupingSets(sets, "meter", "measurement").agg(F.sum("value").alias("v"))
    return got.select(F.coalesce("meter", F.lit("*")).alias("meter"), F.coalesce("measurement", F.lit("*")).alias("measurement"), fixed(F.col("v"), 3).alias("value"))
