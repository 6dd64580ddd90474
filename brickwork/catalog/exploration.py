"""Counts, densities, regressions and learning-curve tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.catalog.base import Registry, sql_fixed, table
from brickwork.catalog.distributions import _METER, meters
from brickwork.catalog.hourly import grid_loads, _grid_sql
from brickwork.functions.rounding import fixed
from brickwork.operators import explore as x
from brickwork.operators.heat_balance import compare_methods, r_squared

REGISTRY = Registry()


@REGISTRY.add("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def counts_per_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add(f"SELECT p_type, p_brand, {sql_fixed('avg(p_retailprice)', 4)} AS mean, {sql_fixed('stddev_samp(p_retailprice)', 4)} AS std, count(*) AS n FROM part GROUP BY ALL")
def group_means_sorted(spark, sf_dir):
    got = x.group_mean_std(table(spark, sf_dir, "part"), ["p_type", "p_brand"], "p_retailprice")
    return got.withColumns({c: fixed(F.col(c), 4) for c in ("mean", "std")})


_R = "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"


@REGISTRY.add(
    f"WITH r AS {_R}, b AS (SELECT least(CAST(floor((o_totalprice-lo)/((hi-lo)/30)) AS INTEGER), 29) AS bin FROM orders, r), g AS (SELECT unnest(range(30))::INTEGER AS bin) "
    f"SELECT g.bin, {sql_fixed('lo + g.bin*((hi-lo)/30)', 3)} AS low, count(b.bin) AS n FROM g CROSS JOIN r LEFT JOIN b ON b.bin=g.bin GROUP BY g.bin, lo, hi"
)
def histogram_equal_bins(spark, sf_dir):
    return x.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 30).withColumn("low", fixed(F.col("low"), 3))


@REGISTRY.add(
    "WITH r AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c, max(l_extendedprice) d FROM lineitem) SELECT least(CAST(floor((l_quantity-a)/((b-a)/12)) AS INTEGER), 11) AS x_bin, least(CAST(floor((l_extendedprice-c)/((d-c)/12)) AS INTEGER), 11) AS y_bin, count(*) AS n FROM lineitem, r GROUP BY 1, 2"
)
def histogram_two_dimensions(spark, sf_dir):
    return x.histogram_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 12)


_KDE = (
    "WITH r AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem), h AS (SELECT l_returnflag, stddev_samp(l_extendedprice)*pow(count(*), -0.2::DOUBLE) AS h FROM lineitem GROUP BY 1), "
    "g AS (SELECT i AS point, lo + (hi-lo)*i/19 AS x FROM r, (SELECT unnest(range(20)) AS i)), "
    "k AS (SELECT l.l_returnflag, point, x, avg(exp(-0.5::DOUBLE*pow((l_extendedprice-x)/h, 2))/(h*2.5066282746310002::DOUBLE)) AS density FROM lineitem l JOIN h USING (l_returnflag), g GROUP BY ALL)"
)


@REGISTRY.add(_KDE + f" SELECT l_returnflag, point::INTEGER AS point, {sql_fixed('x', 3)} AS x, {sql_fixed('density*1e6::DOUBLE', 5)} AS density_ppm FROM k")
def kernel_density_grid(spark, sf_dir):
    d = x.kernel_density(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20, ["l_returnflag"])
    return d.select("l_returnflag", "point", fixed(F.col("x"), 3).alias("x"), fixed(F.col("density") * 1e6, 5).alias("density_ppm"))


@REGISTRY.add(_KDE + f" SELECT l_returnflag, {sql_fixed('arg_max(x, density)', 3)} AS mode FROM k GROUP BY 1")
def density_mode_per_group(spark, sf_dir):
    d = x.density_mode(x.kernel_density(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20, ["l_returnflag"]), ["l_returnflag"])
    return d.withColumn("mode", fixed(F.col("mode"), 3))


@REGISTRY.add(
    f"SELECT l_returnflag, {sql_fixed('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {sql_fixed('regr_intercept(l_extendedprice, l_quantity)', 2)} AS intercept, {sql_fixed('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem GROUP BY 1"
)
def annual_against_peak_regression(spark, sf_dir):
    got = x.simple_regression(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return got.withColumns({"slope": fixed(F.col("slope"), 4), "intercept": fixed(F.col("intercept"), 2), "r2": fixed(F.col("r2"))})


@REGISTRY.add(
    f"WITH m AS (SELECT run_id, month, sum(value) AS v FROM ({_METER}) GROUP BY ALL), t AS (SELECT run_id, month, row_number() OVER (PARTITION BY run_id ORDER BY v DESC, month) AS k FROM m), c AS (SELECT month, count(*) AS n FROM t WHERE k=1 GROUP BY month) "
    f"SELECT month, {sql_fixed('n/(SELECT sum(n) FROM c)::DOUBLE')} AS share FROM c"
)
def peak_month_share(spark, sf_dir):
    monthly = meters(spark, sf_dir).groupBy("run_id", "month").agg(F.sum("value").alias("v"))
    return x.peak_share(monthly, ["run_id"], "month", "v").withColumn("share", fixed(F.col("share")))


@REGISTRY.add(
    f"SELECT l_returnflag, l_linestatus, {sql_fixed('avg(CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END)')} AS pass_rate, min(l_discount) AS best, max(l_discount) AS worst FROM lineitem GROUP BY ALL"
)
def stratum_pass_rate(spark, sf_dir):
    got = x.pass_rate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", 0.05)
    return got.withColumn("pass_rate", fixed(F.col("pass_rate")))


@REGISTRY.add(f"SELECT year(o_orderdate)::INTEGER AS iteration, o_orderpriority AS metric, {sql_fixed('avg(o_totalprice)', 3)} AS value FROM orders GROUP BY ALL")
def metric_per_iteration(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("iteration"), F.col("o_orderpriority").alias("metric")).agg(fixed(F.avg("o_totalprice"), 3).alias("value"))


@REGISTRY.add("SELECT floor(o_totalprice/25)*25 AS bin, count(*) AS n FROM orders GROUP BY 1")
def counts_in_steps_of_25(spark, sf_dir):
    return x.binned_counts(table(spark, sf_dir, "orders"), "o_totalprice", 25.0).withColumn("bin", F.col("bin").cast("double"))


@REGISTRY.add(
    f"SELECT event_type, {sql_fixed('avg(value*1000.0::DOUBLE*0.316998::DOUBLE)', 4)} AS mean, {sql_fixed('quantile_cont(value*1000.0::DOUBLE*0.316998::DOUBLE, 0.5)', 6)} AS median FROM events GROUP BY 1"
)
def peak_rate_conversion(spark, sf_dir):
    got = x.peak_rate(table(spark, sf_dir, "events"), "value", ["event_type"])
    return got.withColumns({"mean": fixed(F.col("mean"), 4), "median": fixed(F.col("median"), 6)})


@REGISTRY.add(
    f"WITH r AS (SELECT l_returnflag, l_orderkey, l_partkey, abs(l_quantity*1500 - l_extendedprice) AS e FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY e DESC, l_orderkey) AS i FROM r) SELECT l_returnflag, l_orderkey, l_partkey, {sql_fixed('e', 3)} AS abs_residual FROM k WHERE i=1"
)
def worst_fit_row(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    got = x.worst_fit(li, F.col("l_quantity") * 1500 - F.col("l_extendedprice"), ["l_orderkey", "l_partkey"], ["l_returnflag"])
    return got.withColumn("abs_residual", fixed(F.col("abs_residual"), 3))


_G = f"SELECT roof, wall, \"window\", leakage, heating_eui, cooling_eui FROM ({_grid_sql()})"


@REGISTRY.add(
    f"WITH g AS ({_G}), m AS (SELECT max(heating_eui) a, max(cooling_eui + heating_eui) b FROM g) SELECT roof, wall, \"window\", leakage, {sql_fixed('(cooling_eui+heating_eui)/b', 4)} AS sim, {sql_fixed('heating_eui/a', 4)} AS fp FROM g, m"
)
def methods_side_by_side(spark, sf_dir):
    g = grid_loads(spark, sf_dir).withColumn("total", F.col("heating_eui") + F.col("cooling_eui"))
    keys = ["roof", "wall", "window", "leakage"]
    got = compare_methods(g.selectExpr(*keys, "total AS v"), g.selectExpr(*keys, "heating_eui AS v"), keys, "v")
    return got.withColumns({c: fixed(F.col(c), 4) for c in ("sim", "fp")})


@REGISTRY.add(f"WITH g AS ({_G}) SELECT {sql_fixed('1 - sum(pow(heating_eui - cooling_eui, 2))/(var_pop(heating_eui)*count(*))', 4)} AS r2 FROM g")
def methods_r_squared(spark, sf_dir):
    return r_squared(grid_loads(spark, sf_dir), "heating_eui", "cooling_eui").select(fixed(F.col("r2"), 4).alias("r2"))
