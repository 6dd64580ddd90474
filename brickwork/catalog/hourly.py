"""Events as hourly zone series: user = run, event type = zone, value = temperature."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.catalog.base import Registry, sql_fixed, table
from brickwork.functions.rounding import fixed
from brickwork.operators import heat_balance as hb
from brickwork.operators import hourly as op

REGISTRY = Registry()
_EPOCH = 1704067200  # 2024-01-01, start of the series
_HOUR_SQL = f"CAST(floor((epoch(ts) - {_EPOCH})/3600) AS BIGINT)"
_ZONES_SQL = (
    f"z AS (SELECT user_id AS run_id, event_type AS zone, {_HOUR_SQL} AS hour, avg(value % 40) AS temp_c, avg(20.0::DOUBLE + value % 60) AS rh_pct FROM events GROUP BY ALL)"
)


def zones(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("zone"), hour.alias("hour")).agg(
        F.avg(F.col("value") % 40).alias("temp_c"), F.avg(F.lit(20.0) + F.col("value") % 60).alias("rh_pct")
    )


_W = "w AS (SELECT run_id AS station, hour, hour // 24 AS day, 1 + (hour // 24) % 12 AS month, avg(temp_c) AS t FROM z GROUP BY ALL)"
_D = (
    "d AS (SELECT station, month, day, count(*) FILTER (WHERE t < 18) AS hc, count(*) FILTER (WHERE t > 23) AS hw, min(t) AS lo, max(t) AS hi, median(t) AS mid FROM w GROUP BY ALL), "
    "b AS (SELECT *, unnest([0, month]) AS period FROM d), "
    "s AS (SELECT station, period::INTEGER AS period, sum(hc)/24.0::DOUBLE AS days_below_base, sum(hw)/24.0::DOUBLE AS days_above_base, min(lo) AS daily_min, max(hi) AS daily_max, "
    "median(mid) AS daily_median_median, median(lo) AS daily_min_median, median(hi) AS daily_max_median, median(hi-lo) AS daily_range_median FROM b GROUP BY ALL)"
)


def _weather(spark, sf_dir):
    z = zones(spark, sf_dir)
    w = z.groupBy(F.col("run_id").alias("station"), "hour").agg(F.avg("temp_c").alias("dry_bulb_c"))
    w = w.withColumns({"day": F.floor(F.col("hour") / 24), "month": (F.lit(1) + F.floor(F.col("hour") / 24) % 12)})
    return op.weather_summary(w)


@REGISTRY.add(f"WITH {_ZONES_SQL}, {_W}, {_D} SELECT station, period, " + ", ".join(f"{sql_fixed(s)} AS {s}" for s in op.WEATHER_STATS) + " FROM s")
def weather_station_summary(spark, sf_dir):
    return _weather(spark, sf_dir).select("station", "period", *[fixed(F.col(s)).alias(s) for s in op.WEATHER_STATS])


_WIDE = ["days_below_base", "daily_max", "daily_median_median"]


@REGISTRY.add(
    f"WITH {_ZONES_SQL}, {_W}, {_D} SELECT station, "
    + ", ".join(
        f"max(CASE WHEN period={m} THEN {sql_fixed(s)} END) AS {f'annual_{s}' if m == 0 else f'monthly_{s}_{m:02d}'}" for s in _WIDE for m in range(13)
    )
    + " FROM s GROUP BY station"
)
def weather_features_wide(spark, sf_dir):
    s = _weather(spark, sf_dir).withColumns({c: fixed(F.col(c)) for c in _WIDE})
    return op.weather_features(s, stats=_WIDE)


@REGISTRY.add("SELECT h AS hour, month(TIMESTAMP '2023-01-01' + to_hours(h::INTEGER))::INTEGER AS month FROM (SELECT DISTINCT event_id % 8760 AS h FROM events)")
def month_of_hour_of_year(spark, sf_dir):
    h = table(spark, sf_dir, "events").select((F.col("event_id") % 8760).alias("hour")).distinct()
    return h.withColumn("month", op.month_of_hour(F.col("hour")))


_R = lambda e: f"(round_even(({e})*100.0::DOUBLE, 0)/100.0::DOUBLE)"


@REGISTRY.add(
    f"WITH {_ZONES_SQL}, h AS (SELECT run_id, hour, max(temp_c) AS hi, min(temp_c) AS lo FROM z GROUP BY ALL), "
    "q AS (SELECT run_id, zone, max(temp_c) AS peak, count(*) FILTER (WHERE temp_c > 26) AS ov FROM z GROUP BY ALL), "
    f"a AS (SELECT run_id, {_R('max(hi)')} AS peak_temp, {_R('min(lo)')} AS coldest_temp, count(*) FILTER (WHERE hi>26) AS OH_26, count(*) FILTER (WHERE hi>30) AS OH_30, count(*) FILTER (WHERE hi>35) AS OH_35, "
    "count(*) FILTER (WHERE lo<10) AS CH_10, count(*) FILTER (WHERE lo<5) AS CH_5 FROM h GROUP BY run_id), "
    f"b AS (SELECT run_id, {_R('avg(peak)')} AS peak_temp_avg, {_R('avg(ov)')} AS avg_overheat_per_zone, max(ov) AS hottest_zone FROM q GROUP BY run_id) "
    "SELECT a.*, b.* EXCLUDE (run_id) FROM a JOIN b USING (run_id)"
)
def comfort_summary(spark, sf_dir):
    return op.comfort_summary(zones(spark, sf_dir))


_T = "(temp_c*9.0::DOUBLE/5.0::DOUBLE+32.0::DOUBLE)"
_HI = (
    f"(-42.379::DOUBLE + 2.04901523::DOUBLE*{_T} + 10.14333127::DOUBLE*rh_pct - 0.22475541::DOUBLE*{_T}*rh_pct - 6.83783e-3::DOUBLE*{_T}*{_T} - 5.481717e-2::DOUBLE*rh_pct*rh_pct"
    f" + 1.22874e-3::DOUBLE*{_T}*{_T}*rh_pct + 8.5282e-4::DOUBLE*{_T}*rh_pct*rh_pct - 1.99e-6::DOUBLE*{_T}*{_T}*rh_pct*rh_pct)"
)


@REGISTRY.add(
    f"WITH {_ZONES_SQL}, c AS (SELECT run_id, hour, CASE WHEN {_HI}>=130 THEN 'Extreme Danger' WHEN {_HI}>=105 THEN 'Danger' WHEN {_HI}>=90 THEN 'Extreme Caution' WHEN {_HI}>=80 THEN 'Caution' ELSE 'Normal' END AS k FROM z), "
    "n AS (SELECT run_id, hour, k, row_number() OVER (PARTITION BY run_id, hour ORDER BY count(*) DESC, k) AS r FROM c GROUP BY run_id, hour, k) "
    "SELECT run_id, " + ", ".join(f"count(*) FILTER (WHERE k='{k}') AS hi_{k.lower().replace(' ', '_')}" for k in op.HEAT_CLASSES) + " FROM n WHERE r=1 GROUP BY run_id"
)
def heat_index_class_hours(spark, sf_dir):
    return op.heat_class_hours(zones(spark, sf_dir))


@REGISTRY.add(
    f"WITH {_ZONES_SQL} SELECT run_id, {sql_fixed('sum(greatest(temp_c-27.0::DOUBLE, 0.0::DOUBLE))', 4)} AS edh_hot, {sql_fixed('sum(greatest(22.0::DOUBLE-temp_c, 0.0::DOUBLE))', 4)} AS edh_cold, "
    f"{sql_fixed('sum(greatest(temp_c-27.0::DOUBLE, 0.0::DOUBLE)+greatest(22.0::DOUBLE-temp_c, 0.0::DOUBLE))', 4)} AS edh FROM z GROUP BY run_id"
)
def exceedance_degree_hours(spark, sf_dir):
    got = op.exceedance_hours(zones(spark, sf_dir), "temp_c")
    return got.withColumns({c: fixed(F.col(c), 4) for c in ("edh_hot", "edh_cold", "edh")})


def _runs_sql() -> str:
    parts = []
    for t in op.RUN_THRESHOLDS:
        for k, o in (("H", ">"), ("C", "<")):
            parts.append(
                f"SELECT run_id, 'P_{k}_{t}' AS k, max(n) AS n FROM (SELECT run_id, zone, g, count(*) AS n FROM (SELECT run_id, zone, hour, hour - row_number() OVER (PARTITION BY run_id, zone ORDER BY hour) AS g FROM z WHERE temp_c {o} {t}) GROUP BY ALL) GROUP BY run_id"
            )
    names = [f"P_{k}_{t}" for t in op.RUN_THRESHOLDS for k in ("H", "C")]
    return (
        f"WITH {_ZONES_SQL}, u AS ({' UNION ALL '.join(parts)}), r AS (SELECT DISTINCT run_id FROM z) SELECT r.run_id, "
        + ", ".join(f"coalesce(max(n) FILTER (WHERE k='{n}'), 0)::BIGINT AS {n}" for n in names) + " FROM r LEFT JOIN u USING (run_id) GROUP BY r.run_id"
    )


@REGISTRY.add(_runs_sql())
def longest_consecutive_runs(spark, sf_dir):
    """Longest run of hours above or below five thresholds, worst zone per run."""
    return op.longest_runs(zones(spark, sf_dir), ["run_id"], "zone")


@REGISTRY.add(
    f"WITH {_ZONES_SQL} SELECT run_id, zone, hour, CAST(sum(CASE WHEN temp_c > 26 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, zone ORDER BY hour) AS BIGINT) AS running FROM z"
)
def cumulative_overheated_hours(spark, sf_dir):
    got = op.running_count(zones(spark, sf_dir), ["run_id", "zone"], "hour", F.col("temp_c") > 26)
    return got.select("run_id", "zone", "hour", "running")


_INPUTS = "i_east, i_west, i_north, i_south, i_roof, equip_frac, light_frac"


def _grid_hours(spark, sf_dir):
    z = zones(spark, sf_dir).groupBy("hour").agg(F.avg("temp_c").alias("t"), F.avg("rh_pct").alias("r"))
    return z.selectExpr(
        "hour", "t - 15D AS dry_bulb_c", "r AS i_east", "r * 1.5D AS i_west", "r * 0.5D AS i_north", "r * 2D AS i_south", "r * 3D AS i_roof",
        "double(hour % 24) / 24D AS equip_frac", "double((hour + 6) % 24) / 24D AS light_frac",
    )


def _lvl(c, t):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in t.items()) + " END"


def _grid_sql() -> str:
    lists = {"roof": hb.ROOF_U, "wall": hb.WALL_U, "window": hb.WINDOWS, "leakage": hb.LEAKAGE}
    cross = ", ".join(f"(SELECT unnest({list(v)!r}) AS {k if k != 'window' else 'win'})" for k, v in lists.items())
    return (
        f"WITH {_ZONES_SQL}, h AS (SELECT hour, avg(temp_c)-15.0::DOUBLE AS t, avg(rh_pct) AS r, (hour % 24)::DOUBLE/24.0::DOUBLE AS ef, ((hour+6) % 24)::DOUBLE/24.0::DOUBLE AS lf FROM z GROUP BY hour), "
        f"g AS (SELECT *, {_lvl('roof', hb.ROOF_U)} AS ur, {_lvl('wall', hb.WALL_U)} AS uw, {_lvl('win', {k: v[0] for k, v in hb.WINDOWS.items()})} AS ug, {_lvl('win', {k: v[1] for k, v in hb.WINDOWS.items()})} AS sh, {_lvl('leakage', hb.LEAKAGE)} AS ach FROM {cross}), "
        "q AS (SELECT g.*, h.*, least(t-20, 0.0::DOUBLE)+greatest(t-20, 0.0::DOUBLE) AS dt FROM g, h), "
        "p AS (SELECT *, 224.0::DOUBLE*(1+1.5+0.5+2)*r*(0.12::DOUBLE*sh + 0.88::DOUBLE*uw/(10.0::DOUBLE+uw)*0.7::DOUBLE) + 3.0::DOUBLE*r*100.0::DOUBLE*0.7::DOUBLE*ur/(10.0::DOUBLE+ur) "
        "+ (uw*896.0::DOUBLE*0.88::DOUBLE + ur*100.0::DOUBLE + ug*896.0::DOUBLE*0.12::DOUBLE + ach*2240.0::DOUBLE/3600.0::DOUBLE*1.225::DOUBLE*1005.0::DOUBLE)*dt + 800.0::DOUBLE*(ef*3.1::DOUBLE+lf*2.2::DOUBLE) AS q FROM q) "
        f"SELECT roof, wall, win AS \"window\", leakage, {sql_fixed('sum(abs(least(q,0.0::DOUBLE)))/800.0::DOUBLE/1000.0::DOUBLE')} AS heating_eui, {sql_fixed('sum(greatest(q,0.0::DOUBLE))/800.0::DOUBLE/1000.0::DOUBLE')} AS cooling_eui, "
        f"{sql_fixed('sum(ef)*3.1::DOUBLE/1000.0::DOUBLE')} AS equipment_eui, {sql_fixed('sum(lf)*2.2::DOUBLE/1000.0::DOUBLE')} AS lighting_eui FROM p GROUP BY roof, wall, win, leakage"
    )


def grid_loads(spark, sf_dir):
    grid = hb.building_columns(hb.full_grid(_grid_hours(spark, sf_dir)))
    return hb.annual_loads(grid, ["roof", "wall", "window", "leakage"])


@REGISTRY.add(_grid_sql())
def heat_balance_option_grid(spark, sf_dir):
    """81 envelope variants over the hourly series: annual load intensities."""
    got = grid_loads(spark, sf_dir)
    return got.withColumns({c: fixed(F.col(c)) for c in ("heating_eui", "cooling_eui", "equipment_eui", "lighting_eui")})
