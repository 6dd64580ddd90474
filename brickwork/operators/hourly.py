"""Hourly weather and zone series: summaries, comfort, longest runs.

Long tables throughout: ``weather(station, hour, dry_bulb_c)`` and
``zones(run_id, zone, hour, temp_c, rh_pct)``.  Every operator first reduces to
(series, hour) or (series, day); what a later window or median sees is bounded
by the calendar, not by the number of readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwork.functions.rounding import half_even
from brickwork.names import DAYS_PER_MONTH

HEATING_BASE, COOLING_BASE = 18.0, 23.0  # fixed values
COMFORT_BAND = (22.0, 27.0)  # fixed value
RUN_THRESHOLDS = (5, 10, 26, 30, 35)  # fixed value
HEAT_CLASSES = ("Extreme Danger", "Danger", "Extreme Caution", "Caution", "Normal")


def month_of_hour(hour: Column) -> Column:
    """Calendar month (1-12) of an hour of a 365-day year."""
    day, upto, out = F.floor(hour / 24), 0, F.lit(None).cast("int")
    starts = []
    for m, n in enumerate(DAYS_PER_MONTH, 1):
        starts.append((upto, m))
        upto += n
    for start, m in starts:
        out = F.when(day >= start, F.lit(m)).otherwise(out)
    return F.when(day < upto, out)


def to_hourly(df: DataFrame, series: Sequence[str], hour: Column, value: Column) -> DataFrame:
    """Mean reading per series and hour; partially aggregated before the shuffle."""
    return df.groupBy(*series, hour.alias("hour")).agg(F.avg(value).alias("temp_c"))


def weather_summary(hourly: DataFrame, station: str = "station", temp: str = "dry_bulb_c", *, day: str = "day", month: str = "month") -> DataFrame:
    """Annual and monthly figures per station, one row per (station, period).

    ``period`` is 0 for the year and 1-12 for months.  The "days" figures count
    hours beyond the base temperature divided by 24.
    """
    daily = hourly.groupBy(station, month, day).agg(
        F.count_if(F.col(temp) < HEATING_BASE).alias("h_cold"),
        F.count_if(F.col(temp) > COOLING_BASE).alias("h_warm"),
        F.min(temp).alias("lo"), F.max(temp).alias("hi"), F.median(temp).alias("mid"),
    )
    both = daily.withColumn("period", F.explode(F.array(F.lit(0), F.col(month).cast("int"))))
    return both.groupBy(station, "period").agg(
        (F.sum("h_cold") / 24.0).alias("days_below_base"),
        (F.sum("h_warm") / 24.0).alias("days_above_base"),
        F.min("lo").alias("daily_min"), F.max("hi").alias("daily_max"),
        F.median("mid").alias("daily_median_median"), F.median("lo").alias("daily_min_median"),
        F.median("hi").alias("daily_max_median"), F.median(F.col("hi") - F.col("lo")).alias("daily_range_median"),
    )


WEATHER_STATS = (
    "days_below_base", "days_above_base", "daily_min", "daily_max", "daily_median_median",
    "daily_min_median", "daily_max_median", "daily_range_median",
)


def weather_features(summary: DataFrame, station: str = "station", stats: Sequence[str] = WEATHER_STATS) -> DataFrame:
    """One wide row per station: ``annual_*`` and ``monthly_*_MM`` columns."""
    aggs = []
    for s in stats:
        aggs.append(F.max(F.when(F.col("period") == 0, F.col(s))).alias(f"annual_{s}"))
        aggs += [F.max(F.when(F.col("period") == m, F.col(s))).alias(f"monthly_{s}_{m:02d}") for m in range(1, 13)]
    return summary.groupBy(station).agg(*aggs)


def heat_index_f(temp_c: Column, rh: Column) -> Column:
    """Rothfusz regression in Fahrenheit, applied at every temperature."""
    t = temp_c * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)
    # fixed values: regression coefficients
    return (
        F.lit(-42.379) + F.lit(2.04901523) * t + F.lit(10.14333127) * rh - F.lit(0.22475541) * t * rh
        - F.lit(6.83783e-3) * t * t - F.lit(5.481717e-2) * rh * rh + F.lit(1.22874e-3) * t * t * rh
        + F.lit(8.5282e-4) * t * rh * rh - F.lit(1.99e-6) * t * t * rh * rh
    )


def heat_class(index_f: Column) -> Column:
    return (
        F.when(index_f >= 130, "Extreme Danger").when(index_f >= 105, "Danger")
        .when(index_f >= 90, "Extreme Caution").when(index_f >= 80, "Caution").otherwise("Normal")
    )


def heat_class_hours(zones: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Hours per heat class after a plurality vote of the zones of each hour.

    A tie goes to the alphabetically first label.  The vote is five counters per
    (run, hour), so no zone list is ever gathered.
    """
    label = heat_class(heat_index_f(F.col("temp_c"), F.col("rh_pct")))
    counts = zones.groupBy(*run, "hour").agg(
        *[F.count_if(label == c).alias(c) for c in sorted(HEAT_CLASSES)]
    )
    top = F.greatest(*[F.col(f"`{c}`") for c in HEAT_CLASSES])
    winner = F.coalesce(*[F.when(F.col(f"`{c}`") == top, F.lit(c)) for c in sorted(HEAT_CLASSES)])
    return counts.withColumn("__w", winner).groupBy(*run).agg(
        *[F.count_if(F.col("__w") == c).alias("hi_" + c.lower().replace(" ", "_")) for c in HEAT_CLASSES]
    )


def comfort_summary(zones: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Peaks and hours beyond thresholds; all NULL for runs without temperatures."""
    t = F.when(~F.isnan("temp_c"), F.col("temp_c"))
    z = zones.withColumn("temp_c", t)
    hours = z.groupBy(*run, "hour").agg(F.max("temp_c").alias("hi"), F.min("temp_c").alias("lo"))

    def n(cond: Column, name: str) -> Column:
        return F.when(F.count("hi") > 0, F.count_if(cond)).alias(name)

    per_run = hours.groupBy(*run).agg(
        half_even(F.max("hi"), 2).alias("peak_temp"), half_even(F.min("lo"), 2).alias("coldest_temp"),
        n(F.col("hi") > 26, "OH_26"), n(F.col("hi") > 30, "OH_30"), n(F.col("hi") > 35, "OH_35"),
        n(F.col("lo") < 10, "CH_10"), n(F.col("lo") < 5, "CH_5"),
    )
    per_zone = z.groupBy(*run, "zone").agg(F.max("temp_c").alias("peak"), F.count_if(F.col("temp_c") > 26).alias("over"), F.count("temp_c").alias("n"))
    seen = F.when(F.col("n") > 0, F.col("over"))
    zones_agg = per_zone.groupBy(*run).agg(
        half_even(F.avg("peak"), 2).alias("peak_temp_avg"), half_even(F.avg(seen), 2).alias("avg_overheat_per_zone"), F.max(seen).alias("hottest_zone"),
    )
    return per_run.join(zones_agg, list(run))


def exceedance_hours(df: DataFrame, value: str = "set_c", run: Sequence[str] = ("run_id",), band: tuple[float, float] = COMFORT_BAND) -> DataFrame:
    """Degree hours above and below the comfort band of a supplied temperature."""
    hot = F.greatest(F.col(value) - F.lit(band[1]), F.lit(0.0))
    cold = F.greatest(F.lit(band[0]) - F.col(value), F.lit(0.0))
    return df.groupBy(*run).agg(F.sum(hot).alias("edh_hot"), F.sum(cold).alias("edh_cold")).withColumn(
        "edh", F.col("edh_hot") + F.col("edh_cold")
    )


def longest_runs(hourly: DataFrame, run: Sequence[str], zone: str, thresholds: Sequence[float] = RUN_THRESHOLDS) -> DataFrame:
    """Longest run of consecutive hours beyond each threshold, worst zone per run.

    ``P_H_<t>`` counts hours above, ``P_C_<t>`` below.  All conditions share one
    sort by hour: the start of the current run is the last hour that broke it.
    """
    w = Window.partitionBy(*run, zone).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    conds = {f"P_H_{t}": F.col("temp_c") > t for t in thresholds} | {f"P_C_{t}": F.col("temp_c") < t for t in thresholds}
    gap = F.col("hour") - F.coalesce(F.lag("hour").over(Window.partitionBy(*run, zone).orderBy("hour")), F.col("hour") - 1) > 1
    base = hourly.withColumn("__gap", gap)
    # a missing hour breaks a run: the hour before the current reading counts as a break
    broke = {
        k: F.max(
            F.when(~F.coalesce(c, F.lit(False)), F.col("hour")).when(F.col("__gap"), F.col("hour") - 1)
        ).over(w)
        for k, c in conds.items()
    }
    first = F.min("hour").over(w) - 1
    lengths = base.select(
        *run, zone,
        *[F.when(F.coalesce(c, F.lit(False)), F.col("hour") - F.coalesce(broke[k], first)).otherwise(0).alias(k) for k, c in conds.items()],
    )
    return lengths.groupBy(*run).agg(*[F.max(k).alias(k) for k in conds])


def running_count(df: DataFrame, keys: Sequence[str], order: str, cond: Column, name: str = "running") -> DataFrame:
    """Cumulative number of hours satisfying ``cond`` within a series."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(cond.cast("int")).over(w))
