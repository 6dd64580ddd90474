"""Histograms, densities, regressions, argmax shares: one aggregation each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.operators.ranking import join_null_safe
from brickwork.operators.summary import exact_percentiles


def binned_counts(df: DataFrame, value: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per lower bin edge."""
    return df.groupBy(*keys, (F.floor(F.col(value) / F.lit(width)) * F.lit(width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    return F.least(F.floor((value - F.lit(low)) / F.lit((high - low) / bins)).cast("int"), F.lit(bins - 1))


def _known(df: DataFrame, *values: str) -> DataFrame:
    """Rows whose values are neither NULL nor NaN."""
    for v in values:
        df = df.filter(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    return df


def _ranges(df: DataFrame, *values: str) -> list[tuple[float, float]]:
    """(low, high) per column; a single value gets half a unit on either side, no value (0, 1)."""
    row = df.agg(*[f(v).cast("double") for v in values for f in (F.min, F.max)]).first()
    out = []
    for low, high in zip(row[::2], row[1::2]):
        if low is None:
            low, high = 0.0, 1.0
        out.append((low - 0.5, high + 0.5) if low == high else (low, high))
    return out


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram over the data range, empty bins included; NULL and NaN are left out."""
    inside = _known(df, value)
    [(low, high)] = _ranges(inside, value)
    counts = inside.groupBy(_bin(F.col(value), low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    step = (high - low) / bins
    return edges.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(step)).alias("low"), F.coalesce("n", F.lit(0)).alias("n")
    )


def histogram_2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Counts per occupied cell of an equal-width grid; rows without both values are left out."""
    df = _known(df, x, y)
    (x0, x1), (y0, y1) = _ranges(df, x, y)
    return df.groupBy(_bin(F.col(x), x0, x1, bins).alias("x_bin"), _bin(F.col(y), y0, y1, bins).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def kernel_density(df: DataFrame, value: str, points: int, keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian density on an even grid over the data range, Scott bandwidth.

    Every grid point is one aggregate of the same scan: rows are not multiplied
    by the grid, and a task ships ``points`` partial sums per group.  NULL keys
    are a group; a group without spread has NULL densities.
    """
    df = _known(df, value)
    [(low, high)] = _ranges(df, value)
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]
    spread = F.nullif(F.stddev_samp(value), F.lit(0.0))
    band = df.groupBy(*keys).agg((spread * F.pow(F.count(value), F.lit(-0.2))).alias("h"))
    df = join_null_safe(df, band, keys) if keys else df.crossJoin(F.broadcast(band))  # one row
    z = [f"avg(exp(-0.5D * pow((`{value}` - {g!r}D) / h, 2)) / (h * {math.sqrt(2 * math.pi)!r}D)) AS d{i}" for i, g in enumerate(grid)]
    wide = df.groupBy(*keys).agg(*[F.expr(e) for e in z])
    items = ", ".join(f"struct({i} AS point, {g!r}D AS x, d{i} AS density)" for i, g in enumerate(grid))
    return wide.selectExpr(*keys, f"inline(array({items}))")


def density_mode(density: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return density.groupBy(*keys).agg(F.max_by("x", F.struct("density", -F.col("x"))).alias("mode"))


def simple_regression(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def peak_share(df: DataFrame, run: Sequence[str], label: str, value: str) -> DataFrame:
    """Share of runs whose largest value carries each label; ties to the lower label."""
    top = df.groupBy(*run).agg(F.max_by(label, F.struct(value, -F.col(label))).alias(label))
    counts = top.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).first()["t"]
    return counts.select(label, (F.col("n") / F.lit(total)).alias("share"))


def group_mean_std(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")).orderBy(*keys)


def pass_rate(df: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Share below the threshold with the best and worst value."""
    return df.groupBy(*keys).agg(
        F.avg((F.col(value) < threshold).cast("int")).alias("pass_rate"), F.min(value).alias("best"), F.max(value).alias("worst")
    )


def worst_fit(df: DataFrame, residual: Column, carry: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The row with the largest absolute residual, ties to the smaller carried values."""
    picked = F.max_by(F.struct(*carry), F.struct(F.abs(residual), *[-F.col(c) for c in carry[:1]]))
    return df.groupBy(*keys).agg(picked.alias("w"), F.max(F.abs(residual)).alias("abs_residual")).select(*keys, "w.*", "abs_residual")


W_M2_TO_BTU_H_FT2 = 0.316998  # fixed value


def peak_rate(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """kW/m2 as Btu/(h ft2): mean and exact median."""
    rate = df.select(*keys, (F.col(value) * F.lit(1000.0 * W_M2_TO_BTU_H_FT2)).alias("rate"))
    mean = rate.groupBy(*keys).agg(F.avg("rate").alias("mean"))
    return join_null_safe(mean, exact_percentiles(rate, keys, "rate", {"median": 0.5}), keys)
