"""Feature spaces, encoding, fold metrics and convergence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.text import derive, sql_list
from brickwork.operators.validation import domain_report


#: Most options of a feature that are written into a plan; more are joined as a table.
LITERALS = 1000


@dataclass(frozen=True)
class FeatureSpace:
    """Ordered features: a tuple of options, or a (low, high) range."""

    features: Mapping[str, tuple]

    def options(self) -> dict[str, tuple[str, ...]]:
        return {f: v for f, v in self.features.items() if v and isinstance(v[0], str)}

    def ranges(self) -> dict[str, tuple[float, float]]:
        return {f: v for f, v in self.features.items() if not (v and isinstance(v[0], str))}

    def check(self, df: DataFrame) -> DataFrame:
        return domain_report(df, self.options(), self.ranges())

    def codes(self, read: Callable[[str], str]) -> dict[str, str]:
        """SQL text of every encoded feature; ``read`` names the column that a feature is read from.

        Ordinal codes (-1 when unseen) and min-max scaled numbers.
        """
        out = {}
        for f, v in self.features.items():
            if v and isinstance(v[0], str):
                out[f] = f"coalesce(double(array_position(array({sql_list(v)}), {read(f)}) - 1), -1D)"
            else:
                out[f] = f"try_divide(double({read(f)}) - {v[0]!r}D, {v[1] - v[0]!r}D)"
        return out

    def encode(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Encoded features in space order; features with many options are looked up in a table of them."""
        large = [f for f, v in self.options().items() if len(v) > LITERALS]
        looked_up = {}
        for k, f in enumerate(large):
            rows = df.sparkSession.createDataFrame([(o, float(i)) for i, o in enumerate(self.features[f])], f"__o{k} string, __c{k} double")
            df = df.join(rows, F.col(f"`{f}`") == F.col(f"__o{k}"), "left")
            looked_up[f] = f"coalesce(__c{k}, -1D)"
        small = FeatureSpace({f: v for f, v in self.features.items() if f not in large}).codes(lambda f: f"`{f}`")
        return df.selectExpr(*[f"`{c}`" for c in keep], *[f"{ {**small, **looked_up}[f]} AS `{f}`" for f in self.features])

    def table(self, spark) -> DataFrame:
        rows = [
            (f, "categorical", None, None, list(v)) if v and isinstance(v[0], str) else (f, "continuous", float(v[0]), float(v[1]), None)
            for f, v in self.features.items()
        ]
        return spark.createDataFrame(rows, "name string, kind string, min double, max double, values array<string>")

    @classmethod
    def from_table(cls, df: DataFrame) -> FeatureSpace:
        rows = df.collect()  # one row per feature
        return cls({r["name"]: tuple(r["values"]) if r["kind"] == "categorical" else (r["min"], r["max"]) for r in rows})


def categorical_domains(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, options) over the whole data, sorted; distinct before gathering."""
    pairs = ", ".join(f"struct('{c}' AS feature, `{c}` AS option)" for c in columns)
    seen = df.selectExpr(f"inline(array({pairs}))").filter("option IS NOT NULL").distinct()
    return seen.groupBy("feature").agg(F.array_sort(F.collect_list("option")).alias("options"))


def numeric_bounds(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, low, high) on training rows, widened to the next 0.001."""
    bounds = train.selectExpr(*[x for c in columns for x in (f"min(`{c}`) AS `lo_{c}`", f"max(`{c}`) AS `hi_{c}`")])
    pairs = ", ".join(
        f"struct('{c}' AS feature, floor(double(`lo_{c}`) * 1000D) / 1000D AS low, ceil(double(`hi_{c}`) * 1000D) / 1000D AS high)" for c in columns
    )
    return bounds.selectExpr(f"inline(array({pairs}))")


def learn_space(data: DataFrame, train: DataFrame, features: Sequence[str], categorical: Sequence[str]) -> FeatureSpace:
    options = {r["feature"]: tuple(r["options"]) for r in categorical_domains(data, categorical).collect()} if categorical else {}
    numeric = [f for f in features if f not in categorical]
    bounds = {r["feature"]: (r["low"], r["high"]) for r in numeric_bounds(train, numeric).collect()} if numeric else {}
    return FeatureSpace({f: options[f] if f in categorical else bounds[f] for f in features})


def metric_columns(target: Column, estimate: Column) -> list[Column]:
    """Aggregates: mae, rmse, r2, cvrmse, mape of one pair of columns."""
    e = estimate - target
    rmse = F.sqrt(F.avg(e * e))
    shifted = target + F.lit(1e-5)
    eps = 2.220446049250313e-16  # fixed value: smallest divisor of the percentage error
    return [
        F.avg(F.abs(e)).alias("mae"),
        rmse.alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(target))).alias("r2"),
        F.try_divide(rmse, F.avg(target) + F.lit(1e-5)).alias("cvrmse"),
        F.avg(F.abs(estimate - shifted) / F.greatest(F.abs(shifted), F.lit(eps))).alias("mape"),
    ]


METRICS = ("mae", "rmse", "r2", "cvrmse", "mape")


def regression_metrics(predictions: DataFrame, keys: Sequence[str], stratum: str | None = None, target: str = "target_value", estimate: str = "prediction") -> DataFrame:
    """Metrics per key and, with a stratum, per (key, stratum) and overall in one pass.

    The overall rows have a NULL stratum and a true ``overall``, which tells them
    from rows whose stratum is NULL in the data.  Per-group sums are combined
    before the shuffle; group size does not matter.
    """
    aggs = metric_columns(F.col(target), F.col(estimate))
    if stratum is None:
        return predictions.groupBy(*keys).agg(*aggs)
    sets = [[F.col(k) for k in (*keys, stratum)], [F.col(k) for k in keys]]
    return predictions.groupingSets(sets, *keys, stratum).agg(*aggs, (F.grouping(stratum) == 1).alias("overall"))


def long_metrics(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics.unpivot(list(keys), list(METRICS), "metric", "value")


def fold_average(metrics: DataFrame, keys: Sequence[str] = ("measurement", "target", "metric", "stratum")) -> DataFrame:
    """Mean over folds of the test metrics."""
    return metrics.filter("split = 'test'").groupBy(*keys).agg(F.avg("value").alias("value"))


# Default convergence targets.
THRESHOLDS = {"mae": 0.5, "rmse": 0.5, "mape": 0.15, "r2": 0.95, "cvrmse": 0.05}


def converged_pairs(averages: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS, measurement: str = "Energy") -> DataFrame:
    """(stratum, target, converged): any metric of the pair within its threshold."""
    whens = " ".join(
        f"WHEN '{m}' THEN value {'>' if m == 'r2' else '<'} {t!r}D" for m, t in thresholds.items()
    )
    hit = derive(averages.filter(F.col("measurement") == measurement), {"ok": f"coalesce(CASE metric {whens} END, false)"})
    return hit.groupBy("stratum", "target").agg(F.bool_or("ok").alias("converged"))


def converged(pairs: DataFrame) -> DataFrame:
    """One row: every target in every stratum converged."""
    return pairs.groupBy("stratum").agg(F.bool_and("converged").alias("c")).agg(F.coalesce(F.bool_and("c"), F.lit(False)).alias("converged"))


def annual_targets(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Monthly energy summed and monthly peaks maximized, per meter."""
    both = results.groupBy(*keys, "measurement", "meter").agg(F.sum("value").alias("s"), F.max("value").alias("m"))
    return both.select(*keys, "measurement", "meter", F.when(F.col("measurement") == "Peak", F.col("m")).otherwise(F.col("s")).alias("value"))

