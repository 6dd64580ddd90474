"""Portfolio inference: buildings x draws, two scenarios, summaries.

The portfolio has one row per building: ``building_id``, ``area_m2``,
``current_solar_kw``, base features, and ``semantic__<field>_new`` for every
field some building changes.  All work between the expansion and the summary is
projection; the only shuffle moves the one-row-per-building table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.draws import Draw
from brickwork.functions.rng import Keyed, with_row_key
from brickwork.functions.text import derive
from brickwork.names import INCOME_BRACKETS, UNITS, UNITS_PER
from brickwork.operators.energy import add_results, result_columns
from brickwork.operators.priors import PriorSet, default_priors, expand_samples
from brickwork.operators.quantities import RuleSet
from brickwork.operators.retrofit import (
    add_cost_features, add_incentive_features, add_retrofit_economics, economics_columns, incentive_programs,
)
from brickwork.operators.summary import MOMENTS, PERCENTILES, wide_summary
from brickwork.session import tune_for_wide_rows

NEW = "_new"
Predictor = Callable[[DataFrame, str], DataFrame]


def draw_ensemble(
    portfolio: DataFrame, n: int, priors: PriorSet | None = None, seed: int = 42
) -> tuple[DataFrame, Keyed]:
    """Base rows repeated n times with every prior drawn; prior-owned columns go first."""
    priors = priors or default_priors()
    tune_for_wide_rows(portfolio.sparkSession)
    if "semantic__OnsiteSolar" not in portfolio.columns:
        portfolio = portfolio.withColumn("semantic__OnsiteSolar", F.lit("NoSolarPV"))
    base = portfolio.drop(*[c for c in priors.draws if c in portfolio.columns])
    rows, keyed = with_row_key(expand_samples(base, n), seed, ["building_id", "sample_id"])
    return priors.apply(rows, keyed), keyed


def _reading(draw: Draw, suffix: str, have: set[str]) -> Draw:
    """The same draw over the scenario's version of whatever it reads."""

    def alt(name: str) -> str:
        return name + suffix if name + suffix in have else name

    args = dict(draw.args)
    if draw.kind == "expression" and any(r + suffix in have for r in draw.reads):
        raise ValueError("an expression over a changed feature needs its own scenario draw")
    if "of" in args:
        args["of"] = alt(args["of"]) if isinstance(args["of"], str) else tuple(map(alt, args["of"]))
    if draw.kind == "by_value":
        args["cases"] = tuple((m, _reading(d, suffix, have)) for m, d in args["cases"])
        if args["otherwise"] is not None:
            args["otherwise"] = _reading(args["otherwise"], suffix, have)
    return Draw(draw.kind, args)


def apply_upgrade(
    df: DataFrame, priors: PriorSet, keyed: Keyed, fields: Iterable[str], suffix: str = NEW
) -> DataFrame:
    """Draw again only what depends on a field that changed in this row.

    Features outside the reach of the changed fields keep their column, so both
    scenarios share those draws.  A reached feature gets ``<feature><suffix>``:
    a fresh draw where one of its fields changed, the old draw elsewhere.
    """
    fields = list(fields)
    reach = {f: set(priors.downstream([f]).draws) for f in fields}
    redo = priors.downstream(fields)
    fresh = keyed.scoped("upgraded/")
    for layer in redo.layers():
        have = set(df.columns)
        made = {}
        for feature in layer:
            moved = " OR ".join(f"NOT `{f}` <=> `{f}{suffix}`" for f in fields if feature in reach[f])
            again = _reading(redo.draws[feature], suffix, have).sql(feature, fresh)
            made[feature + suffix] = f"CASE WHEN {moved} THEN {again} ELSE `{feature}` END"
        df = derive(df, made)
    return df


def infer(portfolio: DataFrame, n: int, predict: Predictor, priors: PriorSet | None = None, seed: int = 42) -> DataFrame:
    """The wide ensemble of one scenario with every normalized result column."""
    df, _ = draw_ensemble(portfolio, n, priors, seed)
    return add_results(predict(df, ""))


def infer_savings(
    portfolio: DataFrame,
    n: int,
    predict: Predictor,
    costs: RuleSet,
    incentives: RuleSet,
    priors: PriorSet | None = None,
    seed: int = 42,
    brackets: tuple[str, ...] = INCOME_BRACKETS,
) -> DataFrame:
    """Original, upgraded, delta and economics on the same draw, one row per draw."""
    priors = priors or default_priors()
    fields = [c.removesuffix(NEW) for c in portfolio.columns if c.startswith("semantic__") and c.endswith(NEW)]
    df, keyed = draw_ensemble(portfolio, n, priors, seed)
    df = apply_upgrade(df, priors, keyed, fields)
    df = add_results(predict(df, ""))
    df = add_results(predict(df, NEW), NEW)
    df = derive(df, {f"Delta_{c}": f"`{c}` - `{c}{NEW}`" for c in result_columns()})
    df = derive(df, {"saving_usd": "Delta_Total_FuelCost * area_m2"})
    df = add_cost_features(df, NEW)
    df = add_incentive_features(df, NEW)
    return add_retrofit_economics(df, costs, incentives, suffix=NEW, keyed=keyed, brackets=brackets)


def summarize_results(
    ensemble: DataFrame, n: int, columns: Sequence[str] | None = None, prefix: str = "", suffix: str = "", *, nested: bool = False
) -> DataFrame:
    """(building, normalization, dataset, segment) summaries with units.

    Gross figures are the normalized ones times the building's area, and every
    statistic here scales with a positive constant, so they are derived from
    the summary instead of summarizing a second set of columns.  ``nested`` keeps
    a building's summaries in its row, as the array ``results``.
    """
    cols = list(columns or result_columns())
    named = ensemble.select(
        "building_id", "area_m2", *[F.col(f"{prefix}{c}{suffix}").alias(c) for c in cols]
    )
    stats = [*MOMENTS, *PERCENTILES]
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])

    def shown(result: Column, own: dict[str, Column], normalization: Column, per: Column, scale: Column) -> list[Column]:
        total = result.startswith("Total_")
        dataset = F.when(total, F.substring_index(result, "_", -1)).otherwise(F.substring_index(result, "_", 1))
        segment = F.when(total, "Total").otherwise(F.substring_index(result, "_", -1))
        return [
            normalization.alias("normalization"), dataset.alias("dataset"), segment.alias("segment"),
            F.concat(F.element_at(unit, dataset), per).alias("units"), *[(own[s] * scale).alias(s) for s in stats],
        ]

    scales = {"Normalized": F.lit(1.0), "Gross": F.col("area_m2").cast("double")}
    if nested:
        rows = wide_summary(named, ["building_id", "area_m2"], cols, n, label="result", nested=True)
        both = lambda r: F.array(*[F.struct(*shown(r["result"], {s: r[s] for s in stats}, F.lit(k), F.lit(UNITS_PER[k]), v)) for k, v in scales.items()])
        return rows.select("building_id", F.flatten(F.transform("items", both)).alias("results"))
    flat = wide_summary(named, ["building_id", "area_m2"], cols, n, label="result")
    both = F.array(*[F.struct(F.lit(k).alias("normalization"), F.lit(UNITS_PER[k]).alias("per"), v.alias("scale")) for k, v in scales.items()])
    at = [F.col(f"__n.{c}") for c in ("normalization", "per", "scale")]
    return flat.withColumn("__n", F.explode(both)).select("building_id", *shown(F.col("result"), {s: F.col(s) for s in stats}, *at))


def summarize_economics(
    ensemble: DataFrame, n: int, costs: RuleSet, incentives: RuleSet, brackets: tuple[str, ...] = INCOME_BRACKETS
) -> DataFrame:
    """Cost, incentive, net cost and payback summaries per building."""
    cols = economics_columns(costs, incentives, brackets)
    flat = wide_summary(ensemble, ["building_id"], cols, n, label="quantity")
    years = F.col("quantity").startswith("payback")
    return flat.withColumn("units", F.when(years, "years").otherwise("USD"))


def _as_map(name: str) -> Column:
    """Entries of a bounded group as a map in key order."""

    def by_key(a: Column, b: Column) -> Column:
        return F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(0)

    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "v")), by_key)).alias("v")


def _nested_maps(entries: Column, names: Sequence[str]) -> Column:
    """The structs of an array as maps within maps by their fields ``names``, in key order, with ``v`` innermost."""
    name, rest = names[0], names[1:]
    if not rest:
        return F.map_from_entries(F.array_sort(F.transform(entries, lambda e: F.struct(e[name].alias(name), e["v"].alias("v")))))
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e[name])))
    inner = lambda k: _nested_maps(F.filter(entries, lambda e: e[name].eqNullSafe(k)), rest)
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias(name), inner(k).alias("v"))))


def respond(summary: DataFrame) -> DataFrame:
    """One nested JSON document per building from a result summary.

    A building has two normalizations of the fixed datasets and segments, so its
    entries are bounded by the vocabulary.  Nested summaries become documents where
    they are; long ones are gathered once.
    """
    if "results" not in summary.columns:
        row = F.struct("normalization", "dataset", "segment", "units", *MOMENTS, *PERCENTILES)
        summary = summary.groupBy("building_id").agg(F.collect_list(row).alias("results"))

    def entry(r: Column) -> Column:
        part = F.when(r["segment"] == "Total", "Total").otherwise("Disaggregation").alias("part")
        v = F.struct(*[r[c].alias(c) for c in ("units", *MOMENTS, *PERCENTILES)]).alias("v")
        return F.struct(part, *[r[c].alias(c) for c in ("normalization", "dataset", "segment")], v)

    entries = summary.select("building_id", F.transform("results", entry).alias("__entries"))
    maps = _nested_maps(F.col("__entries"), ["part", "normalization", "dataset", "segment"])
    return entries.select("building_id", F.to_json(maps).alias("response"))


def respond_retrofit(
    ensemble: DataFrame, n: int, costs: RuleSet, incentives: RuleSet, keyed: Keyed | None = None, brackets: tuple[str, ...] = INCOME_BRACKETS
) -> DataFrame:
    """One nested JSON document per building for the retrofit half of a savings answer.

    ``quantities`` holds every cost, incentive, net cost and payback with its units and
    statistics; ``metadata`` holds, for each income bracket, the programs that
    contributed with their mean amounts.  Both are bounded by the rule sets.
    """
    views = summarize_economics(ensemble, n, costs, incentives, brackets)
    views = views.select("building_id", "quantity", F.struct("units", *MOMENTS, *PERCENTILES).alias("v"))
    out = views.groupBy("building_id").agg(_as_map("quantity")).withColumnRenamed("v", "quantities")
    for b in brackets:
        programs = incentive_programs(ensemble, incentives, ["building_id"], b, keyed=keyed)
        out = out.join(programs.select("building_id", F.struct("items").alias(f"__{b}")), "building_id", "left")
    metadata = F.struct(*[F.col(f"__{b}").alias(b) for b in brackets]).alias("metadata")
    return out.select("building_id", F.to_json(F.struct("quantities", metadata)).alias("response"))
