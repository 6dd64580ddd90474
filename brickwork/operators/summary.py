"""Distribution summaries: mean, std, min, max and interpolated percentiles.

Three ways to the percentiles, chosen by what is known about group size:

* ``bounded``  - the caller states at most ``GROUP_LIMIT`` rows per group (an
  ensemble of n draws per building); the built-in ``percentile`` is used.  A
  larger figure takes the exact way.
* exact (default) - any group size.  A mergeable sketch brackets every wanted
  rank, a second pass counts the rows outside the brackets and keeps only the
  distinct values inside, and the exact order statistics are read from those.
* ``approximate`` - the sketch alone, on request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwork.operators.ranking import join_null_safe
from brickwork.session import cut_lineage

# Percentile labels of every summary.
PERCENTILES = {
    "p5": 0.05,
    "p10": 0.10,
    "p25": 0.25,
    "p50": 0.50,
    "p75": 0.75,
    "p90": 0.90,
    "p95": 0.95,
}
MOMENTS = ("mean", "std", "min", "max")
GROUP_LIMIT = 1_000_000
LISTED = (32, 1_000)  # rows of a group whose values are sorted as one array for each column
SKETCH_ACCURACY = 100_000


def clean(value: Column) -> Column:
    """NaN is a missing observation, as in the data-frame libraries."""
    return F.when(~F.isnan(value.cast("double")), value.cast("double"))


def _moments(value: str, prefix: str = "") -> list[Column]:
    return [
        F.avg(value).alias(f"{prefix}mean"),
        F.stddev_samp(value).alias(f"{prefix}std"),
        F.min(value).alias(f"{prefix}min"),
        F.max(value).alias(f"{prefix}max"),
    ]


def distribution_summary(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: dict[str, float] = PERCENTILES,
    *,
    rows_per_group: int | None = None,
    approximate: int | None = None,
) -> DataFrame:
    """One row per group with moments and percentile columns."""
    data = df.select(*keys, clean(F.col(value)).alias("__v"))
    probs = list(percentiles.values())
    if approximate is not None:
        stats = data.groupBy(*keys).agg(
            *_moments("__v"), F.percentile_approx("__v", probs, approximate).alias("__q")
        )
        return _unpack(stats, keys, percentiles)
    if rows_per_group is not None and rows_per_group <= GROUP_LIMIT:
        stats = data.groupBy(*keys).agg(
            *_moments("__v"), F.percentile("__v", F.array(*[F.lit(p) for p in probs])).alias("__q")
        )
        return _unpack(stats, keys, percentiles)
    return exact_percentiles(data, keys, "__v", percentiles, moments=True)


def _unpack(stats: DataFrame, keys: Sequence[str], percentiles: dict[str, float]) -> DataFrame:
    return stats.select(
        *keys, *MOMENTS, *[F.col("__q")[i].alias(p) for i, p in enumerate(percentiles)]
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: dict[str, float] = PERCENTILES,
    accuracy: int = SKETCH_ACCURACY,
    margin: float | None = None,
    moments: bool = False,
) -> DataFrame:
    """Linear-interpolated percentiles of groups of any size, in two scans.

    The first scan gives one sketch per group (and the moments, if wanted).  The
    second counts, per group and slot, the rows outside the brackets around the wanted
    ranks and the distinct values inside, whose share of the rows is about ``8 *
    len(percentiles) / accuracy``; repeated values collapse before the shuffle, so a
    value held by a third of all rows is one record.  Slots are walked on their own and
    shifted by the counts of earlier slots.  Brackets of groups above ``GROUP_LIMIT`` rows,
    which are few for their rows, are sent to the tasks, so rows of a large group stay
    where they are until their values have collapsed; rows of smaller groups meet their
    brackets in a join.  The sketches are written once.

    A rank that lies outside its bracket, which the sketch's accuracy rules out, is
    found by the built-in percentile over its group; adaptive execution drops this part
    when no group needs it.  ``margin`` is the half width of a bracket as a share of the
    rows.
    """
    ordered = sorted(percentiles.items(), key=lambda kv: kv[1])
    probs = [p for _, p in ordered]
    margin = 4.0 / accuracy if margin is None else margin
    low = [max(0.0, p - margin) for p in probs]
    high = [min(1.0, p + margin) for p in probs]
    single = not keys
    keys = ["__all"] if single else list(keys)
    data = (df.withColumn("__all", F.lit(0)) if single else df).select(*keys, clean(F.col(value)).alias("__v"))

    cuts = F.percentile_approx("__v", low + high, accuracy).alias("__cut")
    stats = data.groupBy(*keys).agg(F.count("__v").alias("__n"), cuts, *_moments("__v"))
    stats = cut_lineage(stats if moments else stats.filter("__n > 0"))
    small = F.col("__n") * margin < 4
    k = len(probs)
    shown = list(MOMENTS) if moments else []
    brackets = stats.select(
        *keys,
        "__n",
        *[
            F.when(small, F.lit(float("-inf"))).otherwise(F.col("__cut")[i]).alias(f"__lo{i}")
            for i in range(k)
        ],
        *[
            F.when(small, F.lit(float("inf"))).otherwise(F.col("__cut")[k + i]).alias(f"__hi{i}")
            for i in range(k)
        ],
    )
    rows = data.filter("__v IS NOT NULL")
    row = brackets.first() if single else None
    if row:  # one group: a single row of cut points becomes literals
        placed = rows.withColumns({c: F.lit(row[c]) for c in brackets.columns})
    else:
        placed = _placed(rows, brackets, keys)
    v = F.col("__v")
    inside = F.lit(False)
    slot = F.lit(0)
    for i in range(k):
        inside = inside | ((v >= F.col(f"__lo{i}")) & (v <= F.col(f"__hi{i}")))
        slot = slot + (v >= F.col(f"__lo{i}")).cast("int")
    counts = (
        placed.select(
            *keys, "__n", slot.alias("__slot"), F.when(inside, v).alias("__x")
        )
        .groupBy(*keys, "__n", "__slot", "__x")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    # Rows of earlier slots: at most one number for each percentile and group.
    earlier = counts.groupBy(*keys).agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("__slot") < j, F.col("__c"))), F.lit(0)) for j in range(k + 1)]).alias("__before")
    )
    walked = join_null_safe(counts, earlier, keys)
    # The outside rows of a slot follow its inside ones.
    walk = Window.partitionBy(*keys, "__slot").orderBy(F.col("__x").asc_nulls_last())
    upto = F.get("__before", F.col("__slot")) + F.sum("__c").over(walk.rowsBetween(Window.unboundedPreceding, 0))
    running = walked.withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col("__c"))

    def at(rank: Column) -> Column:
        hit = (F.col("__from") <= rank) & (rank < F.col("__upto"))
        return F.max(F.when(hit, F.col("__x")))

    picks = []
    for name, p in ordered:
        pos = (F.col("__n") - 1) * F.lit(p)
        picks += [
            at(F.floor(pos)).alias(f"{name}_0"),
            at(F.ceil(pos)).alias(f"{name}_1"),
        ]
    found = running.groupBy(*keys, "__n").agg(*picks)

    def blend(name: str, p: float) -> Column:
        pos = (F.col("__n") - 1) * F.lit(p)
        frac = pos - F.floor(pos)
        a, b = F.col(f"{name}_0"), F.col(f"{name}_1")
        return F.when(a == b, a).otherwise(a + (b - a) * frac).alias(name)

    names = list(percentiles)
    found = found.select(*keys, *[blend(n, p) for n, p in percentiles.items()])
    # Groups too small for a bracket miss nothing.
    missed = F.broadcast(found.filter(" OR ".join(f"`{n}` IS NULL" for n in names)).select(*keys))
    exact = F.percentile("__v", F.array(*[F.lit(p) for p in percentiles.values()])).alias("__exact")
    again = join_null_safe(rows, missed, keys).groupBy(*keys).agg(exact)
    found = join_null_safe(found, again, keys, "left")
    found = found.select(*keys, *[F.coalesce(F.col(n), F.get("__exact", F.lit(i))).alias(n) for i, n in enumerate(names)])
    if moments:
        found = join_null_safe(stats.select(*keys, *shown), found, keys, "left")
    return found.drop("__all")


def _placed(rows: DataFrame, brackets: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Every row beside its group's row of ``brackets``; groups of more than ``limit`` rows never meet in one task."""
    large = F.col("__n") > (GROUP_LIMIT if limit is None else limit)
    kinds = {bool(r[0]) for r in brackets.select(large).distinct().collect()}
    if True not in kinds:
        return join_null_safe(rows, brackets, keys)
    few = F.broadcast(brackets.filter(large))
    placed = join_null_safe(rows, few, keys)
    if kinds == {True}:
        return placed
    others = join_null_safe(rows, few.select(*keys), keys, "left_anti")
    return placed.unionByName(join_null_safe(others, brackets.filter(~large), keys))


def wide_summary(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    rows_per_group: int,
    percentiles: dict[str, float] = PERCENTILES,
    label: str = "name",
    *,
    nested: bool = False,
) -> DataFrame:
    """Summaries of many columns of an ensemble, for small groups in one aggregation.

    Works on the wide form (one row per draw) instead of exploding every draw
    into one row per column: when the ensemble was expanded on a partitioning
    by ``keys`` no shuffle is needed at all.  Minimum and maximum come from the
    same order statistics as the percentiles: the sorted values of a group within
    ``LISTED`` rows, the built-in aggregate's counted values of smaller and larger ones.  Groups above ``GROUP_LIMIT`` rows,
    which would not fit one task, give the same result through the long form.
    NaN is missing, as in ``distribution_summary``.  ``nested`` keeps the summaries of a
    group in one row, as the array ``items``.
    """
    df = df.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in values])
    if rows_per_group > GROUP_LIMIT:
        long = df.unpivot(list(keys), list(values), label, "__value")
        flat = distribution_summary(long, [*keys, label], "__value", percentiles)
        item = F.struct(*[c for c in flat.columns if c not in keys])
        return flat.groupBy(*keys).agg(F.collect_list(item).alias("items")) if nested else flat
    aggs, items = [], []
    for i, c in enumerate(values):
        aggs += [f"avg(`{c}`) AS m{i}", f"stddev_samp(`{c}`) AS s{i}"]
    if not LISTED[0] <= rows_per_group <= LISTED[1]:
        probs = ", ".join(f"{p!r}D" for p in (0.0, *percentiles.values(), 1.0))
        aggs += [f"percentile(`{c}`, array({probs})) AS q{i}" for i, c in enumerate(values)]
        stats = df.groupBy(*keys).agg(*[F.expr(a) for a in aggs])
        at = {p: j + 1 for j, p in enumerate(percentiles)} | {"min": 0, "max": len(percentiles) + 1}
        point = lambda i, name: f"q{i}[{at[name]}]"
    else:
        aggs += [f"collect_list(`{c}`) AS q{i}" for i, c in enumerate(values)]
        listed = df.groupBy(*keys).agg(*[F.expr(a) for a in aggs])
        own = [x for i in range(len(values)) for x in (f"m{i}", f"s{i}", f"sort_array(q{i}) AS q{i}", f"size(q{i}) - 1 AS n{i}")]
        stats = listed.selectExpr(*[f"`{k}`" for k in keys], *own)
        point = lambda i, name: _ordered(i, {"min": 0.0, "max": 1.0, **percentiles}[name])
    for i, c in enumerate(values):
        points = ", ".join(f"{point(i, name)} AS {name}" for name in ("min", "max", *percentiles))
        items.append(f"struct('{c}' AS `{label}`, m{i} AS mean, s{i} AS std, {points})")
    every = f"array({', '.join(items)})"
    return stats.selectExpr(*[f"`{k}`" for k in keys], f"{every} AS items" if nested else f"inline({every})")


def _ordered(i: int, p: float) -> str:
    """The interpolated percentile of the sorted array ``q{i}``, whose last position is ``n{i}``, as the built-in one gives it."""
    if p in (0.0, 1.0):
        return f"get(q{i}, {'0' if p == 0.0 else f'n{i}'})"
    pos = f"n{i} * {p!r}D"
    low, high = f"get(q{i}, int(floor({pos})))", f"get(q{i}, int(ceil({pos})))"
    return f"if({low} = {high}, {low}, (ceil({pos}) - {pos}) * {low} + ({pos} - floor({pos})) * {high})"
