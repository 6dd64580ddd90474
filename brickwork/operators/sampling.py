"""Stratified draws with replacement, spec sampling and simple random samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions import draws as d
from brickwork.functions.rng import Keyed, with_row_key
from brickwork.functions.text import derive
from brickwork.operators.priors import PriorSet
from brickwork.operators.ranking import hash_rank
from brickwork.session import partitions_for


DRAWS_PER_TASK = 100_000


def resolve_stratum(df: DataFrame, field: str, aliases: Sequence[str] = ("epwzip_path", "epw_path")) -> str:
    """The stratification column: the field itself or the first alias present."""
    for name in (field, *aliases):
        if name in df.columns:
            return name
    raise ValueError(f"stratification field {field} not found, nor any of {list(aliases)}")


def draws_per_stratum(n_iter: int, n_strata: int, min_per_stratum: int, iteration: int) -> int:
    return max(n_iter // n_strata, min_per_stratum if iteration == 0 else 0)


def sample_equally(
    df: DataFrame, stratum: str, unique_key: str, n: int | Column, seed: int | str, draw: str = "draw_id"
) -> DataFrame:
    """``n`` rows per stratum, with replacement, in (stratum, draw) order.

    Rows get a dense rank inside their stratum (bucketed, so a stratum holding
    a third of the table is still ranked by many tasks), draws pick a rank, and
    the two meet in an equi-join on (stratum, rank), which is unique on the
    population side and therefore free of hot keys.
    """
    keyed_df, keyed = with_row_key(df, f"{seed}/order", [unique_key])
    ranked = hash_rank(
        keyed_df, [stratum], keyed.uniform("order"), [unique_key], "__rank"
    ).drop(*keyed.columns())
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size"))
    count = (n if isinstance(n, Column) else F.lit(n)).cast("bigint")
    # two-level expansion: the draws of one stratum are themselves spread over tasks
    last = F.floor((count - 1) / F.lit(DRAWS_PER_TASK))
    blocks = sizes.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    spread = blocks.repartition(partitions_for(df.sparkSession), stratum, "__k")
    first = F.col("__k") * DRAWS_PER_TASK
    wanted = spread.withColumn(
        draw, F.explode(F.sequence(first, F.least(first + DRAWS_PER_TASK, count) - 1))
    ).drop("__k")
    wanted, pick = with_row_key(wanted, f"{seed}/pick", [stratum, draw])
    wanted = wanted.withColumn(
        "__rank", (F.floor(pick.uniform("pick") * F.col("__size")) + 1).cast("bigint")
    ).drop("__size", *pick.columns())
    left = wanted.withColumnRenamed(stratum, "__s")
    on = left["__s"].eqNullSafe(ranked[stratum]) & (left["__rank"] == ranked["__rank"])
    return ranked.join(left, on).drop(left["__rank"]).drop("__s", "__rank")


def stratified_selection(
    df: DataFrame, field: str, unique_key: str, n_iter: int, iteration: int, *,
    min_per_stratum: int = 100, mode: str = "equal", aliases: Sequence[str] = ("epwzip_path", "epw_path"),
) -> DataFrame:
    if mode != "equal":
        raise NotImplementedError(f"{mode} sampling is not available")
    stratum = resolve_stratum(df, field, aliases)
    n_strata = df.select(F.count_distinct(stratum)).first()[0]
    n = draws_per_stratum(n_iter, max(n_strata, 1), min_per_stratum, iteration)
    return sample_equally(df, stratum, unique_key, n, seed=iteration)


def semantic_draws(fields: Mapping[str, Sequence[str] | tuple[float, float]]) -> PriorSet:
    """Uniform over the options of a categorical field or the range of a number."""
    made = {}
    for name, spec in fields.items():
        if all(isinstance(v, (int, float)) for v in spec) and len(spec) == 2:
            made[name] = d.uniform(*spec)
        else:
            made[name] = d.categorical(spec, [1.0] * len(spec))
    return PriorSet(made)


def spec_draws() -> PriorSet:
    """Basement, attic, exposed fraction, glazing ratio and floor height."""
    # Status options with their weights, and ranges.
    status = ("none", "occupied_unconditioned", "unoccupied_unconditioned", "occupied_conditioned", "unoccupied_conditioned")
    weights = (0.5, 0.125, 0.125, 0.125, 0.125)
    return PriorSet(
        {
            "basement": d.categorical(status, weights),
            "attic": d.categorical(status, weights),
            "exposed_basement_frac": d.uniform(0.1, 0.5),
            "wwr": d.uniform(0.05, 0.35),
            "f2f_height": d.uniform(2.3, 4.3),
        }
    )


ATTIC_ATTEMPTS = 20  # fixed value: draws before giving up
ATTIC_LIMIT = 2.5  # fixed value: in floor heights


def attic_height(df: DataFrame, keyed: Keyed, *, attic: str = "attic", short_edge: str = "short_edge", f2f: str = "f2f_height") -> DataFrame:
    """First of up to twenty drawn heights that fits; NULL without an attic.

    A row that has an attic but no fitting draw is flagged in ``attic_failed``.
    """
    occupied = f"{attic} IN ('occupied_unconditioned', 'occupied_conditioned', 'unoccupied_conditioned')"
    # fixed values: rise over run, occupied or conditioned versus neither
    low, high = f"CASE WHEN {occupied} THEN 6D/12D ELSE 4D/12D END", f"CASE WHEN {occupied} THEN 9D/12D ELSE 6D/12D END"
    tries = ", ".join(
        f"{short_edge} / 2D * (({low}) + (({high}) - ({low})) * {keyed.uniform_sql(f'attic_height/{i}')})"
        for i in range(ATTIC_ATTEMPTS)
    )
    fits = f"filter(array({tries}), h -> h <= {ATTIC_LIMIT}D * {f2f})"
    df = derive(df, {"attic_height": f"CASE WHEN {attic} <> 'none' THEN try_element_at({fits}, 1) END"})
    return derive(df, {"attic_failed": f"{attic} <> 'none' AND attic_height IS NULL"})


def use_fractions(df: DataFrame, keyed: Keyed, spaces: Sequence[str] = ("basement", "attic")) -> DataFrame:
    made = {
        f"{s}_use_fraction": (
            f"CASE WHEN {s} IN ('occupied_unconditioned', 'occupied_conditioned') "
            f"THEN 0.2D + 0.4D * {keyed.uniform_sql(f'{s}_use')} ELSE 0.0D END"
        )
        for s in spaces
    }
    return derive(df, made)


def sample_fraction(df: DataFrame, fraction: float, seed: int | str, ids: Sequence[str]) -> DataFrame:
    """A repeatable Bernoulli sample: a filter, no shuffle."""
    rows, keyed = with_row_key(df, seed, ids)
    return rows.filter(keyed.uniform("keep") < F.lit(fraction)).drop(*keyed.columns())


#: Parts into which a range of hashed keys is divided, and rows that one task may sort.
PARTS_LOG2, EDGE = 10, 1000


def sample_rows(df: DataFrame, n: int, seed: int | str, ids: Sequence[str]) -> DataFrame:
    """``n`` rows without replacement: those with the smallest hashed keys.

    Histograms of ever narrower ranges find where the n-th key lies; everything below
    is a filter, and only the rows of the last range, a few, are sorted.
    """
    rows, keyed = with_row_key(df, seed, ids)
    rows, own = rows.withColumn("__u", keyed.uniform("order")), keyed.columns()
    if n <= 0:
        return df.limit(0)
    u, low, width, left = F.col("__u"), 0.0, 1.0, n
    while width > 2.0**-40:
        # Widths are powers of two, so the bounds of the parts are exact.
        part = width / (1 << PARTS_LOG2)
        inside = rows.filter((u >= low) & (u < low + width)).groupBy(F.floor((u - low) / part).alias("part"))
        counts = {r["part"]: r["n"] for r in inside.agg(F.count("*").alias("n")).collect()}
        for at in sorted(counts):
            if counts[at] >= left:
                break
            left -= counts[at]
        else:
            return df  # fewer than n rows
        low, width = low + at * part, part
        if counts[at] <= EDGE:
            break
    edge = rows.filter((u >= low) & (u < low + width)).orderBy("__u", *ids).limit(left)
    return rows.filter(u < low).unionByName(edge).drop("__u", *own)
