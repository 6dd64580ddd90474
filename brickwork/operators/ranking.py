"""Dense ranks and splits that never sort a whole group in one task.

A window partitioned by a stratum puts that stratum in one task.  When the
order key is a hash, its leading part is a ready-made bucket: rows are ranked
inside (stratum, bucket) and shifted by the number of rows in earlier buckets.
Only the (stratum, bucket) counts, partially aggregated before the shuffle, are ever
seen by one task.  The number of buckets follows from the counted rows, so a bucket
stays as large as one task sorts well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 1 << 17


def bucket_number(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets for so many rows: one for every ``bucket_rows``, and one more for their rest."""
    return min(MOST_BUCKETS, rows // bucket_rows + 1)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys match, keeping one copy of each key."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _rank_in_buckets(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], name: str
) -> DataFrame:
    # one struct key: NULL fields compare equal, and the window, the counts and
    # the join all ask for the same distribution, so rows are shuffled once
    tagged = df.withColumn("__cell", F.struct(*keys, bucket)).drop(bucket)
    part = lambda f: F.col("__cell").getField(f)
    counts = tagged.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*[part(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    earlier = upto.orderBy(part(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("__cell").alias("__other"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    inside = tagged.withColumn(
        "__in", F.row_number().over(Window.partitionBy("__cell").orderBy(*order))
    )
    return (
        inside.join(offsets, F.col("__cell") == F.col("__other"))
        .withColumn(name, F.col("__in") + F.col("__before"))
        .drop("__in", "__before", "__cell", "__other")
    )


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    unit: Column,
    tie: Sequence[str],
    name: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """1-based dense rank inside ``keys`` ordered by a uniform hash in (0, 1).

    ``tie`` must make the order total, so the rank is the same on every retry.  The
    rows are counted unless the number of ``buckets`` is given.
    """
    buckets = buckets or bucket_number(df.count())
    tagged = df.withColumn("__u", unit).withColumn(
        "__b", F.floor(F.col("__u") * buckets).cast("int")
    )
    return _rank_in_buckets(
        tagged, keys, "__b", [F.col("__u"), *[F.col(t) for t in tie]], name
    ).drop("__u")


def bucket_of(col: Column, bounds: Sequence[float]) -> Column:
    """Number of ``bounds``, ascending, that are at most ``col``: a binary search in an array."""
    if not bounds:
        return F.lit(0)
    known = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    ahead = lambda low, step: F.when(F.get(known, low + step - 1) <= col, low + step).otherwise(low)
    return F.aggregate(steps, F.lit(0), ahead)


def dense_index(
    df: DataFrame, key: str, name: str = "sort_index", buckets: int | None = None
) -> DataFrame:
    """0-based position in the order of a unique numeric ``key``.

    Bucket bounds are approximate quantiles, one for each bucket of counted rows, so
    clustered keys still spread evenly over tasks.
    """
    buckets = buckets or bucket_number(df.count())
    bounds: list = []
    if buckets > 1:
        probs = [i / buckets for i in range(1, buckets)]
        found = df.select(F.percentile_approx(key, probs, max(10_000, 8 * buckets))).first()[0]
        bounds = sorted(set(found or []))
    tagged = df.withColumn("__b", bucket_of(F.col(key), bounds))
    ranked = _rank_in_buckets(tagged, [], "__b", [F.col(key)], name)
    return ranked.withColumn(name, F.col(name) - 1)


def stratified_folds(
    df: DataFrame,
    strata: Sequence[str],
    unit: Column,
    tie: Sequence[str],
    folds: int,
    name: str = "fold",
) -> DataFrame:
    """Every ``folds``-th row of the shuffled stratum belongs to the same fold."""
    ranked = hash_rank(df, strata, unit, tie, "__rank")
    return ranked.withColumn(
        name, ((F.col("__rank") - 1) % folds).cast("int")
    ).drop("__rank")


def split_label(fold: Column, test_fold: int | Column) -> Column:
    other = test_fold if isinstance(test_fold, Column) else F.lit(test_fold)
    return F.when(fold == other, "test").otherwise("train")


def stride_select(
    df: DataFrame, index: str, path: Sequence[tuple[int, int]]
) -> DataFrame:
    """Rows kept by successive ``[offset::factor]`` slices of the ordered list.

    The list is renumbered after each slice, so the whole path collapses to one
    congruence on the dense index: a filter, not a sequence of passes.
    """
    modulus, residue = 1, 0
    for factor, offset in path:
        residue += modulus * offset
        modulus *= factor
    return df.filter(F.col(index) % modulus == residue)


def training_prefixes(
    ranked: DataFrame, rank: str, total: str, fractions: Sequence[float]
) -> DataFrame:
    """One copy of a row per fraction whose shuffled prefix contains it."""
    kept = F.filter(
        F.array(*[F.lit(float(f)) for f in fractions]),
        lambda f: F.col(rank) <= F.floor(f * F.col(total)),
    )
    return ranked.withColumn("fraction", F.explode(kept))


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
