"""Helpers shared by the corpus operators: tables, row remainders, prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickwork.session import checkpoint_root

#: White space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
PREFIX_BLOCK = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text), F.lit(divisor))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh table in the shared folder and read again.

    Cuts the lineage in a form that outlives every executor; what was computed
    once (tokens, fingerprints, counts) is never computed a second time.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/brickwork-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the bytes of the Arrow batches that whole texts travel in, unless the user has set a bound."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
    if spark.conf.get(key, default) in (default, f"{default}b", "64MB", "64m"):
        spark.conf.set(key, str(size))


def queue_key(column: str) -> Column:
    """A non-null text key of a nullable grouping column; nulls sort last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(column).cast("string")), F.lit("1"))


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over smaller ``order`` within ``keys``; ``order`` is a dense long.

    Two levels: sums of blocks of 4096 positions, then positions inside a block,
    so no task ever walks all positions of a key.
    """
    block = F.floor(F.col(order) / PREFIX_BLOCK)
    rows = df.withColumn("_block", block)
    sums = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(sums, [*keys, "_block"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_block", "_base", "_in")


def grouped(batches: Iterator, keys: list[str], rows: int) -> Iterator:
    """Pandas batches of whole groups, about ``rows`` rows each, from sorted batches."""
    import pandas as pd

    held: list = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame[keys] != frame[keys].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held, n = [frame.iloc[cut:]], len(frame) - cut
    if n:
        yield pd.concat(held, ignore_index=True)
