"""Session settings and the checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, **extra: str
) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brickwork")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BRICKWORK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune_for_wide_rows(spark: SparkSession) -> None:
    """Keep generated methods small enough for the JIT compiler.

    HotSpot never compiles a method above 8000 bytes of bytecode; projections
    with hundreds of columns exceed that in one fused method and would run
    interpreted.  Below the limit Spark splits them instead.  A value the user
    chose is left alone.
    """
    key, default = "spark.sql.codegen.hugeMethodLimit", "65535"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, "8000")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a fresh local one in local mode.

    A machine-local folder is only ever used when the master is local; on a
    cluster a missing setting is an error, because executors could not read
    back what another machine wrote.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF
    )
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="brickwork-checkpoint-")
        spark.conf.set(CHECKPOINT_CONF, named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: survives the loss of any executor."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for(spark: SparkSession, weight: int = 1) -> int:
    """A partition count that adaptive coalescing leaves alone.

    Used before a row is expanded into ``weight`` rows: the rows are tiny at
    that point, so sizing by bytes would put the whole expansion in one task.
    """
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(base, spark.sparkContext.defaultParallelism) * max(1, weight)
