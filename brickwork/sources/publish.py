"""Tables that appear whole or not at all.

Rows are written aside, in a folder that no reader looks into, and become readable by
one rename of that folder.  A write that fails on the way leaves nothing readable.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

BATCH = "frames-"


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``, sorted; hidden ones are left out."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return []
    names = (x.getPath().getName() for x in fs.listStatus(place) if x.isDirectory())
    return sorted(n for n in names if n[0] not in "._")


def _remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, place = _at(spark, old)
    _, goal = _at(spark, new)
    fs.mkdirs(goal.getParent())
    if fs.exists(goal):
        raise FileExistsError(new)
    if not fs.rename(place, goal):
        raise OSError(f"{old} could not be moved to {new}")


def publish(df: DataFrame, path: str, existing: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """``df`` as a parquet table at ``path``; what stood there stays readable until the new rows are written."""
    if existing not in ("forbid", "overwrite"):
        raise ValueError(f"existing tables are kept (forbid) or replaced (overwrite), not {existing!r}")
    spark = df.sparkSession
    if existing == "forbid" and exists(spark, path):
        raise FileExistsError(path)
    parent, _, name = path.rstrip("/").rpartition("/")
    aside = f"{parent}/.aside-{name}-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*partition_by).parquet(aside) if partition_by else df.write.parquet(aside)
        if existing == "overwrite":
            _remove(spark, path)
        _rename(spark, aside, path)
    finally:
        _remove(spark, aside)
    return path


def publish_frames(frames: Mapping[str, DataFrame], root: str, existing: str = "forbid") -> dict[str, str]:
    """All frames as one batch below ``root``: either every key becomes readable, or none.

    The newest batch that holds a key is the one that is read; with
    ``existing="forbid"`` a key that is already there refuses the whole batch.
    """
    if existing not in ("forbid", "overwrite"):
        raise ValueError(f"existing keys are kept (forbid) or replaced (overwrite), not {existing!r}")
    if not frames:
        return {}
    spark = next(iter(frames.values())).sparkSession
    there = frame_places(spark, root)
    taken = sorted(set(there) & set(frames))
    if existing == "forbid" and taken:
        raise FileExistsError(", ".join(there[k] for k in taken))
    batch = f"{BATCH}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    aside = f"{root}/.aside-{batch}"
    try:
        for key, df in frames.items():
            df.write.parquet(f"{aside}/{key}")
        _rename(spark, aside, f"{root}/{batch}")
    finally:
        _remove(spark, aside)
    for key in taken:  # no longer read by anyone who looks now
        _remove(spark, there[key])
    return {k: f"{root}/{batch}/{k}" for k in frames}


def frame_places(spark: SparkSession, root: str) -> dict[str, str]:
    """Key to place of every readable frame below ``root``, found by listing.

    Folders that were not written as a batch are frames of their own name.
    """
    found: dict[str, str] = {}
    for name in folders(spark, root):
        if name.startswith(BATCH):
            found |= {key: f"{root}/{name}/{key}" for key in folders(spark, f"{root}/{name}")}
        else:
            found.setdefault(name, f"{root}/{name}")
    return dict(sorted(found.items()))


def collect_frames(spark: SparkSession, roots: Sequence[str], keys: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Frames of many result folders by key: one scan for each key, with the columns of all of them.

    Without ``keys`` every key that any folder holds is read; columns that a folder
    lacks are NULL in its rows.
    """
    places: dict[str, list[str]] = {}
    for root in roots:
        for key, place in frame_places(spark, root).items():
            places.setdefault(key, []).append(place)
    missing = sorted(set(keys or ()) - set(places))
    if missing:
        raise KeyError(f"no frames named {', '.join(missing)}")
    wanted = sorted(places) if keys is None else list(keys)
    return {k: spark.read.option("mergeSchema", "true").parquet(*places[k]) for k in wanted}


def publish_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """``df`` as the table ``table`` at ``path``, laid out in ``buckets`` sorted buckets of ``keys``.

    Tables with the same keys and buckets join on these keys without moving a row.
    """
    if buckets < 1:
        raise ValueError("a table needs at least one bucket")
    # One task for each bucket, else every task would write a file into every bucket.
    spread = df.repartition(buckets, *keys)
    spread.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").mode("errorifexists").saveAsTable(table)
    return df.sparkSession.table(table)
