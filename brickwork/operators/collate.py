"""Result collation, error tables, spec-wise execution of leaf functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Frames = dict[str, DataFrame]


def collate(parts: Sequence[Mapping[str, DataFrame]]) -> Frames:
    """Union per key; columns a part lacks become NULL."""
    out: Frames = {}
    for part in parts:
        for key, df in part.items():
            out[key] = out[key].unionByName(df, allowMissingColumns=True) if key in out else df
    return out


def _frame(value: object) -> DataFrame:
    """A frame as it is, or rows given inline as mappings; a column that a row lacks is NULL."""
    if isinstance(value, DataFrame):
        return value
    if not isinstance(value, list) or not value or not all(isinstance(r, Mapping) for r in value):
        raise ValueError("explicit results must be frames or lists of rows")
    names = dict.fromkeys(name for row in value for name in row)
    return SparkSession.active().createDataFrame([tuple(row.get(n) for n in names) for row in value], list(names))


def combine_results(parts: Sequence[Mapping[str, object]], load: Callable[[str], Frames]) -> Frames:
    """Parts are frames or inline rows by key, or ``{"uri": …}`` naming stored frames - never both."""
    resolved: list[Mapping[str, DataFrame]] = []
    for part in parts:
        if "uri" in part:
            if len(part) > 1:
                raise ValueError("a result cannot carry both a uri and other keys")
            resolved.append(load(str(part["uri"])))
        else:
            resolved.append({key: _frame(value) for key, value in part.items()})
    return collate(resolved)


def match_outcomes(specs: DataFrame, results: DataFrame, key: str = "run_id") -> DataFrame:
    """Specs beside outcomes with a ``state``: ok, error, missing or unexpected."""
    s = specs.withColumn("__s", F.lit(True))
    r = results.withColumn("__r", F.lit(True))
    state = (
        F.when(F.col("__s").isNull(), "unexpected").when(F.col("__r").isNull(), "missing")
        .when(F.col("error").isNotNull(), "error").otherwise("ok")
    )
    return s.join(r, key, "full_outer").withColumn("state", state).drop("__s", "__r")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def errors_and_missing(outcomes: DataFrame, spec_columns: Sequence[str], key: str = "run_id") -> DataFrame:
    """(spec…, workflow_run_id, missing, errored); empty input gives an empty table."""
    bad = outcomes.filter(F.col("state").isin("error", "missing"))
    return bad.select(
        *spec_columns, F.col(key).alias("workflow_run_id"), (F.col("state") == "missing").alias("missing"),
        F.when(F.col("state") == "error", F.col("error")).alias("errored"),
    )


def label_union(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Stack labelled frames with their label as a column."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def inputs_beside_outputs(specs: DataFrame, rows: DataFrame, key: str = "run_id") -> DataFrame:
    """Spec columns repeated on every result row."""
    return rows.join(specs, key)


def report_cells(report: DataFrame, row: str, column: str, value: str) -> list[tuple[str, str]]:
    """The (row, column) names of a tabular report that hold a value anywhere, in order.

    One aggregation finds them and leaves out the cells that are NULL in every run;
    a report has as many as its layout, whatever the number of runs.
    """
    seen = report.groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count(value).alias("n"))
    return sorted((x["r"], x["c"]) for x in seen.filter("n > 0 AND r IS NOT NULL AND c IS NOT NULL").collect())


def wide_report(report: DataFrame, run: str, row: str, column: str, value: str, names: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Long tabular report to one wide row per run.

    ``names`` lists the (row, column) cells; without it they are found in the data,
    and cells without any value are dropped.  Every run keeps its row.
    """
    cells = report_cells(report, row, column, value) if names is None else list(names)
    titles = [f"{r}_{c}".replace(" ", "_") for r, c in cells]
    if len(set(titles)) < len(titles):
        raise ValueError("several cells would have the same column name")
    taken = [F.max(F.when((F.col(row) == r) & (F.col(column) == c), F.col(value))).alias(t) for (r, c), t in zip(cells, titles)]
    runs = report.groupBy(run)
    return runs.agg(*taken) if taken else runs.agg(F.count(F.lit(1)).alias("__n")).drop("__n")


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the columns that are NULL in every row."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] == 0])


def message_counts(text: str) -> tuple[str, str]:
    """SQL for warning and severe error counts of an end-of-run message."""
    one = lambda word: f"coalesce(try_cast(nullif(regexp_extract({text}, '\\\\s(\\\\d+)\\\\s{word}', 1), '') AS BIGINT), 0)"
    return one("Warning"), one("Severe Errors")


# ---- leaf functions --------------------------------------------------------------------

Leaf = Callable[[dict], dict[str, list[dict]]]
LEAVES: dict[str, Leaf] = {}
RESULT_SCHEMA = "run_id string, key string, row_ix int, values map<string,double>, labels map<string,string>, error string, attempts int"


def register_leaf(name: str, fn: Leaf) -> None:
    """A leaf maps one spec to named lists of rows; it runs inside tasks."""
    LEAVES[name] = fn


def _result_rows(frames: Mapping[str, Sequence[Mapping]]) -> list[tuple]:
    """(key, position, numbers, texts) of every row; numpy scalars and arrays become plain values."""
    out = []
    for name, rows in frames.items():
        for i, row in enumerate(rows):
            row = {k: v.tolist() if hasattr(v, "tolist") else v for k, v in row.items()}
            nums = {k: float(v) for k, v in row.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
            texts = {k: v if isinstance(v, str) else json.dumps(v) for k, v in row.items() if k not in nums}
            out.append((name, i, nums, texts))
    return out


def run_leaf(specs: DataFrame, leaf: str | Leaf, *, key: str = "run_id", attempts: int = 3, partitions: int | None = None) -> DataFrame:
    """Apply a leaf to every spec row; failures become rows, not failed jobs.

    Output is long: one row per result row, or one row with ``error`` per spec
    that kept failing.  Specs are spread over ``partitions`` tasks first (by default
    the session's shuffle partitions) because leaf time, not bytes, decides the load.
    """
    fn = LEAVES[leaf] if isinstance(leaf, str) else leaf
    # an explicit number, because adaptive execution would merge tasks by their bytes
    spark = specs.sparkSession
    number = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = specs.repartition(number, key)

    def run(batches):
        for batch in batches:
            out = []
            for spec in batch.to_dict("records"):
                run_id, error, rows, tried = str(spec[key]), None, [], 0
                while tried < attempts:
                    tried += 1
                    try:
                        rows, error = _result_rows(fn(spec)), None
                        break
                    except Exception as exc:  # noqa: BLE001
                        error = f"{type(exc).__name__}: {exc}"
                if error is not None:
                    out.append((run_id, None, None, None, None, error, tried))
                out += [(run_id, *row, None, tried) for row in rows]
            yield pd.DataFrame(out, columns=["run_id", "key", "row_ix", "values", "labels", "error", "attempts"])

    return spread.mapInPandas(run, RESULT_SCHEMA)


def frame_of(results: DataFrame, key: str, numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """One named frame of a leaf run as ordinary columns."""
    return results.filter((F.col("key") == key) & F.col("error").isNull()).select(
        "run_id", "row_ix", *[F.try_element_at("values", F.lit(n)).alias(n) for n in numbers],
        *[F.try_element_at("labels", F.lit(t)).alias(t) for t in texts],
    )


def leaf_errors(results: DataFrame) -> DataFrame:
    return results.filter("error IS NOT NULL").select("run_id", "error", "attempts")
