"""Checks that report counts instead of looping over rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.functions.text import sql_list


def require_columns(df: DataFrame, expected: Sequence[str | None]) -> None:
    """Schema test only; no job."""
    missing = [c for c in expected if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")


def domain_report(df: DataFrame, options: Mapping[str, Sequence[str]], ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """(field, n_invalid) for every field, in one pass; NULL is invalid."""
    tests = {f: f"`{f}` IN ({sql_list(v)})" for f, v in options.items()}
    tests |= {f: f"`{f}` BETWEEN {lo!r}D AND {hi!r}D" for f, (lo, hi) in (ranges or {}).items()}
    require_columns(df, list(tests))
    counts = df.selectExpr(*[f"count_if(NOT coalesce({t}, false)) AS `{f}`" for f, t in tests.items()])
    pairs = ", ".join(f"struct('{f}' AS field, `{f}` AS n_invalid)" for f in tests)
    return counts.selectExpr(f"inline(array({pairs}))")


def assert_valid(report: DataFrame) -> None:
    bad = report.filter("n_invalid > 0").collect()  # one row per checked field at most
    if bad:
        raise ValueError("values outside the allowed domain: " + ", ".join(f"{r['field']} ({r['n_invalid']})" for r in bad))


def near_constant_columns(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-5) -> list[str]:
    """Numeric columns whose spread is below the tolerance (one aggregation)."""
    row = df.selectExpr(*[f"coalesce(abs(max(`{c}`) - min(`{c}`)), 0) < {tolerance!r}D AS `{c}`" for c in columns]).first()
    return [c for c in columns if row[c]]


def spread_report(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-5) -> DataFrame:
    counts = df.selectExpr(*[f"abs(max(`{c}`) - min(`{c}`)) AS `{c}`" for c in columns])
    pairs = ", ".join(f"struct('{c}' AS field, double(`{c}`) AS spread, `{c}` < {tolerance!r}D AS is_constant)" for c in columns)
    return counts.selectExpr(f"inline(array({pairs}))")


def check_source_choice(df: DataFrame, kinds: Sequence[str] = ("epw", "idf")) -> None:
    """Each input comes either as a path column or as a generator column."""
    for k in kinds:
        has = [c for c in (f"{k}_path", f"{k}_generator") if c in df.columns]
        if len(has) != 1:
            raise ValueError(f"exactly one of {k}_path and {k}_generator is required, found {has}")


def missing_references(specs: DataFrame, column: str, files: DataFrame, name: str = "name") -> DataFrame:
    """Referenced file names that are not in the listing."""
    wanted = specs.select(F.col(column).alias(name)).filter(f"{name} IS NOT NULL").distinct()
    return wanted.join(files.select(name), name, "left_anti")


def is_subset(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """One row: is every value of ``left`` present in ``right``?"""
    gone = left.select(column).distinct().join(right.select(column), column, "left_anti")
    return gone.agg((F.count(F.lit(1)) == 0).alias("is_subset"))


def crs_problems(df: DataFrame, allowed: Sequence[str] = ("EPSG:4326", "EPSG:3857"), column: str = "crs") -> DataFrame:
    return df.selectExpr(
        f"count_if({column} IS NULL) AS n_missing", f"count_if({column} IS NOT NULL AND {column} NOT IN ({sql_list(allowed)})) AS n_unsupported"
    )
