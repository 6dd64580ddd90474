"""SQL expression text and its application to a table.

Plans with hundreds of derived columns are written as SQL expressions: one
``selectExpr`` per step keeps plan construction to a handful of calls.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame


def sql_value(value: Any) -> str:
    """A literal; numbers are doubles so branches of a conditional agree."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        x = float(value)
        if x in (float("inf"), float("-inf")):
            return f"double('{'-' if x < 0 else ''}Infinity')"
        return f"{x!r}D"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_list(values: Sequence[Any]) -> str:
    return ", ".join(sql_value(v) for v in values)


def sql_sum(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")" if terms else "0.0D"


def derive(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add or replace columns given as SQL text, reading the columns of ``df``."""
    made = [f"{text} AS `{name}`" for name, text in columns.items()]
    if not set(columns).intersection(df.columns):
        return df.selectExpr("*", *made)
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c not in columns], *made)


def fence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns behind a generator, which filters are not pushed through.

    A filter on a column at the end of a deep chain of derived columns would be
    rewritten in terms of the first columns of the chain, multiplying its size
    at every step.  Filter behind the fence instead.
    """
    fields = ", ".join(f"`{c}`" for c in columns)
    return df.selectExpr(f"inline(array(struct({fields})))")
