"""Registration helper, table access and SQL text helpers for the catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from brickwork.functions import rng


@dataclass
class Registry:
    queries: dict = field(default_factory=dict)
    sql: dict = field(default_factory=dict)

    def add(self, sql: str | None = None) -> Callable:
        def register(fn):
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.sql[fn.__name__] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_over(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    """``text``, which reads only the table ``name``, without leaving a view in the session."""
    return spark.sql(text.replace(f"FROM {name}", "FROM {" + name + "}"), **{name: table(spark, sf_dir, name)})


def sql_fixed(expr: str, places: int = 6) -> str:
    s = f"{float(10**places)!r}"
    return f"(floor(({expr})*{s}+0.5)/{s})"


def sql_words(seed: int | str, ids: list[str], prefix: str = "rk") -> str:
    """Select-list text computing the row words from id expressions."""
    key = ", ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    h = f"md5(concat_ws('|', {key}))"
    n = rng.HEX_PER_WORD
    return ", ".join(
        f"CAST('0x'||substr({h},{1 + i * n},{n}) AS BIGINT) AS {prefix}{i}"
        for i in range(rng.WORDS)
    )


def sql_uniform(name: str, scope: str = "", prefix: str = "rk") -> str:
    a, b, c, d, e, m, f = rng.stream_constants(f"{scope}{name}")
    p = rng.PRIME
    t = (
        f"(({prefix}0*{a}::BIGINT + {prefix}1*{b}::BIGINT + {prefix}2*{c}::BIGINT"
        f" + {prefix}3*{d}::BIGINT + {e}) % {p})"
    )
    return f"(((({t}*{m | 1 << 30}::BIGINT + {f}) >> 21) % {p})::DOUBLE + 0.5::DOUBLE)/{float(p)!r}::DOUBLE"


def sql_normal(name: str, scope: str = "", prefix: str = "rk") -> str:
    u1 = sql_uniform(f"{name}#1", scope, prefix)
    u2 = sql_uniform(f"{name}#2", scope, prefix)
    return f"(sqrt(-2.0*ln({u1}))*cos(6.283185307179586*({u2})))"


def sql_literal(value) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return f"{float(value)!r}::DOUBLE"
    return "'" + str(value).replace("'", "''") + "'"


def sql_draw(draw, feature: str, scope: str = "", alt=lambda n: n) -> str:
    """SQL text of a draw, written independently of the Column builders."""
    a = draw.args
    if draw.kind == "uniform":
        return f"({a['low']!r}::DOUBLE + {a['high'] - a['low']!r}::DOUBLE*{sql_uniform(feature, scope)})"
    if draw.kind == "clipped_normal":
        x = f"({a['mean']!r}::DOUBLE + {a['std']!r}::DOUBLE*{sql_normal(feature, scope)})"
        if a["low"] is not None:
            x = f"greatest({x}, {a['low']!r}::DOUBLE)"
        if a["high"] is not None:
            x = f"least({x}, {a['high']!r}::DOUBLE)"
        return x
    if draw.kind == "fixed":
        return sql_literal(a["value"])
    if draw.kind == "categorical":
        upto, total, parts = 0.0, sum(a["weights"]), []
        for v, w in list(zip(a["values"], a["weights"]))[:-1]:
            upto += w / total
            parts.append(f"WHEN {sql_uniform(feature, scope)} < {upto!r}::DOUBLE THEN {sql_literal(v)}")
        return f"CASE {' '.join(parts)} ELSE {sql_literal(a['values'][-1])} END"
    if draw.kind == "copy":
        return alt(a["of"])
    if draw.kind == "plus":
        return f"({alt(a['of'])} + {sql_literal(a['value'])})"
    if draw.kind == "times":
        return f"({alt(a['of'])} * {sql_literal(a['value'])})"
    if draw.kind == "total":
        return "(" + " + ".join(alt(c) for c in a["of"]) + ")"
    if draw.kind == "product":
        return "(" + " * ".join(alt(c) for c in a["of"]) + ")"
    if draw.kind == "reciprocal":
        x = alt(a["of"])
        return f"CASE WHEN {x} = 0 THEN 'Infinity'::DOUBLE ELSE 1.0::DOUBLE/{x} END"
    if draw.kind == "power":
        return f"pow({alt(a['of'])}, {sql_literal(a['value'])})"
    if draw.kind == "log":
        import math

        return f"(ln({alt(a['of'])})/{math.log(a['base'])!r}::DOUBLE)"
    if draw.kind == "join_text":
        return f"concat_ws('{a['separator']}', {', '.join(f'CAST({alt(c)} AS VARCHAR)' for c in a['of'])})"
    if draw.kind == "by_value":
        seen, whens = set(), []
        for match, d in reversed(a["cases"]):
            if match in seen:
                continue
            seen.add(match)
            whens.append(f"WHEN {alt(a['of'])} = {sql_literal(match)} THEN {sql_draw(d, feature, scope, alt)}")
        tail = f" ELSE {sql_draw(a['otherwise'], feature, scope, alt)}" if a["otherwise"] is not None else ""
        return f"CASE {' '.join(whens)}{tail} END"
    if draw.kind == "expression":
        return f"({a['sql']})"
    raise ValueError(draw.kind)


class Chain:
    """A growing list of CTEs, each adding columns to the previous one."""

    def __init__(self, first: str):
        self.steps = [first]

    def add(self, columns: dict[str, str]) -> "Chain":
        text = ", ".join(f"{e} AS {n}" for n, e in columns.items())
        self.steps.append(f"SELECT *, {text} FROM s{len(self.steps) - 1}")
        return self

    def then(self, query: str) -> str:
        """Close with a query over the last step, written as {last}."""
        ctes = ", ".join(f"s{i} AS MATERIALIZED ({q})" for i, q in enumerate(self.steps))
        return f"WITH {ctes} {query.replace('{last}', f's{len(self.steps) - 1}')}"
