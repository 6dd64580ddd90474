"""Samplers described as data and compiled to SQL expressions.

A :class:`Draw` names a kind and its arguments; :data:`KINDS` maps the kind to
the features it reads and to an expression builder.  New kinds are registered
with :func:`register_kind`; a draw never runs Python per row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickwork.functions.rng import Keyed
from brickwork.functions.text import sql_sum, sql_value


@dataclass(frozen=True)
class Draw:
    kind: str
    args: Mapping[str, Any]

    @property
    def reads(self) -> frozenset[str]:
        return frozenset(KINDS[self.kind][0](self.args))

    def sql(self, feature: str, keyed: Keyed) -> str:
        return KINDS[self.kind][1](self.args, feature, keyed)

    def column(self, feature: str, keyed: Keyed) -> Column:
        return F.expr(self.sql(feature, keyed))


Reads = Callable[[Mapping[str, Any]], Sequence[str]]
Build = Callable[[Mapping[str, Any], str, Keyed], str]
KINDS: dict[str, tuple[Reads, Build]] = {}


def register_kind(kind: str, reads: Reads, build: Build) -> None:
    KINDS[kind] = (reads, build)


def _none(_: Mapping[str, Any]) -> Sequence[str]:
    return ()


def _one(args: Mapping[str, Any]) -> Sequence[str]:
    return (args["of"],)


def _many(args: Mapping[str, Any]) -> Sequence[str]:
    return tuple(args["of"])


def _case(whens: Sequence[tuple[str, str]], otherwise: str | None) -> str:
    body = " ".join(f"WHEN {test} THEN {value}" for test, value in whens)
    tail = "" if otherwise is None else f" ELSE {otherwise}"
    return f"(CASE {body}{tail} END)" if whens else (otherwise or "NULL")


def _categorical(args: Mapping[str, Any], feature: str, keyed: Keyed) -> str:
    u, total, upto, whens = keyed.uniform_sql(feature), sum(args["weights"]), 0.0, []
    for value, weight in list(zip(args["values"], args["weights"]))[:-1]:
        upto += weight / total
        whens.append((f"{u} < {upto!r}D", sql_value(value)))
    return _case(whens, sql_value(args["values"][-1]))


def _clipped_normal(args: Mapping[str, Any], feature: str, keyed: Keyed) -> str:
    x = f"({sql_value(args['mean'])} + {sql_value(args['std'])} * {keyed.normal_sql(feature)})"
    if args["low"] is not None:
        x = f"greatest({x}, {sql_value(args['low'])})"
    if args["high"] is not None:
        x = f"least({x}, {sql_value(args['high'])})"
    return x


def _by_value(args: Mapping[str, Any], feature: str, keyed: Keyed) -> str:
    # the last matching case wins, so it is tested first
    whens = [
        (f"`{args['of']}` = {sql_value(match)}", draw.sql(feature, keyed))
        for match, draw in reversed(args["cases"])
    ]
    fallback = args["otherwise"]
    return _case(whens, None if fallback is None else fallback.sql(feature, keyed))


def _by_value_reads(args: Mapping[str, Any]) -> Sequence[str]:
    draws = [d for _, d in args["cases"]]
    if args["otherwise"] is not None:
        draws.append(args["otherwise"])
    return (args["of"], *[r for d in draws for r in d.reads])


def _uniform(args: Mapping[str, Any], feature: str, keyed: Keyed) -> str:
    width = float(args["high"]) - float(args["low"])
    return f"({sql_value(args['low'])} + {width!r}D * {keyed.uniform_sql(feature)})"


def _reciprocal(args: Mapping[str, Any], *_: Any) -> str:
    x = f"`{args['of']}`"
    return f"(CASE WHEN {x} = 0 THEN double('Infinity') ELSE 1.0D / {x} END)"


for _kind, _reads, _build in (
    ("uniform", _none, _uniform),
    ("clipped_normal", _none, _clipped_normal),
    ("fixed", _none, lambda a, f, k: sql_value(a["value"])),
    ("categorical", _none, _categorical),
    ("copy", _one, lambda a, f, k: f"`{a['of']}`"),
    ("plus", _one, lambda a, f, k: f"(`{a['of']}` + {sql_value(a['value'])})"),
    ("total", _many, lambda a, f, k: sql_sum([f"`{c}`" for c in a["of"]])),
    ("times", _one, lambda a, f, k: f"(`{a['of']}` * {sql_value(a['value'])})"),
    ("product", _many, lambda a, f, k: "(" + " * ".join(f"`{c}`" for c in a["of"]) + ")"),
    ("reciprocal", _one, _reciprocal),
    ("power", _one, lambda a, f, k: f"pow(`{a['of']}`, {sql_value(a['value'])})"),
    ("log", _one, lambda a, f, k: f"(ln(`{a['of']}`) / {math.log(a['base'])!r}D)"),
    ("join_text", _many, lambda a, f, k: f"concat_ws({sql_value(a['separator'])}, {', '.join(f'string(`{c}`)' for c in a['of'])})"),
    ("by_value", _by_value_reads, _by_value),
    ("expression", _many, lambda a, f, k: f"({a['sql']})"),
):
    register_kind(_kind, _reads, _build)


def uniform(low: float, high: float) -> Draw:
    return Draw("uniform", {"low": low, "high": high})


def clipped_normal(mean: float, std: float, low: float | None = None, high: float | None = None) -> Draw:
    """A normal draw moved to the nearest bound when outside (not truncated)."""
    return Draw("clipped_normal", {"mean": mean, "std": std, "low": low, "high": high})


def fixed(value: float | str | bool) -> Draw:
    return Draw("fixed", {"value": value})


def categorical(values: Sequence[Any], weights: Sequence[float]) -> Draw:
    if len(values) != len(weights):
        raise ValueError("values and weights must be the same length")
    return Draw("categorical", {"values": tuple(values), "weights": tuple(weights)})


def copy_of(feature: str) -> Draw:
    return Draw("copy", {"of": feature})


def plus(feature: str, value: float) -> Draw:
    return Draw("plus", {"of": feature, "value": value})


def total(*features: str) -> Draw:
    return Draw("total", {"of": features})


def times(feature: str, value: float) -> Draw:
    return Draw("times", {"of": feature, "value": value})


def product(*features: str) -> Draw:
    return Draw("product", {"of": features})


def reciprocal(feature: str) -> Draw:
    return Draw("reciprocal", {"of": feature})


def power(feature: str, exponent: float) -> Draw:
    return Draw("power", {"of": feature, "value": exponent})


def log(feature: str, base: float = math.e) -> Draw:
    return Draw("log", {"of": feature, "base": base})


def join_text(*features: str, separator: str = ":") -> Draw:
    return Draw("join_text", {"of": features, "separator": separator})


def by_value(feature: str, cases: Mapping[Any, Draw] | Sequence[tuple[Any, Draw]], otherwise: Draw | None = None) -> Draw:
    """Pick a draw per row by the value of ``feature``; unmatched rows are NULL."""
    pairs = tuple(cases.items()) if isinstance(cases, Mapping) else tuple(cases)
    return Draw("by_value", {"of": feature, "cases": pairs, "otherwise": otherwise})


def expression(sql: str, *reads: str) -> Draw:
    """A SQL expression over other features."""
    return Draw("expression", {"sql": sql, "of": reads})
