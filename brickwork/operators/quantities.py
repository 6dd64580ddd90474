"""Rule-driven quantities: retrofit costs and incentives.

A rule says: when ``trigger`` changes to ``final`` (from ``initial``, or from
anything when it is NULL) add up factors.  Rules are configuration - tens of
rows - so they are compiled into one projection over the ensemble.  Nothing is
joined per draw and nothing is shuffled, whatever the number of buildings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from brickwork.functions.rng import Keyed
from brickwork.functions.text import derive, sql_sum, sql_value
from brickwork.names import plain

LINEAR, FIXED, PERCENT = "LinearQuantity", "FixedQuantity", "PercentQuantity"
DEFAULT_ORDER = (FIXED, PERCENT, LINEAR)
Lookup = Callable[[str], str]  # name -> SQL expression


@dataclass(frozen=True)
class Factor:
    kind: str
    coefficient: float | None = None
    amount: float | None = None
    percent: float | None = None
    limit: float | None = None
    indicators: tuple[str, ...] = ()
    error_scale: float | None = None
    description: str = ""
    source: str = ""
    units: str = ""
    per: str = ""


@dataclass(frozen=True)
class Rule:
    trigger: str
    initial: str | None
    final: str
    factors: tuple[Factor, ...]
    order: tuple[str, ...] = DEFAULT_ORDER

    def problems(self) -> list[str]:
        """Mismatches between ``order`` and the factors, in both directions."""
        kinds, found = {f.kind for f in self.factors}, []
        if not set(self.order) <= kinds:
            found.append(f"order names kinds without factors: {sorted(set(self.order) - kinds)}")
        if kinds - set(self.order):
            found.append(f"factors ignored because not in order: {sorted(kinds - set(self.order))}")
        return found

    def used(self) -> list[Factor]:
        return [f for kind in self.order for f in self.factors if f.kind == kind]

    def applies(self, old: Lookup, new: Lookup) -> str:
        was, now = old(self.trigger), new(self.trigger)
        hit = f"{now} = {sql_value(self.final)} AND NOT {was} <=> {now}"
        if self.initial is not None:
            hit += f" AND {was} = {sql_value(self.initial)}"
        return f"coalesce({hit}, false)"


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    output_key: str
    raise_on_duplicate: bool = True
    create_metadata: bool = False
    metadata_aggregation: str | None = None

    @property
    def triggers(self) -> list[str]:
        return sorted({r.trigger for r in self.rules})

    def problems(self) -> list[str]:
        return [f"{r.trigger} -> {r.final}: {p}" for r in self.rules for p in r.problems()]

    @classmethod
    def from_rows(cls, rows: Iterable[Row], output_key: str, **flags) -> RuleSet:
        """Group exploded (rule, factor) rows back into rules."""
        grouped: dict[tuple, list[Factor]] = {}
        for r in rows:
            key = (r["trigger_column"], r["initial"], r["final"], tuple(r["order"] or DEFAULT_ORDER), r["rule_ix"])
            grouped.setdefault(key, []).append(
                Factor(
                    r["type"], r["coefficient"], r["amount"], r["percent"], r["limit"],
                    tuple(plain(c) for c in (r["indicator_cols"] or ())), r["error_scale"],
                    r["description"] or "", r["source"] or "", r["units"] or "", r["per"] or "",
                )
            )
        rules = tuple(
            Rule(k[0], k[1], k[2], tuple(fs), k[3])
            for k, fs in sorted(grouped.items(), key=lambda kv: kv[0][-1])
        )
        return cls(rules, output_key, **flags)


def quoted(name: str) -> str:
    return f"`{name}`"


@dataclass(frozen=True)
class Terms:
    """What a factor's formula may read: its name, indicators, the cost it refers to, and the row's draws."""

    name: str
    indicator: Lookup
    basis: str | None
    keyed: Keyed | None

    def noise(self) -> str:
        """A standard normal draw of this row and factor."""
        if self.keyed is None:
            raise ValueError("a row key is needed for rules with an error scale")
        return self.keyed.normal_sql(self.name)

    def scaled(self, text: str, scale: float | None) -> str:
        """``text`` times one plus its relative error, never below zero."""
        return f"{text} * greatest(1.0D + {sql_value(scale)} * {self.noise()}, 0.0D)" if scale else text


Formula = Callable[[Factor, Terms], str]
#: Kind of factor to its formula, and the kinds that refer to a cost.
FORMULAS: dict[str, Formula] = {}
COST_KINDS: set[str] = set()


def register_factor(kind: str, formula: Formula, needs_cost: bool = False) -> None:
    """Let rules use factors of ``kind``; ``formula`` gives SQL text, so it joins the one projection of all rules."""
    FORMULAS[kind] = formula
    (COST_KINDS.add if needs_cost else COST_KINDS.discard)(kind)


def _fixed(f: Factor, t: Terms) -> str:
    amount = sql_value(f.amount)
    if not f.error_scale:
        return amount
    drawn = f"{amount} + {sql_value(abs(f.amount) * f.error_scale)} * {t.noise()}"
    return f"{'greatest' if f.amount > 0 else 'least'}({drawn}, 0.0D)"


def _linear(f: Factor, t: Terms) -> str:
    return t.scaled(" * ".join([sql_value(f.coefficient), *[f"double({t.indicator(c)})" for c in f.indicators]]), f.error_scale)


def _percent(f: Factor, t: Terms) -> str:
    if t.basis is None:
        return "0.0D"
    x = t.scaled(f"{t.basis} * {sql_value(f.percent)}", f.error_scale)
    return x if f.limit is None else f"least({x}, {sql_value(f.limit)})"


register_factor(FIXED, _fixed)
register_factor(LINEAR, _linear)
register_factor(PERCENT, _percent, needs_cost=True)


def factor_value(f: Factor, name: str, indicator: Lookup, basis: str | None, keyed: Keyed | None) -> str:
    """SQL value of one factor; ``basis`` is the cost a percentage refers to."""
    if f.kind not in FORMULAS:
        raise ValueError(f"unknown factor kind {f.kind}")
    return FORMULAS[f.kind](f, Terms(name, indicator, basis, keyed))


def add_quantities(
    df: DataFrame,
    rules: RuleSet,
    old: Lookup,
    new: Lookup,
    *,
    indicator: Lookup = quoted,
    cost_prefix: str | None = None,
    keyed: Keyed | None = None,
    finals: Sequence[str] | None = None,
    tail: str = "",
    detailed: bool = False,
) -> DataFrame:
    """Add ``<output_key>_<trigger><tail>`` per trigger and the total.

    ``cost_prefix`` names the cost columns that percent factors refer to and
    that incentives may not exceed.  Percent factors take the full cost, not
    what earlier factors left; only the sum is clipped.  Where several rules
    match one change they add up, or fail the job if ``raise_on_duplicate``.
    """
    key, have, made = rules.output_key, set(df.columns), {}
    for trigger in rules.triggers:
        cost = f"{cost_prefix}{trigger}"
        basis = f"`{cost}`" if cost_prefix and cost in have else None
        per_final: dict[str, list[str]] = {}
        sharing: dict[str, list[Rule]] = {}
        for i, rule in enumerate(rules.rules):
            if rule.trigger != trigger or (finals is not None and rule.final not in finals):
                continue
            if cost_prefix and basis is None and any(f.kind in COST_KINDS for f in rule.used()):
                raise ValueError(f"no cost column for {trigger}")
            amount = sql_sum(
                [factor_value(f, f"{key}/{i}/{j}", indicator, basis, keyed) for j, f in enumerate(rule.used())]
            )
            sharing.setdefault(rule.final, []).append(rule)
            per_final.setdefault(rule.final, []).append(
                f"CASE WHEN {rule.applies(old, new)} THEN {amount} ELSE 0.0D END"
            )
        pieces = []
        for final, terms in per_final.items():
            total = sql_sum(terms)
            if rules.raise_on_duplicate:
                total = _once(sharing[final], total, old, new, f"several {key} rules for {trigger} -> {final}")
            if key == "incentive" and basis is not None:
                total = f"least({total}, {basis})"
            pieces.append(total)
            if detailed:
                made[f"{key}_{trigger}_{final}{tail}"] = total
        made[f"{key}_{trigger}{tail}"] = sql_sum(pieces)
    df = derive(df, made)
    return derive(
        df, {f"{key}_Total{tail}": sql_sum([f"`{key}_{t}{tail}`" for t in rules.triggers])}
    )


def _once(rules: Sequence[Rule], amount: str, old: Lookup, new: Lookup, what: str) -> str:
    """``amount``, or an error where several of ``rules``, which share a final, apply to a row."""
    seen = [r.initial for r in rules]
    if len(rules) < 2 or (None not in seen and len(set(seen)) == len(seen)):
        return amount  # no row can match two of them
    hits = sql_sum([f"int({r.applies(old, new)})" for r in rules])
    return f"CASE WHEN {hits} > 1 THEN raise_error({sql_value(what)}) ELSE {amount} END"


def match_report(df: DataFrame, rules: RuleSet, old: Lookup, new: Lookup, keys: Sequence[str]) -> DataFrame:
    """Changed fields with no rule, or with several: (keys, trigger, n_matches)."""
    rows = []
    for t in rules.triggers:
        hits = sql_sum([f"int({r.applies(old, new)})" for r in rules.rules if r.trigger == t])
        rows.append(f"struct('{t}' AS trigger, NOT {old(t)} <=> {new(t)} AS changed, {hits} AS n_matches)")
    long = df.selectExpr(*keys, f"inline(array({', '.join(rows)}))")
    return long.filter("changed AND n_matches <> 1").drop("changed")


def match_rules(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule lookup as a join, for rule tables too large to compile.

    ``changes(…, trigger, old_value, new_value)`` against
    ``rules(trigger, initial, final, …)``; a NULL ``initial`` matches any value.
    """
    r = rules.withColumnsRenamed({"trigger": "__t", "initial": "__i", "final": "__f"})
    on = (
        (F.col("trigger") == F.col("__t"))
        & (F.col("new_value") == F.col("__f"))
        & (F.col("__i").isNull() | (F.col("__i") == F.col("old_value")))
    )
    moved = changes.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return moved.join(r, on, "left").drop("__t", "__f").withColumnRenamed("__i", "initial")


def factor_metadata(
    df: DataFrame,
    rules: RuleSet,
    old: Lookup,
    new: Lookup,
    keys: Sequence[str],
    *,
    indicator: Lookup = quoted,
    cost_prefix: str | None = None,
    keyed: Keyed | None = None,
    name: str = "items",
) -> DataFrame:
    """Per group the programs that contributed, with their mean amount.

    The list has at most one entry per factor of the rule set, so its length is
    bounded by configuration; amounts are averaged before it is built.
    """
    amounts, shells, have = {}, [], set(df.columns)
    for i, rule in enumerate(rules.rules):
        cost = f"{cost_prefix}{rule.trigger}"
        basis = f"`{cost}`" if cost_prefix and cost in have else None
        for j, f in enumerate(rule.used()):
            value = factor_value(f, f"{rules.output_key}/{i}/{j}", indicator, basis, keyed)
            col = f"meta_{i}_{j}"
            amounts[col] = f"avg(CASE WHEN {rule.applies(old, new)} THEN {value} ELSE 0.0D END) AS {col}"
            shells.append(
                f"struct({sql_value(rule.trigger)} AS trigger, {sql_value(rule.final)} AS final, "
                f"{sql_value(f.description)} AS program_name, {sql_value(f.source)} AS source, "
                f"{col} AS amount_applied, {sql_value(f.kind)} AS factor_type)"
            )
    means = df.groupBy(*keys).agg(*[F.expr(a) for a in amounts.values()])
    return means.selectExpr(*keys, f"filter(array({', '.join(shells)}), x -> x.amount_applied <> 0) AS {name}")
