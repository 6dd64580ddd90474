"""Samplers, stratified draws, folds, ranks and prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.catalog.base import Registry, sql_draw, sql_fixed, sql_uniform, sql_words, table
from brickwork.functions import draws as d
from brickwork.functions.rng import with_row_key
from brickwork.functions.rounding import fixed
from brickwork.operators import ranking, sampling
from brickwork.operators.priors import PriorSet, add_solar_defaults
from brickwork.names import SEMANTIC_OPTIONS

REGISTRY = Registry()

_ALL_KINDS = PriorSet(
    {
        "x_uniform": d.uniform(2.0, 5.0),
        "x_normal": d.clipped_normal(10.0, 3.0, 6.0, None),
        "x_fixed": d.fixed(7),
        "x_choice": d.categorical(["a", "b", "c"], [1, 2, 5]),
        "x_copy": d.copy_of("c_acctbal"),
        "x_plus": d.plus("x_uniform", 1.5),
        "x_total": d.total("x_uniform", "x_normal", "x_fixed"),
        "x_times": d.times("x_total", 0.25),
        "x_product": d.product("x_uniform", "x_normal"),
        "x_reciprocal": d.reciprocal("x_uniform"),
        "x_power": d.power("x_uniform", 1.5),
        "x_log": d.log("x_uniform", 10.0),
        "x_text": d.join_text("c_mktsegment", "x_choice"),
        "x_case": d.by_value(
            "c_mktsegment",
            [("BUILDING", d.uniform(0, 1)), ("MACHINERY", d.fixed(3)), ("BUILDING", d.copy_of("x_uniform"))],
            d.clipped_normal(0, 1, -2, 2),
        ),
        "x_unmatched": d.by_value("x_choice", {"a": d.fixed(1)}),
    }
)


def _layers_sql(priors: PriorSet, source: str, seed, ids) -> str:
    steps = [f"SELECT *, {sql_words(seed, ids)} FROM {source}"]
    for layer in priors.layers():
        cols = ", ".join(f"{sql_draw(priors.draws[f], f)} AS {f}" for f in layer)
        steps.append(f"SELECT *, {cols} FROM s{len(steps) - 1}")
    return "WITH " + ", ".join(f"s{i} AS ({q})" for i, q in enumerate(steps)) + f" SELECT * FROM s{len(steps) - 1}"


_NUM = [f for f in _ALL_KINDS.draws if f not in ("x_choice", "x_text")]


@REGISTRY.add(
    f"SELECT c_custkey, x_choice, x_text, {', '.join(f'{sql_fixed(f, 6)} AS {f}' for f in _NUM)} FROM ({_layers_sql(_ALL_KINDS, 'customer', 7, ['c_custkey'])})"
)
def sampler_kinds(spark, sf_dir):
    """Every sampler kind, conditional and unconditional, in dependency layers."""
    rows, keyed = with_row_key(table(spark, sf_dir, "customer"), 7, ["c_custkey"])
    got = _ALL_KINDS.apply(rows, keyed)
    return got.select("c_custkey", "x_choice", "x_text", *[fixed(F.col(f), 6).alias(f) for f in _NUM])


_CHANGED = _ALL_KINDS.downstream({"x_uniform"}, resample_changed=False)


@REGISTRY.add(
    "WITH a AS (SELECT *, c_acctbal/1000.0::DOUBLE AS x_uniform, "
    + ", ".join(f"{v} AS {k}" for k, v in {"x_normal": "1.0::DOUBLE", "x_fixed": "2.0::DOUBLE", "x_choice": "'a'"}.items())
    + f", {sql_words(7, ['c_custkey'])} FROM customer), b AS (SELECT *, x_uniform + 1.5::DOUBLE AS x_plus, x_uniform + x_normal + x_fixed AS x_total, x_uniform*x_normal AS x_product FROM a) "
    + f"SELECT c_custkey, {sql_fixed('x_plus')} AS x_plus, {sql_fixed('x_total*0.25::DOUBLE')} AS x_times, {sql_fixed('x_product')} AS x_product, "
    + sql_fixed(f"CASE WHEN c_mktsegment='BUILDING' THEN x_uniform WHEN c_mktsegment='MACHINERY' THEN 3.0::DOUBLE ELSE {sql_draw(d.clipped_normal(0, 1, -2, 2), 'x_case')} END")
    + " AS x_case FROM b"
)
def changed_feature_tree(spark, sf_dir):
    """Only what depends on the changed feature is computed again."""
    rows, keyed = with_row_key(table(spark, sf_dir, "customer"), 7, ["c_custkey"])
    base = rows.selectExpr("*", "c_acctbal / 1000.0D AS x_uniform", "1.0D AS x_normal", "2.0D AS x_fixed", "'a' AS x_choice")
    got = _CHANGED.apply(base, keyed)
    return got.select("c_custkey", *[fixed(F.col(f)).alias(f) for f in ("x_plus", "x_times", "x_product", "x_case")])


_GRAPH_SQL = ", ".join(
    f"('{src}', '{dst}')" for src, dsts in sorted(_ALL_KINDS.graph().items()) for dst in sorted(dsts)
)


@REGISTRY.add(
    f"WITH e(source, feature) AS (VALUES {_GRAPH_SQL}) SELECT source, feature, (SELECT count(*) FROM customer)::BIGINT AS n_rows FROM e"
)
def dependency_edges(spark, sf_dir):
    """Edges of the prior graph with the number of rows each re-draw would touch."""
    edges = [(s, t) for s, ts in _ALL_KINDS.graph().items() for t in ts]
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n_rows"))
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("feature")) for s, t in sorted(edges)])
    return n.withColumn("e", F.explode(pairs)).select("e.source", "e.feature", "n_rows")


@REGISTRY.add(
    f"SELECT c_custkey, {', '.join(f'{sql_fixed(sql_draw(x, f), 4)} AS {f}' for f, x in list(__import__('brickwork.operators.priors', fromlist=['solar_priors']).solar_priors({}).items()) if x.kind != 'by_value')}, "
    f"0.0::DOUBLE AS upgraded FROM (SELECT *, {sql_words(3, ['c_custkey'])} FROM customer)"
)
def solar_default_features(spark, sf_dir):
    """Photovoltaic features added only where absent."""
    rows, keyed = with_row_key(table(spark, sf_dir, "customer"), 3, ["c_custkey"])
    got = add_solar_defaults(rows, keyed)
    cols = ("solar__yield_kWh_per_kW_year", "solar__panel_power_density_w_per_m2", "solar__max_roof_utilization")
    return got.select("c_custkey", *[fixed(F.col(c), 4).alias(c) for c in cols], F.col("solar__upgraded_coverage").alias("upgraded"))


_ORDER = f"row_number() OVER (PARTITION BY c_nationkey ORDER BY {sql_uniform('order')}, c_custkey)"


@REGISTRY.add(
    f"WITH r AS (SELECT c_custkey, c_nationkey, {_ORDER} AS rnk FROM (SELECT *, {sql_words('5/order', ['c_custkey'])} FROM customer)), "
    "sz AS (SELECT c_nationkey, count(*) AS n, (SELECT count(*) // 50 FROM customer) AS want FROM customer GROUP BY c_nationkey), "
    "w AS (SELECT c_nationkey, n, unnest(range(want)) AS draw_id FROM sz), "
    f"p AS (SELECT c_nationkey, draw_id, CAST(floor({sql_uniform('pick')}*n) AS BIGINT)+1 AS rnk FROM (SELECT *, {sql_words('5/pick', ['c_nationkey', 'draw_id'])} FROM w)) "
    "SELECT p.c_nationkey, p.draw_id::BIGINT AS draw_id, r.c_custkey FROM p JOIN r ON p.c_nationkey=r.c_nationkey AND p.rnk=r.rnk"
)
def equal_stratified_sample(spark, sf_dir):
    """Same number of draws with replacement from every nation."""
    c = table(spark, sf_dir, "customer")
    n = c.select((F.count(F.lit(1)) / 50).cast("int")).first()[0]
    got = sampling.sample_equally(c, "c_nationkey", "c_custkey", n, 5)
    return got.select("c_nationkey", F.col("draw_id").cast("bigint").alias("draw_id"), "c_custkey")


@REGISTRY.add(
    f"WITH r AS (SELECT c_custkey, c_nationkey, {_ORDER} AS rnk FROM (SELECT *, {sql_words('0/order', ['c_custkey'])} FROM customer)), "
    "sz AS (SELECT c_nationkey, count(*) AS n, greatest(10000 // (SELECT count(DISTINCT c_nationkey) FROM customer), 100) AS want FROM customer GROUP BY c_nationkey), "
    "w AS (SELECT c_nationkey, n, unnest(range(want)) AS draw_id FROM sz), "
    f"p AS (SELECT c_nationkey, draw_id, CAST(floor({sql_uniform('pick')}*n) AS BIGINT)+1 AS rnk FROM (SELECT *, {sql_words('0/pick', ['c_nationkey', 'draw_id'])} FROM w)) "
    "SELECT p.c_nationkey AS epw_path, count(*) AS n_draws, count(DISTINCT c_custkey) AS n_distinct, sum(c_custkey)::BIGINT AS key_sum FROM p JOIN r ON p.c_nationkey=r.c_nationkey AND p.rnk=r.rnk GROUP BY ALL"
)
def stratified_selection_by_alias(spark, sf_dir):
    """The stratification field is missing, so its first alias is used."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "epw_path")
    got = sampling.stratified_selection(c, "feature.weather.file", "c_custkey", 10_000, 0)
    return got.groupBy("epw_path").agg(
        F.count(F.lit(1)).alias("n_draws"), F.count_distinct("c_custkey").alias("n_distinct"), F.sum("c_custkey").alias("key_sum")
    )


_SEMANTIC = {f"s_{k}": v for k, v in SEMANTIC_OPTIONS.items() if k in ("Heating", "Windows", "DHW")} | {"s_setpoint": (18.0, 22.0)}
_SPEC = PriorSet({**sampling.semantic_draws(_SEMANTIC).draws, **sampling.spec_draws().draws})
_SPEC_NUM = ("s_setpoint", "exposed_basement_frac", "wwr", "f2f_height")


@REGISTRY.add(
    f"SELECT c_custkey, s_Heating, s_Windows, s_DHW, basement, attic, {', '.join(f'{sql_fixed(f)} AS {f}' for f in _SPEC_NUM)} FROM ({_layers_sql(_SPEC, 'customer', 11, ['c_custkey'])})"
)
def spec_field_draws(spark, sf_dir):
    """Semantic fields, basements, attics, glazing ratios, floor heights."""
    rows, keyed = with_row_key(table(spark, sf_dir, "customer"), 11, ["c_custkey"])
    got = _SPEC.apply(rows, keyed)
    return got.select("c_custkey", "s_Heating", "s_Windows", "s_DHW", "basement", "attic", *[fixed(F.col(f)).alias(f) for f in _SPEC_NUM])


def _attic_sql() -> str:
    occ = "attic IN ('occupied_unconditioned','occupied_conditioned','unoccupied_conditioned')"
    lo, hi = f"CASE WHEN {occ} THEN 6.0::DOUBLE/12 ELSE 4.0::DOUBLE/12 END", f"CASE WHEN {occ} THEN 9.0::DOUBLE/12 ELSE 6.0::DOUBLE/12 END"
    tries = ", ".join(f"short_edge/2.0::DOUBLE*(({lo})+(({hi})-({lo}))*({sql_uniform(f'attic_height/{i}')}))" for i in range(20))
    use = {s: f"CASE WHEN {s} IN ('occupied_unconditioned','occupied_conditioned') THEN 0.2::DOUBLE+0.4::DOUBLE*({sql_uniform(f'{s}_use')}) ELSE 0.0::DOUBLE END" for s in ("basement", "attic")}
    return (
        f"WITH a AS ({_layers_sql(sampling.spec_draws(), 'customer', 13, ['c_custkey'])}), b AS (SELECT *, 6.0::DOUBLE + c_custkey % 40 AS short_edge FROM a), "
        f"t AS (SELECT *, list_filter([{tries}], lambda h: h <= 2.5::DOUBLE*f2f_height)[1] AS h FROM b) "
        f"SELECT c_custkey, attic, {sql_fixed(chr(39).join(['CASE WHEN attic <> ', 'none', ' THEN h END']))} AS attic_height, "
        f"attic <> 'none' AND h IS NULL AS attic_failed, {sql_fixed(use['basement'])} AS basement_use_fraction, {sql_fixed(use['attic'])} AS attic_use_fraction FROM t"
    )


@REGISTRY.add(_attic_sql())
def attic_heights_and_use(spark, sf_dir):
    """Attic height by bounded rejection and use fractions."""
    rows, keyed = with_row_key(table(spark, sf_dir, "customer"), 13, ["c_custkey"])
    got = sampling.spec_draws().apply(rows, keyed).selectExpr("*", "6.0D + double(c_custkey % 40) AS short_edge")
    got = sampling.use_fractions(sampling.attic_height(got, keyed), keyed)
    cols = ("attic_height", "basement_use_fraction", "attic_use_fraction")
    return got.select("c_custkey", "attic", "attic_failed", *[fixed(F.col(c)).alias(c) for c in cols])


@REGISTRY.add(
    f"SELECT o_orderkey FROM (SELECT *, {sql_words(17, ['o_orderkey'])} FROM orders) WHERE {sql_uniform('keep')} < 0.1::DOUBLE"
)
def bernoulli_sample(spark, sf_dir):
    return sampling.sample_fraction(table(spark, sf_dir, "orders"), 0.1, 17, ["o_orderkey"]).select("o_orderkey")


@REGISTRY.add(
    f"SELECT o_orderkey, o_totalprice FROM (SELECT *, {sql_words(19, ['o_orderkey'])} FROM orders) ORDER BY {sql_uniform('order')}, o_orderkey LIMIT 500"
)
def fixed_size_sample(spark, sf_dir):
    return sampling.sample_rows(table(spark, sf_dir, "orders"), 500, 19, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def _shuffled(spark, sf_dir, seed):
    return with_row_key(table(spark, sf_dir, "customer"), seed, ["c_custkey"])


@REGISTRY.add(
    f"SELECT c_custkey, c_nationkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY {sql_uniform('order')}, c_custkey) - 1) % 5 AS INTEGER) AS fold "
    f"FROM (SELECT *, {sql_words(42, ['c_custkey'])} FROM customer)"
)
def stratified_folds(spark, sf_dir):
    rows, keyed = _shuffled(spark, sf_dir, 42)
    got = ranking.stratified_folds(rows, ["c_nationkey"], keyed.uniform("order"), ["c_custkey"], 5)
    return got.select("c_custkey", "c_nationkey", "fold")


@REGISTRY.add(
    f"SELECT c_custkey, row_number() OVER (ORDER BY {sql_uniform('order')}, c_custkey) AS position FROM (SELECT *, {sql_words(42, ['c_custkey'])} FROM customer)"
)
def deterministic_shuffle(spark, sf_dir):
    rows, keyed = _shuffled(spark, sf_dir, 42)
    return ranking.hash_rank(rows, [], keyed.uniform("order"), ["c_custkey"], "position").select("c_custkey", "position")


@REGISTRY.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS sort_index FROM orders")
def dense_sort_index(spark, sf_dir):
    return ranking.dense_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "sort_index")


@REGISTRY.add(
    "WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), "
    "b AS (SELECT o_orderkey, row_number() OVER (ORDER BY i) - 1 AS i FROM a WHERE i % 3 = 1), "
    "c AS (SELECT o_orderkey, row_number() OVER (ORDER BY i) - 1 AS i FROM b WHERE i % 4 = 2) SELECT o_orderkey FROM c WHERE i % 2 = 0"
)
def stride_path_selection(spark, sf_dir):
    """Rows selected by the slices [1::3], then [2::4], then [0::2]."""
    ix = ranking.dense_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return ranking.stride_select(ix, "sort_index", [(3, 1), (4, 2), (2, 0)]).select("o_orderkey")


_FRACTIONS = [round(0.05 * i, 2) for i in range(1, 20)]


@REGISTRY.add(
    f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {sql_uniform('order')}, c_custkey) AS rnk, count(*) OVER () AS n FROM (SELECT *, {sql_words(42, ['c_custkey'])} FROM customer)), "
    f"f AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in _FRACTIONS)}]) AS fraction) "
    f"SELECT fraction, count(*) AS n_rows, {sql_fixed('avg(c_acctbal)', 4)} AS mean_balance FROM r JOIN f ON rnk <= floor(fraction*n) GROUP BY fraction"
)
def learning_curve_prefixes(spark, sf_dir):
    """Nested training prefixes for nineteen fractions."""
    rows, keyed = _shuffled(spark, sf_dir, 42)
    n = rows.count()
    ranked = ranking.hash_rank(rows, [], keyed.uniform("order"), ["c_custkey"], "rnk").withColumn("n", F.lit(n))
    got = ranking.training_prefixes(ranked, "rnk", "n", _FRACTIONS)
    return got.groupBy("fraction").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("c_acctbal").alias("m")).select(
        "fraction", "n_rows", fixed(F.col("m"), 4).alias("mean_balance")
    )
