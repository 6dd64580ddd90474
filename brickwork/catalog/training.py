"""Encoding, metrics, convergence and boosted surrogates over lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.catalog.base import Registry, sql_fixed, table
from brickwork.catalog.portfolio import FIELDS, portfolio, predict, suppliers_as_customers
from brickwork.functions.rounding import fixed
from brickwork.operators import surrogate as s
from brickwork.operators.energy import cooling_for_prediction
from brickwork.plans import training as plan
from brickwork.plans.base import STATION, base_features
from brickwork.plans.boosting import Patience, fit_staged
from brickwork.plans.inference import draw_ensemble, infer, infer_savings, respond, summarize_results
from brickwork.session import checkpoint_root, cut_lineage
from brickwork.sources.rules import legacy_costs, standard_incentives

REGISTRY = Registry()
_NUM = ("p_size", "p_retailprice")
_CAT = ("p_type", "p_brand")


@REGISTRY.add(" UNION ALL ".join(f"SELECT '{c}' AS feature, string_agg(v, '|' ORDER BY v) AS options FROM (SELECT DISTINCT {c} AS v FROM part)" for c in _CAT))
def categorical_domains(spark, sf_dir):
    return s.categorical_domains(table(spark, sf_dir, "part"), _CAT).withColumn("options", F.array_join("options", "|"))


@REGISTRY.add(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sql_fixed(f'floor(min({c})*1000.0::DOUBLE)/1000.0::DOUBLE')} AS low, {sql_fixed(f'ceil(max({c})*1000.0::DOUBLE)/1000.0::DOUBLE')} AS high FROM part WHERE p_partkey % 5 <> 0" for c in _NUM
    )
)
def numeric_bounds_on_train(spark, sf_dir):
    got = s.numeric_bounds(table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0"), _NUM)
    return got.withColumns({"low": fixed(F.col("low")), "high": fixed(F.col("high"))})


@REGISTRY.add(
    "WITH t AS (SELECT * FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT floor(min(p_size)*1000.0::DOUBLE)/1000 a, ceil(max(p_size)*1000.0::DOUBLE)/1000 b, floor(min(p_retailprice)*1000.0::DOUBLE)/1000 c, ceil(max(p_retailprice)*1000.0::DOUBLE)/1000 d FROM t), "
    "o AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS o FROM part) "
    f"SELECT p_partkey, (list_position(o, p_type) - 1)::DOUBLE AS p_type, {sql_fixed('(p_size-a)/(b-a)')} AS p_size, {sql_fixed('(p_retailprice-c)/(d-c)')} AS p_retailprice FROM part, b, o"
)
def encoded_features(spark, sf_dir):
    """Feature space learned on the training rows and applied to all."""
    p = table(spark, sf_dir, "part")
    space = s.learn_space(p, p.filter("p_partkey % 5 <> 0"), ["p_type", "p_size", "p_retailprice"], ["p_type"])
    return space.encode(p, ["p_partkey"]).withColumns({c: fixed(F.col(c)) for c in _NUM})


_PRED = "SELECT l_returnflag AS target, l_linestatus AS stratum, l_orderkey % 3 AS fold, l_extendedprice AS y, l_quantity*1500 AS p FROM lineitem"
_METRIC_SQL = {
    "mae": "avg(abs(p-y))", "rmse": "sqrt(avg((p-y)*(p-y)))", "r2": "1 - avg((p-y)*(p-y))/var_pop(y)",
    "cvrmse": "sqrt(avg((p-y)*(p-y)))/(avg(y)+1e-5)", "mape": "avg(abs(p-(y+1e-5))/greatest(abs(y+1e-5), 2.220446049250313e-16))",
}


def _pred(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS target", "l_linestatus AS stratum", "l_orderkey % 3 AS fold", "l_extendedprice AS target_value", "l_quantity * 1500 AS prediction"
    )


@REGISTRY.add(f"SELECT target, stratum, grouping(stratum) = 1 AS overall, {', '.join(f'{sql_fixed(e, 4)} AS {k}' for k, e in _METRIC_SQL.items())} FROM ({_PRED}) GROUP BY GROUPING SETS ((target, stratum), (target))")
def stratum_and_global_metrics(spark, sf_dir):
    got = s.regression_metrics(_pred(spark, sf_dir), ["target"], "stratum")
    return got.select("target", "stratum", "overall", *[fixed(F.col(k), 4).alias(k) for k in _METRIC_SQL])


_LONG = f"SELECT target, stratum, fold, {', '.join(f'{e} AS {k}' for k, e in _METRIC_SQL.items())} FROM ({_PRED}) GROUP BY ALL"
_AVG = "SELECT target, stratum, metric, avg(value) AS value FROM (UNPIVOT l ON mae, rmse, r2, cvrmse, mape INTO NAME metric VALUE value) GROUP BY ALL"


def _averages(spark, sf_dir):
    per = s.regression_metrics(_pred(spark, sf_dir), ["target", "stratum", "fold"])
    long = s.long_metrics(per, ["target", "stratum", "fold"]).withColumns({"split": F.lit("test"), "measurement": F.lit("Energy")})
    return s.fold_average(long)


@REGISTRY.add(f"WITH l AS ({_LONG}), a AS ({_AVG}) SELECT target, stratum, metric, {sql_fixed('value', 4)} AS value FROM a")
def fold_averaged_metrics(spark, sf_dir):
    return _averages(spark, sf_dir).select("target", "stratum", "metric", fixed(F.col("value"), 4).alias("value"))


_TH = {"mae": 12500.0, "rmse": 1.0, "mape": 0.01, "r2": 0.55, "cvrmse": 0.01}
_OK = "CASE metric " + " ".join(f"WHEN '{k}' THEN value {'>' if k == 'r2' else '<'} {t!r}" for k, t in _TH.items()) + " END"


@REGISTRY.add(f"WITH l AS ({_LONG}), a AS ({_AVG}) SELECT stratum, target, bool_or({_OK}) AS converged FROM a GROUP BY stratum, target")
def convergence_per_target(spark, sf_dir):
    return s.converged_pairs(_averages(spark, sf_dir), _TH)


@REGISTRY.add(f"WITH l AS ({_LONG}), a AS ({_AVG}), c AS (SELECT stratum, target, bool_or({_OK}) AS c FROM a GROUP BY stratum, target) SELECT bool_and(c) AS converged FROM c")
def convergence_overall(spark, sf_dir):
    return s.converged(s.converged_pairs(_averages(spark, sf_dir), _TH))


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
QUICK = plan.Boosting(rounds=5, depth=4, subsample=1.0, column_share="all")


def _training_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", *FEATURES, "l_linestatus AS stratum", "l_extendedprice / 1000 AS Energy_Heating", "l_extendedprice * l_tax / 1000 AS Peak_Heating"
    )


@REGISTRY.add()
def boosted_fold_metrics(spark, sf_dir):
    """Two folds, two targets: train and test metrics per stratum and overall."""
    data = plan.assign_folds(_training_rows(spark, sf_dir), "stratum", ["l_orderkey", "l_linenumber", "l_partkey"], 2)
    results, metrics = plan.cross_validate(
        data, 2, features=FEATURES, categorical=["l_returnflag"], targets=["Energy_Heating", "Peak_Heating"], stratum="stratum", boosting=QUICK
    )
    metrics = cut_lineage(metrics)  # a few rows, kept before the encoded folds are given back
    for r in results:
        r.release()
    return metrics


@REGISTRY.add()
def boosted_learning_curve(spark, sf_dir):
    data = plan.assign_folds(_training_rows(spark, sf_dir), "stratum", ["l_orderkey", "l_linenumber", "l_partkey"], 4)
    return plan.learning_curve(
        data, [0.25, 1.0], ["l_orderkey", "l_linenumber", "l_partkey"], features=FEATURES, categorical=["l_returnflag"],
        targets=["Energy_Heating"], stratum="stratum", boosting=QUICK,
    )


@REGISTRY.add()
def progressive_training_study(spark, sf_dir):
    """Sample customers, run a closed-form leaf, train, test convergence, repeat."""
    import uuid

    population = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "stratum").withColumn("stratum", F.col("stratum") % 3)

    def simulate(specs, iteration):
        return specs.selectExpr("spec_id", "stratum", "c_acctbal", "c_mktsegment", "c_acctbal / 100 + length(c_mktsegment) AS Energy_Heating")

    n = population.count()
    return plan.progressive_training(
        population, "c_custkey", "stratum", simulate, ["c_acctbal", "c_mktsegment"], ["c_mktsegment"], ["Energy_Heating"],
        f"{checkpoint_root(spark)}/study-{uuid.uuid4().hex}", "customers",
        plan.Progress(n_init=n, n_per_iter=n, min_per_stratum=10, max_iters=2, folds=2), QUICK,
    )


# ---- staged boosting, followed in SQL by one-split trees over few values ------------------

STUMPS = Patience(rounds=6, patience=2, depth=1, step=0.5, min_child=1, subsample=1.0, column_share="all", refresh=3)
_STAGED = {"duty": "l_extendedprice * l_tax / 1000.0", "quantity": "l_quantity"}


def _staged_sql(target: str, expr: str) -> str:
    """Rounds of one-split trees on the residuals of lines whose order number 5 does not divide."""
    cells = "SELECT l_tax AS x0, l_discount AS x1, l_orderkey % 5 = 0 AS held, ({e})::DOUBLE AS y FROM lineitem".format(e=expr)
    steps = [f"r0 AS MATERIALIZED (SELECT *, (SELECT avg(y) FROM ({cells}) WHERE NOT held) AS f FROM ({cells}))"]
    for r in range(1, STUMPS.rounds + 1):
        p = f"r{r - 1}"
        steps += [
            f"v{r} AS (SELECT k, x, sum(y - f) AS s, count(*) AS n FROM (SELECT 0 AS k, x0 AS x, y, f FROM {p} WHERE NOT held UNION ALL SELECT 1, x1, y, f FROM {p} WHERE NOT held) GROUP BY k, x)",
            f"c{r} AS (SELECT k, x, sum(s) OVER a AS sl, sum(n) OVER a AS nl, sum(s) OVER w AS s, sum(n) OVER w AS n FROM v{r} WINDOW a AS (PARTITION BY k ORDER BY x), w AS (PARTITION BY k))",
            f"t{r} AS MATERIALIZED (SELECT k, x, sl / nl AS lo, (s - sl) / (n - nl) AS hi FROM c{r} WHERE nl < n ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1)",
            f"r{r} AS MATERIALIZED (SELECT x0, x1, held, y, f + {STUMPS.step} * CASE WHEN CASE k WHEN 0 THEN x0 ELSE x1 END <= x THEN lo ELSE hi END AS f FROM {p}, t{r})",
        ]
    rmse = lambda h: f"sqrt(avg((y - f) * (y - f)) FILTER (WHERE {h}))"
    each = " UNION ALL ".join(f"SELECT {r} AS round, {rmse('NOT held')} AS a, {rmse('held')} AS b FROM r{r}" for r in range(1, STUMPS.rounds + 1))
    return (
        f"WITH {', '.join(steps)}, h AS MATERIALIZED ({each}), m AS (SELECT a.round, arg_min(b.round, b.b) AS best FROM h a JOIN h b ON b.round <= a.round GROUP BY a.round), "
        f"e AS (SELECT coalesce(min(round), {STUMPS.rounds}) AS last FROM m WHERE round - best >= {STUMPS.patience}) "
        f"SELECT '{target}' AS target, round, {sql_fixed('a')} AS train_rmse, {sql_fixed('b')} AS held_rmse, round = (SELECT best FROM m, e WHERE m.round = e.last) AS chosen FROM h, e WHERE round <= last"
    )


@REGISTRY.add(" UNION ALL ".join(f"SELECT * FROM ({_staged_sql(t, e)})" for t, e in _STAGED.items()))
def staged_boosting_history(spark, sf_dir):
    """Error of every round until two rounds bring no gain, and the round that is kept."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_tax", "l_discount", "l_orderkey % 5 = 0 AS __held", *[f"double({e}) AS {t}" for t, e in _STAGED.items()])
    out = None
    for t in _STAGED:
        got = fit_staged(rows, ["l_tax", "l_discount"], t, STUMPS).table(spark, t)
        out = got if out is None else out.unionByName(got)
    return out.withColumns({c: fixed(F.col(c)) for c in ("train_rmse", "held_rmse")})


# ---- models trained in the session, inside inference --------------------------------------

LOADS = ("Raw_Lighting", "Raw_Equipment", "Raw_DomesticHotWater", "Raw_Heating", "Raw_Cooling", "Peak_Heating")
LOAD_FEATURES = ("geometry__wwr", "geometry__f2f_height", "geometry__num_floors", "extra_spaces__basement__use_fraction", "semantic__Windows", "semantic__Cooling")
LOAD_KINDS = ("semantic__Windows", "semantic__Cooling")


def _simulated(spark, sf_dir, n=2):
    """Draws of every supplier's building with closed-form loads, the stand-in for simulations."""
    drawn, _ = draw_ensemble(portfolio(spark, sf_dir, suppliers_as_customers(spark, sf_dir)), n, seed=7)
    return cooling_for_prediction(predict(drawn, "")).drop("semantic__Cooling").withColumnRenamed("predict__Cooling", "semantic__Cooling")


def _trained(spark, sf_dir, targets=LOADS, settings=Patience(rounds=8, patience=3, depth=4, step=0.5, subsample=1.0, column_share="all")):
    data = _simulated(spark, sf_dir).withColumn("fold", F.pmod(F.hash("building_id"), F.lit(4))).withColumn("stratum", F.lit("all"))
    result = plan.train_fold(data, 0, LOAD_FEATURES, LOAD_KINDS, list(targets), "stratum", boosting=settings)
    result.release()
    return result


@REGISTRY.add(
    "SELECT c_custkey AS building_id, unnest(range(2)) AS sample_id, t AS target, TRUE AS same FROM customer, (SELECT unnest(['Raw_Heating', 'Raw_Cooling']) AS t)"
)
def trained_loads_equal_transform(spark, sf_dir):
    """Each draw's loads from the stored trees beside those of the models' own transform."""
    targets = ["Raw_Heating", "Raw_Cooling"]
    result = _trained(spark, sf_dir, targets, plan.Boosting(rounds=4, depth=4, subsample=1.0, column_share="all"))
    ensemble, _ = draw_ensemble(portfolio(spark, sf_dir), 2)
    both = plan.trained_predictor(result.models, result.space)(ensemble, "")
    cooled = cooling_for_prediction(both).drop("semantic__Cooling").withColumnRenamed("predict__Cooling", "semantic__Cooling")
    own = plan.predict(result.space.encode(cooled, ["building_id", "sample_id", *targets]), result.models)
    near = lambda t: f"abs(`{t}` - `pred_{t}`) <= 1e-9D * greatest(abs(`pred_{t}`), 1D)"
    return own.selectExpr("building_id", "sample_id", f"inline(array({', '.join(f'''struct('{t}' AS target, {near(t)} AS same)''' for t in targets)}))")


@REGISTRY.add()
def trained_inference_summary(spark, sf_dir):
    """Distributions of every customer's building with loads from models trained in this session."""
    result = _trained(spark, sf_dir)
    return summarize_results(infer(portfolio(spark, sf_dir), 8, plan.trained_predictor(result.models, result.space)), 8)


@REGISTRY.add()
def trained_savings_summary(spark, sf_dir):
    """Savings of every customer's upgrade, both scenarios predicted by the same trained models."""
    result = _trained(spark, sf_dir)
    ensemble = infer_savings(portfolio(spark, sf_dir), 4, plan.trained_predictor(result.models, result.space), legacy_costs(), standard_incentives())
    return summarize_results(ensemble, 4, prefix="Delta_")


# ---- from building requests to predicted results ------------------------------------------

_KINDS = ("none", "unoccupied_unconditioned", "unoccupied_conditioned", "occupied_unconditioned", "occupied_conditioned")
_AT = {"customer": ("c_custkey", 31, 1009, 600.0, 17, 997, 1100.0), "supplier": ("s_suppkey", 7919, 1000, 500.0, 104729, 1000, 1000.0)}


def _degrees(of, number=lambda v: f"{v!r}D"):
    k, a, m, w, c, n, h = _AT[of]
    return f"{number(-71.0)} + ({k} * {a} % {m}) / {number(w)} AS lon, {number(42.0)} + ({k} * {c} % {n}) / {number(h)} AS lat"


def _requests(spark, sf_dir):
    kinds = f"array({', '.join(map(repr, _KINDS))})"
    p = portfolio(spark, sf_dir).drop("geometry__short_edge", "geometry__long_edge", "geometry__num_floors", "geometry__energy_model_conditioned_area", *[x for x in portfolio(spark, sf_dir).columns if x.startswith("extra_spaces__")])
    p = p.withColumnsRenamed({x: x.removeprefix("semantic__") for x in p.columns if x.startswith("semantic__") and not x.endswith("_new")})
    return p.withColumn("c_custkey", F.col("building_id")).selectExpr(
        "*", _degrees("customer").split(", ")[0], _degrees("customer").split(", ")[1], "15D + c_custkey % 13 AS long_edge", "8D + c_custkey % 7 AS short_edge",
        "double(1 + c_custkey % 3) AS num_floors", "(c_custkey % 7) / 10D AS long_edge_angle",
        f"{kinds}[int(c_custkey % 5)] AS basement", f"{kinds}[int(c_custkey % 4)] AS attic",
    ).drop("c_custkey")


def _station_space(spark, sf_dir):
    """A feature space whose models know two thirds of the stations."""
    names = [r["s_name"] for r in table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select("s_name").collect()]
    return s.FeatureSpace({STATION: tuple(sorted(names))})


def _base(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    stations = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS station_id", "s_name AS name", *_degrees("supplier").split(", "))
    weather = table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_acctbal / 100 AS weather__mean")
    shading = requests.selectExpr("building_id", *[f"(building_id % {7 + k}) / 10D AS shading_mask_{k:02d}" for k in range(4)])
    fields = [x for x in requests.columns if x in (*FIELDS, "Cooling", "OnsiteSolar")]
    carry = ["area_m2", "current_solar_kw", "c_mktsegment"]
    return base_features(requests, stations, _station_space(spark, sf_dir), fields, county="location__county", carry=carry, weather=weather, shading=shading)


_METRES = "radians(lon) * 6378137.0::DOUBLE AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE AS y"
_D = lambda v: f"{v!r}::DOUBLE"


@REGISTRY.add(
    f"WITH c AS (SELECT c_custkey AS k, {_METRES} FROM (SELECT c_custkey, {_degrees('customer', _D)} FROM customer)), "
    f"t AS (SELECT s_suppkey, s_name, s_acctbal, {_METRES} FROM (SELECT *, {_degrees('supplier', _D)} FROM supplier WHERE s_suppkey % 3 <> 0)), "
    "n AS (SELECT k, s_name, s_acctbal, sqrt((c.x-t.x)*(c.x-t.x) + (c.y-t.y)*(c.y-t.y)) AS d, row_number() OVER (PARTITION BY k ORDER BY (c.x-t.x)*(c.x-t.x) + (c.y-t.y)*(c.y-t.y), s_suppkey) AS r FROM c, t) "
    f"SELECT k AS building_id, s_name AS station, {sql_fixed('d', 2)} AS station_distance, {sql_fixed('s_acctbal / 100', 4)} AS weather_mean, {sql_fixed('(k % 9) / 10.0::DOUBLE', 4)} AS shading, "
    f"{sql_fixed('(15.0::DOUBLE + k % 13) / (8.0::DOUBLE + k % 7)')} AS aspect_ratio, CASE WHEN k % 5 = 0 THEN 'No' ELSE 'Yes' END AS basement_exists, "
    "(1 + k % 3 + CASE WHEN k % 5 IN (2, 4) THEN 1 ELSE 0 END + CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END) * (15.0::DOUBLE + k % 13) * (8.0::DOUBLE + k % 7) AS conditioned_area FROM n WHERE r = 1"
)
def portfolio_base_features(spark, sf_dir):
    """Nearest trained station, its weather, shading, geometry and spaces of every building."""
    return _base(spark, sf_dir).select(
        "building_id", F.col(STATION).alias("station"), fixed(F.col("station_distance"), 2).alias("station_distance"), fixed(F.col("weather__mean"), 4).alias("weather_mean"),
        fixed(F.col("geometry__shading_mask_02"), 4).alias("shading"), fixed(F.col("geometry__aspect_ratio")).alias("aspect_ratio"),
        F.col("extra_spaces__basement__exists").alias("basement_exists"), F.col("geometry__energy_model_conditioned_area").alias("conditioned_area"),
    )


@REGISTRY.add()
def requests_to_answers(spark, sf_dir):
    """From building requests over base features and trained models to one JSON answer each."""
    result = _trained(spark, sf_dir)
    base = cut_lineage(_base(spark, sf_dir))  # one row per building
    return respond(summarize_results(infer(base, 8, plan.trained_predictor(result.models, result.space)), 8, nested=True))
