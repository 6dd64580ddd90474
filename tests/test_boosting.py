"""Staged boosting, stored tree ensembles and trained models in inference."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwork.catalog import training as catalog
from brickwork.catalog.portfolio import portfolio
from brickwork.operators import surrogate as s
from brickwork.plans import boosting as b
from brickwork.plans import inference as plan
from brickwork.plans import training as tr
from brickwork.sources.rules import legacy_costs, standard_incentives


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(600).selectExpr("id", "double(id % 17) AS x", "double(id % 5) AS z", "id % 4 = 0 AS __held", "double(hash(id) % 100) / 50 AS noise")
    return base.selectExpr("*", "x * 2 + z * z + noise AS Energy_Heating", "noise AS Energy_Cooling", "CASE WHEN id % 7 = 0 THEN 'b' ELSE 'a' END AS c").persist()


QUICK = b.Patience(rounds=12, patience=3, depth=2, step=0.5, min_child=1, subsample=1.0, column_share="all", refresh=4)


def test_the_kept_round_has_the_least_held_out_error(rows):
    for target in ("Energy_Heating", "Energy_Cooling"):
        got = b.fit_staged(rows, ["x", "z"], target, QUICK)
        held = [h for _, _, h in got.history]
        assert got.best == 1 + int(np.argmin(held)) and len(got.model.trees) == got.best
        assert len(held) == QUICK.rounds or len(held) - got.best == QUICK.patience
        train = [t for _, t, _ in got.history]
        assert all(y <= x + 1e-9 for x, y in zip(train, train[1:]))
    assert len(b.fit_staged(rows, ["x", "z"], "Energy_Cooling", QUICK).history) < QUICK.rounds


def test_history_follows_from_the_stored_trees(spark, rows):
    got = b.fit_staged(rows, ["x", "z"], "Energy_Heating", QUICK)
    for r in (1, got.best):
        cut = b.TreeEnsemble(got.model.features, got.model.base, b.boosted(spark, got.model.trees[:r], got.model.boosted.treeWeights[:r]))
        scored = b.predict_trees(rows, {"t": cut}, {"x": "x", "z": "z"}, {"t": "p"})
        error = scored.filter("__held").agg(F.sqrt(F.avg((F.col("p") - F.col("Energy_Heating")) ** 2))).first()[0]
        assert error == pytest.approx(got.history[r - 1][2], rel=1e-9)


def test_without_held_out_or_training_rows(rows):
    every = b.fit_staged(rows.withColumn("__held", F.lit(None).cast("boolean")), ["x"], "Energy_Heating", b.Patience(rounds=3, depth=1))
    assert every.best == 3 and every.history[0][2] is None
    none = b.fit_staged(rows.filter("false"), ["x"], "Energy_Heating", QUICK)
    assert none.model.trees == [] and none.model.base == 0.0 and none.history == ()


def test_trees_equal_the_models_own_transform(spark, rows):
    odd = rows.withColumn("x", F.when(F.col("id") % 11 != 0, F.col("x")))
    model = tr.fit_target(rows, ["x", "z"], "Energy_Heating", tr.Boosting(rounds=5, depth=4))
    codes, names = {"x": "x", "z": "z"}, {"Energy_Heating": "p"}
    got = b.predict_trees(model.transform(odd), {"Energy_Heating": b.of_pipeline(model)}, codes, names)
    assert got.filter("p IS NULL OR abs(p - pred_Energy_Heating) > 1e-9").count() == 0
    assert b.predict_trees(odd.limit(0), {"Energy_Heating": b.of_pipeline(model)}, codes, names).count() == 0
    with pytest.raises(ValueError):
        two = {"a": b.TreeEnsemble(("x",), 0.0, None), "b": b.TreeEnsemble(("z",), 0.0, None)}
        b.predict_trees(odd, two, codes, {"a": "a", "b": "b"})


def test_staged_fold_is_stored_and_read(spark, rows, tmp_path):
    data = rows.drop("__held").withColumn("fold", F.col("id") % 3).withColumn("st", F.col("id") % 2)
    result = tr.train_fold(data, 0, ["x", "z", "c"], ["c"], ["Energy_Heating", "Energy_Cooling"], "st", boosting=QUICK)
    assert result.stages["Energy_Heating"].best >= 1 and result.metrics.count() > 0
    tr.save_models(result, spark, str(tmp_path / "m"))
    models, space = tr.load_models(spark, str(tmp_path / "m"))
    assert {t: (m.features, m.base, len(m.trees)) for t, m in models.items()} == {t: (m.features, m.base, len(m.trees)) for t, m in result.models.items()} and space == result.space
    coded = space.encode(data, ["id"])
    assert sorted(tr.predict(coded, models).collect()) == sorted(tr.predict(coded, result.models).collect())
    result.release()


@pytest.fixture(scope="module")
def trained(spark, sf):
    return catalog._trained(spark, sf)


def test_inference_on_trained_models_moves_only_the_portfolio(spark, sf, trained):
    loads = tr.trained_predictor(trained.models, trained.space)
    ensemble = plan.infer(portfolio(spark, sf), 4, loads)
    text = plan.summarize_results(ensemble, 4)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
    savings = plan.infer_savings(portfolio(spark, sf), 2, loads, legacy_costs(), standard_incentives())
    text = savings._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
    # An upgrade that no feature of the models reads changes no load.
    assert savings.filter("c_mktsegment = 'AUTOMOBILE' AND NOT Raw_Heating <=> Raw_Heating_new").count() == 0
    assert savings.filter("Raw_Heating IS NULL OR Raw_Heating_new IS NULL").count() == 0


def test_no_cooling_is_predicted_as_central(spark, trained):
    loads = tr.trained_predictor(trained.models, trained.space)
    base = {f: 0.3 for f in catalog.LOAD_FEATURES if f not in catalog.LOAD_KINDS}
    rows = spark.createDataFrame([{**base, "semantic__Windows": "SinglePane", "semantic__Cooling": c} for c in ("none", "ACCentral")])
    got = loads(rows, "").collect()
    assert got[0]["Raw_Cooling"] == got[1]["Raw_Cooling"] and "predict__Cooling" not in got[0].asDict()
    assert {r["semantic__Cooling"] for r in got} == {"none", "ACCentral"}


def test_many_options_are_joined(spark):
    options = tuple(f"o{k:06d}" for k in range(200_000))
    space = s.FeatureSpace({"c": options, "x": (0.0, 2.0)})
    rows = spark.createDataFrame([(1, "o000007", 1.0), (2, "o199999", 2.0), (3, "zzz", 0.0), (4, None, None)], "id int, c string, x double")
    got = {r["id"]: (r["c"], r["x"]) for r in space.encode(rows, ["id"]).collect()}
    assert got == {1: (7.0, 0.5), 2: (199999.0, 1.0), 3: (-1.0, 0.0), 4: (-1.0, None)}
    data = spark.range(120_000).selectExpr("concat('k', id) AS c")
    assert len(s.learn_space(data, data, ["c"], ["c"]).features["c"]) == 120_000
