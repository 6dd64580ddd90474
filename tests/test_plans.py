import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brickwork.catalog.portfolio import portfolio, predict
from brickwork.names import RAW_END_USES
from brickwork.operators import surrogate as s
from brickwork.operators.energy import cooling_for_prediction
from brickwork.plans import inference as plan
from brickwork.plans import training as tr
from brickwork.sources.rules import legacy_costs, standard_incentives


@pytest.fixture(scope="module")
def savings(spark, sf):
    p = portfolio(spark, sf).limit(60)
    return plan.infer_savings(p, 3, predict, legacy_costs(), standard_incentives()).persist()


def test_shared_draws(savings):
    bad = savings.filter("semantic__Heating <=> semantic__Heating_new AND factors__system__heat__cop <> factors__system__heat__cop_new").count()
    moved = savings.filter("NOT semantic__Heating <=> semantic__Heating_new AND factors__system__heat__cop <> factors__system__heat__cop_new").count()
    assert bad == 0 and moved > 0
    assert "geometry__wwr_new" not in savings.columns


def test_balance(savings):
    by_use = sum((F.col(f"use_{f}_{u}") for f in ("Electricity", "NaturalGas", "Oil") for u in RAW_END_USES), F.lit(0.0))
    by_fuel = F.col("Fuel_Electricity") + F.col("Fuel_NaturalGas") + F.col("Fuel_Oil")
    assert savings.filter(F.abs(by_use - by_fuel) > 1e-9).count() == 0
    assert savings.filter("feasible_cov_new < 0 OR feasible_cov_new > 1 OR net_share_new < -1e-12 OR net_share_new > 1").count() == 0
    assert savings.filter("incentive_Total_AllCustomers > cost_Total + 1e-9 OR net_cost_Total_IncomeEligible < 0").count() == 0
    assert savings.filter("abs(Delta_Total_EndUse - (Total_EndUse - Total_EndUse_new)) > 1e-9").count() == 0


def test_no_shuffle_after_expansion(spark, sf):
    ens = plan.infer(portfolio(spark, sf), 4, predict)
    text = plan.summarize_results(ens, 4)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1  # only the one-row-per-building table moves


def test_response(spark, sf):
    import json

    ens = plan.infer(portfolio(spark, sf).limit(5), 3, predict)
    doc = json.loads(plan.respond(plan.summarize_results(ens, 3)).first()["response"])
    assert doc["Disaggregation"]["Gross"]["FuelCost"]["Oil"]["units"] == "USD"
    assert doc["Total"]["Normalized"]["Raw"]["Total"]["units"] == "kWh/m2"


def test_responses_are_built_in_the_row_of_their_building(spark, sf):
    import json

    ens = plan.infer(portfolio(spark, sf).limit(40), 3, predict).cache()
    long = plan.summarize_results(ens, 3)
    nested = plan.respond(plan.summarize_results(ens, 3, nested=True))
    want = {}
    for r in long.collect():
        part = want.setdefault(r["building_id"], {}).setdefault("Total" if r["segment"] == "Total" else "Disaggregation", {})
        figures = {k: v for k, v in r.asDict().items() if v is not None and k not in ("building_id", "normalization", "dataset", "segment")}
        part.setdefault(r["normalization"], {}).setdefault(r["dataset"], {})[r["segment"]] = figures
    got = [r.asDict() for r in nested.collect()]
    assert {r["building_id"]: json.loads(r["response"]) for r in got} == want and len(got) == len(want) == 40
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in plan.respond(long).collect())
    # Keys in order at every level.
    ordered = json.loads(got[0]["response"], object_pairs_hook=lambda pairs: [k for k, _ in pairs])
    assert ordered == ["Disaggregation", "Total"]
    # The draws of a building are summed up; its summaries are gathered no more.
    text = nested._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [") == 1 and "collect_list" not in text


def test_cooling_none(spark):
    df = spark.createDataFrame([("none",), ("ACWindow",)], "semantic__Cooling string")
    assert [r["predict__Cooling"] for r in cooling_for_prediction(df).collect()] == ["ACCentral", "ACWindow"]


def test_space_encode_and_models(spark, tmp_path):
    df = spark.range(200).selectExpr("id", "id % 2 AS st", "double(id) AS x", "CASE WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS c", "double(id) * 2 AS Energy_Heating")
    data = tr.assign_folds(df, "st", ["id"], 2)
    res = tr.train_fold(data, 0, ["x", "c"], ["c"], ["Energy_Heating"], "st", boosting=tr.Boosting(rounds=3, depth=3))
    assert res.space.features["c"] == ("a", "b")
    enc = res.space.encode(spark.createDataFrame([(1.0, "zzz")], "x double, c string")).first()
    assert enc["c"] == -1.0
    root = str(tmp_path / "models")
    tr.save_models(res, spark, root)
    models, space = tr.load_models(spark, root)
    assert list(models) == ["Energy_Heating"] and space == res.space
    out = tr.predict(space.encode(df, ["id"]), models)
    assert "pred_Energy_Heating" in out.columns and out.count() == 200
    assert {r["metric"] for r in res.metrics.select("metric").distinct().collect()} == set(s.METRICS)


def test_convergence_rules(spark):
    rows = [("Energy", "E", "s1", "mae", 0.1), ("Energy", "E", "s1", "r2", 0.1), ("Energy", "G", "s1", "r2", 0.99), ("Peak", "E", "s1", "mae", 99.0)]
    avg = spark.createDataFrame(rows, "measurement string, target string, stratum string, metric string, value double")
    assert s.converged(s.converged_pairs(avg)).first()["converged"] is True
    worse = avg.unionByName(spark.createDataFrame([("Energy", "E", "s2", "mae", 9.0)], avg.schema))
    assert s.converged(s.converged_pairs(worse)).first()["converged"] is False


def test_progressive_loop_stops(spark, tmp_path):
    pop = spark.range(300).selectExpr("id", "id % 2 AS st", "double(id) AS x")
    sim = lambda df, it: df.selectExpr("spec_id", "st", "x", "x AS Energy_Heating")
    hist = tr.progressive_training(
        pop, "id", "st", sim, ["x"], [], ["Energy_Heating"], str(tmp_path / uuid.uuid4().hex), "e",
        tr.Progress(n_init=200, n_per_iter=100, min_per_stratum=10, max_iters=3, folds=2, thresholds={"mae": 1e9}), tr.Boosting(rounds=2, depth=3),
    )
    assert {r["iteration"] for r in hist.collect()} == {0} and hist.filter("NOT converged").count() == 0


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90


def test_manifest(spark):
    from brickwork.plans.manifest import manifest

    sq = lambda x, y, w=8.0: [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + 6.0}, {"x": x, "y": y + 6.0}]
    rows = [(1, "EPSG:3857", sq(0.0, 0.0), "SFH", 7.0), (2, "EPSG:3857", sq(20.0, 0.0), "MFH", None), (3, "EPSG:3857", sq(900.0, 0.0), "SFH", 10.6)]
    foot = spark.createDataFrame(rows, "id long, crs string, ring array<struct<x:double,y:double>>, Typology string, h double")
    st = spark.createDataFrame([(0, "a.zip", 0.0, 0.0), (1, "b.zip", 1000.0, 0.0)], "station_id long, path string, x double, y double")
    got = {r["id"]: r for r in manifest(foot, st, "id", "exp", {"Typology": ["SFH", "MFH"]}, height="h").collect()}
    assert len(got) == 3 and [got[i]["sort_index"] for i in (1, 2, 3)] == [0, 1, 2]
    assert got[1]["neighbor_heights"] == [7.0] and got[2]["neighbor_heights"] == [7.0] and got[3]["neighbor_polys"] == []
    assert got[3]["epwzip_uri"].endswith("b.zip") and got[3]["num_floors"] == 3 and got[1]["long_edge"] == pytest.approx(8)
    with pytest.raises(ValueError):
        manifest(foot, st, "id", "exp", {"Typology": ["SFH"]}, height="h")
    with pytest.raises(ValueError):
        manifest(foot, st.filter("station_id = 1"), "id", "exp", {"Typology": ["SFH", "MFH"]}, height="h", max_station_distance=100.0)
    with pytest.raises(ValueError):
        manifest(foot.withColumn("crs", F.lit(None).cast("string")), st, "id", "exp", {"Typology": ["SFH", "MFH"]}, height="h")
