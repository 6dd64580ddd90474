import json

import pytest
from pyspark.sql import functions as F

from brickwork.operators import quantities as q
from brickwork.operators.retrofit import add_retrofit_economics, next_size, payback_years
from brickwork.sources.rules import legacy_costs, load_rule_set, read_rules, standard_incentives

ROW = {
    "building_id": 1,
    "geometry__energy_model_conditioned_area": 250.0,
    "geometry__est_fp_ratio": 1.0,
    "geometry__computed__roof_surface_area": 200.0,
    "geometry__computed__whole_bldg_facade_area": 300.0,
    "geometry__est_uniform_linear_scaling_factor": 1.0,
    "geometry__computed__total_linear_facade_distance": 100.0,
    "geometry__computed__footprint_area": 250.0,
    "geometry__computed__window_area": 30.0,
    "saving_usd": 1000.0,
}
OLD = {
    "Heating": "NaturalGasHeating", "Windows": "SinglePane", "Walls": "SomeInsulationWalls", "Weatherization": "LeakyEnvelope",
    "AtticFloorInsulation": "NoInsulation", "DHW": "NaturalGasDHW", "Thermostat": "NoControls", "Equipment": "LowEfficiencyEquipment",
    "Cooling": "ACCentral", "Distribution": "Steam",
}


def economics(spark, costs=None, incentives=None, **changes):
    row = dict(ROW)
    for k, v in OLD.items():
        row[f"semantic__{k}"] = v
        row[f"semantic__{k}_new"] = changes.get(k, v)
    df = spark.createDataFrame([row])
    return add_retrofit_economics(df, costs or legacy_costs(), incentives or standard_incentives()).first()


def test_hand_computed_costs(spark):
    r = economics(
        spark, Weatherization="TightEnvelope", Windows="DoublePaneLowE", Walls="FullInsulationWallsCavity", AtticFloorInsulation="HighlyInsulated"
    )
    assert r["cost_Weatherization"] == pytest.approx(2207.50)
    assert r["cost_Windows"] == pytest.approx(16146.0)
    assert r["cost_Walls"] == pytest.approx(10478.0)
    assert r["cost_AtticFloorInsulation"] == pytest.approx(4145.0)
    assert r["cost_Total"] == pytest.approx(2207.5 + 16146 + 10478 + 4145)
    assert r["incentive_Windows_AllCustomers"] == pytest.approx(600)
    assert r["net_cost_Windows_AllCustomers"] == pytest.approx(15546)
    assert r["cost_Heating"] == 0


def test_bracket_incentives_and_clip(spark):
    r = economics(spark, Heating="ASHPHeating", Thermostat="Controls")
    assert r["incentive_Heating_AllCustomers"] == pytest.approx(12000)
    assert r["incentive_Heating_IncomeEligible"] == pytest.approx(17000)
    assert (r["incentive_Thermostat_AllCustomers"], r["incentive_Thermostat_IncomeEligible"]) == (100, 200)
    r = economics(spark, Heating="GSHPHeating")
    assert r["incentive_Heating_IncomeEligible"] == pytest.approx(18000)  # clipped to the cost
    assert r["net_cost_Total_IncomeEligible"] == 0
    assert r["incentive_Total_IncomeEligible"] > r["incentive_Total_AllCustomers"]


@pytest.mark.parametrize("cost,all_,low", [(20000, 12000, 17000), (11091, 11091, 11091)])
def test_percent_of_full_cost(spark, cost, all_, low):
    costs = q.RuleSet((q.Rule("Heating", None, "ASHPHeating", (q.Factor("FixedQuantity", amount=float(cost)),), ("FixedQuantity",)),), "cost")
    r = economics(spark, costs, q.RuleSet(tuple(x for x in standard_incentives().rules if x.trigger == "Heating"), "incentive"), Heating="ASHPHeating")
    assert r["incentive_Heating_AllCustomers"] == pytest.approx(all_)
    assert r["incentive_Heating_IncomeEligible"] == pytest.approx(low)


def test_initial_value_must_match(spark):
    assert economics(spark, DHW="HPWH")["incentive_DHW_AllCustomers"] == 0
    assert economics(spark, DHW="HPWH")["cost_DHW"] == 3200


def test_factors_outside_order_are_ignored_and_reported(spark):
    rule = q.Rule("Heating", None, "ASHPHeating", (q.Factor("FixedQuantity", amount=5.0), q.Factor("LinearQuantity", coefficient=9.0)), ("FixedQuantity",))
    assert rule.problems()
    assert economics(spark, q.RuleSet((rule,), "cost"), q.RuleSet((), "incentive"), Heating="ASHPHeating")["cost_Heating"] == 5.0


def test_percent_needs_a_cost(spark):
    costs = q.RuleSet((q.Rule("Walls", None, "SIP", (q.Factor("FixedQuantity", amount=1.0),), ("FixedQuantity",)),), "cost")
    with pytest.raises(ValueError):
        economics(spark, costs, standard_incentives(), Heating="ASHPHeating")


def test_error_factors_keep_sign(spark):
    from brickwork.functions.rng import with_row_key

    rows, keyed = with_row_key(spark.range(500), 1, ["id"])
    f = q.Factor("FixedQuantity", amount=-100.0, error_scale=1.0)
    x = rows.selectExpr(f"{q.factor_value(f, 'f', q.quoted, None, keyed)} AS x").agg(F.max("x"), F.stddev("x")).first()
    assert x[0] <= 0 and x[1] > 20


def test_detailed_columns_and_final_filter(spark):
    row = {"semantic__Heating": "OilHeating", "semantic__Heating_new": "ASHPHeating"}
    df = spark.createDataFrame([row])
    look = lambda t: f"semantic__{t}"
    heat = q.RuleSet(tuple(r for r in legacy_costs().rules if r.trigger == "Heating"), "cost")
    out = q.add_quantities(df, heat, look, lambda t: f"semantic__{t}_new", detailed=True).first()
    assert out["cost_Heating_ASHPHeating"] == 18000 and out["cost_Heating_GSHPHeating"] == 0
    none = q.add_quantities(df, heat, look, lambda t: f"semantic__{t}_new", finals=["GSHPHeating"]).first()
    assert none["cost_Total"] == 0


def test_two_matching_rules_add_up_or_fail(spark):
    df = spark.createDataFrame([("old", "new")], "was string, now string")
    for initials, hits in (((None, "old"), 2), (("other", "old"), 1)):
        rules = tuple(q.Rule("T", i, "new", (q.Factor(q.FIXED, amount=10.0),), (q.FIXED,)) for i in initials)
        run = lambda flag: q.add_quantities(df, q.RuleSet(rules, "cost", flag), lambda t: "was", lambda t: "now").first()["cost_T"]  # noqa: B023, E731
        assert run(False) == 10.0 * hits
        if hits == 1:
            assert run(True) == 10.0
        else:
            with pytest.raises(Exception, match="several cost rules for T -> new"):
                run(True)


def test_rule_file(spark, tmp_path):
    doc = {
        "output_key": "incentive", "raise_on_duplicate_trigger": False, "create_metadata": True, "metadata_aggregation": "bracket",
        "quantities": [
            {
                "trigger_column": "Heating", "initial": None, "final": "ASHPHeating", "order": ["LinearQuantity", "PercentQuantity"],
                "quantity_factors": [
                    {"type": "LinearQuantity", "coefficient": 10000, "indicator_cols": ["feature.homeowner.in_bracket.AllCustomers"], "error_scale": 0, "description": "d", "source": "s", "units": "$", "per": "rebate"},
                    {"type": "PercentQuantity", "percent": 0.3, "limit": 2000, "limit_unit": "USD", "error_scale": 0, "description": "d", "source": "s"},
                ],
            }
        ],
    }
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(doc))
    assert read_rules(spark, str(path)).count() == 2
    rules = load_rule_set(spark, str(path))
    assert rules.rules[0].factors[0].indicators == ("homeowner__in_bracket__AllCustomers",)
    r = economics(spark, None, rules, Heating="ASHPHeating")
    assert r["incentive_Heating_AllCustomers"] == pytest.approx(12000)


def test_sizes_and_payback(spark):
    df = spark.createDataFrame([(5.3,), (5.31,), (31.6,), (40.0,)], "v double")
    assert [r[0] for r in df.selectExpr(next_size("v")).collect()] == [5.3, 7.0, 31.6, 40.0]
    p = spark.createDataFrame([(100.0, 50.0), (100.0, -5.0), (-1.0, 10.0)], "c double, s double")
    assert [r[0] for r in p.selectExpr(payback_years("c", "s")).collect()] == [2.0, 10000.0, float("inf")]
