"""Steps that several queries share, and what they move."""

import math
import re

import pytest

from brickwork import catalog
from brickwork.operators import summary


def _wide(spark):
    rows = [(i % 3, *[None if (i + k) % 7 == 0 else math.nan if (i * k) % 11 == 5 else math.sin(i * (k + 1)) * 10**k for k in range(3)]) for i in range(40)]
    rows += [(9, None, 1.0, float("inf")), (9, None, 1.0, float("-inf")), (None, 2.0, 3.0, 4.0)]
    return spark.createDataFrame(rows, "g int, a double, b double, c double")


def test_sorted_arrays_give_the_built_in_percentiles(spark, monkeypatch):
    wide = _wide(spark)
    got = summary.wide_summary(wide, ["g"], ["a", "b", "c"], 40)
    assert "percentile(" not in got._jdf.queryExecution().analyzed().toString()
    listed = {(r["g"], r["name"]): r.asDict() for r in got.collect()}
    monkeypatch.setattr(summary, "LISTED", (0, 0))
    built_in = {(r["g"], r["name"]): r.asDict() for r in summary.wide_summary(wide, ["g"], ["a", "b", "c"], 40).collect()}
    assert listed.keys() == built_in.keys() and len(listed) == 15
    for key, want in built_in.items():
        for name, value in want.items():
            have = listed[key][name]
            assert have == value or have == pytest.approx(value, rel=1e-12, nan_ok=True), (key, name)


def test_stored_differences_move_wide_draws_once(spark, sf):
    plan = catalog.queries()["matched_difference_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    exchanges = re.findall(r"Exchange hashpartitioning\(.*", initial)
    assert len(exchanges) == 1 and "building_id" in exchanges[0] and "normalization" not in exchanges[0]


def test_folds_are_ranked_once(spark, monkeypatch):
    from brickwork.plans import training

    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            scans.add(len(b))
            yield b

    rows = spark.range(400).selectExpr("id", "id % 2 AS stratum", "double(id % 17) AS x", "double(id % 17) * 2 AS Energy_Heating").mapInPandas(seen, "id long, stratum long, x double, Energy_Heating double")
    data = training.assign_folds(rows, "stratum", ["id"], 4)
    before = scans.value
    quick = training.Boosting(rounds=1, depth=1, subsample=1.0, column_share="all")
    got = training.learning_curve(data, [0.5, 1.0], ["id"], features=["x"], categorical=[], targets=["Energy_Heating"], stratum="stratum", boosting=quick)
    assert got.filter("split = 'test'").count() > 0
    assert scans.value == before
