"""Sinks that publish whole batches, discovered frames and cells, factor kinds, fixed-size samples."""

import os

import pytest
from pyspark.sql import functions as F

from brickwork.operators import collate as c
from brickwork.operators import quantities as q
from brickwork.operators.sampling import sample_rows
from brickwork.sources import publish as pub
from brickwork.sources import tables as t


def failing(spark):
    return spark.range(3).selectExpr("id", "CASE WHEN id = 2 THEN raise_error('no row') ELSE 'x' END AS v")


def test_a_failed_key_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    with pytest.raises(Exception):
        t.write_frames({"first": spark.range(5), "second": failing(spark)}, root)
    assert pub.frame_places(spark, root) == {} and t.read_frames(spark, root) == {}
    assert not [n for n in os.listdir(root) if not n.startswith(".")]
    t.write_frames({"first": spark.range(5)}, root)
    with pytest.raises(Exception):
        t.write_frames({"first": spark.range(9), "second": failing(spark)}, root, existing="overwrite")
    assert {k: df.count() for k, df in t.read_frames(spark, root).items()} == {"first": 5}


def test_refused_and_replaced_keys(spark, tmp_path):
    root = str(tmp_path / "out")
    t.write_frames({"a": spark.range(1), "b": spark.range(2)}, root)
    with pytest.raises(FileExistsError):
        t.write_frames({"c": spark.range(3), "b": spark.range(9)}, root)
    assert sorted(t.read_frames(spark, root)) == ["a", "b"]
    t.write_frames({"b": spark.range(4), "c": spark.range(3)}, root, existing="overwrite")
    assert {k: df.count() for k, df in t.read_frames(spark, root).items()} == {"a": 1, "b": 4, "c": 3}
    assert t.write_frames({"my_errors": spark.range(1)}, root) == {} and t.write_frames({}, root) == {}
    with pytest.raises(ValueError):
        t.write_frames({"a": spark.range(1)}, root, existing="append")
    with pytest.raises(KeyError):
        t.read_frames(spark, root, ["nothing"])


def test_frames_of_many_folders_are_merged(spark, tmp_path):
    for k in range(3):
        t.write_frames({"x": spark.range(2).withColumn(f"c{k}", F.lit(k)), f"only{k}": spark.range(1)}, str(tmp_path / str(k)))
    spark.range(7).write.parquet(str(tmp_path / "0" / "plain"))
    got = pub.collect_frames(spark, [str(tmp_path / str(k)) for k in range(3)])
    assert sorted(got) == ["only0", "only1", "only2", "plain", "x"] and got["plain"].count() == 7
    assert sorted(got["x"].columns) == ["c0", "c1", "c2", "id"] and got["x"].count() == 6
    assert pub.collect_frames(spark, []) == {}


def test_a_stage_is_replaced_only_by_a_whole_one(spark, tmp_path):
    root = str(tmp_path)
    path = t.write_stage(spark.range(5), root, "e", 0, "specs")
    with pytest.raises(Exception):
        t.write_stage(failing(spark), root, "e", 0, "specs")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(FileExistsError):
        t.write_stage(spark.range(1), root, "e", 0, "specs", existing="forbid")
    assert spark.read.parquet(t.write_stage(spark.range(2), root, "e", 0, "specs")).count() == 2
    assert sorted(os.listdir(tmp_path / "e" / "iter-000")) == ["specs"]


def test_inline_rows(spark):
    a = spark.createDataFrame([(1, "x")], "n long, s string")
    got = c.combine_results([{"k": a}, {"k": [{"n": 2}, {"n": 3, "m": 1.5}]}], lambda uri: {})
    assert sorted((r["n"], r["s"], r["m"]) for r in got["k"].collect()) == [(1, "x", None), (2, None, None), (3, None, 1.5)]
    for bad in ([], [1, 2], "text"):
        with pytest.raises(ValueError):
            c.combine_results([{"k": bad}], lambda uri: {})


def test_cells_are_found_and_empty_ones_dropped(spark):
    rows = [("r1", "Total", "kWh", 1.0), ("r1", "Total", "W m2", 2.0), ("r2", "Total", "kWh", None), ("r2", "Never", "kWh", None), ("r3", None, "kWh", 3.0)]
    report = spark.createDataFrame(rows, "run string, row string, col string, v double")
    wide = c.wide_report(report, "run", "row", "col", "v")
    assert wide.columns == ["run", "Total_W_m2", "Total_kWh"]
    assert sorted(map(tuple, wide.collect()), key=repr) == [("r1", 2.0, 1.0), ("r2", None, None), ("r3", None, None)]
    assert c.wide_report(report.filter("v IS NULL"), "run", "row", "col", "v").columns == ["run"]
    assert c.drop_empty(report.filter("v IS NULL"), ["v", "row"]).columns == ["run", "row", "col"]
    with pytest.raises(ValueError):
        c.wide_report(report, "run", "row", "col", "v", [("a b", "c"), ("a", "b c")])


def test_registered_kinds_join_the_projection(spark):
    q.register_factor("PerStorey", lambda f, t: f"{f.coefficient}D * {t.indicator('floors')} + {t.basis}", needs_cost=True)
    rules = q.RuleSet((q.Rule("w", None, "new", (q.Factor("PerStorey", coefficient=2.0), q.Factor(q.FIXED, amount=1.0)), ("PerStorey", q.FIXED)),), "incentive")
    rows = spark.createDataFrame([(3, 10.0, "old", "new"), (3, 10.0, "new", "new")], "floors int, cost_w double, was string, now string")
    done = q.add_quantities(rows, rules, lambda _: "was", lambda _: "now", cost_prefix="cost_")
    assert [r["incentive_Total"] for r in done.collect()] == [10.0, 0.0]  # at most the cost
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        q.add_quantities(rows.drop("cost_w"), rules, lambda _: "was", lambda _: "now", cost_prefix="cost_")
    with pytest.raises(ValueError):
        q.factor_value(q.Factor("NoSuchKind"), "x", q.quoted, None, None)


def test_fixed_size_samples(spark):
    df = spark.range(20_000).withColumn("v", F.col("id") % 7)
    got = sample_rows(df, 7_000, 5, ["id"])
    assert got.columns == df.columns and got.count() == 7_000 == got.distinct().count()
    inner = {r["id"] for r in sample_rows(df, 500, 5, ["id"]).collect()}
    assert len(inner) == 500 and inner < {r["id"] for r in got.collect()}
    assert sample_rows(df, 20_001, 5, ["id"]).count() == 20_000 and sample_rows(df, 0, 5, ["id"]).count() == 0
    assert sample_rows(df.limit(0), 3, 5, ["id"]).count() == 0
    same = spark.createDataFrame([(1,)] * 3000, "id long")
    assert sample_rows(same, 1234, 5, ["id"]).count() == 1234


def test_bucketed_scenarios_join_in_place(spark, tmp_path):
    from brickwork.operators.retrofit import matched_difference_wide

    rows = spark.range(400).selectExpr("id % 50 AS building_id", "id % 8 AS sample_id", "id", "double(id) AS a", "double(id * 2) AS b").dropDuplicates(["building_id", "sample_id"])
    keys = ["building_id", "sample_id"]
    one = pub.publish_bucketed(rows, "scenario_one", str(tmp_path / "one"), keys, 5)
    two = pub.publish_bucketed(rows.filter("building_id <> 3").withColumn("a", F.col("a") - 1), "scenario_two", str(tmp_path / "two"), keys, 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = matched_difference_wide(one, two, keys, ["a", "b"], ("id",))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        kept = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(kept) == rows.filter("building_id <> 3").count() and {(r["a"], r["b"]) for r in kept} == {(1.0, 0.0)}
    for name in ("scenario_one", "scenario_two"):
        spark.sql(f"DROP TABLE {name}")
    with pytest.raises(ValueError):
        pub.publish_bucketed(rows, "none", str(tmp_path / "none"), keys, 0)
