import math

import pytest
from pyspark.sql import functions as F

from brickwork.functions import draws as d
from brickwork.functions import geometry as g
from brickwork.functions.rng import with_row_key
from brickwork.names import dotted, expose_dotted, plain
from brickwork.operators import explore, heat_balance, hourly, ranking, sampling, spatial, summary
from brickwork.operators.priors import PriorSet, default_priors


def test_uniform_and_normal(spark):
    rows, k = with_row_key(spark.range(20000), 3, ["id"])
    r = rows.select(k.uniform("a").alias("u"), k.normal("b").alias("z"), k.scoped("x/").uniform("a").alias("v")).agg(
        F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z"), F.corr("u", "v")
    ).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 < r[1] and r[2] < 1
    assert abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03 and abs(r[5]) < 0.03


def test_draws_do_not_depend_on_partitioning(spark):
    make = lambda df: with_row_key(df, 3, ["id"])
    a, k = make(spark.range(100).repartition(1))
    b, _ = make(spark.range(100).repartition(7))
    assert sorted(a.select("id", k.uniform("q")).collect()) == sorted(b.select("id", k.uniform("q")).collect())


def test_prior_graph():
    p = PriorSet({"a": d.uniform(0, 1), "b": d.plus("a", 1), "c": d.product("b", "base"), "e": d.by_value("base", {1: d.fixed(1)}, d.copy_of("b"))})
    assert p.roots() == {"a", "base"}
    assert set(p.downstream({"a"}).draws) == {"a", "b", "c", "e"}
    assert set(p.downstream({"a"}, False).draws) == {"b", "c", "e"}
    assert set(p.downstream({"base"}).draws) == {"c", "e"}
    assert p.layers() == [["a"], ["b"], ["c", "e"]]
    with pytest.raises(ValueError):
        d.categorical(["a"], [1, 2])


def test_default_priors_solar_only_moves_coverage():
    redo = set(default_priors().downstream({"semantic__OnsiteSolar"}).draws)
    assert redo == {"solar__upgraded_coverage"}
    assert "factors__system__heat__effective_cop" in default_priors().downstream({"semantic__Heating"}).draws


def test_missing_source_and_nulls(spark):
    df, k = with_row_key(spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string"), 1, ["id"])
    with pytest.raises(ValueError):
        PriorSet({"x": d.copy_of("nope")}).apply(df, k)
    p = PriorSet({"x": d.by_value("s", {"a": d.fixed("v")})})
    rep = p.null_report(p.apply(df, k)).collect()
    assert [(r["feature"], r["n_null"]) for r in rep] == [("x", 1)]


def test_names(spark):
    assert dotted("semantic__Heating") == "feature.semantic.Heating" and plain("feature.geometry.wwr") == "geometry__wwr"
    assert expose_dotted(spark.createDataFrame([(1,)], "geometry__wwr int")).columns == ["feature.geometry.wwr"]


def test_percentiles_match_builtin_when_one_value_dominates(spark):
    df = spark.range(30000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 5) END AS k", "CASE WHEN id % 2 = 0 THEN 7D ELSE pow(id, 1.5) END AS v")
    want = {r["k"]: r for r in summary.distribution_summary(df, ["k"], "v", rows_per_group=30000).collect()}
    for got in summary.exact_percentiles(df, ["k"], "v", accuracy=200).collect():
        for p in summary.PERCENTILES:
            assert got[p] == pytest.approx(want[got["k"]][p])


def test_summary_ignores_nan_and_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), (None, 3.0)], "k string, v double")
    r = summary.distribution_summary(df, ["k"], "v").first()
    assert (r["mean"], r["p50"], r["max"]) == (2.0, 2.0, 3.0)


def test_infinite_payback_summary(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, float("inf"))], "b int, v double")
    r = summary.wide_summary(df, ["b"], ["v"], 3).first()
    assert r["mean"] == float("inf") and r["min"] == 1.0 and r["p50"] == 2.0


def test_wide_summary_beyond_one_task_and_nan(spark, monkeypatch):
    df = spark.range(900).selectExpr("id % 3 AS b", "CASE WHEN id % 7 = 0 THEN double('NaN') ELSE sqrt(id) END AS v", "double(id % 5) AS w")
    small = sorted(summary.wide_summary(df, ["b"], ["v", "w"], 300).collect())
    monkeypatch.setattr(summary, "GROUP_LIMIT", 100)
    large = summary.wide_summary(df, ["b"], ["v", "w"], 300)
    assert not any(math.isnan(x) for r in small for x in r[2:])
    for got, want in zip(sorted(large.collect()), small, strict=True):
        assert got[:2] == want[:2] and list(got[2:]) == pytest.approx(list(want[2:]))


def test_option_grid_takes_array_columns(spark):
    df = spark.createDataFrame([(1, ["x", None])], "k int, a array<string>")
    rows = heat_balance.option_grid(df, {"o": F.col("a"), "p": ["u", "v"]}).select("o", "p").collect()
    assert {tuple(r) for r in rows} == {("x", "u"), ("x", "v"), (None, "u"), (None, "v")}


def test_hot_stratum_rank_and_sample(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id < 2500 THEN 'hot' ELSE string(id % 3) END AS s")
    rows, k = with_row_key(df, 9, ["id"])
    ranked = ranking.hash_rank(rows, ["s"], k.uniform("o"), ["id"], "r")
    chk = ranked.groupBy("s").agg(F.count("*").alias("n"), F.max("r").alias("m"), F.count_distinct("r").alias("u")).collect()
    assert all(r["n"] == r["m"] == r["u"] for r in chk)
    folds = ranking.stratified_folds(rows, ["s"], k.uniform("o"), ["id"], 5).groupBy("s", "fold").count().groupBy("s").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r["d"] <= 1 for r in folds.collect())
    got = sampling.sample_equally(df, "s", "id", 40, 1).groupBy("s").count().collect()
    assert {r["count"] for r in got} == {40}
    with pytest.raises(NotImplementedError):
        sampling.stratified_selection(df, "s", "id", 10, 0, mode="proportional")
    with pytest.raises(ValueError):
        sampling.resolve_stratum(df, "nope")


def test_stride_path(spark):
    df = ranking.dense_index(spark.range(50).withColumn("id", F.col("id") * 3), "id")
    items = sorted(r["id"] for r in df.collect())
    want = items[1::3][2::4]
    assert sorted(r["id"] for r in ranking.stride_select(df, "sort_index", [(3, 1), (4, 2)]).collect()) == want


def runs(spark, temps):
    return spark.createDataFrame([("r", "z", i, float(t)) for i, t in enumerate(temps)], "run_id string, zone string, hour int, temp_c double")


def test_longest_runs_edges(spark):
    r = hourly.longest_runs(runs(spark, [20, 31, 31, 20, 31, 31, 31]), ["run_id"], "zone", [30, 10]).first()
    assert (r["P_H_30"], r["P_C_10"], r["P_C_30"]) == (3, 0, 1)  # open run at the end counts, none is 0
    gap = runs(spark, [31, 31, 31]).filter("hour <> 1")
    assert hourly.longest_runs(gap, ["run_id"], "zone", [30]).first()["P_H_30"] == 1


def test_heat_class_tie_and_empty_comfort(spark):
    z = spark.createDataFrame([("r", "a", 0, 20.0, 40.0), ("r", "b", 0, 50.0, 60.0)], "run_id string, zone string, hour int, temp_c double, rh_pct double")
    r = hourly.heat_class_hours(z).first()
    assert r["hi_extreme_danger"] == 1 and r["hi_normal"] == 0
    empty = hourly.comfort_summary(z.withColumn("temp_c", F.lit(None).cast("double"))).first()
    assert all(empty[c] is None for c in ("peak_temp", "OH_26", "CH_5", "hottest_zone"))


def test_rectangle_of_rotated_box(spark):
    a, w, h = 0.4, 12.0, 5.0
    pts = [(math.cos(a) * x - math.sin(a) * y, math.sin(a) * x + math.cos(a) * y) for x, y in ((0, 0), (w, 0), (w, h), (6, 4), (0, h))]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in pts],)], "ring array<struct<x:double,y:double>>")
    r = spatial.add_rectangles(df).first()
    assert r["long_edge"] == pytest.approx(w) and r["short_edge"] == pytest.approx(h) and r["long_edge_angle"] == pytest.approx(a)
    assert r["footprint_area"] < w * h and r["aspect_ratio"] == pytest.approx(w / h)


def test_wkt(spark):
    df = spark.createDataFrame([("POLYGON ((5 0, 5 10, 15 10, 15 0, 5 0))",)], "w string").withColumn("ring", g.ring_from_wkt(F.col("w")))
    r = df.select(g.ring_area(F.col("ring")).alias("a"), g.ring_to_wkt(F.col("ring")).alias("t")).first()
    assert r["a"] == 100 and r["t"] == "POLYGON ((5.0 0.0, 5.0 10.0, 15.0 10.0, 15.0 0.0, 5.0 0.0))"


def test_neighbors_of_copies_and_overlaps(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 30.0, 0.0), (4, 2.0, 0.0), (5, 500.0, 0.0)]
    b = spark.createDataFrame(rows, "id int, cx double, cy double").selectExpr("*", "4D AS long", "2D AS short", "0D AS angle", "CASE WHEN id = 3 THEN NULL ELSE 6D END AS height")
    rects = spatial.distinct_rectangles(b, "id", "height")
    pairs = {(r["loc"], r["other"]) for r in spatial.neighbor_pairs(rects, 50.0).collect()}
    assert pairs == {(1, 3), (3, 1), (3, 4), (4, 3)}
    arr = {r["loc"]: r for r in spatial.neighbor_arrays(rects, spatial.neighbor_pairs(rects, 50.0), "height", 7.0, 3.5).collect()}
    assert arr[5]["neighbor_polys"] == [] and arr[1]["neighbor_heights"] == [7.0] and arr[1]["neighbor_floors"] == [2]
    assert arr[3]["neighbor_copies"] == [2, 1]


def test_nearest_both_ways_against_brute_force(spark):
    p = spark.range(300).selectExpr("id", "double((id * 37) % 101) AS x", "double((id * 53) % 97) * 10 AS y")
    s = spark.range(60).selectExpr("id AS station_id", "CASE WHEN id < 30 THEN 50D + id / 1000 ELSE double((id * 17) % 101) END AS x", "CASE WHEN id = 59 THEN double('NaN') ELSE double((id * 29) % 89) * 11 END AS y")
    pr, sr = p.collect(), [r for r in s.collect() if not math.isnan(r["y"])]
    want = {q["id"]: min(((a["x"] - q["x"]) ** 2 + (a["y"] - q["y"]) ** 2, a["station_id"]) for a in sr)[1] for q in pr}
    for limit in (1000, 0):
        got = {r["id"]: r["station_id"] for r in spatial.nearest_station(p, s, limit=limit).collect()}
        assert got == want


def test_nearest_keeps_rough_points_both_ways(spark):
    nan = float("nan")
    rows = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, None, 1.0), (3, nan, 1.0), (4, 9.0, float("inf")), (5, 8.0, 0.0)]
    p = spark.createDataFrame(rows, "id int, x double, y double").withColumn("tags", F.create_map(F.lit("a"), F.col("id")))
    s = spark.createDataFrame([(7, 0.0, 3.0), (6, 0.0, 3.0), (8, 9.0, 0.0)], "station_id int, x double, y double")
    want = [(1, 6, 3.0), (1, 6, 3.0), (2, None, None), (3, None, None), (4, None, None), (5, 8, 1.0)]
    for limit in (1000, 0):
        got = spatial.nearest_station(p, s, limit=limit)
        assert got.columns == ["id", "x", "y", "tags", "station_id", "distance"]
        assert sorted(((r["id"], r["station_id"], r["distance"]) for r in got.collect()), key=lambda r: r[0]) == want
        assert spatial.nearest_station(p.filter("id > 9"), s, limit=limit).count() == 0


def test_density_integrates(spark):
    df = spark.range(2000).selectExpr("double(id % 100) AS v")
    rows = sorted((r["x"], r["density"]) for r in explore.kernel_density(df, "v", 40).collect())
    step = rows[1][0] - rows[0][0]
    assert 0.85 < sum(y for _, y in rows) * step < 1.05


def test_constant_empty_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("c", 2.0), ("c", 2.0), ("n", float("nan")), ("n", None)], "k string, v double")
    dens = explore.kernel_density(df, "v", 5, ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.count("density").alias("known"))
    assert {(r["k"], r["n"], r["known"]) for r in dens.collect()} == {(None, 5, 5), ("c", 5, 0)}
    flat = explore.histogram(df.filter("k = 'c'"), "v", 4).collect()
    assert sum(r["n"] for r in flat) == 2 and len(flat) == 4
    assert sum(r["n"] for r in explore.histogram(df.filter("k = 'n'"), "v", 4).collect()) == 0
    assert [r["n"] for r in explore.histogram_2d(df.filter("k = 'c'"), "v", "v", 3).collect()] == [2]


def test_rank_keeps_null_strata_and_shuffles_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(400).selectExpr("id", "CASE WHEN id % 4 <> 0 THEN id % 4 END AS s")
        rows, k = with_row_key(df, 2, ["id"])
        got = ranking.hash_rank(rows, ["s"], k.uniform("o"), ["id"], "r", buckets=8)
        assert {(r["s"], r["m"]) for r in got.groupBy("s").agg(F.max("r").alias("m")).collect()} == {(None, 100), (1, 100), (2, 100), (3, 100)}
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        left = plan.split("SortMergeJoin")[1].split("\n+- ")[0]
        assert "SortMergeJoin" in plan and left.count("Exchange hashpartitioning(__cell") >= 1
        assert "row_number()" in left
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
