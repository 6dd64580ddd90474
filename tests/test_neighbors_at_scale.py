"""Neighbour queries on crowded places: exact against brute force, with little met and only rectangles shuffled."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwork.operators import spatial as op

R = 60.0


def crowd(spark, n=260, side=90.0, seed=3):
    """Small and large rectangles of many heights in a crowded square, some far out, some without numbers."""
    g = np.random.default_rng(seed)
    at = np.vstack([g.uniform(0, side, (n - 20, 2)), g.uniform(-400, 400, (20, 2))])
    rows = [(i, float(x), float(y), float(g.uniform(1, 6)), float(g.uniform(0.5, 3)), float(g.uniform(-2, 2)), float(g.uniform(3, 30)) if i % 9 else None) for i, (x, y) in enumerate(at)]
    rows += [(1000, None, 5.0, 2.0, 1.0, 0.0, 5.0), (1001, 5.0, 5.0, 2.0, 1.0, None, 500.0), (1002, 40.0, math.nan, 2.0, 1.0, 0.0, 5.0), (1003, 41.0, 40.0, 2.0, 1.0, 0.1, -4.0)]
    schema = "loc long, cx double, cy double, long double, short double, angle double, height double"
    return spark.createDataFrame(rows, schema).withColumn("copies", F.lit(1).cast("long"))


def every_pair(rects, apart=True):
    """All pairs by a product, tested by the rectangles' text alone."""
    a, b = (rects.withColumnsRenamed({c: f"{p}{c}" for c in rects.columns}) for p in ("a_", "b_"))
    pairs = a.crossJoin(b).filter(f"a_loc <> b_loc AND {op._D2} <= {R * R!r}D")
    return pairs.filter("NOT " + op.g.overlap_sql("a_", "b_")) if apart else pairs


def brute_horizon(rects, n):
    ring = op.rectangle_ring("b_cx", "b_cy", "b_long", "b_short", "b_angle")
    points = op.edge_points(every_pair(rects).selectExpr("a_loc AS loc", "a_cx AS x0", "a_cy AS y0", "coalesce(b_height, 7D) AS z", f"{ring} AS ring"))
    return {(r["loc"], r["az_bin"]): r["elevation"] for r in op.horizon(points, ["loc", "x0", "y0"], n).collect()}


def test_horizon_is_exact_and_meets_few_rectangles(spark, monkeypatch):
    rects = crowd(spark, 700).cache()
    want = brute_horizon(rects, 12)
    met = []
    real = op.edge_points

    def counted(surfaces, ring="ring"):
        met.append(surfaces.count())
        return real(surfaces, ring)

    monkeypatch.setattr(op, "edge_points", counted)
    got = {(r["loc"], r["az_bin"]): r["elevation"] for r in op.neighbor_horizon(rects, R, 12, "height", 7.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert sum(met) < every_pair(rects).count() / 4


def test_horizon_of_repeated_names(spark):
    one = crowd(spark, 60).filter("loc < 1000")
    twice = one.unionByName(one.filter("loc % 3 = 0").withColumn("cx", F.col("cx") + 7))
    got = op.neighbor_horizon(twice, R, 12, "height", 7.0)
    assert got.count() == got.dropDuplicates(["loc", "x0", "y0", "az_bin"]).count() > 0


def test_neighbor_arrays_hold_all_and_shuffle_only_rectangles(spark):
    rects = crowd(spark, 200).cache()
    want = {}
    for r in every_pair(rects).select("a_loc", "b_loc", F.expr("coalesce(b_height, 7D)").alias("h")).collect():
        want.setdefault(r["a_loc"], []).append((r["b_loc"], r["h"]))
    found = op.neighbor_arrays_within(rects, R, "height", 7.0, 3.5)
    got = {r["loc"]: r for r in found.collect()}
    assert got.keys() == {r["loc"] for r in rects.collect()}
    for loc, r in got.items():
        assert r["neighbor_heights"] == [h for _, h in sorted(want.get(loc, []))]
        assert len(r["neighbor_polys"]) == len(r["neighbor_copies"]) == len(r["neighbor_floors"]) == len(r["neighbor_heights"])
    assert got[1000]["neighbor_polys"] == [] and got[0]["neighbor_polys"][0].startswith("POLYGON ((")
    # Both sides of the meeting, and nothing after it.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan[: plan.index("Join")].count("Exchange") == 0


def test_members_travel_with_their_rectangle(spark, monkeypatch):
    monkeypatch.setattr(op, "MEMBERS", 3)
    rects = crowd(spark, 40, 60.0).drop("copies")
    copies = spark.range(8).selectExpr("id AS k")
    b = rects.crossJoin(copies).filter("k = 0 OR loc % 5 = 0").withColumn("id", F.col("loc") * 10 + F.col("k")).drop("loc", "k")
    own = op.distinct_rectangles(b, "id", "height")
    rows = op.with_members(b, own, "id")
    assert rows.selectExpr("sum(size(members))").first()[0] == b.count()
    pairs = op.neighbor_pairs(rows, R, carry=("members",))
    key = lambda df: sorted((x["id"], x["other"], x["distance"]) for x in df.collect())
    found = op.building_pairs(b, own, pairs, "id")
    assert key(found) == key(op.building_pairs(b, own, op.neighbor_pairs(own, R), "id")) != []
    # The pairs themselves are joined with nothing.
    assert found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0].count("members") > 0


@pytest.mark.parametrize("side", [8.0, 90.0, 700.0])
def test_neighbor_statistics(spark, side):
    rects = crowd(spark, 160, side).cache()
    want = {}
    for r in every_pair(rects, apart=False).selectExpr("a_loc AS loc", f"sqrt({op._D2}) AS d").collect():
        want.setdefault(r["loc"], []).append(r["d"])
    got = {r["loc"]: (r["n_neighbors"], r["nearest"]) for r in op.neighbor_statistics(rects, R).collect()}
    assert got == {k: (len(v), min(v)) for k, v in want.items()}
