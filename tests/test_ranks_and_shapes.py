"""Bucketed ranks, two-scan percentiles, copies of buildings, rectangles of long rings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwork.functions import geometry as g
from brickwork.operators import ranking as r
from brickwork.operators import spatial as sp
from brickwork.operators import summary as s


def test_buckets_follow_the_rows():
    assert [r.bucket_number(n, 100) for n in (0, 99, 100, 1000, 10_000, 100_000)] == [1, 1, 2, 11, 101, 1001]
    assert r.bucket_number(10**15) == r.MOST_BUCKETS


@pytest.mark.parametrize("bounds", [[], [5], [1, 3, 3.5, 9], list(range(0, 100, 7))])
def test_binary_search(spark, bounds):
    got = spark.range(-2, 103).select("id", r.bucket_of(F.col("id").cast("double"), [float(b) for b in bounds]).alias("b")).collect()
    assert [x["b"] for x in got] == [sum(b <= x["id"] for b in bounds) for x in got]


@pytest.mark.parametrize("rows", [50, 300, 3000])
def test_ranks_do_not_depend_on_buckets(spark, monkeypatch, rows):
    df = spark.range(rows).selectExpr("id", "id % 3 AS k", "pmod(hash(id), 1000003) / 1000003D AS u", "id * id - 7 AS square")
    few = {x["id"]: x["rank"] for x in r.hash_rank(df, ["k"], F.col("u"), ["id"]).collect()}
    index = {x["id"]: x["sort_index"] for x in r.dense_index(df, "square").collect()}
    monkeypatch.setattr(r.bucket_number, "__defaults__", (40,))
    assert {x["id"]: x["rank"] for x in r.hash_rank(df, ["k"], F.col("u"), ["id"]).collect()} == few
    assert {x["id"]: x["sort_index"] for x in r.dense_index(df, "square").collect()} == index
    order = sorted(range(rows), key=lambda i: i * i - 7)
    assert [index[i] for i in order] == list(range(rows))


@pytest.fixture(scope="module")
def skewed(spark):
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE concat('k', id % 5) END AS k", "double(pmod(hash(id), 997)) AS v", "id")
    return df.withColumn("v", F.when(F.col("id") % 50 == 0, float("nan")).when(F.col("id") % 3 == 0, F.floor(F.col("v") / 300).cast("double")).otherwise(F.col("v"))).persist()


def expected(df, p):
    groups = {}
    for row in df.collect():
        groups.setdefault(row["k"], []).append(row["v"])
    out = {}
    for k, vs in groups.items():
        vs = np.array([v for v in vs if v is not None and not math.isnan(v)])
        out[k] = tuple(np.quantile(vs, list(p.values())))
    return out


@pytest.mark.parametrize("accuracy, margin", [(100_000, None), (200, None), (20, 0.0), (50, 0.001)])
def test_exact_whatever_the_brackets(skewed, accuracy, margin):
    """A margin of nothing plants ranks outside their brackets, which are repaired."""
    p = {"p5": 0.05, "p50": 0.5, "p90": 0.9}
    got = {x["k"]: tuple(x[n] for n in p) for x in s.exact_percentiles(skewed, ["k"], "v", p, accuracy, margin).collect()}
    want = expected(skewed, p)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12), k
    one = s.exact_percentiles(skewed, [], "v", p, accuracy, margin).collect()
    values = np.array([x["v"] for x in skewed.collect()])
    assert [tuple(x[n] for n in p) for x in one] == [pytest.approx(tuple(np.quantile(values[~np.isnan(values)], list(p.values()))), rel=1e-12)]


def test_summary_in_two_scans(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = s.distribution_summary(df, ["k"], "v")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and all("__slot" in line for line in windows)
    empty = s.distribution_summary(df.filter("false"), [], "v").collect()
    assert len(s.distribution_summary(df.filter("false"), ["k"], "v").collect()) == 0 and len(empty) <= 1
    nothing = s.distribution_summary(df.withColumn("v", F.lit(None).cast("double")), ["k"], "v").collect()
    assert len(nothing) == df.select("k").distinct().count() and all(x["mean"] is None and x["p50"] is None for x in nothing)


def test_every_copy_of_a_building_has_neighbours(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 30.0, 0.0), (5, 30.0, 0.0), (6, 500.0, 0.0)]
    b = spark.createDataFrame([(i, x, y, 10.0, 4.0, 0.0) for i, x, y in rows], "id long, cx double, cy double, long double, short double, angle double")
    rects = sp.distinct_rectangles(b, "id")
    pairs = sp.neighbor_pairs(rects, 50.0)
    got = sorted((x["id"], x["other"], x["distance"]) for x in sp.building_pairs(b, rects, pairs, "id").collect())
    want = sorted((i, j, 30.0) for i in (1, 2, 3) for j in (4, 5)) + sorted((j, i, 30.0) for i in (1, 2, 3) for j in (4, 5))
    assert got == sorted(want)
    both = sp.building_pairs(b, rects, sp.neighbor_pairs(rects, 50.0, remove_intersections=False), "id", copies_meet=True)
    assert both.count() == len(want) + 6 + 2


def brute_rectangle(points):
    best = None
    pts = np.unique(points, axis=0)
    hull = g._hull(pts)
    d = np.roll(hull, -1, axis=0) - hull
    for t in sorted(set(np.mod(np.arctan2(d[:, 1], d[:, 0]), math.pi / 2))):
        u, v = pts @ [math.cos(t), math.sin(t)], pts @ [-math.sin(t), math.cos(t)]
        area = (u.max() - u.min()) * (v.max() - v.min())
        if best is None or area < best[0] * (1 - 1e-9):
            best = (area, u.min(), u.max(), v.min(), v.max())
    return best[0]


def test_rectangles_of_long_rings(spark):
    rng = np.random.default_rng(3)
    turn = np.sort(rng.uniform(0, 2 * math.pi, 5000))
    rings = [
        np.column_stack([40 * np.cos(turn), 25 * np.sin(turn)]),  # convex
        np.column_stack([np.cos(turn) * (30 + 20 * np.cos(9 * turn)), np.sin(turn) * (30 + 20 * np.cos(9 * turn))]),  # concave
        np.column_stack([np.linspace(0, 30, 60), np.linspace(0, 40, 60)]),  # on a line
        np.array([[x, y] for x in range(20) for y in range(3)], float),  # collinear sides
        rng.normal(size=(40, 2)) @ [[3, 1], [0, 1]],
    ]
    df = spark.createDataFrame([(i, p[:, 0].tolist(), p[:, 1].tolist()) for i, p in enumerate(rings)], "id int, xs array<double>, ys array<double>")
    got = {x["id"]: x["r"] for x in df.select("id", g.smallest_rectangle(F.col("xs"), F.col("ys")).alias("r")).collect()}
    for i, p in enumerate(rings):
        a = got[i]
        u, v = p @ [math.cos(a["angle"]), math.sin(a["angle"])], p @ [-math.sin(a["angle"]), math.cos(a["angle"])]
        assert (a["u0"], a["u1"], a["v0"], a["v1"]) == pytest.approx((u.min(), u.max(), v.min(), v.max()), abs=1e-9)
        assert (a["u1"] - a["u0"]) * (a["v1"] - a["v0"]) == pytest.approx(brute_rectangle(p), rel=1e-8, abs=1e-9)


@pytest.mark.parametrize("limit", [50, 500, 5000])
def test_percentiles_of_large_groups_beside_small_ones(spark, monkeypatch, limit):
    """Rows of a group above the limit are not gathered by their group, NULL keys included."""
    monkeypatch.setattr(s, "GROUP_LIMIT", limit)
    df = spark.range(0, 4000, 1, 8).selectExpr("CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN id % 40 ELSE -1 END AS k", "double(id * 7919 % 997) AS v")
    seen = []
    real = s._placed

    def watched(*args):
        out = real(*args)
        seen.append(out.groupBy("k", F.spark_partition_id().alias("at")).count().groupBy("k").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect())
        return out

    monkeypatch.setattr(s, "_placed", watched)
    p = {"a": 0.1, "b": 0.5, "c": 0.97}
    got = {r["k"]: r for r in s.exact_percentiles(df, ["k"], "v", p, accuracy=100, moments=True).collect()}
    want = {r["k"]: r for r in s.distribution_summary(df, ["k"], "v", p, rows_per_group=4000).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert [got[k][c] for c in (*s.MOMENTS, *p)] == pytest.approx([r[c] for c in (*s.MOMENTS, *p)], rel=1e-12)
    assert {r["k"]: r["n"] for r in seen[0]} == {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    assert all(r["most"] <= r["n"] / 4 for r in seen[0] if r["n"] > limit)
