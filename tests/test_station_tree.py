"""Nearest stations by descent: crowded stations, far places, ties, and how little is compared."""

import numpy as np
import pytest

from brickwork.operators import spatial


def brute(points, stations):
    out = {}
    for i, x, y in points:
        out[i] = min(((sx - x) ** 2 + (sy - y) ** 2, s) for s, sx, sy in stations)
    return out


def check(spark, points, stations):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in points], "id long, x double, y double")
    s = spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in stations], "station_id long, x double, y double")
    got = {r["id"]: (r["distance"], r["station_id"]) for r in spatial.nearest_station(p, s, limit=0).collect()}
    want = brute(points, stations)
    assert got.keys() == want.keys()
    for i, (d2, sid) in want.items():
        assert got[i][1] == sid and got[i][0] == pytest.approx(np.sqrt(d2), rel=1e-12)


def crowded(seed=0):
    """Nine of ten stations in one town; places in the town, around it and far outside."""
    g = np.random.default_rng(seed)
    town = g.normal(500.0, 0.5, (900, 2))
    land = g.uniform(0, 1000, (100, 2))
    stations = [(i, x, y) for i, (x, y) in enumerate(np.vstack([town, land]))]
    places = np.vstack([g.normal(500.0, 0.5, (60, 2)), g.uniform(0, 1000, (60, 2)), g.uniform(-1e6, 1e6, (30, 2))])
    return [(i, x, y) for i, (x, y) in enumerate(places)], stations


def test_crowded_stations_and_far_places(spark):
    check(spark, *crowded())


def test_ties_and_stations_on_a_line(spark):
    stations = [(100 - i, float(i % 50), 0.0) for i in range(100)]
    points = [(i, i / 2, 3.0) for i in range(-20, 140)]
    check(spark, points, stations)


def test_one_station_and_one_place_on_it(spark):
    check(spark, [(1, 5.0, 5.0), (2, -7.0, 1e9)], [(9, 5.0, 5.0)])


def test_more_stations_around_one_place_than_a_leaf_holds(spark):
    g = np.random.default_rng(2)
    stations = [(i, x, y) for i, (x, y) in enumerate(1e6 + g.normal(0, 1e-6, (200, 2)))] + [(1000, 0.0, 0.0)]
    check(spark, [(0, 1e6, 1e6), (1, 1.0, 1.0), (2, 2e6, -1e6)], stations)


def test_leaves_are_small_and_a_place_holds_few_cells(spark, monkeypatch):
    points, stations = crowded(1)
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in stations], "sid long, x double, y double")
    kids, leaves = spatial.station_tree(sites)
    sizes = [len(r["sites"]) for r in leaves.collect()]
    assert sum(sizes) == len(stations) and max(sizes) <= spatial.LEAF
    assert max(len(r["kids"]) for r in kids.collect()) <= 64
    # No place meets more than a small part of the stations, those far outside included.
    met = []
    real = spatial.cut_lineage

    def watched(df):
        out = real(df)
        if out.columns == ["x", "y", "cells"]:
            met.append(max(len(r["cells"]) for r in out.collect()))
        return out

    monkeypatch.setattr(spatial, "cut_lineage", watched)
    places = spark.createDataFrame([(float(x), float(y)) for _, x, y in points], "x double, y double")
    assert spatial._nearest_by_tree(places, sites).count() == len(points)
    assert met and max(met) <= 16


def test_places_descend_in_blocks_and_crowded_blocks_go_on_alone(spark, monkeypatch):
    points, stations = crowded(3)
    monkeypatch.setattr(spatial, "BLOCK", 16)
    monkeypatch.setattr(spatial, "HELD", 4)
    rounds = []
    real = spatial.cut_lineage

    def watched(df):
        out = real(df)
        if "cells" in out.columns:
            rounds.append((out.columns[0], out.count()))
        return out

    monkeypatch.setattr(spatial, "cut_lineage", watched)
    check(spark, points, stations)
    # The first round is one of blocks; places meet their cells once, at the end.
    assert rounds[0][0] == "block" and rounds[0][1] < len(points) / 2
    assert [n for first, n in rounds if first == "x"] == [len(points)]
    assert max(n for first, n in rounds if first == "block") <= len(points)
