"""Base features of building requests, and the way from requests to answers."""

import json

import pytest
from pyspark.sql import functions as F

from brickwork.catalog import training as catalog
from brickwork.operators.surrogate import FeatureSpace
from brickwork.plans import base


@pytest.fixture(scope="module")
def stations(spark):
    rows = [(1, "near_but_unknown", 10.0, 50.0), (2, "known", 10.5, 50.0), (3, "far", 80.0, 10.0)]
    return spark.createDataFrame(rows, "station_id long, name string, lon double, lat double")


def request(spark, lon=10.0, lat=50.0):
    row = {"building_id": 7, "lon": lon, "lat": lat, "long_edge": 20.0, "short_edge": 10.0, "num_floors": 2, "long_edge_angle": 0.0, "basement": "none", "attic": "occupied_conditioned", "Walls": "Brick", "county": "Essex", "own": 5}
    types = "building_id long, lon double, lat double, long_edge double, short_edge double, num_floors int, long_edge_angle double, basement string, attic string, Walls string, county string, own int"
    return spark.createDataFrame([tuple(row.values())], types)


def test_only_trained_stations_are_near(spark, stations):
    space = FeatureSpace({base.STATION: ("known", "far"), "geometry__wwr": (0.0, 1.0)})
    shading = spark.createDataFrame([(7, 0.25)], "building_id long, shading_mask_00 double")
    weather = spark.createDataFrame([("known", 9.5)], "name string, weather__mean double")
    got = base.base_features(request(spark), stations, space, ["Walls"], carry=["own"], weather=weather, shading=shading).collect()
    (r,) = got
    assert r[base.STATION] == "known" and r["station_distance"] == pytest.approx(6378137.0 * 0.5 * 3.141592653589793 / 180, rel=1e-9)
    assert (r["weather__mean"], r["geometry__shading_mask_00"], r["semantic__Walls"], r["location__county"], r["own"]) == (9.5, 0.25, "Brick", "Essex", 5)
    assert (r["geometry__f2f_height"], r["geometry__wwr"], r["extra_spaces__attic__conditioned"], r["geometry__energy_model_conditioned_area"]) == (3.5, 0.1, "Yes", 600.0)


def test_buildings_without_place_keep_their_row(spark, stations):
    space = FeatureSpace({base.STATION: ("known",)})
    (r,) = base.base_features(request(spark, lon=None), stations, space, ["Walls"]).collect()
    assert r[base.STATION] is None and r["station_distance"] is None and r["geometry__aspect_ratio"] == 2.0
    with pytest.raises(ValueError):
        base.base_features(request(spark), stations, FeatureSpace({}), [])


def test_requests_to_answers(spark, sf):
    got = catalog.requests_to_answers(spark, sf).collect()
    assert len(got) == len({r["building_id"] for r in got}) == spark.read.parquet(f"{sf}/customer.parquet").count()
    doc = json.loads(got[0]["response"])
    assert doc["Total"]["Gross"]["FuelCost"]["Total"]["p50"] > 0
