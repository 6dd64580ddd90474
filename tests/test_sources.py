import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwork.operators import collate as c
from brickwork.operators import validation as v
from brickwork.operators.buildings import restore_truncated_names
from brickwork.operators.hourly import weather_summary
from brickwork.sources import tables as t


def test_spec_lists(spark, tmp_path):
    specs = spark.createDataFrame([("original", 1), ("original", 2), ("original", 3)], "experiment_id string, param_a int")
    specs.write.parquet(str(tmp_path / "specs.parquet"))
    got = t.read_specs(spark, str(tmp_path / "specs.parquet"))
    out = t.assign_identity(got, "test", "param_a")
    assert {r["experiment_id"] for r in out.collect()} == {"test"}
    assert sorted(r["sort_index"] for r in out.collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        t.read_specs(spark, str(tmp_path / "specs.csv"))
    with pytest.raises(ValueError):
        t.assign_identity(specs.drop("experiment_id"), None, "param_a")
    (tmp_path / "s.json").write_text(json.dumps([{"epw_path": "a.epw", "idf_path": "m.idf"}]))
    js = t.read_spec_json(spark, str(tmp_path / "s.json"))
    v.check_source_choice(js)
    with pytest.raises(ValueError):
        v.check_source_choice(js.withColumn("epw_generator", F.lit("x")))


def test_frames_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(0, 1, 2)], "idx int, A int, B int")
    b = spark.createDataFrame([(1, 5, 6)], "idx int, C int, D int")
    frames = c.collate([{"key1": a}, {"key1": b, "errors": b}])
    rows = sorted(frames["key1"].select("idx", "A", "B", "C", "D").collect())
    assert [tuple(r) for r in rows] == [(0, 1, 2, None, None), (1, None, None, 5, 6)]
    written = t.write_frames(frames, str(tmp_path / "out"))
    assert list(written) == ["key1"]
    assert t.read_frames(spark, str(tmp_path / "out"), ["key1"])["key1"].count() == 2
    with pytest.raises(Exception):
        t.write_frames(frames, str(tmp_path / "out"))
    assert "errors" in t.write_frames(frames, str(tmp_path / "out"), save_errors=True, existing="overwrite")
    load = lambda uri: t.read_frames(spark, uri, ["key1"])
    both = c.combine_results([{"uri": str(tmp_path / "out")}, {"key1": a}], load)
    assert both["key1"].count() == 3
    with pytest.raises(ValueError):
        c.combine_results([{"uri": "x", "key1": a}], load)
    with pytest.raises(ValueError):
        c.combine_results([{"key1": {"not": "a frame"}}], load)


def test_outcomes(spark):
    specs = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("3", "c", 3)], "run_id string, name string, value int")
    results = spark.createDataFrame([("1", "fine", None), ("2", None, "boom"), ("9", "?", None)], "run_id string, ok string, error string")
    out = c.match_outcomes(specs, results)
    assert {r["run_id"]: r["state"] for r in out.collect()} == {"1": "ok", "2": "error", "3": "missing", "9": "unexpected"}
    bad = {r["workflow_run_id"]: (r["missing"], r["errored"]) for r in c.errors_and_missing(out, ["name", "value"]).collect()}
    assert bad == {"2": (False, "boom"), "3": (True, None)}
    empty = c.errors_and_missing(out.filter("false"), ["name"])
    assert empty.columns == ["name", "workflow_run_id", "missing", "errored"] and empty.count() == 0


def test_geojson_and_stations(spark, tmp_path):
    doc = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"Typology": "SFH"}, "geometry": {"type": "Polygon", "coordinates": [[[5, 0], [5, 10], [15, 10], [15, 0], [5, 0]]]}},
        ],
    }
    (tmp_path / "b.geojson").write_text(json.dumps(doc))
    r = t.read_footprints(spark, str(tmp_path / "b.geojson")).first()
    assert r["properties"]["Typology"] == "SFH" and len(r["ring"]) == 4 and r["crs"] == "EPSG:4326"
    box = lambda x, w: [[x, 0], [x, w], [x + w, w], [x + w, 0], [x, 0]]
    shapes = [("Polygon", [box(0, 4), box(1, 1)]), ("MultiPolygon", [[box(0, 2)], [box(9, 3), box(10, 1)]]), ("Point", [1, 2])]
    more = {"features": [{"properties": {"id": str(i)}, "geometry": {"type": k, "coordinates": c}} for i, (k, c) in enumerate(shapes)]}
    (tmp_path / "m.geojson").write_text(json.dumps(more))
    rows = t.read_footprints(spark, str(tmp_path / "m.geojson")).collect()
    assert sorted((r["properties"]["id"], r["part"], len(r["ring"] or ()), len(r["holes"] or ())) for r in rows if r["ring"]) == [("0", 0, 4, 1), ("1", 0, 4, 0), ("1", 1, 4, 1)]
    assert [r["properties"]["id"] for r in rows if not r["ring"]] == ["2"]
    st = {"features": [{"properties": {"name": n, "source": s, "path": n + ".zip"}, "geometry": {"type": "Point", "coordinates": xy}} for n, s, xy in (("A", "tmyx", [1, 2]), ("B", "old", [3, 4]))]}
    (tmp_path / "s.geojson").write_text(json.dumps(st))
    got = t.read_stations(spark, str(tmp_path / "s.geojson"), "source in ('tmyx')").collect()
    assert [(g["name"], g["x"], g["y"]) for g in got] == [("A", 1.0, 2.0)]


def test_hourly_files(spark, tmp_path):
    (tmp_path / "z.csv").write_text("Date/Time,Z1:Zone Air Temperature [C](Hourly),Z1:Zone Air Relative Humidity [%](Hourly),Other\n01:00,20.5,40,1\n02:00,21,41,2\n")
    rows = t.read_zone_csv(spark, str(tmp_path / "z.csv")).collect()
    assert sorted((r["zone"], r["temp_c"], r["rh_pct"]) for r in rows) == [("Z1", 20.5, 40.0), ("Z1", 21.0, 41.0)]
    folder = tmp_path / "zones"
    folder.mkdir()
    (folder / "a.csv").write_text("Date/Time,Z1:Zone Air Temperature [C],Z1:Zone Radiant Temperature [C],Z1:Relative Humidity [%]\n01:00,20,21,40\n")
    (folder / "b.csv").write_text('Date/Time,Z9:Relative Humidity [%],"Z9:Zone Air Temperature, mean [C]",Z1:Zone Air Temperature [C],Z2:Relative Humidity [%]\n01:00,50,30,10,60\n')
    rows = t.read_zone_csv(spark, str(folder)).collect()
    assert sorted((r["file"][-5:], r["zone"], r["temp_c"] or 0.0, r["rh_pct"] or 0.0, r["stamp"]) for r in rows) == [
        ("a.csv", "Z1", 20.0, 40.0, "01:00"), ("a.csv", "Z1", 21.0, 40.0, "01:00"), ("b.csv", "Z1", 10.0, 0.0, "01:00"),
        ("b.csv", "Z2", 0.0, 60.0, "01:00"), ("b.csv", "Z9", 30.0, 50.0, "01:00"),
    ]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        t.read_zone_csv(spark, str(tmp_path / "bad.csv"))
    head = ["LOCATION,Boston,MA,USA,TMY,725090,42.36,-71.01,-5,6"] + ["X"] * 7
    body = [f"2020,{m},{d},{h},60,?," + f"{10 if m < 7 else 25}" + ",0" * 28 for m, d in ((1, 1), (7, 1)) for h in range(1, 25)]
    (tmp_path / "w.epw").write_text("\n".join(head + body))
    w = t.read_weather_text(spark, str(tmp_path / "w.epw"))
    assert w.count() == 48 and w.agg(F.max("hour")).first()[0] == 181 * 24 + 23
    s = {r["period"]: r for r in weather_summary(w, "file").collect()}
    assert (s[0]["days_below_base"], s[0]["days_above_base"]) == (1.0, 1.0) and s[1]["daily_max"] == 10
    assert t.weather_location(spark, str(tmp_path / "w.epw")).first()["latitude"] == 42.36


def test_case_listing(spark, tmp_path):
    for name in ("C1_Cairo_G2/C1_Cairo_G2_rmy.epw", "C1_Cairo_G2/B1.idf", "C2_Giza_G3/B2.idf", "other/x.idf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    r = t.case_specs(t.list_files(spark, str(tmp_path)), "exp").collect()
    assert [(x["case"], x["city"], x["grid"], x["climate"], x["building_name"]) for x in r] == [("1", "Cairo", "2", "Cairo_rmy", "B1")]


def test_hourly_sink_and_fold_specs(spark, tmp_path):
    h = spark.range(48).selectExpr("'e' AS experiment_id", "'1' AS case", "'x' AS city", "'g' AS grid", "concat('b', id % 2) AS building", "id AS hour", "1D AS t")
    t.write_hourly(h, str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h"))
    sel = spark.createDataFrame([("b1",)], "building string")
    assert t.series_of(sel, back, ["building"]).count() == 24
    assert t.fold_specs(spark, 5, {"data_uri": "u"}).count() == 5
    assert t.write_stage(h, str(tmp_path), "exp", 3, "specs").endswith("exp/iter-003/specs")


def test_validation(spark):
    df = spark.createDataFrame([("a", 1.0), ("z", 9.0), (None, None)], "k string, x double")
    rep = {r["field"]: r["n_invalid"] for r in v.domain_report(df, {"k": ("a", "b")}, {"x": (0.0, 5.0)}).collect()}
    assert rep == {"k": 2, "x": 2}
    with pytest.raises(ValueError):
        v.assert_valid(v.domain_report(df, {"k": ("a",)}))
    with pytest.raises(ValueError):
        v.require_columns(df, ["k", None, "nope"])
    assert v.near_constant_columns(df.withColumn("flat", F.lit(2.0)), ["x", "flat"]) == ["flat"]
    short = spark.createDataFrame([(1,)], "AtticFloor int")
    assert restore_truncated_names(short, ["AtticFloorInsulation", None]).columns == ["AtticFloorInsulation"]


def test_leaf_errors_and_frames(spark):
    seen = spark.createDataFrame([(1, 2.0), (2, -1.0)], "run_id int, x double")

    def leaf(spec):
        if spec["x"] < 0:
            raise RuntimeError("negative")
        return {"results": [{"y": np.float32(spec["x"] * 2), "note": "n", "at": np.arange(2)}], "extra": [{"z": 1.0}, {"z": 2.0}]}

    c.register_leaf("double", leaf)
    out = c.run_leaf(seen, "double", attempts=2).collect()
    frame = c.frame_of(spark.createDataFrame(out, c.RESULT_SCHEMA), "results", ["y"], ["note"]).collect()
    assert [(r["run_id"], r["y"], r["note"]) for r in frame] == [("1", 4.0, "n")]
    errs = [r for r in out if r["error"]]
    assert [(r["run_id"], r["error"], r["attempts"]) for r in errs] == [("2", "RuntimeError: negative", 2)]
