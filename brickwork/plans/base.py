"""Base features of a portfolio: what is known of every building before anything is drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.functions import geometry as g
from brickwork.functions.text import derive
from brickwork.operators import buildings as b
from brickwork.operators import spatial
from brickwork.operators.surrogate import FeatureSpace

STATION = "weather__file"
#: Dimensions that stand in until they are drawn.
F2F_HEIGHT, WWR = 3.5, 0.1


def trained_stations(stations: DataFrame, space: FeatureSpace, name: str = "name") -> DataFrame:
    """The stations whose weather the models were trained on; others cannot be predicted for."""
    options = space.options().get(STATION)
    if not options:
        raise ValueError(f"the feature space has no options of {STATION}")
    known = stations.sparkSession.createDataFrame([(o,) for o in options], "__name string")
    return stations.join(known, F.col(name) == F.col("__name"), "left_semi")


def base_features(
    requests: DataFrame,
    stations: DataFrame,
    space: FeatureSpace,
    fields: Sequence[str],
    *,
    key: str = "building_id",
    county: str = "county",
    carry: Sequence[str] = (),
    weather: DataFrame | None = None,
    shading: DataFrame | None = None,
) -> DataFrame:
    """One feature row per building of ``requests``, ready for an inference plan.

    ``requests`` has ``key``, lon and lat in degrees, edges, orientation
    (``long_edge_angle``), floors, the kinds of basement and attic, the semantic
    ``fields`` and the county.  ``stations(station_id, name, lon, lat)`` are in degrees
    too.  ``weather`` (name and ``weather__…`` columns) is joined by station and
    ``shading`` (key and ``shading_mask_…`` columns) by building; ``carry`` columns are
    kept as they are.  Buildings without coordinates have no station and keep their row.
    """
    corner = lambda: g.to_mercator(F.array(F.struct(F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))))
    placed = lambda df: df.withColumn("__at", corner()).withColumns({"x": F.col("__at")[0]["x"], "y": F.col("__at")[0]["y"]})
    known = placed(trained_stations(stations, space)).select("station_id", "x", "y", F.col("name").alias(STATION))
    near = spatial.nearest_station(placed(requests).select(key, "x", "y"), known.select("station_id", "x", "y"))
    near = near.join(known.select("station_id", STATION), "station_id", "left")
    near = near.select(key, STATION, F.col("distance").alias("station_distance"))
    df = derive(requests.join(near, key), {"f2f_height": f"{F2F_HEIGHT}D", "wwr": f"{WWR}D"})
    if weather is not None:
        df = df.join(weather.withColumnRenamed("name", STATION), STATION, "left")
    if shading is not None:
        df = df.join(shading, key, "left")
    kept = [key, *carry, "station_distance"]
    return b.feature_projection(b.add_areas(df).withColumn("location__county", F.col(county)), fields, [*kept, "location__county"])
