"""Footprints to simulation specs: the whole preparation as one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.functions import geometry as g
from brickwork.functions.text import derive
from brickwork.operators import buildings as b
from brickwork.operators import spatial, validation
from brickwork.operators.ranking import dense_index, join_null_safe
from brickwork.session import cut_lineage

NEIGHBOR_RADIUS = 100.0  # fixed value: metres
SPEC_COLUMNS = (
    "experiment_id", "sort_index", "semantic_field_context", "epwzip_uri", "station_distance", "rotated_rectangle",
    "neighbor_polys", "neighbor_heights", "neighbor_floors", "neighbor_copies", "long_edge", "short_edge", "long_edge_angle",
    "aspect_ratio", "rotated_rectangle_area_ratio", "footprint_area", "wwr", "wwr_out_of_range", "height", "num_floors",
    "f2f_height", "basement", "attic", "exposed_basement_frac",
)


def prepare_footprints(df: DataFrame, crs: str = "crs", ring: str = "ring") -> DataFrame:
    """Rings in metres (EPSG:3857); refuses rows without a supported crs."""
    bad = validation.crs_problems(df, column=crs).first()
    if bad["n_missing"] or bad["n_unsupported"]:
        raise ValueError(f"{bad['n_missing']} rows without crs, {bad['n_unsupported']} with an unsupported one")
    return df.withColumn(ring, F.when(F.col(crs) == "EPSG:4326", g.to_mercator(F.col(ring))).otherwise(F.col(ring)))


def manifest(
    footprints: DataFrame,
    stations: DataFrame,
    key: str,
    experiment_id: str,
    options: Mapping[str, Sequence[str]],
    *,
    height: str | None = None,
    floors: str | None = None,
    wwr: str | None = None,
    assumptions: b.Assumptions = b.Assumptions(),
    uris: Mapping[str, str] | None = None,
    radius: float = NEIGHBOR_RADIUS,
    max_station_distance: float = spatial.MAX_STATION_DISTANCE,
) -> DataFrame:
    """One spec row per building of ``footprints(key, crs, ring, fields…)``.

    ``stations(station_id, path, x, y)`` is in metres like the rings.  ``key``
    is a unique whole number.
    """
    fields = list(options)
    df = b.restore_truncated_names(footprints, [*fields, height, floors, wwr])
    validation.require_columns(df, [key, *fields, height, floors, wwr])
    validation.assert_valid(validation.domain_report(df, options))
    df = spatial.add_rectangles(prepare_footprints(df))
    df = b.impute_dimensions(df, assumptions, height, floors, wwr)

    shape = {"cx": "cx", "cy": "cy", "long": "long_edge", "short": "short_edge", "angle": "long_edge_angle"}
    # the fitted table feeds five later steps: store it once
    df = cut_lineage(derive(df, {k: f"double({v})" for k, v in shape.items() if k != v}))
    rects = spatial.distinct_rectangles(df, key, "height")
    pairs = spatial.neighbor_pairs(rects, radius)
    fill = assumptions.num_floors * assumptions.f2f_height
    arrays = spatial.neighbor_arrays(rects, pairs, "height", fill, assumptions.f2f_height)
    located = rects.drop("copies").join(arrays, "loc").drop("loc")
    df = join_null_safe(df, located, [*shape, "height"])

    points = df.selectExpr(f"`{key}`", "cx AS x", "cy AS y")
    near = cut_lineage(spatial.nearest_station(points, stations))
    far = spatial.far_points(near, max_station_distance).first()["n_too_far"]
    if far:
        raise ValueError(f"{far} buildings have no weather station within {max_station_distance} m")
    paths = stations.select("station_id", b.weather_uri(F.col("path")).alias("epwzip_uri"))
    weather = near.select(key, "station_id", F.col("distance").alias("station_distance")).join(paths, "station_id").drop("station_id")
    df = df.join(weather, key)

    df = derive(df, {"__rect": spatial.rectangle_ring()})
    df = df.withColumn("rotated_rectangle", g.ring_to_wkt(F.col("__rect")))
    df = b.building_specs(df, experiment_id, fields, assumptions, uris or {})
    return dense_index(df, key).select(key, *SPEC_COLUMNS, *(uris or {}))
