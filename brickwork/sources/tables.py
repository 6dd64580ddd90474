"""Spec, GIS, weather, result and model tables: readers and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brickwork.functions.text import derive
from brickwork.operators.ranking import dense_index
from brickwork.sources.publish import collect_frames, publish, publish_frames

PARQUET_SUFFIXES = (".pq", ".parquet")


def read_specs(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet specs; any other extension is refused."""
    if not path.rstrip("/").endswith(PARQUET_SUFFIXES):
        raise ValueError(f"specs must be parquet ({', '.join(PARQUET_SUFFIXES)}): {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_spec_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=True)


def assign_identity(specs: DataFrame, experiment_id: str | None, key: str | None = None) -> DataFrame:
    """The parent's experiment id replaces the rows' own; ``sort_index`` is added if absent."""
    if experiment_id is not None:
        specs = specs.withColumn("experiment_id", F.lit(experiment_id))
    elif "experiment_id" not in specs.columns:
        raise ValueError("experiment_id is missing from both the request and the specs")
    if "sort_index" not in specs.columns:
        if key is None:
            raise ValueError("a unique numeric key is needed to number the specs")
        specs = dense_index(specs, key)
    return specs


def spec_problems(specs: DataFrame) -> DataFrame:
    return specs.selectExpr(
        "count_if(experiment_id IS NULL OR experiment_id = '') AS n_without_experiment", "count_if(sort_index IS NULL OR sort_index < 0) AS n_bad_index"
    )


GEOJSON = (
    "crs STRUCT<properties: STRUCT<name: STRING>>, features ARRAY<STRUCT<properties: MAP<STRING, STRING>, "
    "geometry: STRUCT<type: STRING, coordinates: STRING>>>"
)


def read_footprints(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """Footprints of GeoJSON files: crs, attribute map, part, outer ring, holes.

    One row per polygon; a multipolygon gives one row for each of its parts,
    numbered by ``part``.  Features of other kinds have a NULL ring, so a caller
    sees them.  A file is one task: split a large collection into many files.
    """
    raw = spark.read.schema(GEOJSON).json(path, multiLine=True)
    feats = raw.select(F.coalesce("crs.properties.name", F.lit(crs)).alias("crs"), F.explode("features").alias("f"))
    shape, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons = F.when(shape == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(
        shape == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>")
    )
    parts = feats.select("crs", F.col("f.properties").alias("properties"), F.posexplode_outer(polygons).alias("part", "rings"))

    def opened(ring):  # without the closing vertex
        return F.transform(F.slice(ring, 1, F.size(ring) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    holes = F.transform(F.slice("rings", 2, F.size("rings")), opened)
    return parts.select("crs", "properties", "part", opened(F.get("rings", F.lit(0))).alias("ring"), holes.alias("holes"))


def read_stations(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Weather stations of a GeoJSON point file, optionally filtered."""
    raw = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.explode("features").alias("f"))
    at = F.from_json("f.geometry.coordinates", "array<double>")
    out = raw.select(
        F.col("f.properties")["name"].alias("name"), F.col("f.properties")["source"].alias("source"),
        F.col("f.properties")["path"].alias("path"), at[0].alias("x"), at[1].alias("y"),
    )
    return out.filter(where) if where else out


COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'  # outside quotation marks


def read_zone_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hourly zone reports, wide to long: (file, stamp, zone, variable, temp_c, rh_pct).

    Every file is read by its own header line (the one with temperature or
    humidity columns; files without one are an error).  A zone with several
    temperatures has a row for each, told apart by ``variable``, the temperature
    column's name; its humidity stands on all of them.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter("trim(value) <> ''")
    cells = lines.withColumn("cells", F.transform(F.split("value", COMMA, -1), lambda c: F.trim(F.regexp_replace(c, r'^\s*"|"\s*$', "")))).drop("value")
    named = F.lower(F.array_join("cells", ","))
    headed = cells.withColumn("is_header", named.contains("temperature") | named.contains("relative humidity"))
    headers = headed.filter("is_header").select("file", F.col("cells").alias("names")).dropDuplicates(["file"])
    bare = headed.groupBy("file").agg(F.bool_or("is_header").alias("ok")).filter("NOT ok").select("file").take(5)
    if bare:
        raise ValueError("no temperature or humidity columns in " + ", ".join(r["file"] for r in bare))
    # One row per file: headers are small beside the hours they name.
    rows = headed.filter("NOT is_header").join(headers, "file")

    def has(column, text: str):
        return F.lower(column).contains(text)

    numbered = F.transform(
        "names", lambda c, i: F.struct(c.alias("name"), F.trim(F.split(c, ":")[0]).alias("zone"), F.get("cells", i).alias("text"))
    )
    rows = rows.withColumn("c", numbered)
    times = F.filter("c", lambda c: has(c["name"], "date/time") | has(c["name"], "datetime"))
    stamp = F.get(times, F.lit(0))["text"]
    temps = F.filter("c", lambda c: has(c["name"], "temperature"))
    humid = F.filter("c", lambda c: has(c["name"], "relative humidity"))
    rows = rows.select("file", stamp.alias("stamp"), temps.alias("t"), humid.alias("h"))
    with_temp = F.transform(
        "t",
        lambda t: F.struct(
            t["zone"].alias("zone"), t["name"].alias("variable"), t["text"].try_cast("double").alias("temp_c"),
            F.get(F.filter("h", lambda h: h["zone"] == t["zone"]), F.lit(0))["text"].try_cast("double").alias("rh_pct"),
        ),
    )
    dry = F.filter("h", lambda h: ~F.exists("t", lambda t: t["zone"] == h["zone"]))
    only_humid = F.transform(
        dry,
        lambda h: F.struct(
            h["zone"].alias("zone"), F.lit(None).cast("string").alias("variable"), F.lit(None).cast("double").alias("temp_c"),
            h["text"].try_cast("double").alias("rh_pct"),
        ),
    )
    return rows.select("file", "stamp", F.explode(F.concat(with_temp, only_humid)).alias("z")).select("file", "stamp", "z.*")


def read_weather_text(spark: SparkSession, path: str) -> DataFrame:
    """Hourly weather files (plain or gzip): eight header lines, then comma fields.

    Data lines start with a year, so no per-file line counter is needed; the
    hour of the year comes from month, day and hour fields of a 365-day year.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", ",").alias("v"))
    data = lines.filter(F.size("v") > 30).filter(F.col("v")[0].rlike(r"^\d{4}$"))
    got = data.selectExpr("file", "int(v[1]) AS month", "int(v[2]) AS dom", "int(v[3]) AS hr", "double(v[6]) AS dry_bulb_c")
    upto = "array(0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)"
    got = derive(got, {"day": f"{upto}[month - 1] + dom - 1"})
    return derive(got, {"hour": "day * 24 + hr - 1"}).drop("dom", "hr")


def weather_location(spark: SparkSession, path: str) -> DataFrame:
    """Latitude and longitude from the LOCATION line of every weather file."""
    lines = spark.read.text(path).filter(F.col("value").startswith("LOCATION,"))
    v = F.split("value", ",")
    return lines.select(F.col("_metadata.file_path").alias("file"), v[1].alias("city"), v[6].cast("double").alias("latitude"), v[7].cast("double").alias("longitude"))


CASE_FOLDER = r"^C(\d+)_(.*)_G(\d+)$"
CLIMATE_FILE = r"^C\d+_([^_]+)_G\d+_(.*)\.epw$"


def case_specs(paths: DataFrame, experiment_id: str, column: str = "path") -> DataFrame:
    """Folder listing to specs: one row per model file of folders with one weather file."""
    p = paths.select(F.col(column).alias("path")).distinct()
    p = p.withColumns({"folder": F.element_at(F.split("path", "/"), -2), "file": F.element_at(F.split("path", "/"), -1)})
    p = p.filter(F.col("folder").rlike(CASE_FOLDER))
    weather = p.filter(F.col("file").endswith(".epw")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("epw"))
    weather = weather.filter("n = 1").drop("n")
    models = p.filter(F.col("file").endswith(".idf"))
    pick = lambda i: F.regexp_extract("folder", CASE_FOLDER, i)
    climate = F.concat_ws("_", F.regexp_extract("epw", CLIMATE_FILE, 1), F.regexp_extract("epw", CLIMATE_FILE, 2))
    return models.join(weather, "folder").select(
        F.lit(experiment_id).alias("experiment_id"), pick(1).alias("case"), pick(2).alias("city"), pick(3).alias("grid"),
        climate.alias("climate"), F.regexp_replace("file", r"\.idf$", "").alias("building_name"), F.col("path").alias("idf_uri"), "epw",
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def write_frames(frames: Mapping[str, DataFrame], root: str, *, save_errors: bool = False, existing: str = "forbid") -> dict[str, str]:
    """One parquet dataset per key, all of them readable at once; error tables only on request."""
    return publish_frames({k: df for k, df in frames.items() if save_errors or "error" not in k.lower()}, root, existing)


def read_frames(spark: SparkSession, root: str, keys: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The frames below ``root``; without ``keys``, all that are there."""
    return collect_frames(spark, [root], keys)


def write_stage(df: DataFrame, root: str, experiment_id: str, iteration: int, name: str, existing: str = "overwrite") -> str:
    """A stage artefact in its own iteration folder."""
    return publish(df, f"{root}/{experiment_id}/iter-{iteration:03d}/{name}", existing)


def write_hourly(df: DataFrame, path: str, existing: str = "overwrite") -> None:
    """Hourly series laid out by scope, so selected runs are read by partition."""
    scope = ["experiment_id", "case", "city", "grid", "building"]
    publish(df.repartition(*scope, F.pmod(F.hash("hour"), F.lit(16))), path, existing, scope)


def series_of(selected: DataFrame, hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hourly rows of the selected summary rows only (dynamic partition pruning)."""
    return hourly.join(selected.select(*keys).distinct(), list(keys), "left_semi")


def fold_specs(spark: SparkSession, n_folds: int, config: Mapping[str, str]) -> DataFrame:
    df = spark.range(n_folds).select(F.col("id").alias("sort_index"), F.lit(n_folds).alias("n_folds"))
    return df.withColumns({k: F.lit(v) for k, v in config.items()})
