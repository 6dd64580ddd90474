"""Readers and sinks: given tables written by Spark in each format, read back, compared with the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brickwork.catalog.base import Registry, sql_fixed, sql_normal, sql_words, table
from brickwork.functions.rng import with_row_key
from brickwork.functions.rounding import fixed
from brickwork.functions.text import sql_value
from brickwork.operators import collate as c
from brickwork.operators import quantities as q
from brickwork.operators import surrogate
from brickwork.session import checkpoint_root
from brickwork.sources import rules
from brickwork.sources import tables as src

REGISTRY = Registry()


def _root(spark, name):
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _documents(rows, group, path):
    """One text file for each row (group, value)."""
    rows.repartition(group).write.partitionBy(group).text(path)


@REGISTRY.add("SELECT c_custkey, c_name, c_acctbal, 'study' AS experiment_id FROM customer")
def spec_json_round_trip(spark, sf_dir):
    """Specs as JSON arrays of about 500, read back with a schema."""
    specs = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    groups = specs.groupBy(F.floor(F.col("c_custkey") / 500).alias("part")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    path = _root(spark, "specs-json")
    _documents(groups, "part", path)
    got = src.read_spec_json(spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE").drop("part")
    return src.assign_identity(got.withColumn("sort_index", F.col("c_custkey")), "study").drop("sort_index")


def _feature(kind, coordinates, **properties):
    props = F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))])
    return F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"))


def _collections(features, path, per_file=500):
    """Feature collections of about ``per_file`` features each."""
    rows = features.groupBy(F.floor(F.col("id") / per_file).alias("part")).agg(F.collect_list("feature").alias("features"))
    _documents(rows.select("part", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")), "part", path)


@REGISTRY.add(
    "SELECT CAST(p_partkey AS VARCHAR) AS id, 0 AS part, 4 AS n_corners, 1 AS n_holes, p_size::DOUBLE AS left_x, p_size + 10.0::DOUBLE AS right_x, 'EPSG:4326' AS crs FROM part "
    "UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, 4, 0, p_size + 20.0::DOUBLE, p_size + 30.0::DOUBLE, 'EPSG:4326' FROM part WHERE p_partkey % 3 = 0"
)
def footprint_round_trip(spark, sf_dir):
    """Polygons with a hole, and multipolygons of two parts, through feature collections."""

    def ring(x, a, b):
        corner = lambda dx, dy: F.array(x + F.lit(float(dx)), F.lit(float(dy)))
        return F.array(corner(a, 0), corner(a, 10), corner(b, 10), corner(b, 0), corner(a, 0))

    x = F.col("p_size").cast("double")
    one, two = F.array(ring(x, 0, 10), ring(x, 2, 3)), F.array(ring(x, 20, 30))
    parts = table(spark, sf_dir, "part")
    path = _root(spark, "footprints")
    both = parts.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 3 == 0, F.to_json(_feature("MultiPolygon", F.array(one, two), id=F.col("p_partkey"))))
        .otherwise(F.to_json(_feature("Polygon", one, id=F.col("p_partkey")))).alias("feature"),
    )
    # Both kinds stand in one collection, so the features are joined as text.
    rows = both.groupBy(F.floor(F.col("id") / 500).alias("part")).agg(F.array_join(F.collect_list("feature"), ",").alias("all"))
    _documents(rows.select("part", F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("value")), "part", path)
    got = src.read_footprints(spark, path)
    xs = F.transform("ring", lambda p: p["x"])
    return got.select(
        F.col("properties")["id"].alias("id"), "part", F.size("ring").alias("n_corners"), F.size("holes").alias("n_holes"),
        F.array_min(xs).alias("left_x"), F.array_max(xs).alias("right_x"), "crs",
    )


@REGISTRY.add("SELECT s_name AS name, 'tmy' AS source, 's/' || s_suppkey || '.epw' AS path, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier WHERE s_suppkey % 4 <> 0")
def station_round_trip(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    source = F.when(F.col("s_suppkey") % 4 == 0, "old").otherwise("tmy")
    at = F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double"))
    point = _feature("Point", at, name=F.col("s_name"), source=source, path=F.format_string("s/%s.epw", F.col("s_suppkey").cast("string")))
    path = _root(spark, "stations")
    _collections(s.select(F.col("s_suppkey").alias("id"), point.alias("feature")), path)
    return src.read_stations(spark, path, "source = 'tmy'")


@REGISTRY.add(
    "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, 'Z' || (event_id % 2) AS zone, round(value, 3) AS temp_c, CASE WHEN event_id % 2 = 0 THEN (event_id % 100)::DOUBLE END AS rh_pct FROM events"
)
def zone_csv_round_trip(spark, sf_dir):
    """Hourly reports of two layouts: one file lists humidity, the other does not."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date/Time"), F.round("value", 3).alias("v"))
    path = _root(spark, "zones")
    title = "Z{}:Zone Mean Air Temperature [C](Hourly)"
    damp = F.col("event_id") % 100
    e.filter("event_id % 2 = 0").select("Date/Time", F.col("v").alias(title.format(0)), damp.alias("Z0:Zone Air Relative Humidity [%](Hourly)")).write.option("header", "true").csv(f"{path}/even")
    e.filter("event_id % 2 = 1").select("Date/Time", F.col("v").alias(title.format(1))).write.option("header", "true").csv(f"{path}/odd")
    return src.read_zone_csv(spark, f"{path}/*").select("stamp", "zone", "temp_c", "rh_pct")


@REGISTRY.add("SELECT s_suppkey::BIGINT AS station, 24 AS n_hours, 0 AS first_hour, 23 AS last_hour, s_nationkey::DOUBLE AS coldest, s_nationkey + 23.0::DOUBLE AS warmest FROM supplier")
def weather_text_round_trip(spark, sf_dir):
    """A day of comma-separated weather for each supplier, behind its header lines."""
    s = table(spark, sf_dir, "supplier")
    hours = s.select("s_suppkey", F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), F.lit(23)))).alias("h"), "s_nationkey")
    rest = ",".join(["0"] * 28)
    line = F.when(F.col("h") < 0, F.concat(F.lit("LOCATION,"), F.col("s_suppkey").cast("string"), F.lit(",-,-,-,-,1.0,2.0"))).otherwise(
        F.format_string(f"2001,1,1,%d,60,A,%d,{rest}", F.col("h") + 1, F.col("s_nationkey") + F.col("h"))
    )
    path = _root(spark, "weather")
    hours.select("s_suppkey", "h", line.alias("value")).repartition("s_suppkey").sortWithinPartitions("s_suppkey", "h").select("s_suppkey", "value").write.partitionBy("s_suppkey").text(path)
    got = src.read_weather_text(spark, path).withColumn("station", F.regexp_extract("file", r"s_suppkey=(\d+)", 1).cast("bigint"))
    return got.groupBy("station").agg(
        F.count("*").cast("int").alias("n_hours"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"),
        F.min("dry_bulb_c").alias("coldest"), F.max("dry_bulb_c").alias("warmest"),
    )


@REGISTRY.add(
    "SELECT 'balances' AS key, o_custkey AS id, NULL::DOUBLE AS c_acctbal, o_totalprice AS amount FROM orders "
    "UNION ALL SELECT 'balances', c_custkey, c_acctbal, NULL FROM customer UNION ALL SELECT 'names', s_suppkey, NULL, NULL FROM supplier "
    "UNION ALL SELECT 'names', -1, NULL, NULL"
)
def keyed_frames_round_trip(spark, sf_dir):
    """Frames of two folders, their keys found by listing, their columns merged, beside rows given inline."""
    root = _root(spark, "frames")
    left = {"balances": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "errors": table(spark, sf_dir, "region")}
    right = {
        "balances": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount")),
        "names": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")),
    }
    src.write_frames(left, f"{root}/a")
    src.write_frames(right, f"{root}/b")
    load = lambda uri: src.collect_frames(spark, [f"{uri}/a", f"{uri}/b"])
    both = c.combine_results([{"uri": root}, {"names": [{"id": -1}]}], load)
    return c.label_union(both, "key").select("key", "id", "c_acctbal", "amount")


@REGISTRY.add(
    "SELECT 'first' AS attempt, FALSE AS refused, count(*) AS n_rows FROM customer UNION ALL SELECT 'forbidden', TRUE, count(*) FROM customer UNION ALL SELECT 'replaced', FALSE, count(*) FROM nation"
)
def forbidden_and_replaced_frames(spark, sf_dir):
    """A second write of a key is refused and changes nothing, unless it may replace."""
    root, key = _root(spark, "sink"), "rows"
    attempts = (("first", "customer", "forbid"), ("forbidden", "orders", "forbid"), ("replaced", "nation", "overwrite"))
    out = None
    for name, of, existing in attempts:
        refused = False
        try:
            src.write_frames({key: table(spark, sf_dir, of)}, root, existing=existing)
        except FileExistsError:
            refused = True
        # Counted now, as the next attempt may replace the rows.
        n = src.read_frames(spark, root)[key].count()
        row = spark.range(1).select(F.lit(name).alias("attempt"), F.lit(refused).alias("refused"), F.lit(n).cast("long").alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out


@REGISTRY.add("SELECT user_id % 5 AS case_number, count(*) AS n, " + sql_fixed("sum(value)", 3) + " AS total FROM events WHERE user_id % 5 IN (1, 3) GROUP BY 1")
def hourly_sink_round_trip(spark, sf_dir):
    """Hourly series by scope; only the folders of the selected cases are read."""
    e = table(spark, sf_dir, "events").selectExpr(
        "'exp' AS experiment_id", "concat('C', user_id % 5) AS `case`", "'city' AS city", "'G1' AS grid", "concat('b', user_id % 3) AS building", "hour(ts) AS hour", "value"
    )
    path = _root(spark, "hourly")
    src.write_hourly(e, path)
    chosen = spark.read.parquet(path).filter(F.col("case").isin("C1", "C3"))
    return chosen.groupBy(F.substring("case", 2, 9).cast("long").alias("case_number")).agg(F.count("*").alias("n"), fixed(F.sum("value"), 3).alias("total"))


@REGISTRY.add("SELECT sort_index, 5 AS n_folds, 'n' || (SELECT count(*) FROM nation) AS study FROM (SELECT unnest(range(5)) AS sort_index)")
def fold_spec_rows(spark, sf_dir):
    return src.fold_specs(spark, 5, {"study": f"n{table(spark, sf_dir, 'nation').count()}"})


@REGISTRY.add(
    "SELECT p_partkey, (list_position((SELECT list(DISTINCT p_type ORDER BY p_type) FROM part), p_type) - 1)::DOUBLE AS p_type FROM part"
)
def stored_space_round_trip(spark, sf_dir):
    """A feature space written as a table, read back, and applied."""
    p = table(spark, sf_dir, "part")
    path = _root(spark, "space")
    surrogate.learn_space(p, p, ["p_type"], ["p_type"]).table(spark).write.parquet(path)
    return surrogate.FeatureSpace.from_table(spark.read.parquet(path)).encode(p, ["p_partkey"])


@REGISTRY.add(
    "SELECT p_partkey, (CASE WHEN p_size > 25 THEN 100.0::DOUBLE + 2.0::DOUBLE*p_size ELSE 0 END) AS cost_Walls, (CASE WHEN p_size > 25 THEN 100.0::DOUBLE + 2.0::DOUBLE*p_size ELSE 0 END) AS cost_Total FROM part"
)
def rules_file_round_trip(spark, sf_dir):
    """Rules as a JSON file, read, compiled and applied."""
    name = "feature.geometry.wall_area"
    factors = [("LinearQuantity", 2.0, None, [name]), ("FixedQuantity", None, 100.0, [])]
    one = "struct({}) ".format(", ".join([
        "'semantic__Walls' AS trigger_column", "string(NULL) AS initial", "'Insulated' AS `final`", "array('FixedQuantity', 'LinearQuantity') AS `order`",
        "array({}) AS quantity_factors".format(", ".join(f"struct('{k}' AS type, double({sql_value(co)}) AS coefficient, double({sql_value(am)}) AS amount, array({', '.join(map(repr, ind))}) AS indicator_cols)".replace("array()", "CAST(array() AS array<string>)") for k, co, am, ind in factors)),
    ]))
    path = _root(spark, "rules")
    spark.range(1, numPartitions=1).selectExpr(f"to_json(struct('cost' AS output_key, array({one}) AS quantities)) AS value").write.text(path)
    read = rules.load_rule_set(spark, path)
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS geometry__wall_area", "'Bare' AS was", "CASE WHEN p_size > 25 THEN 'Insulated' ELSE 'Bare' END AS now")
    done = q.add_quantities(p, read, lambda _: "was", lambda _: "now")
    made = [x for x in done.columns if x.startswith("cost_")]
    return done.select("p_partkey", *[F.col(x).alias("cost_Total" if x == "cost_Total" else "cost_Walls") for x in made])


_STEP_VALUE = f"(CASE WHEN c_acctbal > 0 THEN 7.5::DOUBLE*ceil(c_acctbal/100.0::DOUBLE)*greatest(1.0::DOUBLE + 0.2::DOUBLE*{sql_normal('cost/0/0')}, 0.0::DOUBLE) ELSE 0.0 END)"


@REGISTRY.add(f"SELECT c_custkey, {sql_fixed(_STEP_VALUE, 4)} AS cost FROM (SELECT *, {sql_words(42, ['c_custkey'])} FROM customer)")
def registered_factor_kind(spark, sf_dir):
    """A kind of factor registered by the caller: a price for every step begun, with its error."""

    def stepped(f, t):
        (of,) = f.indicators
        return t.scaled(f"{sql_value(f.coefficient)} * ceil(double({t.indicator(of)}) / {sql_value(f.amount)})", f.error_scale)

    q.register_factor("SteppedQuantity", stepped)
    factor = q.Factor("SteppedQuantity", coefficient=7.5, amount=100.0, indicators=("c_acctbal",), error_scale=0.2)
    ruled = q.RuleSet((q.Rule("Heating", None, "new", (factor,), ("SteppedQuantity",)),), "cost")
    rows, keyed = with_row_key(table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal", "'old' AS was", "CASE WHEN c_acctbal > 0 THEN 'new' ELSE 'old' END AS now"), 42, ["c_custkey"])
    done = q.add_quantities(rows, ruled, lambda _: "was", lambda _: "now", keyed=keyed)
    return done.select("c_custkey", fixed(F.col("cost_Total"), 4).alias("cost"))
