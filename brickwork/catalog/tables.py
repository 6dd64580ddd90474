"""Spec tables, validation, classification, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.catalog.base import Registry, sql_fixed, sql_over, table
from brickwork.functions.rounding import fixed
from brickwork.functions.text import derive
from brickwork.operators import buildings as b
from brickwork.operators import collate as c
from brickwork.operators import validation as v
from brickwork.operators.heat_balance import option_grid
from brickwork.sources import tables as src

REGISTRY = Registry()


@REGISTRY.add("SELECT o_orderkey, 'study/iter-000' AS experiment_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS sort_index, o_orderpriority FROM orders")
def spec_scan_with_identity(spark, sf_dir):
    specs = src.read_specs(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    return src.assign_identity(specs, "study/iter-000", "o_orderkey").select("o_orderkey", "experiment_id", "sort_index", "o_orderpriority")


@REGISTRY.add("SELECT count(*) FILTER (WHERE o_orderpriority IS NULL) AS n_without_experiment, count(*) FILTER (WHERE o_orderkey < 0) AS n_bad_index FROM orders")
def spec_problem_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS experiment_id", "o_orderkey AS sort_index")
    return src.spec_problems(o)


@REGISTRY.add(
    "SELECT 'c_mktsegment' AS field, count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING','MACHINERY')) AS n_invalid FROM customer "
    "UNION ALL SELECT 'c_acctbal', count(*) FILTER (WHERE NOT c_acctbal BETWEEN 0 AND 5000) FROM customer"
)
def domain_violations(spark, sf_dir):
    return v.domain_report(table(spark, sf_dir, "customer"), {"c_mktsegment": ("BUILDING", "MACHINERY")}, {"c_acctbal": (0.0, 5000.0)})


@REGISTRY.add(
    " UNION ALL ".join(
        f"SELECT '{x}' AS field, {sql_fixed(f'abs(max({x})-min({x}))::DOUBLE')} AS spread, abs(max({x})-min({x})) < 1e-5 AS is_constant FROM (SELECT *, 3.0::DOUBLE AS flat FROM lineitem)"
        for x in ("l_quantity", "l_discount", "l_tax", "flat")
    )
)
def near_constant_columns(spark, sf_dir):
    got = v.spread_report(table(spark, sf_dir, "lineitem").withColumn("flat", F.lit(3.0)), ["l_quantity", "l_discount", "l_tax", "flat"])
    return got.withColumn("spread", fixed(F.col("spread")))


@REGISTRY.add("SELECT count(*) FILTER (WHERE lang IS NULL) AS n_missing, count(*) FILTER (WHERE lang NOT IN ('en','fr')) AS n_unsupported FROM documents")
def crs_guard(spark, sf_dir):
    return v.crs_problems(table(spark, sf_dir, "documents"), ("en", "fr"), "lang")


@REGISTRY.add(
    f"SELECT p_partkey, {sql_fixed('3.5::DOUBLE*p_size')} AS height, p_size AS num_floors, CASE WHEN p_size % 5 = 0 THEN 0.2::DOUBLE ELSE p_size/40.0::DOUBLE END AS wwr, "
    "CASE WHEN p_size % 5 = 0 THEN FALSE ELSE p_size/40.0::DOUBLE > 1 END AS wwr_out_of_range, CAST(greatest(1, floor(p_retailprice/100/3.5::DOUBLE)) AS INTEGER) AS floors_from_height FROM part"
)
def imputed_dimensions(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "p_retailprice / 100 AS h", "CASE WHEN p_size % 5 <> 0 THEN p_size / 40.0D END AS w")
    a = b.Assumptions()
    one = b.impute_dimensions(p, a, None, "p_size", "w")
    other = F.greatest(F.lit(1), F.floor(F.col("h") / a.f2f_height)).cast("int")
    return one.select("p_partkey", fixed(F.col("height")).alias("height"), "num_floors", "wwr", "wwr_out_of_range", other.alias("floors_from_height"))


@REGISTRY.add(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, floor(l_quantity/3.5::DOUBLE)::BIGINT AS f0, floor(l_quantity*l_tax/3.5::DOUBLE)::BIGINT AS f1, NULL::BIGINT AS f2 FROM lineitem"
)
def neighbor_floor_arrays(spark, sf_dir):
    """Element-wise floors of a height array with a missing element."""
    h = F.array(F.col("l_quantity"), F.col("l_quantity") * F.col("l_tax"), F.lit(None).cast("double"))
    got = table(spark, sf_dir, "lineitem").withColumn("f", b.floors_of(h, 3.5))
    return got.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", *[F.col("f")[i].alias(f"f{i}") for i in range(3)])


_TYPO = "CASE p_brand WHEN 'Brand#1' THEN 'Residential MF' WHEN 'Brand#2' THEN 'Multi Residential 3 units' WHEN 'Brand#3' THEN 'Commercial multi' ELSE 'Residential' END"
_TYPED = f"SELECT *, {_TYPO} AS typology, 1930 + p_partkey % 95 AS year_built, p_size % 6 AS num_floors, p_retailprice - CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE -60 END AS footprint_area, CASE p_partkey % 4 WHEN 0 THEN 'Baseline' WHEN 1 THEN 'Deep retrofit' WHEN 2 THEN 'Shallow' ELSE NULL END AS retrofit FROM part"
_SIZE = "CASE WHEN ((contains(lower(typology),'multi') OR contains(lower(typology),'mf')) AND NOT contains(lower(typology),'4 units') AND NOT contains(lower(typology),'3 units')) OR num_floors > 3 OR footprint_area > 1000 THEN 'MF' ELSE 'SF' END"
_AGE = "CASE WHEN year_built < 1975 THEN 'pre_1975' WHEN year_built <= 2003 THEN 'btw_1975_2003' ELSE 'post_2003' END"


@REGISTRY.add(
    f"WITH t AS ({_TYPED}), s AS (SELECT *, {_SIZE} AS size_key, {_AGE} AS age_key FROM t) SELECT p_partkey, contains(lower(typology),'residential') AS is_residential, size_key, age_key, "
    "'MA_' || size_key || '_' || age_key AS template_name, 'Template_' || age_key AS window_name, "
    "CASE WHEN retrofit IS NULL OR lower(retrofit)='baseline' THEN NULL WHEN starts_with(lower(retrofit),'deep') THEN retrofit || ' ' || size_key ELSE retrofit END AS retrofit_name FROM s"
)
def typology_classes(spark, sf_dir):
    p = b.add_typology(sql_over(spark, sf_dir, _TYPED, "part"))
    return derive(p, {"retrofit_name": b.retrofit_name("retrofit", "size_key")}).select(
        "p_partkey", "is_residential", "size_key", "age_key", "template_name", "window_name", "retrofit_name"
    )


@REGISTRY.add(f"SELECT count(*) FILTER (WHERE retrofit IS NOT NULL AND retrofit <> 'Baseline' AND p_size > 25) AS n_without_library FROM ({_TYPED})")
def retrofits_without_library(spark, sf_dir):
    return b.retrofits_without_library(sql_over(spark, sf_dir, _TYPED, "part").selectExpr("retrofit", "CASE WHEN p_size <= 25 THEN 's3://lib' END AS retrofit_lib_uri"))


_SPACES = "['none','unoccupied_unconditioned','unoccupied_conditioned','occupied_unconditioned','occupied_conditioned']"
_BLD = f"SELECT c_custkey, 10.0::DOUBLE + c_custkey % 12 AS long_edge, 8.0::DOUBLE + c_custkey % 10 AS short_edge, 1 + c_custkey % 4 AS num_floors, ({_SPACES})[1 + c_custkey % 5] AS basement, ({_SPACES})[1 + c_custkey % 3] AS attic, c_acctbal/5000.0::DOUBLE AS long_edge_angle, 0.1::DOUBLE + (c_custkey % 7)/20.0::DOUBLE AS wwr, 3.0::DOUBLE AS f2f_height, c_mktsegment FROM customer"


def _buildings(spark, sf_dir):
    status = "array('none','unoccupied_unconditioned','unoccupied_conditioned','occupied_unconditioned','occupied_conditioned')"
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "10D + c_custkey % 12 AS long_edge", "8D + c_custkey % 10 AS short_edge", "1 + c_custkey % 4 AS num_floors",
        f"{status}[int(c_custkey % 5)] AS basement", f"{status}[int(c_custkey % 3)] AS attic", "c_acctbal / 5000D AS long_edge_angle",
        "0.1D + (c_custkey % 7) / 20D AS wwr", "3D AS f2f_height", "c_mktsegment",
    )


_OCC, _CON = "('occupied_unconditioned','occupied_conditioned')", "('occupied_conditioned','unoccupied_conditioned')"
_AREA = (
    f"a AS (SELECT *, CASE WHEN long_edge > 15 AND short_edge > 15 THEN 'core/perim' ELSE 'by_storey' END AS zoning, num_floors + (basement IN {_CON})::INT + (attic IN {_CON})::INT AS nc, num_floors + (basement IN {_OCC})::INT + (attic IN {_OCC})::INT AS no FROM b)"
)


@REGISTRY.add(
    f"WITH b AS ({_BLD}), {_AREA} SELECT c_custkey, zoning, nc::BIGINT AS n_conditioned_floors, no::BIGINT AS n_occupied_floors, nc*long_edge*short_edge AS conditioned_area, no*long_edge*short_edge AS occupied_area, basement <> 'none' AS has_basement, attic IN {_OCC} AS attic_is_occupied FROM a"
)
def building_areas(spark, sf_dir):
    got = b.add_areas(_buildings(spark, sf_dir))
    return got.select(
        "c_custkey", "zoning", F.col("n_conditioned_floors").cast("bigint").alias("n_conditioned_floors"), F.col("n_occupied_floors").cast("bigint").alias("n_occupied_floors"),
        F.col("energy_model_conditioned_area").alias("conditioned_area"), F.col("energy_model_occupied_area").alias("occupied_area"), "has_basement", "attic_is_occupied",
    )


@REGISTRY.add(
    f"WITH b AS ({_BLD}), {_AREA} SELECT c_custkey, {sql_fixed('cos(long_edge_angle)')} AS orientation_cos, {sql_fixed('sin(long_edge_angle)')} AS orientation_sin, {sql_fixed('long_edge/short_edge')} AS aspect_ratio, zoning, "
    f"CASE WHEN basement <> 'none' THEN 'Yes' ELSE 'No' END AS basement_exists, CASE WHEN attic IN {_CON} THEN 'Yes' ELSE 'No' END AS attic_conditioned, c_mktsegment AS segment, {sql_fixed('w.t', 4)} AS station_mean FROM a JOIN (SELECT c_mktsegment AS k, avg(c_acctbal) AS t FROM customer GROUP BY 1) w ON w.k=a.c_mktsegment"
)
def building_feature_projection(spark, sf_dir):
    """Feature vector with a station summary joined on the weather key."""
    f = b.feature_projection(b.add_areas(_buildings(spark, sf_dir)), ["c_mktsegment"], ["c_custkey"])
    w = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("semantic__c_mktsegment")).agg(F.avg("c_acctbal").alias("t"))
    g = lambda n: fixed(F.col(f"geometry__{n}"))
    return f.join(w, "semantic__c_mktsegment").select(
        "c_custkey", g("orientation__cos").alias("orientation_cos"), g("orientation__sin").alias("orientation_sin"), g("aspect_ratio").alias("aspect_ratio"),
        F.col("geometry__zoning").alias("zoning"), F.col("extra_spaces__basement__exists").alias("basement_exists"), F.col("extra_spaces__attic__conditioned").alias("attic_conditioned"),
        F.col("semantic__c_mktsegment").alias("segment"), fixed(F.col("t"), 4).alias("station_mean"),
    )


@REGISTRY.add(
    "SELECT c_custkey, 'exp' AS experiment_id, 'https://climate.onebuilding.org/' || c_mktsegment AS epwzip_uri, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nation, 'none' AS basement, 0.25::DOUBLE AS exposed_basement_frac FROM customer"
)
def building_spec_rows(spark, sf_dir):
    p = table(spark, sf_dir, "customer").withColumn("epwzip_uri", b.weather_uri(F.col("c_mktsegment")))
    got = b.building_specs(p, "exp", ["c_mktsegment", "c_nationkey"], b.Assumptions(), {"db_uri": "s3://db"})
    m = F.col("semantic_field_context")
    return got.select("c_custkey", "experiment_id", "epwzip_uri", m["c_mktsegment"].alias("seg"), m["c_nationkey"].alias("nation"), "basement", "exposed_basement_frac")


_SURF = "SELECT l_orderkey % 500 AS building, CASE WHEN l_linenumber % 2 = 0 THEN 'FLR' || (l_linenumber % 3 + 1) || '_OFFICEBLDG_' || (l_partkey % 4) || '_FLOOR9_ROOM' || (l_suppkey % 3) ELSE 'Core Flr' || (l_linenumber % 4) END AS zone, CASE WHEN l_returnflag='R' THEN 'Floor' ELSE 'Wall' END AS surface_type, CASE WHEN l_linestatus='O' THEN 'Outdoors' ELSE 'Zone' END AS boundary, l_quantity*14 AS azimuth FROM lineitem"


@REGISTRY.add(
    f"WITH s AS ({_SURF}), n AS (SELECT *, CASE WHEN zone LIKE 'FLR%' THEN 'Officebldg_' || split_part(zone,'_',3) || '_Floor' || substr(split_part(zone,'_',1),4) || '_Room' || substr(split_part(zone,'_',5),5) ELSE zone END AS zone_name FROM s), "
    "z AS (SELECT building, zone_name, avg(azimuth) FILTER (WHERE surface_type='Wall' AND boundary='Outdoors') AS az, count(*) FILTER (WHERE surface_type='Wall' AND boundary='Outdoors') AS k, CASE WHEN zone_name LIKE 'Core%' THEN CAST(substr(zone_name, 9) AS INT) ELSE CAST(regexp_extract(zone_name, 'Floor([0-9]+)', 1) AS INT) END AS floor_number FROM n GROUP BY ALL), "
    "e AS (SELECT *, min(floor_number) OVER (PARTITION BY building) AS lo, max(floor_number) OVER (PARTITION BY building) AS hi, az - floor(az/360)*360 AS m FROM z) "
    "SELECT building, zone_name, (round_even(coalesce(az, 0.0::DOUBLE)*10.0::DOUBLE, 0)/10.0::DOUBLE) AS avg_azimuth, CASE WHEN k=0 THEN 'core' WHEN m>=315 OR m<45 THEN 'North' WHEN m<135 THEN 'East' WHEN m<225 THEN 'South' ELSE 'West' END AS orientation, floor_number, "
    "CASE WHEN lo=hi OR floor_number=lo THEN 'ground' WHEN floor_number=hi THEN 'top' ELSE 'middle' END AS floor_assignment FROM e"
)
def zone_orientation_table(spark, sf_dir):
    return b.zone_table(sql_over(spark, sf_dir, _SURF, "lineitem"))


_OUT = "WITH s AS (SELECT o_orderkey AS run_id, o_orderpriority AS name FROM orders), r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus='O' THEN 'boom ' || o_orderpriority END AS error FROM orders WHERE o_orderstatus <> 'P')"


def _outcomes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = o.selectExpr("o_orderkey AS run_id", "o_orderpriority AS name")
    r = o.filter("o_orderstatus <> 'P'").selectExpr("o_orderkey AS run_id", "CASE WHEN o_orderstatus = 'O' THEN concat('boom ', o_orderpriority) END AS error")
    return c.match_outcomes(s, r)


@REGISTRY.add(_OUT + " SELECT CASE WHEN r.run_id IS NULL THEN 'missing' WHEN error IS NOT NULL THEN 'error' ELSE 'ok' END AS state, count(*) AS n FROM s LEFT JOIN r USING (run_id) GROUP BY 1")
def run_outcome_counts(spark, sf_dir):
    return c.outcome_counts(_outcomes(spark, sf_dir))


@REGISTRY.add(_OUT + " SELECT name, s.run_id AS workflow_run_id, r.run_id IS NULL AS missing, error AS errored FROM s LEFT JOIN r USING (run_id) WHERE r.run_id IS NULL OR error IS NOT NULL")
def errored_and_missing_runs(spark, sf_dir):
    return c.errors_and_missing(_outcomes(spark, sf_dir), ["name"])


@REGISTRY.add(
    "SELECT key, id, a, b FROM (SELECT 'part' AS key, p_partkey AS id, p_size::DOUBLE AS a, NULL::DOUBLE AS b FROM part WHERE p_size < 25 UNION ALL SELECT 'part', p_partkey, NULL, p_retailprice FROM part WHERE p_size >= 25 UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier)"
)
def collated_result_frames(spark, sf_dir):
    """Frames united per key; columns missing from a part become NULL."""
    p = table(spark, sf_dir, "part")
    got = c.collate(
        [
            {"part": p.filter("p_size < 25").selectExpr("p_partkey AS id", "double(p_size) AS a")},
            {"part": p.filter("p_size >= 25").selectExpr("p_partkey AS id", "p_retailprice AS b"), "supplier": table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS b")},
        ]
    )
    return c.label_union(got, "key").select("key", "id", "a", "b")


@REGISTRY.add("SELECT o_orderkey AS run_id, o_orderpriority, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey=l_orderkey")
def inputs_beside_outputs(spark, sf_dir):
    specs = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", "o_orderpriority")
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS run_id", "l_linenumber", "l_quantity")
    return c.inputs_beside_outputs(specs, rows).select("run_id", "o_orderpriority", "l_linenumber", "l_quantity")


@REGISTRY.add("SELECT DISTINCT o_custkey AS name FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def missing_file_references(spark, sf_dir):
    files = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey AS name")
    return v.missing_references(table(spark, sf_dir, "orders"), "o_custkey", files)


@REGISTRY.add("SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0 AS is_subset")
def reference_subset_test(spark, sf_dir):
    return v.is_subset(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k"), table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k"), "k")


@REGISTRY.add("SELECT e.user_id, e.event_id, e.value FROM events e WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def series_of_selected_runs(spark, sf_dir):
    sel = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").selectExpr("c_custkey AS user_id")
    return src.series_of(sel, table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"])


_CELLS = [(f, s) for f in ("A", "N", "R") for s in ("F", "O")]


@REGISTRY.add(
    "SELECT l_orderkey, " + ", ".join(f"max(l_quantity) FILTER (WHERE l_returnflag='{f}' AND l_linestatus='{s}') AS {f}_{s}" for f, s in _CELLS) + " FROM lineitem GROUP BY l_orderkey"
)
def wide_tabular_report(spark, sf_dir):
    return c.wide_report(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", _CELLS)


_FOUND = [(f"{f} {s}", p) for f in ("A", "N", "R") for s in ("F", "O") for p in ("early", "late")]
_PART = "CASE WHEN l_linenumber <= 3 THEN 'early' ELSE 'late' END"
_SHOWN = "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END"


@REGISTRY.add(
    "SELECT l_orderkey, " + ", ".join(
        f"max(CASE WHEN l_returnflag || ' ' || l_linestatus = '{r}' AND {_PART} = '{p}' THEN l_quantity END) AS \"{r.replace(' ', '_')}_{p}\"" for r, p in _FOUND if r[0] != "A"
    ) + " FROM lineitem GROUP BY l_orderkey"
)
def wide_report_found_cells(spark, sf_dir):
    """Cells are found in the data; those of returned lines hold no value in any order and are dropped."""
    report = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "concat(l_returnflag, ' ', l_linestatus) AS title", f"{_PART} AS part", f"{_SHOWN} AS shown")
    return c.wide_report(report, "l_orderkey", "title", "part", "shown")


_MSG = "'EnergyPlus Completed Successfully-- ' || (o_orderkey % 17) || ' Warning; ' || (o_custkey % 5) || ' Severe Errors; Elapsed'"


@REGISTRY.add("SELECT o_orderkey, o_orderkey % 17 AS warnings, o_custkey % 5 AS severe FROM orders")
def message_counts(spark, sf_dir):
    w, s = c.message_counts("msg")
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_MSG} AS msg").selectExpr("o_orderkey", f"{w} AS warnings", f"{s} AS severe")


_PATHS = "SELECT 'root/C' || (o_custkey % 7) || '_Cairo' || (o_custkey % 3) || '_G' || (o_orderkey % 5) || '/' || CASE WHEN o_orderkey % 4 = 0 THEN 'C1_Cairo_G2_' || CASE WHEN o_custkey % 11 = 0 THEN 'tmy' ELSE 'rmy' END || '.epw' ELSE 'B' || (o_orderkey % 9) || '.idf' END AS path FROM orders"


@REGISTRY.add(
    f"WITH p AS (SELECT DISTINCT path, split_part(path,'/',2) AS folder, split_part(path,'/',3) AS file FROM ({_PATHS})), w AS (SELECT folder, min(file) AS epw FROM p WHERE file LIKE '%.epw' GROUP BY 1 HAVING count(*) = 1) "
    "SELECT regexp_extract(folder, '^C([0-9]+)_', 1) AS \"case\", regexp_extract(folder, '_(Cairo[0-9])_', 1) AS city, regexp_extract(folder, '_G([0-9]+)$', 1) AS grid, 'Cairo_' || regexp_extract(epw, 'G2_(.*)[.]epw', 1) AS climate, replace(file, '.idf', '') AS building_name, path AS idf_uri FROM p JOIN w USING (folder) WHERE file LIKE '%.idf'"
)
def case_folder_specs(spark, sf_dir):
    """Model files of folders with exactly one weather file, from a path listing."""
    return src.case_specs(sql_over(spark, sf_dir, _PATHS, "orders"), "exp").drop("experiment_id", "epw")


def _leaf(spec: dict) -> dict[str, list[dict]]:
    if spec["p_size"] % 10 == 0:
        raise ValueError(f"size {spec['p_size']}")
    return {"results": [{"energy": spec["p_retailprice"] * spec["p_size"]}]}


@REGISTRY.add(
    f"SELECT CAST(p_partkey AS VARCHAR) AS run_id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE {sql_fixed('p_retailprice*p_size', 4)} END AS energy, CASE WHEN p_size % 10 = 0 THEN 'ValueError: size ' || p_size END AS error, CASE WHEN p_size % 10 = 0 THEN 2 ELSE 1 END::INTEGER AS attempts FROM part"
)
def leaf_function_over_specs(spark, sf_dir):
    """A user function per spec row with retries and captured errors."""
    specs = table(spark, sf_dir, "part").selectExpr("p_partkey AS run_id", "p_size", "p_retailprice")
    res = c.run_leaf(specs, _leaf, attempts=2)
    return res.select("run_id", fixed(F.try_element_at("values", F.lit("energy")), 4).alias("energy"), "error", "attempts")


@REGISTRY.add("SELECT r_name, p AS o_orderpriority, f AS status, (SELECT count(*) FROM orders) AS n_orders FROM region, (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT unnest(['F','O','P']) AS f)")
def option_product(spark, sf_dir):
    """Grid of options: distinct option rows and literal labels over every row."""
    o = table(spark, sf_dir, "orders")
    facts = o.select(
        F.struct(F.transform(F.collect_set(F.struct("o_orderpriority")), lambda s: s["o_orderpriority"]).alias("levels"), F.count(F.lit(1)).alias("n")).alias("f")
    ).scalar()
    g = table(spark, sf_dir, "region").select("r_name", facts["n"].alias("n_orders"))
    return option_grid(g, {"o_orderpriority": facts["levels"], "status": ["F", "O", "P"]})


@REGISTRY.add(
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 3 AND user_id > 5 AND contains(props, '1')"
)
def cross_section_and_masks(spark, sf_dir):
    """One level value selected and dropped, size masks and a text mask; all reach the scan."""
    e = table(spark, sf_dir, "events").filter((F.col("event_type") == "click") & (F.col("value") > 3) & (F.col("user_id") > 5))
    return e.filter(F.col("props").contains("1")).select("event_id", "user_id", "value")


@REGISTRY.add(
    "WITH c AS (SELECT o_orderkey % 7 AS k, CASE WHEN o_custkey % 3 = 0 THEN 'a' END AS label, o_totalprice AS v FROM orders) SELECT k, label, count(*) AS n FROM c GROUP BY ALL ORDER BY k, label"
)
def sorted_group_sizes(spark, sf_dir):
    """Sizes per level, sorted; a missing level is a group of its own."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 7 AS k", "CASE WHEN o_custkey % 3 = 0 THEN 'a' END AS label")
    return o.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("k", "label")
