"""Footprint rectangles, neighbours, nearest stations and horizons."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.functions import geometry as g
from brickwork.functions.text import derive, fence
from brickwork.operators.ranking import join_null_safe
from brickwork.session import cut_lineage, partitions_for

SPLITS = 4  # cells to the radius of a neighbour search
MEMBERS = 256  # buildings that travel in one row of their rectangle
ARRAY_WEIGHT = 16  # partitions of neighbour arrays, times the usual number
RIM_SPLITS = 16  # cells to the radius where neighbours are only counted
NEAREST_ROUNDS = (16, 8, 4, 2, 1)  # the nearest neighbour is sought within these parts of the radius
HORIZON_ROUNDS = (8, 4, 2, 1)  # a horizon is sought within these parts of the radius, one after another
STATION_LIMIT = 50_000  # stations that may be sent to every task
LEAF = 32  # stations of a cell that is not divided
FANOUT_BITS, LEVELS = 3, 16  # a cell has 8 x 8 children; the finest is 2**-48 of the whole side
BLOCK = 128  # places that descend the tree together
HELD = 256  # cells that a block holds before its places go on alone
MAX_STATION_DISTANCE = 500_000.0  # fixed value: metres


def add_rectangles(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Rectangle, areas, edges, angle and aspect ratio of every footprint."""
    fitted = df.withColumn(
        "__r", g.smallest_rectangle(g.ring_axis(F.col(ring), "x"), g.ring_axis(F.col(ring), "y"))
    ).withColumn("footprint_area", g.ring_area(F.col(ring)))
    flat = derive(
        fitted,
        {
            "__du": "__r.u1 - __r.u0", "__dv": "__r.v1 - __r.v0",
            "cx": "(__r.u0 + __r.u1) / 2 * cos(__r.angle) - (__r.v0 + __r.v1) / 2 * sin(__r.angle)",
            "cy": "(__r.u0 + __r.u1) / 2 * sin(__r.angle) + (__r.v0 + __r.v1) / 2 * cos(__r.angle)",
        },
    )
    turned = f"__r.angle + CASE WHEN __du > __dv THEN 0D ELSE {math.pi / 2!r}D END"
    flat = derive(flat, {"long_edge": "greatest(__du, __dv)", "short_edge": "least(__du, __dv)", "__t": turned})
    return derive(
        flat,
        {
            "long_edge_angle": f"CASE WHEN __t > {math.pi / 2!r}D + 1e-12D THEN __t - {math.pi!r}D ELSE __t END",
            "rotated_rectangle_area_ratio": "try_divide(long_edge * short_edge, footprint_area)",
            "aspect_ratio": "try_divide(long_edge, short_edge)",
        },
    ).drop("__r", "__du", "__dv", "__t")


def rectangle_ring(cx: str = "cx", cy: str = "cy", long: str = "long_edge", short: str = "short_edge", angle: str = "long_edge_angle") -> str:
    """SQL of the four corners of an oriented rectangle."""
    corners = []
    for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        u, v = f"({a}D * {long} / 2)", f"({b}D * {short} / 2)"
        corners.append(
            f"struct({cx} + {u} * cos({angle}) - {v} * sin({angle}) AS x, {cy} + {u} * sin({angle}) + {v} * cos({angle}) AS y)"
        )
    return f"array({', '.join(corners)})"


def _cell(axis: str, side: float) -> str:
    return f"bigint(floor({axis} / {side!r}D))"


def _offsets(splits: int, *, half: bool = False) -> list[tuple[int, int]]:
    """Cells, ``splits`` to a radius, that may hold points within the radius of a point of the cell (0, 0).

    ``half`` leaves one of each two opposite cells.
    """
    gap = lambda o: max(abs(o) - 1, 0)
    span = range(-splits, splits + 1)
    return [(x, y) for x in span for y in span if gap(x) ** 2 + gap(y) ** 2 < splits**2 and not (half and (y, x) < (0, 0))]


def _meetings(targets: DataFrame, rects: DataFrame, radius: float, offsets: list[tuple[int, int]], splits: int, weight: int = 4) -> DataFrame:
    """Every row of ``targets`` (columns ``a_…``) beside every row of ``rects`` (``b_…``) of the cells around it.

    Cells are ``splits`` to the radius, so a crowded place is many join keys, and only rows
    of ``rects`` are sent to several cells; the pairs of a target lie where its cell
    (gx, gy) lies and are shuffled no more.
    """
    side = radius / splits * (1 + 1e-9)  # rounding moves nothing two cells away
    n = partitions_for(targets.sparkSession, weight)

    def placed(df: DataFrame, prefix: str) -> DataFrame:
        at = {"gx": _cell("cx", side), "gy": _cell("cy", side)}
        return derive(df, at).withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns})

    a = placed(targets, "a_").filter("gx IS NOT NULL AND gy IS NOT NULL")
    b = placed(rects, "b_").withColumnsRenamed({"gx": "b_gx", "gy": "b_gy"}).filter("b_gx IS NOT NULL AND b_gy IS NOT NULL")
    near = ", ".join(f"struct({x} AS ox, {y} AS oy)" for x, y in offsets)
    b = b.selectExpr("*", f"inline(array({near}))").selectExpr("*", "b_gx - ox AS gx", "b_gy - oy AS gy").drop("b_gx", "b_gy")
    return a.repartition(n, "gx", "gy").join(b.repartition(n, "gx", "gy"), ["gx", "gy"])


def _d2(a: str, b: str) -> str:
    """SQL: the squared distance of the centres of a and b."""
    return f"(pow({a}cx - {b}cx, 2) + pow({a}cy - {b}cy, 2))"


_D2 = _d2("a_", "b_")
_HALF = "hypot(long, short) / 2 + angle * 0"  # without an angle there is no rectangle
#: Rectangles can only share a point where their centres are no farther apart than their half diagonals.
_OVERLAP = f"({_D2} <= pow(a_half + b_half, 2) * (1 + 1e-9D) AND {g.overlap_sql('a_', 'b_')})"
_FINITE_CENTRE = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('Infinity')" for c in ("cx", "cy"))
_SHAPE = ["loc", "cx", "cy", "long", "short", "angle"]


def neighbor_pairs(rects: DataFrame, radius: float, *, remove_intersections: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of distinct rectangles whose centres are within ``radius``.

    ``rects(loc, cx, cy, long, short, angle, …)`` holds one row per distinct
    rectangle (see :func:`distinct_rectangles`), so copies never multiply.
    Centres meet in a join on grid cells, ``SPLITS`` to the radius; each unordered
    pair is found once, in half of the cells around, and mirrored afterwards.
    Columns to ``carry`` are returned for both sides, the other's as ``other_…``.
    """
    rows = derive(rects.select(*_SHAPE, *carry), {"half": _HALF})
    once = "a_loc <> b_loc AND (ox <> 0 OR oy <> 0 OR a_loc < b_loc)"
    pairs = _meetings(rows, rows, radius, _offsets(SPLITS, half=True), SPLITS).filter(f"{once} AND {_D2} <= {radius * radius!r}D")
    if remove_intersections:
        pairs = pairs.filter(f"NOT {_OVERLAP}")

    def sides(a: str, b: str) -> str:
        return ", ".join([f"{a}loc AS loc", f"{b}loc AS other", *[x for c in carry for x in (f"{a}{c} AS {c}", f"{b}{c} AS other_{c}")]])

    both = f"array(struct({sides('a_', 'b_')}), struct({sides('b_', 'a_')}))"
    return pairs.selectExpr(f"inline({both})", f"sqrt({_D2}) AS distance")


def one_row_each(rects: DataFrame) -> bool:
    """Does every rectangle have a name of its own?"""
    return not rects.groupBy("loc").count().filter("count > 1 OR loc IS NULL").take(1)


def distinct_rectangles(buildings: DataFrame, key: str, height: str | None = None) -> DataFrame:
    """One row per distinct rectangle with its copies counted."""
    shape = ["cx", "cy", "long", "short", "angle", *([height] if height else [])]
    return buildings.groupBy(*shape).agg(F.min(key).alias("loc"), F.count(F.lit(1)).alias("copies"))


def with_members(buildings: DataFrame, rects: DataFrame, key: str) -> DataFrame:
    """The rows of ``rects`` with their buildings as an array, in several rows where they are many."""
    shape = [c for c in rects.columns if c not in ("loc", "copies")]
    named = join_null_safe(buildings.select(F.col(key).alias("__key"), *shape), rects.select("loc", "copies", *shape), shape)
    chunk = F.pmod(F.xxhash64("__key"), F.ceil(F.col("copies") / MEMBERS)).alias("__chunk")
    return named.select("__key", "loc", *shape, chunk).groupBy("loc", *shape, "__chunk").agg(F.collect_list(F.struct("__key")).alias("members")).drop("__chunk")


def building_pairs(buildings: DataFrame, rects: DataFrame, pairs: DataFrame, key: str, *, copies_meet: bool = False) -> DataFrame:
    """(key, other, distance) for every building, copies of a rectangle included.

    ``rects`` are the distinct rectangles of ``buildings`` and ``pairs`` the pairs of
    them.  Pairs that carry the ``members`` of :func:`with_members` are expanded where
    they are; others are joined.  Copies overlap each other, so they are pairs only if
    ``copies_meet``, as is right where intersecting neighbours are kept.
    """
    shape = [c for c in rects.columns if c not in ("loc", "copies")]
    members = join_null_safe(buildings.select(F.col(key).alias("__key"), *shape), rects.select("loc", *shape), shape).select("__key", "loc")
    others = members.select(F.col("__key").alias("__other"), F.col("loc").alias("other"))
    if "members" in pairs.columns:
        found = pairs.selectExpr("distance", "inline(members)", "other_members").selectExpr("distance", "__key", "inline(other_members) AS (__other)")
        found = found.select("__key", "__other", "distance")
    else:
        found = pairs.select("loc", "other", "distance").join(members, "loc").join(others, "other").select("__key", "__other", "distance")
    if copies_meet:
        same = members.join(others, F.col("loc") == F.col("other")).filter("__key <> __other")
        found = found.unionByName(same.select("__key", "__other", F.lit(0.0).alias("distance")))
    found = found.filter("__key <> __other")  # a key may name several rectangles
    return found.select(F.col("__key").alias(key), F.col("__other").alias("other"), "distance")


def neighbor_statistics(rects: DataFrame, radius: float) -> DataFrame:
    """(loc, n_neighbors, nearest) of every rectangle with another centre within ``radius``, intersecting ones included.

    Rectangles with one centre are met as one and counted as many.  A cell that lies within
    the radius as a whole is counted by its number of rectangles; only the centres of cells
    on the rim are measured.  The nearest is sought in growing circles, each for the centres
    that have found none.  Rectangles without a name are nobody's neighbours.
    """
    rects = rects.filter("loc IS NOT NULL")
    if not one_row_each(rects):
        pairs = neighbor_pairs(rects, radius, remove_intersections=False)
        return pairs.groupBy("loc").agg(F.count(F.lit(1)).alias("n_neighbors"), F.min("distance").alias("nearest"))
    named = cut_lineage(rects.filter(_FINITE_CENTRE).select("loc", "cx", "cy"))
    rows = cut_lineage(named.groupBy("cx", "cy").agg(F.min("loc").alias("loc"), F.count(F.lit(1)).alias("copies")))
    side = radius / RIM_SPLITS * (1 + 1e-9)
    around = _offsets(RIM_SPLITS)
    whole = [(x, y) for x, y in around if (abs(x) + 1) ** 2 + (abs(y) + 1) ** 2 < RIM_SPLITS**2 * (1 - 1e-6)]
    rim = sorted(set(around) - set(whole))
    cells = rows.selectExpr(f"{_cell('cx', side)} AS gx", f"{_cell('cy', side)} AS gy", "copies").groupBy("gx", "gy").agg(F.sum("copies").alias("count"))
    n = partitions_for(rects.sparkSession, 4)
    moved = cells.repartition(n, "gx", "gy").selectExpr("count", "gx", "gy", f"inline(array({', '.join(f'struct({x} AS ox, {y} AS oy)' for x, y in whole)}))")
    inner = moved.groupBy((F.col("gx") - F.col("ox")).alias("gx"), (F.col("gy") - F.col("oy")).alias("gy")).agg(F.sum("count").alias("n"))
    # The rectangle itself stands in its own cell.
    inner = derive(rows, {"gx": _cell("cx", side), "gy": _cell("cy", side)}).join(inner, ["gx", "gy"]).selectExpr("loc", "n - 1 AS n")
    measured = _meetings(rows, rows, radius, rim, RIM_SPLITS).filter(f"a_loc <> b_loc AND {_D2} <= {radius * radius!r}D")
    measured = measured.groupBy(F.col("a_loc").alias("loc")).agg(F.sum("b_copies").alias("n"))
    counts = inner.unionByName(measured).groupBy("loc").agg(F.sum("n").alias("n_neighbors")).filter("n_neighbors > 0")
    counts = cut_lineage(rows.join(counts, "loc"))
    found, open_ = counts.filter("copies > 1").selectExpr("loc", "0D AS nearest"), counts.filter("copies = 1")
    for part in NEAREST_ROUNDS:
        pairs = _meetings(open_, rows, radius / part, _offsets(2), 2)
        pairs = pairs.filter(f"a_loc <> b_loc AND {_D2} <= {(radius / part) ** 2!r}D")
        nearest = cut_lineage(pairs.groupBy(F.col("a_loc").alias("loc")).agg(F.min(F.expr(f"sqrt({_D2})")).alias("nearest")))
        found = found.unionByName(nearest)
        open_ = cut_lineage(open_.join(nearest, "loc", "left_anti"))
    return named.join(counts.join(found, "loc").drop("loc"), ["cx", "cy"]).select("loc", "n_neighbors", "nearest")


def _outlined(rects: DataFrame, height: str, fill_height: float) -> DataFrame:
    """The rectangles with their outline ``poly`` and filled height ``h``."""
    ring = rectangle_ring(long="long", short="short", angle="angle")
    side = derive(rects, {"ring": ring, "h": f"coalesce({height}, {fill_height!r}D)"})
    return side.withColumn("poly", g.ring_to_wkt(F.col("ring"))).drop("ring")


def _array_columns(lists: DataFrame, f2f: float) -> DataFrame:
    return lists.selectExpr(
        "loc",
        "coalesce(n.poly, array()) AS neighbor_polys",
        "coalesce(n.h, array()) AS neighbor_heights",
        f"transform(coalesce(n.h, array()), h -> floor(h / {f2f!r}D)) AS neighbor_floors",
        "coalesce(n.copies, array()) AS neighbor_copies",
    )


def neighbor_arrays(rects: DataFrame, pairs: DataFrame, height: str, fill_height: float, f2f: float) -> DataFrame:
    """Per rectangle: neighbour outlines, heights, floors and copy counts.

    Missing heights are filled, rectangles without neighbours get empty arrays.
    """
    side = _outlined(rects, height, fill_height).select(F.col("loc").alias("other"), "poly", "h", "copies")
    lists = pairs.join(side, "other").groupBy("loc").agg(
        F.sort_array(F.collect_list(F.struct("other", "poly", "h", "copies"))).alias("n")
    )
    return _array_columns(rects.select("loc").join(lists, "loc", "left"), f2f)


def neighbor_arrays_within(rects: DataFrame, radius: float, height: str, fill_height: float, f2f: float) -> DataFrame:
    """The arrays of :func:`neighbor_arrays` of all rectangles within ``radius`` that do not intersect.

    Only rectangles are shuffled, with their outlines.  What stands around a cell is gathered
    and sorted once; each rectangle of the cell picks its neighbours out of it in its own row,
    so no pair is ever sorted, spilled or kept beside another rectangle's.
    """
    named = rects.filter("loc IS NOT NULL")
    if not one_row_each(named):
        return neighbor_arrays(rects, neighbor_pairs(rects, radius), height, fill_height, f2f)
    side = radius / SPLITS * (1 + 1e-9)
    n = partitions_for(rects.sparkSession, ARRAY_WEIGHT)
    at = {"half": _HALF, "gx": _cell("cx", side), "gy": _cell("cy", side)}
    rows = derive(named.select(*_SHAPE), at).filter("gx IS NOT NULL AND gy IS NOT NULL").withColumnsRenamed({c: f"a_{c}" for c in (*_SHAPE, "half")})
    outlined = derive(_outlined(named, height, fill_height).select(*_SHAPE, "poly", "h", "copies"), at).filter("gx IS NOT NULL AND gy IS NOT NULL")
    near = ", ".join(f"struct({x} AS ox, {y} AS oy)" for x, y in _offsets(SPLITS))
    one = "struct(loc AS other, poly, h, copies, cx, cy, long, short, angle, half) AS one"
    moved = outlined.selectExpr("gx", "gy", one, f"inline(array({near}))").selectExpr("gx - ox AS gx", "gy - oy AS gy", "one")
    around = moved.repartition(n, "gx", "gy").groupBy("gx", "gy").agg(F.sort_array(F.collect_list("one")).alias("around"))
    overlap = f"({_d2('a_', 'b.')} <= pow(a_half + b.half, 2) * (1 + 1e-9D) AND {g.overlap_sql('a_', 'b.')})"
    pair = f"b.other <> a_loc AND {_d2('a_', 'b.')} <= {radius * radius!r}D AND NOT {overlap}"
    met = rows.repartition(n, "gx", "gy").join(around, ["gx", "gy"])
    lists = met.selectExpr("a_loc AS loc", f"filter(around, b -> {pair}) AS n")
    nowhere = rects.filter("loc IS NULL OR cx IS NULL OR cy IS NULL").select("loc")
    return _array_columns(lists.unionByName(nowhere, allowMissingColumns=True), f2f)


# ---- nearest station ---------------------------------------------------------------


class StripIndex:
    """Equal-count strips along x, sorted by y inside: adapts to crowding."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray):
        n = len(ids)
        self.k = max(1, int(math.sqrt(n)))
        order = np.argsort(x, kind="stable")
        bounds = np.linspace(0, n, self.k + 1).astype(int)
        parts = [order[bounds[i] : bounds[i + 1]] for i in range(self.k)]
        parts = [p[np.argsort(y[p], kind="stable")] for p in parts if len(p)]
        self.k = len(parts)
        self.strips = [(ids[p], x[p], y[p]) for p in parts]
        self.low = np.array([x[p].min() for p in parts])
        self.high = np.array([x[p].max() for p in parts])

    def query(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.full(len(px), np.inf)
        who = np.full(len(px), -1, dtype=np.int64)
        home = np.clip(np.searchsorted(self.low, px, "right") - 1, 0, self.k - 1)
        for s in range(self.k):
            self._scan(s, np.flatnonzero(home == s), px, py, best, who)
        for s in range(self.k):
            gap = np.maximum(0, np.maximum(self.low[s] - px, px - self.high[s]))
            self._scan(s, np.flatnonzero((gap * gap <= best) & (home != s)), px, py, best, who)
        return who, best

    def _scan(self, s, rows, px, py, best, who) -> None:
        ids, x, y = self.strips[s]
        start = np.searchsorted(y, py[rows])
        for step in (1, -1):
            live, at = rows, start if step == 1 else start - 1
            while len(live):
                ok = (at >= 0) & (at < len(y))
                live, at = live[ok], at[ok]
                dy = y[at] - py[live]
                near = dy * dy <= best[live]
                live, at, dy = live[near], at[near], dy[near]
                dx = x[at] - px[live]
                d2 = dx * dx + dy * dy
                better = (d2 < best[live]) | ((d2 == best[live]) & (ids[at] < who[live]))
                hit = live[better]
                best[hit], who[hit] = d2[better], ids[at[better]]
                at = at + step


FINITE = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND abs(x) < double('Infinity') AND abs(y) < double('Infinity')"


def nearest_station(points: DataFrame, stations: DataFrame, station: str = "station_id", limit: int = STATION_LIMIT) -> DataFrame:
    """Every row of ``points`` with its nearest station and distance; ties to the lower id.

    Both sides have ``x`` and ``y``; station ids are whole numbers.  Stations
    without finite coordinates are ignored and co-located ones collapse to the
    lowest id; points without finite coordinates get NULL for both.  A counted
    number of stations within ``limit`` is sent to the tasks as a sorted index
    and the points never move; beyond it the distinct places descend a tree of
    station cells in joins.  Both ways give the same rows.
    """
    sites = stations.filter(FINITE).groupBy("x", "y").agg(F.min(station).cast("bigint").alias("sid"))
    small = sites.limit(limit + 1).toPandas()
    if len(small) == 0:
        raise ValueError("no usable station")
    if len(small) > limit:
        places = points.filter(FINITE).select(F.col("x").cast("double"), F.col("y").cast("double")).distinct()
        found = _nearest_by_tree(places, sites).withColumnsRenamed({"x": "__x", "y": "__y"})
        joined = points.join(found, (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")), "left")
        return joined.select(*[points[c] for c in points.columns], F.col("sid").alias(station), F.sqrt("d2").alias("distance"))
    shared = points.sparkSession.sparkContext.broadcast(
        (small["sid"].to_numpy(), small["x"].to_numpy(float), small["y"].to_numpy(float))
    )
    built: list[StripIndex] = []

    @F.pandas_udf("sid long, d2 double")
    def find(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        if not built:
            built.append(StripIndex(*shared.value))
        px, py = x.to_numpy(float), y.to_numpy(float)
        placed = np.flatnonzero(np.isfinite(px) & np.isfinite(py))
        who, best = built[0].query(px[placed], py[placed])
        return pd.DataFrame({"sid": pd.Series(who, placed, "Int64").reindex(range(len(px))), "d2": pd.Series(best, placed).reindex(range(len(px)))})

    found = points.withColumn("__f", find("x", "y"))
    known = F.col("__f.sid").isNotNull()  # a missing distance comes back from pandas as NaN or NULL
    return found.select(
        *[F.col(f"`{c}`") for c in points.columns], F.col("__f.sid").alias(station), F.when(known, F.sqrt("__f.d2")).alias("distance")
    )


def station_tree(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested cells over ``sites`` (x, y, sid): children of every full cell, and stations of every leaf.

    A cell with more than ``LEAF`` stations is full and has up to 64 children, each
    with the box around its stations; the others are leaves.  Crowded places are
    divided further than others.  The finest level is never full.
    """
    sites = cut_lineage(sites.select(F.col("x").cast("double"), F.col("y").cast("double"), "sid"))
    box = sites.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max(box[1] - box[0], box[3] - box[2]) or 1.0
    finest = FANOUT_BITS * LEVELS

    def cell(axis: str, low: float) -> str:
        # The finest cell, shifted to the level, so that cells nest.
        fine = f"least(bigint(floor(({axis} - {low!r}D) / {side!r}D * {float(1 << finest)!r}D)), {(1 << finest) - 1}L)"
        return f"shiftright({fine}, {finest} - {FANOUT_BITS} * level)"

    levels = sites.selectExpr("*", f"explode(sequence(0, {LEVELS})) AS level")
    levels = derive(levels, {"gx": cell("x", box[0]), "gy": cell("y", box[2])})
    nodes = levels.groupBy("level", "gx", "gy").agg(
        F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count(F.lit(1)).alias("n")
    )
    nodes = nodes.withColumn("full", (F.col("n") > LEAF) & (F.col("level") < LEVELS))
    children = F.collect_list(F.struct("level", "gx", "gy", "full", "x1", "x2", "y1", "y2")).alias("kids")
    parent = [(F.col("level") - 1).alias("level"), *[F.shiftright(c, FANOUT_BITS).alias(c) for c in ("gx", "gy")]]
    kids = nodes.groupBy(*parent).agg(children, F.sum("n").alias("n")).filter((F.col("level") < 0) | (F.col("n") > LEAF)).drop("n")
    kids = cut_lineage(kids)
    leaf = kids.selectExpr("inline(kids)").filter("NOT full").select("level", "gx", "gy")
    leaves = levels.join(leaf, ["level", "gx", "gy"]).groupBy("level", "gx", "gy").agg(F.collect_list(F.struct("x", "y", "sid")).alias("sites"))
    return kids, leaves


def _blocks(places: DataFrame) -> DataFrame:
    """Neighbouring places gathered: (block, px1, px2, py1, py2, xs, ys), at most ``BLOCK`` places and the box around them.

    Places are sorted into about as many strips along x as a strip has blocks, and run
    along y inside; what a task meets at once is halved in the middle of its longer side.
    """
    places = cut_lineage(places)
    strips = max(partitions_for(places.sparkSession), math.isqrt(places.count() // BLOCK))

    def gather(batches):
        for batch in batches:
            x, y = batch["x"].to_numpy(float), batch["y"].to_numpy(float)
            todo, out = [np.arange(len(x))], []
            while todo:
                rows = todo.pop()
                px, py = x[rows], y[rows]
                x1, x2, y1, y2 = px.min(), px.max(), py.min(), py.max()
                if len(rows) <= BLOCK:
                    out.append((x1, x2, y1, y2, px, py))
                    continue
                left = px < x1 / 2 + x2 / 2 if x2 - x1 >= y2 - y1 else py < y1 / 2 + y2 / 2
                if left.all() or not left.any():
                    left = np.arange(len(rows)) < len(rows) // 2
                todo += [rows[left], rows[~left]]
            yield pd.DataFrame(out, columns=["px1", "px2", "py1", "py2", "xs", "ys"])

    along = places.repartitionByRange(strips, "x", "y").sortWithinPartitions("y", "x")
    gathered = along.mapInPandas(gather, "px1 double, px2 double, py1 double, py2 double, xs array<double>, ys array<double>")
    return cut_lineage(gathered.withColumn("block", F.monotonically_increasing_id()))


_BEGINS = " + ".join(f"pow(greatest(c.{a}1 - p{a}2, p{a}1 - c.{a}2, 0D), 2)" for a in "xy")
_ENDS = " + ".join(f"pow(greatest(c.{a}2 - p{a}1, p{a}2 - c.{a}1), 2)" for a in "xy")


def _near_cells(df: DataFrame, columns: list[str], box: Sequence[str] = ()) -> DataFrame:
    """``df`` with only those ``cells`` that begin no farther from its box than the nearest one ends."""
    reach = df.selectExpr(*columns, *box, "cells", f"array_min(transform(cells, c -> {_ENDS})) AS reach")
    return fence(reach, [*columns, *box, "cells", "reach"]).selectExpr(*columns, f"filter(cells, c -> {_BEGINS} <= reach) AS cells")


def _nearest_by_tree(points: DataFrame, sites: DataFrame) -> DataFrame:
    """(x, y, sid, d2) of distinct places, by descent through nested cells of stations.

    Blocks of neighbouring places hold the cells that may have the nearest station of
    one of them.  In each round their full cells are replaced by their children, and a
    cell stays only if its box begins no farther away than the nearest box ends.  A
    block that holds many cells goes on as its single places, so each keeps a few cells
    however crowded the stations and however far the place.  Leaves are compared
    station by station.
    """
    kids, leaves = station_tree(sites)
    blocks = _blocks(points)
    keys, box = ["level", "gx", "gy"], ["px1", "px2", "py1", "py2"]
    # A single place has its number in the block, a whole block -1.
    who = ["block", "nth", *box]
    root = "array(named_struct('level', -1, 'gx', 0L, 'gy', 0L, 'full', true, 'x1', 0D, 'x2', 0D, 'y1', 0D, 'y2', 0D))"
    held = blocks.selectExpr("block", "-1 AS nth", *box, f"inline({root})")
    settled, depth = None, -1
    while held.take(1):
        # At most 64 cells are full above the second level: they are met where the blocks lie.
        below = kids.filter(F.col("level") == depth)
        found = held.filter("full").select(*who, *keys).join(F.broadcast(below) if depth < 2 else below, keys).selectExpr(*who, "kids AS cells")
        both = held.filter("NOT full").unionByName(_near_cells(found, who).selectExpr(*who, "inline(cells)"))
        cells = both.groupBy(*who).agg(F.collect_list(F.struct(*keys, "full", "x1", "x2", "y1", "y2")).alias("cells"))
        cells = cut_lineage(_near_cells(cells, who))
        crowded = (F.size("cells") > HELD) & (F.col("nth") < 0)
        single = cells.filter(crowded).select("block", "cells").join(blocks.select("block", "xs", "ys"), "block")
        single = single.selectExpr("block", "cells", "posexplode(arrays_zip(xs, ys)) AS (nth, p)")
        single = single.selectExpr("block", "nth", "p.xs AS px1", "p.xs AS px2", "p.ys AS py1", "p.ys AS py2", "cells")
        if cells.filter(crowded).take(1):
            cells = cut_lineage(cells.filter(~crowded).unionByName(_near_cells(single, who)))
        opened = F.exists("cells", lambda c: c["full"])
        done = cells.filter(~opened)
        settled = done if settled is None else settled.unionByName(done)
        held = cells.filter(opened).selectExpr(*who, "inline(cells)")
        depth += 1
    if settled is None:
        return points.selectExpr("x", "y", "bigint(NULL) AS sid", "double(NULL) AS d2")
    whole = settled.filter("nth < 0").select("block", "cells").join(blocks.select("block", "xs", "ys"), "block")
    places = whole.selectExpr("cells", "inline(arrays_zip(xs, ys)) AS (x, y)").unionByName(settled.filter("nth >= 0").selectExpr("cells", "px1 AS x", "py1 AS y"))
    places = places.selectExpr("x", "y", "cells", "x AS px1", "x AS px2", "y AS py1", "y AS py2")
    places = cut_lineage(_near_cells(places, ["x", "y"], box))
    met = places.selectExpr("x", "y", "inline(cells)").select("x", "y", *keys).join(leaves, keys)
    best = "array_min(transform(sites, s -> struct(pow(s.x - x, 2) + pow(s.y - y, 2) AS d2, s.sid AS sid)))"
    best = met.select("x", "y", F.expr(best).alias("b")).groupBy("x", "y").agg(F.min("b").alias("b"))
    return best.select("x", "y", "b.sid", "b.d2")


def far_points(nearest: DataFrame, threshold: float = MAX_STATION_DISTANCE) -> DataFrame:
    """How many points have no station within the threshold."""
    return nearest.agg(F.count_if(F.col("distance") >= threshold).alias("n_too_far"))


# ---- horizons ----------------------------------------------------------------------


def edge_points(surfaces: DataFrame, ring: str = "ring") -> DataFrame:
    """Start, middle and end of every edge of every ring, with height ``z``."""
    nxt = f"concat(slice({ring}, 2, size({ring}) - 1), slice({ring}, 1, 1))"
    edges = f"arrays_zip({ring}, {nxt})"
    points = (
        f"flatten(transform({edges}, e -> array(struct(e['{ring}'].x AS px, e['{ring}'].y AS py), "
        f"struct((e['{ring}'].x + e['1'].x) / 2 AS px, (e['{ring}'].y + e['1'].y) / 2 AS py), struct(e['1'].x AS px, e['1'].y AS py))))"
    )
    return surfaces.selectExpr("*", f"inline({points})")


def horizon(points: DataFrame, keys: list[str], n_divs: int, *, x0: str = "x0", y0: str = "y0", z: str = "z") -> DataFrame:
    """Largest elevation per direction bin; partially aggregated maxima."""
    dx, dy = F.col("px") - F.col(x0), F.col("py") - F.col(y0)
    return points.groupBy(*keys, g.azimuth_bin(g.azimuth(dx, dy), n_divs).alias("az_bin")).agg(
        F.max(g.elevation(dx, dy, F.col(z))).alias("elevation")
    )


def neighbor_horizon(rects: DataFrame, radius: float, n_divs: int, height: str, fill_height: float) -> DataFrame:
    """(loc, x0, y0, az_bin, elevation): the horizon that the neighbours within ``radius`` make around every centre.

    Neighbours are met in growing circles.  Where all directions are taken, only what
    may rise above the lowest of them still counts: a rectangle is no nearer than its
    centre less half its diagonal.  A centre is done once nothing outside its circle
    can, by the heights and sizes of the cells around it.  Copies of a rectangle, which
    intersect, have one horizon; it is found once.
    """
    named = rects.select(*_SHAPE, F.expr(f"coalesce({height}, {fill_height!r}D)").alias("z")).filter("loc IS NOT NULL").distinct()
    if not one_row_each(named):
        here = named.selectExpr(*_SHAPE, "cx AS x0", "cy AS y0")
        side = named.selectExpr("loc AS other", f"{rectangle_ring(long='long', short='short', angle='angle')} AS ring", "z")
        pairs = neighbor_pairs(here, radius, carry=("x0", "y0")).select("loc", "x0", "y0", "other")
        return horizon(edge_points(pairs.join(side, "other")), ["loc", "x0", "y0"], n_divs)
    shape = ["cx", "cy", "long", "short", "angle", "z"]
    rows = distinct_rectangles(named, "loc", "z")
    rows = cut_lineage(derive(rows, {"half": _HALF}))
    side = radius * (1 + 1e-9)
    cells = derive(rows, {"gx": _cell("cx", side), "gy": _cell("cy", side)})
    nine = ", ".join(f"struct({x} AS ox, {y} AS oy)" for x in (-1, 0, 1) for y in (-1, 0, 1))
    tops = cells.groupBy("gx", "gy").agg(F.max(F.expr("CASE WHEN NOT isnan(half) THEN half END")).alias("half"), F.max("z").alias("z"))
    tops = tops.selectExpr("half", "z", f"inline(array({nine}))", "gx", "gy").groupBy((F.col("gx") + F.col("ox")).alias("gx"), (F.col("gy") + F.col("oy")).alias("gy"))
    tops = tops.agg(F.max("half").alias("top_half"), F.max("z").alias("top_z"))
    targets = open_ = cut_lineage(cells.drop("z").join(tops, ["gx", "gy"]).drop("gx", "gy").withColumn("low", F.lit(0.0)))
    keys, held, inner = ["loc", "x0", "y0"], None, None
    for part in HORIZON_ROUNDS:
        reach = radius / part
        far = f"{_D2} <= {reach * reach!r}D" + (f" AND {_D2} > {inner * inner!r}D" if inner else "")
        rises = f"NOT (a_low > 0 AND a_low * (sqrt({_D2}) - b_half) >= b_z * (1 + 1e-9D))"
        met = _meetings(open_, rows, reach, _offsets(2), 2).filter(f"a_loc <> b_loc AND {far} AND {rises} AND NOT {_OVERLAP}")
        ring = rectangle_ring("b_cx", "b_cy", "b_long", "b_short", "b_angle")
        points = edge_points(met.selectExpr("a_loc AS loc", "a_cx AS x0", "a_cy AS y0", "b_z AS z", f"{ring} AS ring"))
        profile = horizon(points, keys, n_divs)
        if held is not None:
            profile = held.unionByName(profile).groupBy(*keys, "az_bin").agg(F.max("elevation").alias("elevation"))
        if part == HORIZON_ROUNDS[-1]:
            break
        held, inner = cut_lineage(profile), reach
        lowest = held.groupBy("loc").agg(F.count(F.lit(1)).alias("n"), F.min("elevation").alias("least"))
        low = f"CASE WHEN n = {n_divs} THEN greatest(tan(least), 0D) ELSE 0D END"
        now = targets.drop("low").join(lowest, "loc", "left").selectExpr(*[c for c in targets.columns if c != "low"], f"{low} AS low")
        open_ = cut_lineage(now.filter(f"NOT (low > 0 AND low * ({reach!r}D - top_half) >= top_z * (1 + 1e-9D))"))
    if not rows.filter("copies > 1").take(1):
        return profile
    profile = cut_lineage(profile)
    copies = join_null_safe(named.withColumnRenamed("loc", "__copy"), rows.filter("copies > 1").select("loc", *shape), shape).filter("__copy <> loc")
    copied = copies.select("__copy", "loc").join(profile, "loc").drop("loc").withColumnRenamed("__copy", "loc")
    return profile.unionByName(copied)


def shading_mask(profile: DataFrame, keys: list[str], n_divs: int = 48) -> DataFrame:
    """One column per direction, zero where nothing rises above the horizon."""
    return profile.groupBy(*keys).agg(
        *[
            F.greatest(F.coalesce(F.max(F.when(F.col("az_bin") == i, F.col("elevation"))), F.lit(0.0)), F.lit(0.0)).alias(f"shading_mask_{i:02d}")
            for i in range(n_divs)
        ]
    )


def shading_fence(profile: DataFrame, n_divs: int, distance: float = 100.0, *, x0: str = "x0", y0: str = "y0", n_bins: str | None = None) -> DataFrame:
    """Corners of one vertical rectangle per direction bin.

    ``n_bins`` names the number of fence panels per group; by default all
    ``n_divs`` directions are assumed to have one.
    """
    n = n_bins or f"{float(n_divs)!r}D"
    p = derive(profile, {"az": f"az_bin * {2 * math.pi / n_divs!r}D", "edge": f"2D * {distance!r}D * tan({math.pi!r}D / {n})"})
    p = derive(
        p,
        {
            "mx": f"{x0} + {distance!r}D * cos(az)", "my": f"{y0} + {distance!r}D * sin(az)",
            "top": f"{distance!r}D * tan(elevation)",
        },
    )
    left = "mx - sin(az) * edge / 2 AS x, my + cos(az) * edge / 2 AS y"
    right = "mx + sin(az) * edge / 2 AS x, my - cos(az) * edge / 2 AS y"
    return p.selectExpr(
        "*", f"struct({left}, 0D AS z) AS lower_left", f"struct({right}, 0D AS z) AS lower_right",
        f"struct({right}, top AS z) AS upper_right", f"struct({left}, top AS z) AS upper_left",
    )
