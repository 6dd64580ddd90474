"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt to shards by a hash of their smallest id.  Each shard
gets a graph: a greedy beam search over the graph so far proposes neighbours for
the next batch of nodes, and pruning keeps an edge only if no kept neighbour is
closer to its end by the factor ``ALPHA``, so edges stay diverse.  Every query
searches every shard, and the shards' results are merged.

Shards grow with the table, up to a bound on memory, and the beam grows with the
shard, so recall holds.  A task searches one shard for at most as many queries as
a shard has vectors; so neither side is copied more often than the other.

Graphs are built and searched on vectors scaled by a power of two: in single
precision where the input is single and no vector is a billionth of another, else
in double.  Scores are always measured in double precision on the vectors given.

Copies of one vector are one node.  Of its ids only the smallest ``k + 1`` can be
in any result, because ties go to the smaller id; these are kept beside it.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, as query or candidate; repeated rows of an id count
once; a query has fewer than ``k`` results if there are fewer candidates; vectors
meet only those of the same length; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brickwork.llm.shared import stored

K = 10
EVERY = 100
#: Least vectors of a shard, in expectation; most of them, and of their components; shards of a table between.
SHARD, LARGEST, COMPONENTS = 2048, 32_768, 1 << 24
SHARDS = 16
#: Tasks for each shard, so that few shards share one.
TASKS = 4
#: Queries of one task, and components gathered by one step of their searches.
BLOCK, GATHERED = 32_768, 1 << 23
DEGREE = 24
#: A node may gather so many edges before it is pruned back to ``DEGREE``.
SLACK = 36
ALPHA = 1.2
BUILD_BEAM, SEARCH_BEAM = 48, 96
#: The beam of a search grows with this power of the shard's vectors beyond ``SHARD``.
BEAM_GROWTH = 0.4
#: Binary digits by which a vector may be longer or shorter than the largest of its shard in single precision.
RANGE = 30
#: Nodes expanded in one step of a search, nodes added in one batch, and nodes where a search starts.
EXPAND, BATCH, ENTRIES = 4, 256, 8


def _distances(vectors: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of the vectors numbered [q, c] from the points [q, d]; inf for -1."""
    d = vectors[at]
    d -= to[:, None, :]
    out = np.einsum("qcd,qcd->qc", d, d)
    out[at < 0] = np.inf
    return out


def beam_search(graph: np.ndarray, vectors: np.ndarray, to: np.ndarray, entries: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and squared distances [q, beam] of what greedy searches found, nearest first."""
    q = len(to)
    ids = np.full((q, beam), -1, np.int32)
    start = min(entries, beam, len(vectors))
    ids[:, :start] = np.arange(start)
    far = _distances(vectors, ids, to)
    done = np.zeros((q, beam), bool)
    active = np.arange(q)
    while len(active):
        cost = np.where(done[active], np.inf, far[active])
        pick = np.argpartition(cost, EXPAND, axis=1)[:, :EXPAND]
        chosen = np.take_along_axis(cost, pick, axis=1) < np.inf
        alive = chosen.any(axis=1)
        active, pick, chosen = active[alive], pick[alive], chosen[alive]
        if not len(active):
            break
        nodes = np.where(chosen, np.take_along_axis(ids[active], pick, axis=1), -1)
        mark = done[active]
        np.put_along_axis(mark, pick, np.take_along_axis(mark, pick, axis=1) | chosen, axis=1)
        near = graph[nodes]
        near[nodes < 0] = -1
        near = near.reshape(len(active), -1)
        both = np.concatenate([ids[active], near], axis=1)
        # Of equal numbers the first stays, which is the one already in the beam.
        order = np.argsort(both, axis=1, kind="stable")
        sorted_ = np.take_along_axis(both, order, axis=1)
        again = np.zeros_like(sorted_, bool)
        again[:, 1:] = sorted_[:, 1:] == sorted_[:, :-1]
        repeated = np.zeros_like(again)
        np.put_along_axis(repeated, order, again, axis=1)
        near = np.where(repeated[:, beam:], -1, near)
        cost = np.concatenate([far[active], _distances(vectors, near, to[active])], axis=1)
        both[:, beam:] = near
        keep = np.argpartition(cost, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(both, keep, axis=1)
        far[active] = np.take_along_axis(cost, keep, axis=1)
        done[active] = np.take_along_axis(np.concatenate([mark, np.zeros_like(near, bool)], axis=1), keep, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours [p, degree] out of ``candidates`` [p, c]; -1 fills."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    far = _distances(vectors, candidates, vectors[points])
    gathered = vectors[candidates]
    out = np.full((len(points), degree), -1, np.int32)
    row = np.arange(len(points))
    alive = np.isfinite(far)
    for k in range(degree):
        cost = np.where(alive, far, np.inf)
        best = np.argmin(cost, axis=1)
        there = alive[row, best]
        if not there.any():
            break
        out[there, k] = candidates[row, best][there]
        d = gathered - gathered[row, best][:, None, :]
        between = np.einsum("pcd,pcd->pc", d, d)
        alive &= alpha * alpha * between > far
        alive[row, best] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, slack: int = SLACK, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> np.ndarray:
    """Out-edges [n, slack] of every vector; -1 fills."""
    n = len(vectors)
    graph = np.full((n, slack), -1, np.int32)
    at = 0
    while at < n:
        upto = min(n, max(at + min(BATCH, max(at, 1)), ENTRIES))
        new = np.arange(at, upto)
        if at < ENTRIES:
            found = np.tile(np.arange(upto, dtype=np.int32), (len(new), 1))
        else:
            found, _ = beam_search(graph, vectors, vectors[new], ENTRIES, beam)
        edges = robust_prune(vectors, new, found, degree, alpha)
        graph[new, :degree] = edges
        source, place = np.nonzero(edges >= 0)
        _add_back_edges(graph, vectors, edges[source, place], new[source].astype(np.int32), degree, alpha)
        at = upto
    return graph


def _add_back_edges(graph: np.ndarray, vectors: np.ndarray, targets: np.ndarray, sources: np.ndarray, degree: int, alpha: float) -> None:
    """Append ``sources`` to the edges of ``targets``; nodes that overflow are pruned first."""
    slack = graph.shape[1]
    order = np.argsort(targets, kind="stable")
    targets, sources = targets[order], sources[order]
    while len(targets):
        first = np.append(True, targets[1:] != targets[:-1])
        rank = np.arange(len(targets)) - np.maximum.accumulate(np.where(first, np.arange(len(targets)), 0))
        now = rank < slack - degree
        nodes, counts = np.unique(targets[now], return_counts=True)
        used = (graph[nodes] >= 0).sum(axis=1)
        full = used + counts > slack
        for at in range(0, int(full.sum()), 4 * BATCH):
            some = nodes[full][at : at + 4 * BATCH]
            graph[some] = -1 if not len(some) else np.pad(robust_prune(vectors, some, graph[some], degree, alpha), ((0, 0), (0, slack - degree)), constant_values=-1)
        used = (graph[nodes] >= 0).sum(axis=1)
        graph[targets[now], used[np.searchsorted(nodes, targets[now])] + rank[now]] = sources[now]
        targets, sources = targets[~now], sources[~now]


def shard_size(n: int, dim: int, least: int = SHARD) -> int:
    """Vectors of a shard, in expectation, of a table of ``n`` vectors of ``dim`` components."""
    most = max(1, min(LARGEST, COMPONENTS // max(dim, 1)))
    return max(1, min(most, max(least, n // SHARDS)))


def exponents(vectors: np.ndarray) -> np.ndarray:
    """The power of two above the largest component of each vector."""
    return np.frexp(np.abs(vectors).max(axis=-1))[1].astype(np.int64)


def _scaled(vectors: np.ndarray, power: int) -> np.ndarray:
    return np.ldexp(vectors.astype(np.float64), -power)


def _searchable(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """The vectors as graphs are built on them, and the power of two that they were divided by."""
    own = exponents(vectors)
    power = int(own.max())
    narrow = vectors.dtype == np.float32 and power - int(own.min()) <= RANGE
    return _scaled(vectors, power).astype(np.float32 if narrow else np.float64), power


def distances(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, of the vectors [q, c, d] from the points [q, d]."""
    d = vectors.astype(np.float64) - to.astype(np.float64)[:, None, :]
    power = exponents(d)
    d = np.ldexp(d, -power[..., None])
    return np.ldexp(np.sqrt(np.einsum("qcd,qcd->qc", d, d)), power)


def _found(own: np.ndarray, graph: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Numbers [q, beam] of the vectors found for each query, nearest first; -1 fills."""
    usual, power = _searchable(own)
    beam = round(SEARCH_BEAM * max(1.0, len(own) / SHARD) ** BEAM_GROWTH)
    step = max(1, GATHERED // (EXPAND * SLACK * own.shape[1]))
    out = np.full((len(to), beam), -1, np.int32)
    # A query that dwarfs the shard would overflow; it is searched at its own scale.
    scale = np.where(exponents(to) - power <= RANGE, power, exponents(to))
    for p in np.unique(scale):
        vectors = usual if p == power else _scaled(own, int(p))
        rows = np.flatnonzero(scale == p)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            points = _scaled(to[some], int(p)).astype(vectors.dtype)
            out[some] = beam_search(graph, vectors, points, ENTRIES, beam)[0]
    return out


def _graph_rows(dtype: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("vec_id").sort_values("vec_id")
        # Ids may follow the clusters; nodes must not.
        rows = rows.iloc[np.random.default_rng(11).permutation(len(rows))]
        own = np.stack(rows["vector"].to_numpy()).astype(dtype)
        graph = build_graph(_searchable(own)[0])
        return pd.DataFrame(
            [(rows["dim"].iloc[0], rows["shard"].iloc[0], rows["vec_id"].to_numpy(np.int64).tobytes(), own.tobytes(), graph.tobytes())],
            columns=["dim", "shard", "ids", "vectors", "graph"],
        )

    return run


def _search(dtype: str, k: int):
    def run(graphs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(asked):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "rep": np.empty(0, np.int64), "score": np.empty(0)})
        row = graphs.iloc[0]
        ids = np.frombuffer(row["ids"], np.int64)
        own = np.frombuffer(row["vectors"], dtype).reshape(len(ids), -1)
        graph = np.frombuffer(row["graph"], np.int32).reshape(len(ids), -1)
        to = np.stack(asked["vector"].to_numpy()).astype(dtype)
        found = _found(own, graph, to)[:, : 2 * k + 2]
        step = max(1, GATHERED // (found.shape[1] * own.shape[1]))
        exact = np.concatenate([distances(own[found[at : at + step]], to[at : at + step]) for at in range(0, len(to), step)])
        there = found >= 0
        q = np.repeat(asked["vec_id"].to_numpy(np.int64), there.sum(axis=1))
        return pd.DataFrame({"query_id": q, "rep": ids[found[there]], "score": exact[there]})

    return run


def _per_dim(values: dict[int, int]) -> Column:
    """``values`` of the column ``dim``."""
    return F.element_at(F.create_map(*[x for d, v in values.items() for x in (F.lit(d), F.lit(v))]), F.col("dim"))


def nearest(table: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    element = table.schema["embedding"].dataType.elementType
    dtype = "float64" if isinstance(element, (T.DoubleType, T.DecimalType, T.LongType, T.IntegerType)) else "float32"
    vector = F.col("embedding").cast("array<double>" if dtype == "float64" else "array<float>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.filter(F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    copies = rows.withColumn("place", F.dense_rank().over(by_id)).filter(F.col("place") <= k + 1)
    copies = stored(copies.withColumn("rep", F.min("vec_id").over(Window.partitionBy("vector"))).distinct(), "copies")
    reps = copies.filter("place = 1").select("dim", "vec_id", "vector")
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = {d: -(-n // shard_size(n, d, shard)) for d, n in sizes.items()}
    graphs = reps.withColumn("shard", F.pmod(F.xxhash64("vec_id"), _per_dim(shards)).cast("int"))
    # A number of tasks of its own: shards are few and dear, and are not to be put together for their bytes.
    graphs = graphs.repartition(TASKS * sum(shards.values()), "dim", "shard")
    graphs = graphs.groupBy("dim", "shard").applyInPandas(_graph_rows(dtype), "dim int, shard int, ids binary, vectors binary, graph binary")
    graphs = stored(graphs, "graphs")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("dim", "vec_id", "vector").distinct()
    parts = {r["dim"]: -(-r["count"] // block) for r in asked.groupBy("dim").count().collect()}
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), _per_dim(parts)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), _per_dim(shards) - 1)))
    # Vectors of a length that no query has meet none.
    graphs = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), _per_dim(parts) - 1)))
    keys, tasks = ["dim", "shard", "part"], TASKS * sum(shards[d] * n for d, n in parts.items())
    graphs, asked = (df.repartition(tasks, *keys) for df in (graphs, asked))
    found = graphs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search(dtype, k), "query_id long, rep long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "rep")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= 2 * k + 2).drop("place")
    members = copies.select("rep", "vec_id")
    pairs = found.join(members, "rep").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
