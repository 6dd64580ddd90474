"""Tests of the graph index: recall by shard size, precision, scale, the sharding rule."""

import numpy as np
import pytest

from brickwork.llm import ann


def recall(spark, x, element, **kwargs):
    """Share of the true nearest ten that ``ann.nearest`` finds; scores are checked on the way."""
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>")
    got = ann.nearest(table, **kwargs).toPandas()
    hit = total = 0
    for q in range(0, len(x), ann.EVERY):
        power = int(np.frexp(np.abs(x).max())[1])
        d = np.ldexp(np.sqrt((np.ldexp(x - x[q], -power) ** 2).sum(axis=1)), power)
        d[q] = np.inf
        mine = got[got["query_id"] == q].sort_values("rank")
        assert len(mine) == 10 and np.allclose(mine["score"], d[mine["vec_id"]], rtol=1e-12, atol=0)
        hit += len(set(np.argsort(d, kind="stable")[:10]) & set(mine["vec_id"]))
        total += 10
    return hit / total


def test_recall_over_several_full_shards_with_production_parameters(spark):
    x = np.random.default_rng(3).standard_normal((3 * ann.SHARD, 32)).astype(np.float32).astype(float)
    assert recall(spark, x, "float") > 0.9


def test_double_vectors_far_from_the_origin(spark):
    x = 1e8 + np.random.default_rng(4).standard_normal((1500, 16))
    assert recall(spark, x, "double", shard=400) > 0.9


@pytest.mark.parametrize("element, size", [("float", 1e25), ("float", 1e-25), ("double", 1e200), ("double", 1e-200)])
def test_very_large_and_very_small_components(spark, element, size):
    x = np.random.default_rng(5).standard_normal((1000, 8)) * size
    if element == "float":
        x = x.astype(np.float32).astype(float)
    assert recall(spark, x, element, shard=400) > 0.9


def test_one_giant_vector_among_small_ones(spark):
    x = np.random.default_rng(6).standard_normal((1000, 8)).astype(np.float32).astype(float)
    x[100], x[7] = 1e30, -3e30
    x = x.astype(np.float32).astype(float)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard=400).toPandas()
    assert got.groupby("query_id").size().tolist() == [10] * 10
    for q in (0, 200, 900):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert len(set(np.argsort(d)[:10]) & set(got[got["query_id"] == q]["vec_id"])) >= 9


def test_a_large_graph_is_searched_with_a_wider_beam():
    g = np.random.default_rng(7)
    x = g.standard_normal((8 * ann.SHARD, 24)).astype(np.float32)
    graph = ann.build_graph(x)
    some = g.integers(0, len(x), 100)
    found = ann._found(x, graph, x[some])
    assert found.shape[1] == round(ann.SEARCH_BEAM * 8**ann.BEAM_GROWTH)
    near = [set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[:11]) for q in some]
    assert np.mean([len(a & set(b[:11])) / 11 for a, b in zip(near, found)]) > 0.9


def test_shards_grow_with_the_table_up_to_a_bound_on_memory():
    assert ann.shard_size(1000, 64) == ann.SHARD
    assert ann.shard_size(160_000, 64) == 10_000
    assert ann.shard_size(10**9, 64) == ann.LARGEST
    assert ann.shard_size(10**9, 4096) * 4096 <= ann.COMPONENTS
    # Up to that bound the shards that a query visits stay as many.
    assert {-(-n // ann.shard_size(n, 64)) for n in (64_000, 256_000, 512_000)} == {16}
