"""SimHash near-duplicates: BK-trees in shards that share most of a fingerprint.

Fingerprints with at most three differing bits agree on at least two of five
bit blocks, so every link lies inside a shard named by two blocks and their
values.  Each shard gets a BK-tree (children keyed by the Hamming distance to
their parent); a search follows only the edges within the radius.  Equal
fingerprints are one tree entry, and a shard with more entries than one tree
may hold is split: a tree for each pair of sub-shards, so no link is lost.
Trees are built where their shard lies instead of being sent to all tasks,
because fingerprints grow with the data.

Searches give a spanning forest of each shard instead of all its pairs; the
forests are joined to components by alternating large-star and small-star steps.

Defined results: null and empty texts have fingerprint zero and link like any
other; a null id takes part and is named only if nothing else is in its class;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm.shared import grouped, stored

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Bits of the five blocks; every pair of them names a shard.
BLOCKS = (13, 13, 13, 13, 12)
#: Entries of one tree; larger shards are split.
TREE = 4096
#: Rows that a task builds trees for at once.
FOREST_ROWS = 100_000
#: Search steps held at once.
FRONTIER = 1 << 20


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the lower-cased (A-Z) words of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    windows = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, windows, repeat(seed)), np.uint64, len(words) - shingle + 1))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the ``carry`` columns; fp is the fingerprint as a signed long."""
    fields = [docs.schema["doc_id"], T.StructField("fp", T.LongType()), *[docs.schema[c] for c in carry]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            arrays = [batch.column("doc_id"), pa.array(fps.view(np.int64)), *[batch.column(c) for c in carry]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.select(*dict.fromkeys(["doc_id", "text", *carry])).mapInArrow(run, T.StructType(fields))


class Forest:
    """BK-trees of many shards at once, built and searched level by level.

    ``shard`` and ``fp`` are aligned arrays sorted by shard; the first entry of a
    shard is its root.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp, n = fp, len(fp)
        self.edge = np.full(n, -1, np.int16)
        self.parent = np.full(n, -1, np.int64)
        _, root = np.unique(shard, return_index=True)
        self.root = root[np.searchsorted(shard[root], shard)]
        at = self.root.copy()
        open_ = np.flatnonzero(at != np.arange(n))
        while len(open_):
            distance = np.bitwise_count(fp[open_] ^ fp[at[open_]]).astype(np.int64)
            slot, first, place = np.unique(at[open_] * 65 + distance, return_index=True, return_inverse=True)
            child = open_[first]
            self.parent[child], self.edge[child] = slot // 65, slot % 65
            at[open_] = child[place]
            open_ = open_[at[open_] != open_]
        self.order = np.lexsort((self.edge, self.parent))
        self.order = self.order[np.searchsorted(self.parent[self.order], 0) :]
        self.slots = self.parent[self.order] * 65 + self.edge[self.order]

    def search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, found) entry numbers within ``radius``, for entries as queries of their own tree."""
        todo = [(query, self.root[query])]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            distance = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            hit = distance <= radius
            yield query[hit], node[hit]
            low = np.searchsorted(self.slots, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.slots, node * 65 + np.minimum(distance + radius, 64), "right")
            count = high - low
            if count.sum():
                start = np.repeat(low - np.cumsum(count) + count, count)
                todo.append((np.repeat(query, count), self.order[start + np.arange(count.sum())]))


def spanning_links(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each entry with its smallest connected entry of the same shard, where another."""
    forest = Forest(shard, fp)
    label = np.arange(len(fp))
    sides = [np.stack(hit) for hit in forest.search(np.arange(len(fp)), radius)]
    pairs = np.concatenate(sides, axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    while True:
        before = label.copy()
        np.minimum.at(label, pairs[0], label[pairs[1]])
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(fp)))
    return fp[other], fp[label[other]]


def _links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(batches, ["pair", "value", "side"], FOREST_ROWS):
            shard = frame.groupby(["pair", "value", "side"], sort=False).ngroup().to_numpy()
            a, b = spanning_links(shard, frame["fp"].to_numpy().view(np.uint64), radius)
            a, b = a.view(np.int64), b.view(np.int64)
            yield pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    return run


def shards(classes: DataFrame, blocks: tuple[int, ...] = BLOCKS, keep: int = 2) -> DataFrame:
    """(pair, value, fp) for every choice of ``keep`` blocks."""
    offsets = [sum(blocks[:i]) for i in range(len(blocks))]
    entries = []
    for number, chosen in enumerate(combinations(range(len(blocks)), keep)):
        value = F.lit(0).cast("long")
        for b in chosen:
            part = F.shiftrightunsigned("fp", offsets[b]).bitwiseAND(F.lit((1 << blocks[b]) - 1))
            value = F.shiftleft(value, blocks[b]).bitwiseOR(part)
        entries.append(F.struct(F.lit(number).alias("pair"), value.alias("value")))
    return classes.select("fp", F.explode(F.array(*entries)).alias("s")).select("s.pair", "s.value", "fp")


def near_links(classes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Distinct (u > v) links that span the components inside every shard."""
    rows = shards(classes)
    sizes = rows.groupBy("pair", "value").agg(F.count("*").alias("entries")).filter("entries > 1")
    parts = F.ceil(F.col("entries") / tree).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("part")), parts).cast("int")
    rows = rows.join(sizes, ["pair", "value"]).withColumn("parts", parts).withColumn("own", own)
    # A split shard has one tree for every pair of its parts, so each two entries meet in one.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).select(
        "pair", "value", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("side"), "fp"
    )
    rows = rows.repartition("pair", "value", "side").sortWithinPartitions("pair", "value", "side", "fp")
    return rows.mapInPandas(_links(radius), "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v): every linked node but the smallest of its component, with that smallest.

    ``links`` are distinct, u > v.  Alternates the two star steps until every node has
    only larger neighbours or a single smaller one; each round is written to the
    shared folder.  Only minima are gathered by node, so a node with very many links
    costs no more than its rows.
    """
    links = stored(links, "links")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low < u AND low < high").isEmpty():
            return links
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(lowest.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, class_size) of every document, and the ``carry`` columns.

    ``component_id`` is the smallest id reachable over links of at most ``radius``
    differing bits; ``class_size`` counts the documents with the same fingerprint.
    What is carried is written beside the fingerprints, so it should be narrow.
    """
    prints = stored(fingerprints(docs, shingle, carry), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size")), "classes")
    roots = components(near_links(classes, radius))
    labelled = classes.join(roots, classes.fp == roots.u, "left").select("fp", "least", "class_size", F.coalesce("v", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(named, "root").select("fp", "component_id", "class_size")
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id", "class_size", *[c for c in carry if c != "doc_id"])


def nested(docs: DataFrame) -> DataFrame:
    """doc_id, text, the whole row as ``row``, and ``content``, a name of rows that are equal in every column.

    Names of the caller's columns cannot clash with any that are added to the result.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    cells = [x for c in docs.columns for x in (F.col("row")[c].isNull(), F.col("row")[c].cast("string"))]
    content = F.concat_ws(":", F.xxhash64(*cells), F.xxhash64(F.lit(SEED), *cells))
    return rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), content.alias("content"))


def one_of_each(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The own columns of one of ``rows`` (see ``nested``) for each ``key`` of ``found`` (doc_id, content, component_id)."""
    first = F.min(F.struct(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(True)), "doc_id", "content"))
    keep = found.groupBy(key).agg(first.alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.content").alias("content")).distinct()
    kept = rows.join(keep, rows.doc_id.eqNullSafe(keep.id) & (rows.content == keep.content), "left_semi")
    # Rows equal in every column are one document.
    return kept.dropDuplicates(["doc_id", "content"]).select("row.*")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` for one document of each component.

    The smallest id stays; of rows that share this id, one.  The choice is made on
    narrow rows (a name of the row beside its id), so whole texts are shuffled at
    most once.
    """
    rows = nested(docs)
    found = near_duplicates(rows.select("doc_id", "text", "content"), carry=("content",))
    return one_of_each(rows, found, "component_id")
