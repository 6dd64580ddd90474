"""Spelling variants against brute force over all pairs, and trie numbers against a trie."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwork.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, id long, part int, key string, form string"
RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows, least_chars=6, least_count=5, damaged=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUNS.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, factor=5, **settings):
    words = brute_words(rows, **settings)
    form, out = {}, []
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and is_near(w, v)] for w in words}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= factor * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "k", "f") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def dense():
    """Words over few letters, so that nearly every kind of neighbour occurs, with runs of equal letters."""
    g = np.random.default_rng(7)
    words = {"".join(g.choice(list("abé"), g.integers(3, 8))) for _ in range(400)}
    rows = []
    for k, w in enumerate(sorted(words)):
        rows += [(k, f"{w}, " * int(g.choice([5, 6, 30, 200, 1100])))]
    return rows


@pytest.mark.parametrize("range_words", [10, 100_000])
def test_equals_brute_force(spark, dense, range_words):
    settings = {"least_chars": 4, "damaged": 7}
    got = spelling.grouped(table(spark, dense).repartition(4), range_words=range_words, **settings)
    want = brute(dense, **settings)
    assert result(got) == want
    assert any(r[2] != r[1] and r[1] for r in want) and max(r[4] for r in want) > 5


def test_benchmark_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(spelling.grouped(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    long = "q" * 60_000
    rows = [
        (1, None),
        (2, ""),
        (3, " ... 123 "),
        *[(4, "SPELLING spelling Spelling")] * 40,
        *[(None, "speling no id speling")] * 3,
        *[(k, f"{long} {long}r ÉCOLE-Écoles écoles") for k in range(5, 12)],
        *[(20, "colour中colours x_colors")] * 6,
    ]
    got = result(spelling.grouped(table(spark, rows)))
    assert got == brute(rows)
    assert ("speling", "spelling", "spelling", 6, 1, 120) in got
    assert [r[4] for r in got if r[0].startswith("qq")] == [1, 1]
    assert spelling.grouped(table(spark, []).where("false")).count() == 0
    assert spelling.grouped(table(spark, rows[:3])).count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 8, 40])
def test_numbers_are_nodes_of_a_trie(spark, ranges):
    g = np.random.default_rng(ranges)
    words = sorted({"".join(g.choice(list("ab"), g.integers(1, 9))) for _ in range(150)})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.heads for r in spelling.trie_nodes(frame, F.col("word"), "heads", ranges).collect()}
    by_prefix, by_node = {}, {}
    for w in words:
        assert len(got[w]) == len(w) + 1 and got[w][0] == 0
        for i, node in enumerate(got[w]):
            assert by_prefix.setdefault(w[:i], node) == node and by_node.setdefault(node, w[:i]) == w[:i]
    last = [got[w][-1] for w in words]
    assert last == sorted(last) and len(set(last)) == len(last)


def test_chains_end_at_their_root(spark):
    sizes = [5, 25, 125, 625, 3125, 15625]
    names = ["zzzzzz" + "y" * k for k in range(len(sizes))]
    rows = [(k, f"{w} " * n) for k, (w, n) in enumerate(zip(names, sizes))]
    got = spelling.grouped(table(spark, rows), damaged=1 << 40)
    assert {r.root for r in got.collect()} == {names[-1]}
    assert result(got) == brute(rows, damaged=1 << 40)


def test_no_pair_of_words_is_joined(spark, dense):
    paths = spelling.word_paths(spelling.word_counts(table(spark, dense), 4, 5, 7), 2)
    plan = spelling.near_words(spelling.node_pairs(paths.select("id", "n", "heads", "tails", "letters")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and plan.split("Aggregate [id")[1].split("Aggregate [p")[0].count("Join") == 0
