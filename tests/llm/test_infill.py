"""Fill-in-the-middle against a direct version, on the benchmark tables and on awkward rows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brickwork.llm import infill

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, form string, output string, cut long, h1 string"
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "a"),
    *[(k, "one two  three\nfour five\x0b six \U0001f600 café no break ") for k in range(5, 40)],
    *[(k, "x <P> marked y") for k in range(40, 50)],
    (50, "same"),
    (50, "same"),
    (None, "no id"),
    *[(k, "word été\r\n" * 200_000) for k in (60, 61, 62, 63)],
    *[(k, "y" * 1_000_000) for k in (70, 71, 72, 73)],
    *[(k, "almost <P a<S <M>"[:-1]) for k in range(80, 100)],
]


def direct(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 7, "x", "y", 9, "z") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["benchmark", "odd"])
def test_equals_direct_version(spark, sf, odd, name):
    docs = odd if name == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    got = infill.infilled(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted(((r.doc_id, *direct(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {r[2] for r in want} == {"plain", "spm", "psm"}


def test_restores_every_text(odd):
    got = infill.digests(odd).collect()
    want = sorted((r.doc_id is None, r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.fillna({"text": ""}).collect() if r.doc_id is not None)
    assert sorted((False, r.doc_id, r.restored_sha256) for r in got if r.doc_id is not None) == want
    outputs = {r.doc_id: r.output for r in infill.infilled(odd).collect()}
    assert all(hashlib.sha256(outputs[r.doc_id].encode()).hexdigest() == r.output_sha256 for r in got)


def test_nothing_and_rates(spark, odd):
    assert infill.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    one = odd.where("doc_id = 5")
    assert infill.infilled(odd, transformed=0).where("form <> 'plain'").count() == 0
    every = infill.infilled(odd, transformed=100, suffix_first=0).where("form = 'plain'")
    assert {r.doc_id for r in every.collect()} == {1, 2, *range(40, 50)}
    assert infill.infilled(one, seed=1).first() != infill.infilled(one, seed=42).first()


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet=" \t\n\x0b\x0c\rab \U0001f600"), st.integers(2, 5))
def test_units_and_lanes(text, fan):
    ends = infill.unit_ends(text)
    units = UNITS.findall(text)
    assert ends.tolist() == np.cumsum([len(u) for u in units]).tolist()
    lanes = infill.SkipList(ends, fan)
    assert [lanes.reach(k) for k in range(len(units) + 1)] == [0, *ends.tolist()]
    assert all(lane.sum(axis=1).tolist() == [len(units), len(text)] for lane in lanes.lanes)


def test_lanes_are_short():
    lanes = infill.SkipList(np.arange(1, 1_000_001))
    assert [lane.shape[1] for lane in lanes.lanes] == [1_000_000, 62_500, 3_907, 245, 16]
    assert lanes.reach(777_777) == 777_777


def test_only_the_text_goes_to_python(odd):
    plan = infill.digests(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan.replace("RepartitionByExpression", "")
