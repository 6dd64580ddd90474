"""Whole licences: inserted words, lost phrases, order, neighbours in one file."""

import random

from brickwork.llm import licenses

TEXT = {label: text for label, text, _ in licenses.LICENCES}


def labels(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stands string")
    return {r["doc_id"]: r for r in licenses.scan(df).collect()}


def with_inserted(text, every, rng):
    """``text`` with a stray word after about one word in ``every``, but not inside mandatory phrases."""
    words, keys = text.split(), [p.split() for _, t, ps in licenses.LICENCES if t == text for p in ps]
    inside = {i + k for p in keys for i in range(len(words)) if words[i : i + len(p)] == p for k in range(len(p) - 1)}
    return " ".join(w + (f" holder{i}" if i not in inside and rng.random() < 1 / every else "") for i, w in enumerate(words))


def test_phrases_stand_in_their_licences():
    assert len(licenses.LICENCES) >= 10 and all(len(t.split()) > 70 for t in TEXT.values())
    for _, text, phrases in licenses.LICENCES:
        at = [licenses.place(text.split(), p.split()) for p in phrases]
        assert at == sorted(at) and len(phrases) >= 3


def test_whole_texts_and_texts_with_inserted_words(spark):
    rng = random.Random(3)
    names = sorted(TEXT)
    got = labels(spark, [f"Copyright 2020 Someone\n\n{TEXT[n].upper()}.\n\nint main" for n in names] + [with_inserted(TEXT[n], 12, rng) for n in names])
    for k, n in enumerate(names * 2):
        assert n in got[k]["labels"].split(","), (n, got[k]["labels"])
        assert got[k]["score"] > 0.95
    assert all(got[k]["n_base"] == 0 for k, n in enumerate(names) if n != "apache-2")


def test_two_and_three_clauses_are_told_apart(spark):
    got = labels(spark, [TEXT["bsd-2"], TEXT["bsd-3"], TEXT["isc"], TEXT["0bsd"]])
    assert "bsd-3" not in got[0]["labels"] and "bsd-3" in got[1]["labels"]
    assert "0bsd" not in got[2]["labels"] and got[3]["labels"] == "0bsd,isc"


def test_scattered_or_missing_phrases_are_no_licence(spark):
    phrases = next(p for label, _, p in licenses.LICENCES if label == "zlib")
    apart = (" filler" * 400).join(phrases)
    got = labels(spark, [apart, " and ".join(phrases[:2]), " and ".join(reversed(phrases)) + " tail", "", None])
    assert [got[k]["labels"] for k in (0, 1, 3, 4)] == [""] * 4


def test_several_licences_in_one_long_file(spark):
    names = ["zlib", "bsl-1", "unlicense", "gpl"]
    text = (" other words" * 5000 + " ").join(["", *[TEXT[n] for n in names], TEXT["zlib"], ""])
    got = labels(spark, [text])[0]
    assert set(names) <= set(got["labels"].split(","))
    places = sorted(f["at"] for f in got["found"] if f["label"] == "zlib")
    words, head = text.split(), TEXT["zlib"].split()[:9]
    true = [i for i in range(len(words)) if words[i : i + 9] == head]
    assert places[0] - true[0] < 100 and max(places) - true[-1] < 100
