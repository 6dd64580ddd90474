"""The class model against direct versions: scores, classes of words, and held-out texts."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from brickwork.llm import classlm
from brickwork.llm.shared import remainder


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("core, frequent", [(40, 3000), (1024, 200), (5, 0)])
def test_scores_follow_from_the_classes(corpus, monkeypatch, core, frequent):
    monkeypatch.setattr(classlm, "CORE", core)
    monkeypatch.setattr(classlm.frequent_level, "__defaults__", (frequent,))
    held = remainder("doc_id", 5) == 1
    training = [tokens(r.text) for r in corpus.filter(~held).collect()]
    model, rare = classlm.train(corpus.filter(~held))
    count = Counter(w for t in training for w in t)
    names = {w: int(classlm.word_ids([w])[0]) for r in corpus.collect() for w in tokens(r.text)}
    width = classlm.CLASSES + classlm.BANDS + 1
    known = dict(zip(model.frequent.keys.tolist(), model.classes.tolist()))
    known |= {r["word"] % (1 << 64): r["class"] for r in rare.collect()}

    def of(w):
        if w == b"\n":
            return width - 1
        return known.get(names[w], classlm.CLASSES + min(len(w) // classlm.BAND_WIDTH, classlm.BANDS - 1))

    if frequent:
        assert sum(c < classlm.CLASSES for c in known.values()) >= len(known) - 1
    size, kinds, moves = Counter(), Counter(), Counter()
    for w, n in count.items():
        if w != b"\n":
            size[of(w)] += n
            kinds[of(w)] += 1
    for t in training:
        for a, b in zip([b"\n", *t], t):
            moves[of(a), of(b)] += 1
    row = Counter()
    for (a, _), n in moves.items():
        row[a] += n

    def direct(t):
        total = 0.0
        for a, b in zip([b"\n", *t], t):
            total += math.log10((moves[of(a), of(b)] + 0.5) / (row[of(a)] + 0.5 * width))
            if b != b"\n":
                total += math.log10((count[b] + 0.5) / (size[of(b)] + 0.5 * (kinds[of(b)] + 1)))
        return total

    got = {r.doc_id: r.score for r in classlm.scored(corpus).collect()}
    for r in corpus.collect():
        assert got[r.doc_id] == pytest.approx(direct(tokens(r.text)), rel=1e-9), r.doc_id


def test_every_training_word_has_a_class(spark, monkeypatch):
    """Words below the level of frequent ones are judged by their neighbours like the others."""
    texts = [f"{'cold' if i % 2 else 'warm'} {'wind' if i % 2 else 'sun'}{i} {'north' if i % 2 else 'south'}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    ids = {w: int(classlm.word_ids([w])[0]) for t in texts for w in t.encode().split()}
    classes, scores = [], []
    for most in (1000, 8, 0):
        monkeypatch.setattr(classlm, "CORE", 4 if most else 0)
        monkeypatch.setattr(classlm.frequent_level, "__defaults__", (most,))
        model, rare = classlm.train(docs)
        known = dict(zip(model.frequent.keys.tolist(), model.classes.tolist()))
        found = {r["word"] % (1 << 64): (r["class"], r["n"]) for r in rare.collect()}
        assert known.keys() | found.keys() == set(ids.values()) and not known.keys() & found.keys()
        assert all(n == 1 for w, (_, n) in found.items() if w in {ids[f"wind{i}".encode()] for i in range(1, 60, 2)})
        classes.append({**known, **{w: c for w, (c, _) in found.items()}})
        assert max(classes[-1].values()) < classlm.CLASSES
        scores.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in classlm.scored(docs).collect()})
    # The level says only where a class is kept, so it changes no class and no score.
    assert classes[0] == classes[1]
    assert scores[0].keys() == scores[1].keys() == scores[2].keys() and len(scores[0]) == 62
    for i, row in scores[0].items():
        assert scores[1][i] == pytest.approx(row, rel=1e-12) and scores[2][i][:3] == pytest.approx(row[:3], rel=1e-12)


def test_words_go_where_they_inform_most():
    g = np.random.default_rng(1)
    width = classlm.CLASSES + classlm.BANDS + 1
    table = g.integers(0, 50, (width, width)).astype(float)
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    rows = []
    for word in range(12):
        for cell in sorted(g.choice(2 * width, 9, replace=False)):
            # A word's own neighbours lie outside the class that it is tried in, so no cell grows from both sides.
            if cell // 2 >= classlm.CLASSES:
                rows.append((word, cell, int(g.integers(1, 30))))
    word, cell, n = (np.array(c, np.int64) for c in zip(*rows))
    names, got = classlm.best_classes(word, cell, n, table)
    for w, chosen in zip(names, got):
        scores = []
        for c in range(classlm.CLASSES):
            t = table.copy()
            for at, k in zip(cell[word == w], n[word == w]):
                if at % 2 == 0:
                    t[c, at // 2] += k
                else:
                    t[at // 2, c] += k
            rows_, cols = t.sum(axis=1), t.sum(axis=0)
            change_r = f(rows_[: classlm.CLASSES]) - f(table.sum(axis=1)[: classlm.CLASSES])
            change_c = f(cols[: classlm.CLASSES]) - f(table.sum(axis=0)[: classlm.CLASSES])
            scores.append(f(t).sum() - change_r.sum() - change_c.sum())
        assert scores[chosen] == pytest.approx(max(scores), rel=1e-12)


def test_held_out_texts_are_less_surprising_than_to_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = classlm.scored(docs).filter("held_out AND n_tokens > 20").toPandas()
    assert (got["score"] > got["base_score"]).mean() > 0.9
    assert got["score"].sum() / got["n_tokens"].sum() > got["base_score"].sum() / got["n_tokens"].sum() + 0.05


def test_names_of_words():
    assert classlm.word_ids([b"abc"])[0] & np.uint64(7) == 1 and classlm.word_ids([b"x" * 99])[0] & np.uint64(7) == 7
    assert int(classlm.word_ids([b"\n"])[0]) >> 3 == xxhash.xxh64_intdigest(b"\n") >> 3
