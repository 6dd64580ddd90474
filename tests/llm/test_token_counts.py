"""Token counts against the tokenizer itself."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brickwork.llm import catalog, tokencounts

SCHEMA = "doc_id long, text string, row long, pre string, counts string, n_bytes string, tokens long, times long"
VOCABULARY = public_tokenizers.path(catalog.COUNTED)
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b\x0c\r "),
    (4, "Hello, World's end isn't  NIGH!!! 12345"),
    (4, "Hello, World's end isn't  NIGH!!! 12345"),
    (None, "no id"),
    (None, "no id either, two rows"),
    (5, "<|endoftext|>x<|startoftext|><|ENDOFTEXT|> <|endoftext| <|"),
    (6, "a <|endoftext|> b\n<|startoftext|>c"),
    (7, "café café ÉCOLE naïve ΣΟΦΟΣ İstanbul Ångström 日本語 \U0001f600\U0001f468‍\U0001f469"),
    (8, "x y z　w\x85v\x1cu ́mark ̸ ≮|endoftext|>"),
    (9, "\x00 a\x00b \x00\x00<|endoftext|>"),
    (10, "alpha beta gamma's. " * 60_000),
    (11, "z" * 300_000),
    (12, "'s't 're''ll 'D 'LL don'T"),
    (13, "1½Ⅷ٣² ßẞﬁ"),
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "a", "b", "c", 2, 3) for i, t in TEXTS], SCHEMA).repartition(3)


def expected(whole, rows, limit=tokencounts.LIMIT):
    out = []
    for r in rows:
        n = len(whole.encode(r.text or "", add_special_tokens=False).ids)
        out.append((r.doc_id, len((r.text or "").encode()), n, n > limit))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["benchmark", "odd"])
@pytest.mark.parametrize("common", [0, 50, tokencounts.COMMON])
def test_equals_the_tokenizer(spark, sf, odd, whole, name, common):
    docs = odd if name == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    got = tokencounts.counted(docs, VOCABULARY, common=common)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(whole, docs.collect())


def test_other_vocabulary(spark, sf):
    """White space does not separate the pre-tokens of this one, so texts are split whole."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    own = tokencounts.PreTokens(path)
    assert own.words.pattern == "(?s).+"
    assert sorted(map(tuple, tokencounts.counted(docs, path).collect()), key=repr) == expected(Tokenizer.from_file(path), docs.collect())


def test_nothing(spark):
    assert tokencounts.counted(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0


def test_a_pretoken_is_split_once(spark):
    docs = spark.createDataFrame([(k, "same words again") for k in range(500)], "doc_id long, text string")
    table = tokencounts.frequencies(docs, VOCABULARY)
    each = table.select(F.inline("counts")).groupBy("pre").agg(F.count("*").alias("times"))
    got = tokencounts.piece_counts(each, VOCABULARY).collect()
    assert sorted((r.pre, r.times, r.pieces) for r in got) == [("again", 500, 1), ("same", 500, 1), ("words", 500, 1)]


def test_common_pretokens_are_bounded(spark):
    rows = [(f"w{k}", 1 + k * k, 1) for k in range(300)] + [("long" * 50, 10**9, 3)]
    table = spark.createDataFrame(rows, "pre string, times long, pieces long")
    for most in (0, 1, 17, 300, 301):
        often, rare = tokencounts.common_and_rare(table, most)
        assert often.count() <= most and often.count() + rare.count() == 301
        assert rare.where("length(pre) > 64").count() == 1
    assert tokencounts.common_and_rare(table, 300)[0].count() == 300


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokencounts, "REMEMBERED", 10)
    own = tokencounts.PreTokens(VOCABULARY)
    for k in range(100):
        own.counts(f"word{k} and more")
    assert len(own.known) <= 10


def test_usual_characters_are_split_as_by_the_vocabulary():
    """Every printable character below U+0300 alone, in pairs and inside words."""
    own = tokencounts.PreTokens(VOCABULARY)
    usual = [chr(c) for c in range(0x21, 0x300) if not tokencounts.UNUSUAL.match(chr(c))]
    assert len(usual) == 94 + 0x300 - 0xA1
    words = [f"{a}{b}" for a in usual for b in ["", "a", "Z", "1", "'s", ".", "'", "é", "²", "İ"]] + [f"{b}{a}" for a in usual for b in "aZ1'.éªǅ"]
    for word in words:
        if own._usual(word):
            assert sorted(own.counts(word).elements()) == sorted(own._split(word)), word
    assert own._usual("a'b É") and not own._usual("<|") and not own._usual("a\u0301") and not own._usual("a\xa0b")


def test_pattern_is_used_only_where_it_is_known():
    import json

    with open(VOCABULARY, encoding="utf-8") as file:
        settings = json.load(file)
    assert tokencounts._own_pattern(settings) is not None
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": []}}):
        assert tokencounts._own_pattern({**settings, **change}) is None
