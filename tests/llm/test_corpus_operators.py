"""Operators against brute force, on the benchmark tables and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brickwork.llm import ann, catalog, classlm, cleaning, langid, licenses, mixing, nearcopies, packing, pii, simhash, tagger, toxicity

LONG = "alpha beta gamma. " * 5_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, queue string, size long, key long, fp long, words string, lines string, n long, row long, part int, label int, base string, word string"
ODD_TEXTS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", None),
    (4, "one two three four five six seven. ONE two\nthree", None, "b"),
    (4, "one two three four five six seven. ONE two\nthree", None, "b"),
    (None, "no id here, mail a.b@c.org or 10.0.0.1", "en", "b"),
    (5, "12345 !!! 678", "en", "c"),
    (6, LONG, "en", "c"),
    (7, "licensed under cc by nc 4.0\nunder the MIT license, under the MIT license", "fr", None),
    (8, "café ÉCOLE naïve 日本語 <|endoftext|> \U0001f600", "fr", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, la, s, None, *["x" if c.endswith("string") else 1 for c in SCHEMA.split(", ")[5:]]) for i, t, la, s in ODD_TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


# --- packing


def packed(df):
    return packing.pack(df, public_tokenizers.path(catalog.VOCABULARY), public_tokenizers.path(catalog.RANKS), window=64, quantum=16, period=1000)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_packing_places_every_id_once(name, request):
    df = request.getfixturevalue(name)
    got = packed(df).toPandas()
    place = got["sequence_id"] * 64 + got["offset"]
    order = place.argsort()
    assert place.iloc[order].iloc[0] == 0
    assert ((place + got["length"]).iloc[order].to_numpy()[:-1] == place.iloc[order].to_numpy()[1:]).all()
    assert (got["offset"] + got["length"] <= 64).all() and (got["length"] > 0).all()
    full = Tokenizer.from_file(public_tokenizers.path(catalog.VOCABULARY))
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.doc_id].append([*full.encode(r.text or "", add_special_tokens=False).ids, 1])
    assert got["length"].sum() == sum(len(x) for v in ids.values() for x in v)
    for r in got.itertuples():
        doc = None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id)
        crcs = {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[doc] if len(x) == r.doc_tokens}
        assert r.ids_crc32 in crcs


def test_packing_windows_follow_the_proportions():
    segments = packing.schedule([3000, 1000, 96], [0.7324, 0.2441, 0.0234], [0.0, 0.0, 0.0], 10, 64, 16)
    at = 10
    done = np.zeros(3)
    for q, n, place in segments:
        assert place == at and place // 64 == (place + n - 1) // 64
        done[q] += n
        at += n
        assert (abs(done - (at - 10) * np.array([0.7324, 0.2441, 0.0234])) < 64 + 32).all()
    assert done.tolist() == [3000, 1000, 96]


def test_packing_of_nothing(empty):
    assert packed(empty).count() == 0


# --- language


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all() and not got["rejected"].any()
    kept = langid.in_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_languages_are_learned_from_every_row(spark):
    """The held-out quarter of op2 teaches in the pipeline: a language that stands only there is known."""
    g = np.random.default_rng(8)
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(400)]
    kinds = {True: "ijklmnop", False: "abcdefgh"}
    texts = ["".join(c if k % 6 else " " for k, c in enumerate(g.choice(list(kinds[h]), 300))) for h in held]
    rows = [(i, t, "bb" if h else "aa") for i, (t, h) in enumerate(zip(texts, held))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = {r["doc_id"] for r in langid.in_known_language(docs).collect()}
    assert kept == set(range(400)) and any(held)


@pytest.mark.parametrize("calibration", [3, 2000])
def test_languages_of_long_texts_are_learned(spark, monkeypatch, calibration):
    g = np.random.default_rng(5)
    kinds = {"aa": "abcdefgh", "bb": "ijklmnop"}

    def text(lang, n):
        letters = g.choice(list(kinds[lang]), n)
        letters[5::6] = " "
        return "".join(letters)

    rows = [(i, text("aa", 1_000_000), "aa") for i in range(10)] + [(100 + i, text("bb", 500), "bb") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = {}
    fit = langid.fit_model
    monkeypatch.setattr(langid, "fit_model", lambda grams: seen.update(grams) or fit(grams))
    model = langid.train(df, train_chars=40_000, calibration_docs=calibration)
    assert model.languages == ["aa", "bb"]
    # Twenty blocks of the long texts, give or take, and at most all of the short ones.
    assert all(20_000 < seen[k][1].sum() < 62_000 for k in seen)
    found = langid.identify(df, model, ("doc_id", "lang")).toPandas()
    assert (found["lang"] == found["lang_pred"]).all()
    # A bound from about three texts may reject others.
    assert calibration == 3 or not found["rejected"].any()


def test_kneser_ney_distributions_sum_to_one():
    text = "abracadabra abacus cabaret " * 3
    grams = Counter((" " * langid.ORDER + text)[i : i + langid.ORDER] for i in range(1, len(text) + 1))
    rows = np.array([[ord(c) for c in g] for g in grams], np.uint32)
    model = langid.fit_model({"x": (rows, np.array(list(grams.values())))})
    letters = sorted(set(text))
    for before in ("abra", "zzab", "caba", "    "):
        total = sum(math.exp(model.log_probabilities(np.array([32, *map(ord, before), ord(c)], np.uint32), 5, 6)[0, 0]) for c in letters)
        unseen = math.exp(model.log_probabilities(np.array([32, *map(ord, before), 9999], np.uint32), 5, 6)[0, 0])
        assert total + unseen == pytest.approx(1, abs=1e-5)


def test_cross_entropy_does_not_depend_on_slices(monkeypatch):
    grams = Counter("abcabdabe"[i : i + langid.ORDER] for i in range(5))
    model = langid.fit_model({"x": (np.array([[ord(c) for c in g] for g in grams], np.uint32), np.array(list(grams.values())))})
    texts = [langid.codes_of(t) for t in ("abcab", "", "abdabeabc" * 7, "q")]
    whole = model.cross_entropies(texts)
    monkeypatch.setattr(langid, "SLICE", 7)
    assert model.cross_entropies(texts) == pytest.approx(whole)


def test_language_of_awkward_rows(odd, empty):
    got = langid.predicted(odd).toPandas()
    assert len(got) == len(ODD_TEXTS) and (got["lang_pred"] == "und").sum() == 4
    assert got.loc[got["lang_pred"] == "und", "rejected"].all()
    assert langid.predicted(empty).count() == 0
    assert set(langid.identify(odd, None).toPandas()["lang_pred"]) == {"und"}


# --- mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = 3 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_mixing_meets_its_targets(name, request):
    df = request.getfixturevalue(name)
    got = mixing.mix(df, carry=("source",)).toPandas()
    sizes = Counter()
    for r in df.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    goal = brute_targets(sizes)
    got["source"] = got["source"].map(lambda s: None if s is None or s != s else s)
    for source, own in got.groupby(got["source"].map(repr)):
        source = eval(source)
        assert own["target"].iloc[0] == pytest.approx(goal[source])
        assert own["source_size"].iloc[0] == sizes[source]
        assert abs(own["taken"].sum() - goal[source]) <= 0.5
    assert (got["taken"] <= 3 * got["size"]).all()
    assert rows_of(mixing.mix(df.repartition(7)), "doc_id", "taken") == rows_of(mixing.mix(df), "doc_id", "taken")
    made = mixing.mixed_documents(df)
    assert made.columns == df.columns
    assert sum(len((r.text or "").encode().split()) for r in made.collect()) == got["taken"].sum()


def test_mixing_of_nothing(empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# --- toxicity


def test_toxicity_holds_out_of_sample(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = catalog.op4_toxicity(spark, path).filter("held_out").join(labels, "doc_id").toPandas()
    good, bad = got.loc[got["toxic"] == 0, "score"].to_numpy(), got.loc[got["toxic"] == 1, "score"].to_numpy()
    assert (bad[:, None] > good[None]).mean() > 0.95
    assert (good >= 0.5).mean() < 0.01


def test_toxicity_of_awkward_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, None), (6, 0, 1), (None, 1, 1), (8, None, 1)], "doc_id long, toxic int, text int")
    got = toxicity.scored(odd, labels).toPandas()
    assert len(got) == len(ODD_TEXTS) and got["score"].between(0, 1).all()
    assert toxicity.scored(odd, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.scored(empty, labels).count() == 0


# --- SimHash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_simhash_components(name, request):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    label = brute_components(sorted({fp for _, fp in rows}))
    least = {}
    for i, fp in rows:
        if i is not None:
            least[label[fp]] = min(i, least.get(label[fp], i))
    got = simhash.near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    assert rows_of(got, "doc_id", "f", "component_id") == sorted(((i, f"{fp:016x}", least.get(label[fp])) for i, fp in rows), key=repr)
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(set(label.values()))


@pytest.mark.parametrize("tree", [2, 5, 4096])
def test_split_shards_lose_no_link(spark, tree):
    g = np.random.default_rng(3)
    values = [int(v) for v in g.integers(0, 1 << 62, 30)]
    for v in values[:6]:  # chains of steps within and beyond the radius
        for step in (3, 3, 2, 4, 1, 3):
            for b in g.choice(64, step, replace=False):
                v ^= 1 << int(b)
            values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = dict(tuple(r) for r in simhash.components(simhash.near_links(classes, tree=tree)).collect())
    got = defaultdict(set)
    for v in signed:
        got[roots.get(v, v)].add(v % (1 << 64))
    want = defaultdict(set)
    for v, root in brute_components(values).items():
        want[root].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.without_near_duplicates(empty).count() == 0


def planted_copies():
    g = np.random.default_rng(7)
    word = lambda: f"w{g.integers(1 << 40):x}"
    rows = []
    for pair in range(40):  # single words changed so that 0.82 to 0.95 of the shingles are common
        words = [word() for _ in range(400)]
        other = list(words)
        for at in np.linspace(10, 390, 2 + pair % 7).astype(int):
            other[at] = word()
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    line = " ".join(word() for _ in range(10))
    clean = [(1000 + i, " ".join([word() for _ in range(250)] + [line] * 80)) for i in range(30)]
    apart = []
    for pair in range(20):  # about 0.6 of the shingles are common
        words = [word() for _ in range(400)]
        other = list(words)
        for at in np.linspace(10, 390, 20).astype(int):
            other[at] = word()
        apart += [(2000 + 2 * pair, " ".join(words)), (2001 + 2 * pair, " ".join(other))]
    return rows, clean + apart


@pytest.mark.parametrize("part", [3, 512])
def test_near_copies_go_and_repeated_lines_stay(spark, part, monkeypatch):
    copies, clean = planted_copies()
    df = spark.createDataFrame(copies + clean, "doc_id long, text string").repartition(3)
    if part == 3:
        monkeypatch.setattr(nearcopies.without_near_copies, "__defaults__", (part,))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i, _ in copies if i % 2 == 0} | {i for i, _ in clean}


def test_near_copies_within_three_bits_come_from_the_trees(spark):
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(f"x{i}" for i in range(900))]
    prints = [simhash.majority(nearcopies.shingles(t)) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    # No text has a band, so only the trees of fingerprints can name the pair.
    classes = rows.select(nearcopies.text_class().alias("fp"), "text").join(spark.createDataFrame(list(zip(texts, signed)), "text string, print long"), "text")
    classes = classes.selectExpr("fp", "print", "cast(array() as array<bigint>) AS bands")
    links = [tuple(r) for r in nearcopies.near_links(rows, classes).collect()]
    known = [r.fp for r in rows.select(nearcopies.text_class().alias("fp"), "text").collect()]
    assert links == [(max(known[:2]), min(known[:2]))]


def test_near_copies_are_named_by_fingerprints_before_their_sets_are_compared():
    g = np.random.default_rng(3)
    common = g.integers(0, 1 << 64, 450, dtype=np.uint64)
    sets = [np.unique(np.append(common, g.integers(0, 1 << 64, 50, dtype=np.uint64))) for _ in range(3)]
    prints = [simhash.majority(s) for s in sets]
    fp = np.array([7, 5, 9])
    u, v = nearcopies.verified(fp, sets)
    assert sorted(zip(u.tolist(), v.tolist())) == [(7, 5), (9, 5)]
    nearest = min((a ^ b).bit_count() for a, b in [(prints[0], prints[1]), (prints[0], prints[2]), (prints[1], prints[2])])
    assert nearest > simhash.RADIUS
    assert len(nearcopies.verified(fp, sets, radius=nearest - 1)[0]) == 0


def test_close_pairs_against_brute_force():
    g = np.random.default_rng(5)
    base = g.integers(0, 1 << 63, 8).astype(np.uint64)
    prints = np.concatenate([base, base, base ^ np.uint64(5), base ^ np.uint64((1 << 20) - 1)])
    brute = sorted((i, j) for i in range(32) for j in range(i + 1, 32) if int(prints[i] ^ prints[j]).bit_count() <= 18)
    assert sorted(tuple(sorted(p)) for p in nearcopies.close_pairs(prints, 18)) == brute


def test_finished_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(simhash, "stored", lambda df, name: written.append(name) or df.localCheckpoint())
    stars = [(5, 1), (6, 1), (9, 2)]
    found = simhash.components(spark.createDataFrame(stars, "u long, v long"))
    assert sorted(map(tuple, found.collect())) == stars and len(written) == 1
    path = simhash.components(spark.createDataFrame([(i + 1, i) for i in range(40)], "u long, v long"))
    assert sorted(map(tuple, path.collect())) == [(i, 0) for i in range(1, 41)]


def test_near_copies_of_awkward_rows(spark, odd, empty):
    kept = nearcopies.without_near_copies(odd)
    assert kept.columns == odd.columns
    # The texts without words are one document, and the repeated row is one.
    assert kept.count() == len(ODD_TEXTS) - 3
    assert nearcopies.without_near_copies(empty).count() == 0


# --- quality rules


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.split(" ") and re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_quality_counts(name, request):
    df = request.getfixturevalue(name)
    got = cleaning.quality(df)
    want = sorted(((r.doc_id, *brute_quality(r.text)) for r in df.collect()), key=repr)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.filter("base_failed AND kept").count() == 0


def test_quality_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ("doc_id", "n_words", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = rows_of(catalog.op6_quality_rules(spark, sf), *names)
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({cleaning.SQL})").fetchall(), key=repr)


def test_lines_are_removed_and_thin_documents_rejected(spark, empty):
    prose = "This is a sentence of plain prose that ends as sentences do, with a full stop.\nAnd here is another one of them, which is just as plain and just as long as that."
    rows = [(1, prose + "\nHome | News | Sport | Contact\nRead more about this in our other story today.\nshort line"), (2, "Home | News | Sport | Contact | Login\n" * 9 + prose[:60])]
    got = {r["doc"]["doc_id"]: r for r in cleaning.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["clean_text"] == prose and got[1]["kept"] and not got[2]["kept"]
    assert cleaning.quality(empty).count() == 0


# --- licences


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_licence_phrases(name, request):
    df = request.getfixturevalue(name)
    got = licenses.scan(df)
    want = sorted(((r.doc_id, *brute_phrases(r.text)) for r in df.collect()), key=repr)
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_notices_are_found_at_their_place(spark, empty):
    other = [(i, "nothing of this kind stands here " * 3) for i in range(10, 60)]
    notice = licenses.NOTICES[9][1]
    rows = [
        (1, "one two. " + notice.upper() + " and so on"),
        (2, "permission granted is free hereby of charge obtaining software a this of copy"),
        (3, ("This work is licensed under the GNU General Public License, version 3.\n") * 50),
        (4, "is licensed under the gnu general public license version 3 of which the head is lost"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows + other, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].found[0]["at"] == 2 and got[1].score == 1.0
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "gpl-3" and len(got[3].found) == 50
    assert got[4].labels == "" or got[4].found[0]["at"] == -2
    assert all(got[i].labels == "" for i in range(10, 60))
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("others", [0, 2])
def test_notices_of_common_words_are_found(spark, others):
    notices = [n for n in licenses.NOTICES if n[0] in ("gpl-3", "isc", "bsd")]
    rows = [(10 * i + k, f"one two. {text} and so on") for i, (_, text, _) in enumerate(notices[:3]) for k in range(3)]
    rows = rows if others else rows[:1]
    plain = [(100 + i, "nothing of this kind stands here") for i in range(others * len(rows))]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows + plain, "doc_id long, text string")).collect()}
    assert got == {i: notices[i // 10][0] for i, _ in rows} | {i: "" for i, _ in plain}


def test_every_notice_of_a_file_is_found(spark):
    text = {label: words for label, words, _ in licenses.NOTICES}
    index = " ".join(f"{w} apart" for w in sorted({w for _, words, _ in licenses.NOTICES for w in words.split()}))
    rows = [
        (1, f"one two. {text['bsd']} and {text['gpl-3']} and so on"),
        (2, f"{index} {text['gpl-3']} {index}"),
        (3, " and ".join(words for _, words, _ in licenses.NOTICES)),
        *[(i, text["gpl-3"]) for i in range(10, 40)],
        *[(i, "nothing of this kind stands here") for i in range(40, 200)],
    ]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "bsd,gpl-3" and got[2] == "gpl-3" and got[3] == ",".join(sorted(text))
    assert all(got[i] == "gpl-3" for i in range(10, 40)) and not any(got[i] for i in range(40, 200))


# --- class language model


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_class_model_counts(name, request, monkeypatch):
    df = request.getfixturevalue(name)
    monkeypatch.setattr(classlm.frequent_level, "__defaults__", (500,))
    got = classlm.scored(df).toPandas()
    count = Counter()
    for r in df.collect():
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 != 1:
            count.update([*(r.text or "").encode().lower().split(), None])
    total, types = sum(count.values()), len(count)
    want = []
    for r in df.collect():
        tokens = [*(r.text or "").encode().lower().split(), None]
        want.append((r.doc_id, len(tokens), sum(count[w] > 0 for w in tokens), total, sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens)))
    have = sorted(((None if i != i else int(i), n, k, t, b) for i, n, k, t, b in zip(got["doc_id"], got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"])), key=repr)
    for a, b in zip(have, sorted(want, key=repr)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    assert (got["score"] < 0).all() and (got["perplexity"] > 1).all()


def test_exchange_finds_planted_classes():
    g = np.random.default_rng(0)
    kind = np.arange(20) % 2
    pairs = g.poisson(np.where(kind[:, None] != kind[None, :], 40, 2)).astype(float)
    own = classlm.exchange(pairs, 20, classes=2)
    assert len({(k, c) for k, c in zip(kind, own)}) == 2


def test_class_model_of_nothing(empty):
    assert classlm.scored(empty).count() == 0


# --- nearest neighbours


def test_neighbours_have_high_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    own = table.toPandas()
    x, ids = np.stack(own["embedding"]).astype(float), own["vec_id"].to_numpy()
    got = ann.nearest(table, shard=400, block=7).toPandas()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["score"].is_monotonic_increasing and len(mine) == 10
        assert np.allclose(mine["score"], [d[ids == v][0] for v in mine["vec_id"]], rtol=0, atol=1e-12)
        hit += len({int(ids[i]) for i in best} & set(mine["vec_id"]))
        total += 10
    assert hit / total > 0.95


def test_neighbours_of_awkward_vectors(spark):
    a, b = [1.0, 2.0], [3.0, 4.0]
    rows = [(i, a) for i in range(0, 30)] + [(100, b), (100, b), (200, None), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [None, 1.0]), (600, [1.0]), (None, a)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = rows_of(ann.nearest(table), "query_id", "rank", "vec_id", "score")
    far = math.sqrt(8)
    assert got == sorted([(0, k, k, 0.0) for k in range(1, 11)] + [(100, k + 1, k, far) for k in range(10)], key=repr)
    assert ann.nearest(table.limit(0)).count() == 0


# --- personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_their_patterns():
    g = np.random.default_rng(1)
    for _ in range(20_000):
        text = "".join(g.choice(list("a1@.-+ (%5"), 16))
        assert pii.joined(pii.base_spans(text)) == ",".join(brute_spans(text))


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_personal_data(name, request, monkeypatch):
    monkeypatch.setattr(pii, "TRAIN_STEPS", 10)
    df = request.getfixturevalue(name)
    got = pii.scanned(df)
    want = sorted(((r.doc_id, hashlib.sha256(",".join(brute_spans(r.text)).encode()).hexdigest()) for r in df.collect()), key=repr)
    assert rows_of(got, "doc_id", "base_sha256") == want
    assert all(set(brute_spans(t)) <= set(s.split(",")) | {""} for t, s in [(r.text, r.spans) for r in got.join(df.select("doc_id", "text").distinct(), "doc_id").collect()])
    clean = pii.without_personal_data(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    assert not any(brute_spans(r.text) for r in clean.collect())


def test_personal_data_of_nothing(empty):
    assert pii.scanned(empty).count() == 0 and pii.without_personal_data(empty).count() == 0


def test_tagger_gradient():
    g = np.random.default_rng(0)
    x, y = g.integers(0, 129, (10, 3)), g.integers(0, tagger.LABELS, (10, 3))
    p = {k: v.astype(float) for k, v in tagger.init().items()}
    _, d = tagger.gradient(p, x, y)
    for k in p:
        at = (x[3, 1], 7) if k[0] == "x" else tuple(g.integers(0, s) for s in p[k].shape)
        near = []
        for step in (1e-3, -1e-3):
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += step
            near.append(tagger.gradient(q, x, y)[0])
        assert (near[0] - near[1]) / 2e-3 == pytest.approx(float(d[k][at]), abs=2e-3)


def test_tagger_finds_other_forms():
    g = np.random.default_rng(2)
    lines = []
    for _ in range(200):
        n = "".join(map(str, g.integers(0, 10, 10)))
        lines.append(" ".join([*g.choice(["the", "of", "and", "words", "here"], 4), f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}", *g.choice(["that", "of", "is"], 3)]))

    class Batch:
        def column(self, _):
            import pyarrow as pa

            return pa.array(lines)

    (made,) = pii._labelled_windows([Batch()])
    x, y = (np.frombuffer(b"".join(made.column(k).to_pylist()), np.uint8).reshape(-1, tagger.WIDTH) for k in (0, 1))
    model = tagger.fit(x, y.astype(np.int64), epochs=15)
    text = "words and here (415) 555-0182 of the"
    starts = pii.window_starts(text)
    found = pii.reconcile(len(text), starts, tagger.decode(model, pii.windows_of(text, starts)))
    assert pii.added_spans(text, found, pii.base_spans(text)) == [(3, 15, 29)]


# --- pipeline


def test_pipeline_stages(spark, sf, odd, monkeypatch):
    monkeypatch.setattr(pii, "TRAIN_STEPS", 10)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.stored(stage(spark, left, sf), f"test-{name}")
        assert left.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, left, sf).select("doc_id").distinct().count() == left.select("doc_id").distinct().count()
    left = odd
    for name, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.stored(stage(spark, left, sf), f"odd-{name}")
    assert left.count() > 0


def test_stages_keep_the_values_of_every_column(spark, odd, empty, monkeypatch):
    """Columns named like the operators' own, such as fp and _content, come back as they went in."""
    monkeypatch.setattr(pii, "TRAIN_STEPS", 2)
    own = odd.withColumn("fp", F.coalesce("doc_id", F.lit(0)) * 7).withColumn("_content", F.concat_ws("-", "doc_id", "lang")).withColumn("content", F.lit(3)).withColumn("row", F.col("fp") + 1)
    was = {r.asDict()["doc_id"]: r.asDict() for r in own.collect()}
    for stage in (langid.in_known_language, nearcopies.without_near_copies, simhash.without_near_duplicates, pii.without_personal_data):
        got = stage(own).collect()
        assert got and stage(own.where("false")).count() == 0
        for r in got:
            new, old = r.asDict(), dict(was[r.doc_id])
            if stage is pii.without_personal_data:
                assert new.pop("n_chars") == (None if r.text is None else len(r.text)) and (new.pop("text") is None) == (old.pop("text") is None)
                old.pop("n_chars")
            assert new == old


def test_rows_that_differ_in_nulls_are_two(spark):
    rows = spark.createDataFrame([(1, "same text here", None, "a"), (1, "same text here", "a", None)], "doc_id long, text string, lang string, source string")
    names = simhash.nested(rows).select("content").distinct()
    assert names.count() == 2 and nearcopies.without_near_copies(rows).count() == 1


def test_labels_without_documents_teach_nothing(spark, odd):
    labels = spark.createDataFrame([(10**9 + k, 1, k % 2) for k in range(50)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(odd, labels).collect()
    assert len(got) == odd.count() and {r.predicted for r in got} == {0} and {round(r.score, 6) for r in got} == {0.5}


def test_numerals_are_no_letters(spark):
    assert not langid.has_letter("² ½ 123 _ Ⅷ") and langid.has_letter("² x") and langid.has_letter("ß")


def test_rare_personal_data_is_still_learned(spark):
    rows = [(k, f"plain words number {k} and nothing else") for k in range(3000)] + [(9000 + k, f"write to mail{k}@host{k}.org or +1 415 555 01{k:02d} today") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    mp = pytest.MonkeyPatch()
    mp.setattr(tagger, "fit", lambda x, y, **_: seen.append((y > 0).any(axis=1).sum()))
    pii.train(docs, train_docs=60)
    mp.undo()
    assert seen and seen[0] >= 12
    for text in ("a@b.c", "1.2.3.4", "4111 1111-11111111", "+12 (345) 678-90"):
        assert pii.re.search(pii.LIKELY, text), text
