"""Language identification by interpolated Kneser-Ney character models.

Each language has a character n-gram model.  For every order, one sorted array
holds the hashes of the n-grams that any language has seen, with the finished
log-probability of each in every language, and another the back-off weights of
the contexts.  A text gets the language with the lowest cross-entropy per
character.  A text whose lowest cross-entropy is beyond what is usual at its
length is rejected; the bound comes from labelled texts that the counts left out.

The fit uses a sample of the labelled rows: blocks of ``BLOCK`` characters drawn
inside the texts, ``train_chars`` a language in expectation however long its texts
are, and all of a language that has no more.  Prediction reads whole texts.

Defined results: null text, and text without a letter, gives ``und`` with score 0
and is rejected; with no labelled row everything does; ties go to the language
that sorts first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm.hashes import MULTIPLIERS, SortedHashes, gram_hashes, mixed
from brickwork.llm.shared import remainder, small_batches

ORDER = 5
DISCOUNT = 0.75
#: Characters of training text a language, in expectation.
TRAIN_CHARS = 400_000
#: Labelled texts that set the rejection bound, in expectation.
CALIBRATION_DOCS = 2000
#: Characters that are drawn together for training.
BLOCK = 2000
#: Length at which half of a text's excess cross-entropy counts.
SHORT = 100
#: The bound lies this many times the largest excess seen in calibration.
SLACK = 1.5
#: Characters scored at once.
SLICE = 1 << 18
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def codes_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text with single spaces."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    languages: list[str]
    grams: list[SortedHashes]
    log_p: list[np.ndarray]
    contexts: list[SortedHashes]
    log_weight: list[np.ndarray]
    log_floor: np.ndarray
    usual: float = 0.0
    bound: float = np.inf

    def cross_entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Nats per character of each text in each language; the texts hold codes."""
        pad = np.full(ORDER, 32, np.uint32)
        joined = np.concatenate([x for t in texts for x in (pad, t)] or [pad])
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths + ORDER) - lengths
        sums = np.zeros((len(texts), len(self.languages)))
        # Text after padding after text: every second run of positions counts.
        bounds = np.stack([begins - ORDER, begins], axis=1).ravel()
        for first in range(ORDER, len(joined), SLICE):
            last = min(first + SLICE, len(joined))
            log_p = self.log_probabilities(joined, first, last)
            run = np.searchsorted(bounds, first, "right") - 1
            inside = bounds[run + 1 : np.searchsorted(bounds, last, "left")]
            starts = np.append(0, inside - first)
            parts = np.add.reduceat(log_p, starts, axis=0, dtype=float)
            runs = run + np.arange(len(starts))
            real = runs % 2 == 1
            np.add.at(sums, runs[real] // 2, parts[real])
        return -sums / np.maximum(lengths, 1)[:, None]

    def log_probabilities(self, codes: np.ndarray, first: int, last: int) -> np.ndarray:
        """Rows of log-probabilities of the characters at [first, last); -1 finds a row of zeros."""
        at = self.grams[ORDER - 1].find(gram_hashes(codes, first, last, ORDER))
        out = self.log_p[ORDER - 1].take(at, axis=0, mode="wrap")
        open_ = np.flatnonzero(at < 0)
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                at = self.grams[order - 1].find(self._at(codes, first, open_, order, 0))
                out[open_] += self.log_p[order - 1][at]
                open_ = open_[at < 0]
            if not len(open_):
                return out
            if order > 1:
                at = self.contexts[order - 1].find(self._at(codes, first, open_, order - 1, 1))
                out[open_] += self.log_weight[order - 1][at]
        out[open_] += self.log_floor
        return out

    @staticmethod
    def _at(codes: np.ndarray, first: int, open_: np.ndarray, order: int, skip: int) -> np.ndarray:
        ends = first + open_ - skip
        windows = codes[ends[:, None] - np.arange(order - 1, -1, -1)[None, :]]
        return gram_hashes_of(windows)


def gram_hashes_of(windows: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of codes, equal to those of running text."""
    order = windows.shape[1]
    flat = np.ascontiguousarray(windows[:, ::-1])
    total = np.zeros(len(flat), np.uint64)
    for back in range(order):
        total += (flat[:, back].astype(np.uint64) + np.uint64(1)) * MULTIPLIERS[back]
    return mixed(total + np.uint64(order))


def fit_model(grams: dict[str, tuple[np.ndarray, np.ndarray]], discount: float = DISCOUNT) -> Model:
    """Model from each language's distinct n-grams of the highest order and their counts.

    Below the highest order an n-gram counts once for each distinct character
    before it (Kneser-Ney continuation counts).
    """
    languages = sorted(grams)
    seen = np.unique(np.concatenate([g[:, -1] for g, _ in grams.values()])) if grams else np.zeros(0)
    floor = np.full(len(languages), 1.0 / (len(seen) + 1))
    types = dict(grams)
    levels: list[dict] = []
    for order in range(ORDER, 0, -1):
        levels.insert(0, types)
        shorter = {}
        for language, (g, _) in types.items():
            if order > 1:
                shorter[language] = np.unique(g[:, 1:], axis=0, return_counts=True)
        types = shorter
    model = Model(languages, [], [], [SortedHashes(np.zeros(0))], [np.zeros((1, len(languages)), np.float32)], np.log(floor).astype(np.float32))
    below = None
    for order in range(1, ORDER + 1):
        level = levels[order - 1]
        rows, first = np.unique(np.concatenate([level[x][0] for x in languages]), axis=0, return_index=True)
        keys = gram_hashes_of(rows)
        sort = np.argsort(keys)
        rows, keys = rows[sort], keys[sort]
        table = SortedHashes(keys)
        if order > 1:
            context_rows = np.unique(rows[:, :-1], axis=0)
            context_keys = gram_hashes_of(context_rows)
            contexts = SortedHashes(np.sort(context_keys))
            own_context = contexts.find(gram_hashes_of(rows[:, :-1]))
        else:
            contexts, own_context = None, np.zeros(len(rows), np.int64)
        width = len(contexts.keys) if contexts else 1
        lower = floor[None, :] if order == 1 else below[1][below[0].find(gram_hashes_of(rows[:, 1:]))]
        p = np.zeros((len(rows), len(languages)))
        weight = np.ones((width, len(languages)))
        for k, language in enumerate(languages):
            g, count = level[language]
            at = table.find(gram_hashes_of(g))
            own = np.zeros(len(rows))
            own[at] = count
            total = np.bincount(own_context, own, width)
            kinds = np.bincount(own_context, own > 0, width)
            some = total > 0
            weight[some, k] = discount * kinds[some] / total[some]
            share = np.where(some[own_context], np.maximum(own - discount, 0) / np.maximum(total[own_context], 1), 0)
            p[:, k] = share + weight[own_context, k] * np.broadcast_to(lower, p.shape)[:, k]
        model.grams.append(table)
        last = np.zeros((1, len(languages)))
        model.log_p.append(np.concatenate([np.log(p), last]).astype(np.float32))
        if order == 1:
            model.log_floor = np.log(floor * weight[0]).astype(np.float32)
        else:
            model.contexts.append(contexts)
            model.log_weight.append(np.concatenate([np.log(weight), last]).astype(np.float32))
        below = (table, p)
    return model


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of the highest order, summed in the task; ``begins`` where the text does."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for language, text, begins in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "begins"))):
            line = " " * (ORDER if begins else 0) + " ".join((text or "").lower().split())
            counts.setdefault(language, Counter()).update(line[i : i + ORDER] for i in range(1 if begins else 0, len(line) - ORDER + 1))
    for language, own in counts.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([language] * len(own), pa.string()), pa.array([g.encode("utf-32-le", "surrogatepass") for g in own], pa.binary()), pa.array(list(own.values()), pa.int64())],
            names=["lang", "gram", "n"],
        )


def train(docs: DataFrame, train_chars: int = TRAIN_CHARS, calibration_docs: int = CALIBRATION_DOCS) -> Model | None:
    """Fit on (text, lang) of ``docs``; rows without text or language are not used."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("draw"))
    n_docs = rows.count()
    if not n_docs:
        return None
    # Calibration has its own end of the draw; training leaves it out where the rest of a language suffices.
    reach = int(min(1.0, calibration_docs / n_docs) * (1 << 30))
    aside = F.col("draw") >= (1 << 30) - reach
    chars = F.length("text").cast("long")
    sizes = rows.groupBy("lang").agg(F.sum(chars).alias("chars"), F.sum(F.when(~aside, chars).otherwise(0)).alias("rest")).collect()
    spared = {r["lang"]: r["rest"] >= train_chars for r in sizes}
    share = {r["lang"]: min(1.0, train_chars / max(1, r["rest"] if spared[r["lang"]] else r["chars"])) for r in sizes}

    def of(values: dict) -> Column:
        return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))

    upto = of({k: int(v * (1 << 30)) for k, v in share.items()})
    whole = upto >= 1 << 30
    # A text taken whole is one block.
    last = F.when(whole, F.lit(0)).otherwise(F.greatest(F.floor((F.length("text") - 1) / BLOCK), F.lit(0)).cast("int"))
    drawn = F.filter(F.sequence(F.lit(0), last), lambda b: whole | (F.pmod(F.xxhash64("draw", b), F.lit(1 << 30)) < upto))
    rows = rows.withColumn("blocks", F.when(of(spared) & aside, F.array().cast("array<int>")).otherwise(drawn))
    blocks = rows.filter(F.size("blocks") > 0).select("lang", "text", whole.alias("whole"), F.explode("blocks").alias("block"))
    # A block begins with the context of its first character.
    first = F.greatest(F.col("block") * BLOCK - (ORDER - 1), F.lit(0))
    cut = F.when(F.col("whole"), F.col("text")).otherwise(F.col("text").substr(first + 1, (F.col("block") + 1) * BLOCK - first))
    counts = blocks.select("lang", cut.alias("text"), (F.col("block") == 0).alias("begins"))
    counts = counts.mapInArrow(_gram_counts, "lang string, gram binary, n long")
    table = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    grams = {}
    for language, own in table.groupby("lang"):
        own = own.sort_values("gram")
        grams[language] = np.frombuffer(b"".join(own["gram"]), np.uint32).reshape(-1, ORDER), own["n"].to_numpy()
    if not grams:
        return None
    model = fit_model(grams)
    # Texts that the counts did not use, or any text of languages of which they needed all ends.
    held = rows.filter(aside & ((F.size("blocks") == 0) | ~of(spared)))
    seen = _scored(held.select("text"), model).filter("lang_pred <> 'und'").select("cross_entropy", "n_chars").toPandas()
    if len(seen):
        long = seen[seen["n_chars"] >= SHORT]
        model.usual = float((long if len(long) else seen)["cross_entropy"].mean())
        model.bound = SLACK * max(float(_excess(seen["cross_entropy"], seen["n_chars"], model.usual).max()), 0.05)
    return model


def _excess(cross_entropy, n_chars, usual: float):
    """Cross-entropy above the usual, damped for short texts, whose values scatter."""
    return (cross_entropy - usual) * np.sqrt(n_chars / (n_chars + SHORT))


def has_letter(text: str) -> bool:
    """Whether a letter stands in ``text``; numerals such as superscripts are none."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def _judged(texts: pa.Array, model: Model | None) -> list[tuple]:
    """(lang_pred, score, cross_entropy, n_chars, rejected) of every text."""
    rows: list[tuple] = [(UNKNOWN, 0.0, None, 0, True)] * len(texts)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def settle() -> None:
        values = model.cross_entropies([codes for _, codes in held])
        for (i, codes), own in zip(held, values):
            best = int(np.argmin(own))
            # A text is worth at most 50 independent characters of evidence.
            odds = np.exp((own[best] - own) * min(len(codes), 50))
            excess = _excess(own[best], len(codes), model.usual)
            rows[i] = (model.languages[best], float(1 / odds.sum()), float(own[best]), len(codes), bool(excess > model.bound))

    for i, text in enumerate(texts):
        text = text.as_py()
        if model is None or not text or not has_letter(text):
            continue
        codes = codes_of(text)
        held.append((i, codes))
        size += len(codes)
        if size >= 4 * SLICE:
            settle()
            held, size = [], 0
    if held:
        settle()
    return rows


def _scored(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in carry] + [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("rejected", T.BooleanType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _judged(batch.column("text"), shared.value)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + columns, names=[f.name for f in fields])

    return docs.select(*dict.fromkeys(["text", *carry])).mapInArrow(run, T.StructType(fields))


def identify(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every document, lang_pred, score, cross_entropy, n_chars, rejected."""
    return _scored(docs, model, carry)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder("doc_id", 4) != 2)


def predicted(docs: DataFrame) -> DataFrame:
    """Language of every document; a quarter of the ids is held out of training."""
    found = identify(docs, train(training_rows(docs)))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns; only the text goes to Python.

    Nothing is tested here, so every labelled row may teach, also those that :func:`predicted` holds out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    small_batches(docs.sparkSession)

    def known(texts: pa.Array) -> pa.Array:
        return pa.array([not row[-1] for row in _judged(texts, shared.value)], pa.bool_())

    return docs.filter(F.arrow_udf(known, T.BooleanType())("text"))
