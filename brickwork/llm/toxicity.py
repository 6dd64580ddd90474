"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, hashed
to ``2**BITS`` coordinates.  FTRL keeps a learning rate of its own for each
coordinate and an L1 penalty, so that only coordinates with steady evidence have
a weight; these few weights are broadcast to score all texts.

The fit uses a sample of the labelled rows, ``TRAIN_ROWS`` a class in expectation,
weighted back to the classes' shares; scoring reads whole texts.

Defined results: null and empty texts get the bias alone; without labelled rows
every score is 0.5 less a hair (predicted 0); repeated label rows of an id count
as its largest label, and labels above 0 as 1; of repeated texts of an id the
smallest is learned, and all are scored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm.shared import remainder, small_batches

BITS = 20
TRAIN_ROWS = 3000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 1.0
#: Words hashed at once.
SLICE = 1 << 19
#: ASCII characters other than letters and digits become spaces, capitals small letters.
TABLE = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def feature_ids(h: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Coordinates of the words, of neighbours, and of words with one between."""
    shift = np.uint64(64 - bits)
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> shift
    two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9)) >> shift
    skip = (h[:-2] * np.uint64(0xD6E8FEB86659FD93) + h[2:] * np.uint64(0xA0761D6478BD642F)) >> shift
    return [one.astype(np.int32), two.astype(np.int32), skip.astype(np.int32)]


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, their weights, bias) by FTRL-proximal over binary features."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == size, 0.0, L1), 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = np.append(rows[i], size)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - labels[i]) * weights[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    everything = weight(np.arange(size + 1))
    kept = np.flatnonzero(everything[:size])
    return kept.astype(np.int32), everything[kept].astype(np.float32), float(everything[size])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.unique(np.concatenate(feature_ids(word_hashes(t.as_py())))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "features"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learned from (doc_id, text) and (doc_id, label); see ``fit``."""
    labels = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    # Only ids with a text can be learned from.
    labels = labels.join(docs.filter("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    found = labels.groupBy("label").agg(F.count("*").alias("n")).collect()
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -1e-9
    share = {r["label"]: min(1.0, train_rows / r["n"]) for r in found}
    upto = F.element_at(F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * (1 << 30))))]), F.col("label"))
    sample = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < upto)
    # At most two classes of ``train_rows`` ids, in expectation: small at any size of the tables.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")
    # The order of the rows must not depend on how they were dealt out.
    got = rows.mapInArrow(_features, "label int, features array<int>").toPandas()
    if not len(got):
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -1e-9
    got["order"] = [zlib.crc32(np.asarray(f).tobytes()) for f in got["features"]]
    got = got.sort_values(["order", "label"], kind="stable")
    # Half the way from equal classes back to their shares: rare classes stay audible.
    weights = got["label"].map({k: (1 / v) ** 0.5 for k, v in share.items()}).to_numpy(float)
    return fit([np.asarray(f, np.int64) for f in got["features"]], got["label"].to_numpy(float), weights / weights.mean())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, weights, bias = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[kept] = weights
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for i, text in enumerate(batch.column("text")):
                h = word_hashes(text.as_py())
                hits = []
                for at in range(0, len(h), SLICE):
                    for ids in feature_ids(h[at : at + SLICE + 2]):
                        hits.append(ids[table[ids] != 0])
                if hits:
                    out[i] += table[np.unique(np.concatenate(hits))].sum(dtype=float)
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document; a fifth of the ids is held out of training."""
    known = labels.filter(remainder("doc_id", 5) != 0).select("doc_id", F.col("toxic").cast("int").alias("label"))
    found = score(docs, train(docs, known))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
