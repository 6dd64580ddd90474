"""Class-based language-model scoring: Brown exchange clustering over corpus counts.

Words are counted over all training documents.  The most frequent ones, the core, are
moved between classes by exchange clustering until the mutual information of
neighbouring classes no longer rises.  Every other word of the training documents,
however rare, is then moved to the class in which it gives the most mutual
information: its neighbours are counted by class over all training documents, and the
words are judged in the tasks, each by its own counts.  Only words that no training
document has, and as neighbours those outside the core, belong to the class of their
length.  A text's log-probability is that of its class transitions, which are counted
once all classes are known, and of each word in its class, all smoothed; perplexity
follows from it.

Counts and classes of frequent words travel to the tasks, at most ``FREQUENT`` of them
(a level of a power of two that fits is found from the counts of counts).  The rest
is looked up by a join of each document's distinct rare words with the table of
rare words, so classes and scores are exact at any vocabulary size.  A text is cut into
words once for its scores and the transitions: what is kept is the class of every token, a
byte each.  Words are named by 61 bits of XXH64 and three bits of their length class.

Defined results: null and empty texts are the end token alone; with no training
document all counts are zero; ids may be null or repeated; an empty table gives
an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm.hashes import SortedHashes
from brickwork.llm.shared import grouped, remainder, small_batches, stored

FREQUENT = 1 << 18
#: Words that the exchange moves to and fro; all other words are moved once, to their best class.
CORE = 1024
CLASSES = 64
SWEEPS = 6
#: Length classes of the words that no training document has.
BANDS = 8
BAND_WIDTH = 3
ADD = 0.5
#: Neighbour counts judged at once.
JUDGED = 1 << 15
#: Words handled at once.
SLICE = 1 << 20
#: The end token: white space is in no word.
END = xxhash.xxh64_intdigest(b"\n") & ~7
#: Classes, length classes and the end, which is the last.
WIDTH = CLASSES + BANDS + 1
#: In place of the class of a word that is still to be looked up.
RARE = 255


def word_ids(words: list[bytes]) -> np.ndarray:
    """64-bit names of words; the low three bits hold the length class."""
    names = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    bands = np.minimum(np.fromiter(map(len, words), np.int64, len(words)) // BAND_WIDTH, BANDS - 1)
    return (names & ~np.uint64(BANDS - 1)) | bands.astype(np.uint64)


def token_runs(texts: Iterator[str | None], slice_: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(token ids, lengths, text numbers): texts joined up to about ``slice_`` tokens, an end token after each."""
    held: list[bytes] = []
    lengths: list[int] = []
    numbers: list[int] = []
    for number, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        held += words
        held.append(b"\n")
        lengths.append(len(words) + 1)
        numbers.append(number)
        if len(held) >= slice_:
            yield _named(held, lengths), np.array(lengths), numbers
            held, lengths, numbers = [], [], []
    if lengths:
        yield _named(held, lengths), np.array(lengths), numbers


def _named(words: list[bytes], lengths: list[int]) -> np.ndarray:
    ids = word_ids(words)
    ids[np.cumsum(lengths) - 1] = END
    return ids


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, _, _ in token_runs(t.as_py() for t in batch.column("text")):
            found, n = np.unique(ids, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts, summed in the tasks first."""
    return docs.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_level(counts: DataFrame, most: int = FREQUENT) -> int:
    """The least power of two that at most ``most`` words reach."""
    power = F.floor(F.log2("n") + 1e-9).cast("int")
    groups = {r["p"]: r["count"] for r in counts.groupBy(power.alias("p")).count().collect()}
    level, total = max(groups, default=0) + 1, 0
    while level > 0 and total + groups.get(level - 1, 0) <= most:
        level -= 1
        total += groups.get(level, 0)
    return 1 << level


def _symbols(ids: np.ndarray, names: SortedHashes, number: np.ndarray, others: int) -> np.ndarray:
    """Number of each token: that of its name, else ``others`` and its length class, the end last."""
    at = names.find(ids)
    known = number[at] if len(number) else 0
    out = np.where(at >= 0, known, others + (ids & np.uint64(BANDS - 1)).astype(np.int64))
    out[ids == END] = others + BANDS
    return out


def _count_pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, others = shared.value
        size = others + BANDS + 1
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for ids, _, _ in token_runs(t.as_py() for t in batch.column("text")):
                now = _symbols(ids, names, number, others)
                before = np.concatenate([[size - 1], now[:-1]])
                total += np.bincount(before * size + now, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return run


def pair_counts(docs: DataFrame, names: SortedHashes, number: np.ndarray, others: int) -> np.ndarray:
    """Square table of neighbours: ``number`` of each name, and ``others`` numbers before the length classes and the end."""
    shared = docs.sparkSession.sparkContext.broadcast((names, number, others))
    pairs = docs.select("text").mapInArrow(_count_pairs(shared), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    size = others + BANDS + 1
    table = np.zeros(size * size)
    table[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    return table.reshape(size, size)


def _count_neighbours(shared):
    """(word, cell, n) of the words outside the core; a cell is a class after (even) or before (odd) the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, core, classes = shared.value
        for batch in batches:
            # Several arrays of twice the tokens are held at once.
            for ids, _, _ in token_runs((t.as_py() for t in batch.column("text")), SLICE // 4):
                now = _symbols(ids, core, classes, CLASSES)
                after = np.concatenate([now[1:], now[:1]])
                before = np.concatenate([[WIDTH - 1], now[:-1]])
                place = frequent.find(ids).astype(np.int64)
                rare = np.flatnonzero((place < 0) & (ids != END))
                kinds, kind = np.unique(ids[rare], return_inverse=True)
                place[rare] = len(frequent.keys) + kind
                own = np.flatnonzero((core.find(ids) < 0) & (ids != END))
                word = place[own] * (2 * WIDTH)
                cells, n = np.unique(np.concatenate([word + 2 * after[own], word + 2 * before[own] + 1]), return_counts=True)
                names = np.concatenate([frequent.keys, kinds])[cells // (2 * WIDTH)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array((cells % (2 * WIDTH)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "cell", "n"])

    return run


def best_classes(word: np.ndarray, cell: np.ndarray, n: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, class) of words by their neighbour counts, sorted by word: the class with the most gain of information.

    ``table`` counts neighbours by class as the core has left them.
    """

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    there, ahead = cell // 2, cell % 2 == 0
    # The cell of the table that grows, for every class the word might have.
    grown = np.where(ahead[:, None], table[:CLASSES, there].T, table[there, :CLASSES])
    gain = np.add.reduceat(f(grown + n[:, None]) - f(grown), starts)
    for side, sums in ((ahead, table.sum(axis=1)), (~ahead, table.sum(axis=0))):
        total = np.add.reduceat(np.where(side, n, 0), starts)
        gain -= f(sums[:CLASSES] + total[:, None]) - f(sums[:CLASSES])
    return word[starts], np.argmax(gain, axis=1)


def _assigned(table: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(batches, ["word"], JUDGED):
            word, own = best_classes(*(frame[c].to_numpy() for c in ("word", "cell", "n")), table)
            # Every token has one neighbour after it.
            times = frame["n"].where(frame["cell"] % 2 == 0, 0).groupby(frame["word"]).sum()
            yield pd.DataFrame({"word": word, "class": own, "n": times.loc[word].to_numpy()})

    return run


def other_classes(docs: DataFrame, frequent: SortedHashes, core: SortedHashes, classes: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, class, n) of all words outside the core."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, core, classes))
    cells = docs.select("text").mapInArrow(_count_neighbours(shared), "word long, cell int, n long")
    cells = cells.groupBy("word", "cell").agg(F.sum("n").alias("n")).repartition("word").sortWithinPartitions("word", "cell")
    return stored(cells.mapInPandas(_assigned(table), "word long, class long, n long"), "word-classes")


def exchange(pairs: np.ndarray, movable: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the symbols of a square table of neighbour counts.

    The first ``movable`` symbols start spread over the classes and move, one by
    one, to the class that gives the most mutual information; every other symbol is
    a class of its own.
    """
    size = len(pairs)
    own = np.concatenate([np.arange(movable) % classes, classes + np.arange(size - movable)])
    width = classes + size - movable
    table = np.zeros((width, width))
    np.add.at(table, (own[:, None], own[None, :]), pairs)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    free = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            to = np.bincount(own, pairs[w], width)
            of = np.bincount(own, pairs[:, w], width)
            same, c = pairs[w, w], own[w]
            to[c] -= same
            of[c] -= same
            table[c] -= to
            table[:, c] -= of
            table[c, c] -= same
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            gain = (f(table[:classes] + to) - f(table[:classes])).sum(axis=1)
            gain += (f(table[:, :classes] + of[:, None]) - f(table[:, :classes])).sum(axis=0)
            corner = table[free, free]
            gain -= f(corner + to[:classes]) - f(corner) + f(corner + of[:classes]) - f(corner)
            gain += f(corner + to[:classes] + of[:classes] + same) - f(corner)
            gain -= f(rows[:classes] + to.sum() + same) - f(rows[:classes])
            gain -= f(cols[:classes] + of.sum() + same) - f(cols[:classes])
            best = int(np.argmax(gain))
            best = best if gain[best] > gain[c] + 1e-9 else int(c)
            table[best] += to
            table[:, best] += of
            table[best, best] += same
            moved += best != c
            own[w] = best
        if not moved:
            break
    return own


@dataclass
class Model:
    tokens: int
    types: int
    #: Training documents, which is the count of the end token.
    ends: int
    frequent: SortedHashes
    frequent_n: np.ndarray
    #: Class of each frequent word.
    classes: np.ndarray
    #: Log of the denominator of the emission probability of each class.
    log_size: np.ndarray


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The classes of the words of all texts of ``docs``: of frequent ones, and a table (word, class, n) of the others."""
    small_batches(docs.sparkSession)
    counts = stored(word_counts(docs), "word-counts")
    end = F.col("word") == int(np.uint64(END).astype(np.int64))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(end, F.col("n"))), F.lit(0)).alias("ends")).first()
    level = frequent_level(counts)
    own = counts.filter((F.col("n") >= level) & ~end).toPandas()
    own = own.assign(word=own["word"].to_numpy(np.int64).view(np.uint64)).sort_values("word")
    by_count = own.sort_values(["n", "word"], ascending=[False, True]).head(CORE)
    order = np.argsort(by_count["word"].to_numpy())
    core, rank = SortedHashes(by_count["word"].to_numpy()[order]), order.astype(np.int64)
    pairs = pair_counts(docs, core, rank, len(rank))
    grouping = exchange(pairs, len(rank))
    table = np.zeros((WIDTH, WIDTH))
    np.add.at(table, (grouping[:, None], grouping[None, :]), pairs)
    frequent = SortedHashes(own["word"].to_numpy())
    others = other_classes(docs, frequent, core, grouping[rank], table)
    rare = others.filter(F.col("n") < level)
    classes = np.zeros(len(own), np.int64)
    classes[frequent.find(core.keys)] = grouping[rank]
    rest = others.filter(F.col("n") >= level).select("word", "class").toPandas()
    classes[frequent.find(rest["word"].to_numpy(np.int64).view(np.uint64))] = rest["class"].to_numpy()
    sums = rare.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    n, v = np.zeros(WIDTH), np.zeros(WIDTH)
    at = sums["class"].to_numpy(np.int64)
    n[at], v[at] = sums["n"], sums["v"]
    np.add.at(n, classes, own["n"].to_numpy(float))
    np.add.at(v, classes, 1)
    log_size = np.log10(n + ADD * (v + 1))
    return Model(int(total["n"]), int(total["v"]), int(total["ends"]), frequent, own["n"].to_numpy(np.int64), classes, log_size), rare


_SUMS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()),
    T.StructField("logs", T.DoubleType()),
    T.StructField("class_logs", T.DoubleType()),
    T.StructField("path", T.BinaryType()),
]
_OPEN = [
    T.StructField("row", T.LongType()),
    T.StructField("rare", T.ArrayType(T.LongType())),
    T.StructField("turn", T.ArrayType(T.IntegerType())),
]


def _begun(shared, schema: T.StructType):
    """Everything that needs no rare word: one row per document, with its distinct rare words and the turns they take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        row = TaskContext.get().partitionId() << 33
        log_n = np.log10(np.append(model.frequent_n, model.ends) + ADD)
        log_emitted = np.append(log_n[:-1] - model.log_size[model.classes], 0.0)
        symbol = np.append(model.classes, WIDTH - 1).astype(np.uint8)
        for batch in batches:
            at_row = 0
            for ids, lengths, _ in token_runs(t.as_py() for t in batch.column("text")):
                starts = np.cumsum(lengths) - lengths
                at = model.frequent.find(ids)
                ended = ids == END
                at[ended] = len(log_n) - 1
                there = at >= 0
                path = np.where(there, symbol[at], np.uint8(RARE))
                rare_at = np.flatnonzero(~there)
                cuts = np.searchsorted(rare_at, np.append(starts, len(ids)))
                rare, turn = [], []
                for i in range(len(lengths)):
                    words, turns = np.unique(ids[rare_at[cuts[i] : cuts[i + 1]]], return_inverse=True)
                    rare.append(words.view(np.int64))
                    turn.append(turns.astype(np.int32))
                columns = [
                    pa.array(lengths.astype(np.int64)),
                    pa.array(np.add.reduceat((there & ~ended if model.ends == 0 else there).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(np.where(there, log_n[at], 0.0), starts)),
                    pa.array(np.add.reduceat(np.where(there, log_emitted[at], 0.0), starts)),
                    pa.array([path[a : a + k].tobytes() for a, k in zip(starts, lengths)], pa.binary()),
                    pa.array(row + np.arange(len(lengths))),
                    pa.array(rare, pa.list_(pa.int64())),
                    pa.array(turn, pa.list_(pa.int32())),
                ]
                row += len(lengths)
                own = [batch.column(c).slice(at_row, len(lengths)) for c in schema.names[: len(schema) - len(columns)]]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=schema.names)
                at_row += len(lengths)

    return run


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where the lists begin, and one end, in the joined values."""
    return column.offsets.to_numpy(), column.values


def _ended(log_size: np.ndarray, schema: T.StructType):
    """Rare words set into the rows of ``_begun``; those that were not found have the class of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, logs, class_logs = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("n_known", "logs", "class_logs"))
            paths = batch.column("path").to_pylist()
            (rare_cuts, rare), (turn_cuts, turn), (found_cuts, found) = (_lists(batch.column(c)) for c in ("rare", "turn", "found"))
            rare, turn = rare.to_numpy(zero_copy_only=False), turn.to_numpy(zero_copy_only=False)
            place, class_, times = (found.field(c).to_numpy(zero_copy_only=False) for c in ("place", "class", "n"))
            for i in np.flatnonzero(np.diff(rare_cuts)):
                own = CLASSES + (rare[rare_cuts[i] : rare_cuts[i + 1]] & (BANDS - 1))
                n = np.zeros(len(own))
                hits = slice(found_cuts[i], found_cuts[i + 1])
                own[place[hits]], n[place[hits]] = class_[hits], times[hits]
                turns = turn[turn_cuts[i] : turn_cuts[i + 1]]
                path = np.frombuffer(paths[i], np.uint8).copy()
                path[path == RARE] = own[turns]
                paths[i] = path.tobytes()
                here = np.bincount(turns, minlength=len(own))
                log_n = np.log10(n + ADD)
                known[i] += here[n > 0].sum()
                logs[i] += here @ log_n
                class_logs[i] += here @ (log_n - log_size[own])
            done = {"n_known": pa.array(known), "logs": pa.array(logs), "class_logs": pa.array(class_logs), "path": pa.array(paths, pa.binary())}
            yield pa.RecordBatch.from_arrays([done[c] if c in done else batch.column(c) for c in schema.names], names=schema.names)

    return run


def class_paths(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """Every document without its text: (n_tokens, n_known, logs, class_logs, path).

    ``path`` has the class of every token, a byte each; ``logs`` sums the logs of the
    counts of its tokens, and ``class_logs`` those of its words in their classes.
    """
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *_SUMS, *_OPEN])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    parts = stored(docs.select(*[f.name for f in kept], "text").mapInArrow(_begun(shared, schema), schema), "class-paths")
    looked = parts.select("row", F.posexplode("rare").alias("place", "word")).join(rare, "word")
    looked = looked.groupBy("row").agg(F.collect_list(F.struct("place", "class", "n")).alias("found"))
    none = F.array().cast("array<struct<place: int, class: bigint, n: bigint>>")
    rows = parts.join(looked, "row", "left").withColumn("found", F.coalesce("found", none))
    whole = T.StructType([*kept, *_SUMS])
    return stored(rows.mapInArrow(_ended(model.log_size, whole), whole), "class-paths")


def _steps(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all tokens and of those before them; every text ends with the end token."""
    now = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8).astype(np.int64)
    return np.concatenate([[WIDTH - 1], now[:-1]]), now


def _count_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WIDTH * WIDTH, np.int64)
    for batch in batches:
        if batch.num_rows:
            before, now = _steps(batch)
            total += np.bincount(before * WIDTH + now, minlength=WIDTH * WIDTH)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])


def transitions(paths: DataFrame) -> np.ndarray:
    """Logs of the probabilities of each class after each, from the ``path`` of training documents."""
    pairs = paths.select("path").mapInArrow(_count_moves, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    moves = np.zeros(WIDTH * WIDTH)
    moves[pairs["pair"].to_numpy(np.int64)] = pairs["n"].to_numpy()
    moves = moves.reshape(WIDTH, WIDTH)
    return np.log10((moves + ADD) / (moves.sum(axis=1, keepdims=True) + ADD * WIDTH))


def score(paths: DataFrame, model: Model, log_transition: np.ndarray) -> DataFrame:
    """The columns of ``paths`` but its path, with base_score, score and perplexity for its logs."""
    kept = [f for f in paths.schema.fields if f.name not in ("logs", "class_logs", "path")]
    schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in ("logs", "value")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lengths = batch.column("n_tokens").to_numpy()
                steps = np.add.reduceat(log_transition[_steps(batch)], np.cumsum(lengths) - lengths)
                value = pa.array(batch.column("class_logs").to_numpy() + steps)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-1]], value], names=schema.names)

    floor = float(np.log10(model.tokens + ADD * (model.types + 1)))
    return paths.mapInArrow(run, schema).select(
        *[f.name for f in kept],
        (F.col("logs") - F.col("n_tokens") * floor).alias("base_score"),
        F.col("value").alias("score"),
        F.pow(F.lit(10.0), -F.col("value") / F.col("n_tokens")).alias("perplexity"),
    )


def scored(docs: DataFrame) -> DataFrame:
    """Scores of all documents; a fifth of the ids is held out of training."""
    held = remainder("doc_id", 5) == 1
    model, rare = train(docs.filter(~held))
    paths = class_paths(docs.select("doc_id", "text", held.alias("held_out")), model, rare)
    found = score(paths, model, transitions(paths.filter("NOT held_out")))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )
