"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens (its documents one after another).  The
token axis of the result is divided into equal periods; period ``b`` of ``B``
holds the tokens ``[T*b/B, T*(b+1)/B)`` of a queue with ``T`` tokens.  The deficit
with which each queue enters a period follows from these bounds alone, so the
periods are scheduled in parallel and still carry deficits from one to the
next.  Inside a period every window credits each queue with its share of the
window; queues whose deficit has reached a quantum are served in turn, and
what is left over is carried to the next window.  All windows but the very
last are full.

Defined results: null or empty text is the end token alone; a null source is a
queue of its own; repeated rows and repeated ids are packed as separate
documents; an empty table gives an empty result; columns other than id, text
and source are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brickwork.llm.shared import prefix_sums, queue_key, stored

WINDOW = 2048
QUANTUM = 512
END_ID = 1
#: Tokens of one period, the unit of parallel work.
PERIOD = 1 << 18
#: Most rows of queue positions that are broadcast.
PLACES = 200_000
#: Bytes of token ids in one Arrow batch.
BATCH_BYTES = 8 << 20


def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


class Encoder:
    """Token ids of whole texts by a byte-level BPE vocabulary.

    ``ranks`` is the same vocabulary as merge ranks and is read by the faster of
    two libraries; texts that spell a special token go through the vocabulary
    file itself, which alone knows such tokens.
    """

    def __init__(self, vocabulary: str, ranks: str | None, special: tuple[str, ...]):
        self.vocabulary, self.special = vocabulary, special
        self.full = self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            # Loaded when first needed, as it takes far more memory than the ranks.
            self.full = self.full or _tokenizer(self.vocabulary)
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _token_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("queue", T.StringType()),
            T.StructField("part", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )


def tokenized(docs: DataFrame, vocabulary: str, ranks: str | None, end_id: int = END_ID) -> DataFrame:
    """One row per document: ids as little-endian uint32, and its place in its part of the queue."""
    schema = _token_schema(docs.schema["doc_id"].dataType)
    special = tuple(t.content for t in _tokenizer(vocabulary).get_added_tokens_decoder().values())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, ranks, special)
        part = TaskContext.get().partitionId()
        done: dict[str, int] = {}
        for batch in batches:
            at = 0
            rows: list[tuple] = []
            size = 0
            queues = batch.column("queue").to_pylist()
            texts = batch.column("text")
            for i, queue in enumerate(queues):
                ids = np.array([*encoder(texts[i].as_py() or ""), end_id], dtype="<u4")
                start = done.get(queue, 0)
                done[queue] = start + len(ids)
                rows.append((queue, part, start, len(ids), ids.tobytes()))
                size += ids.nbytes
                if size >= BATCH_BYTES or i + 1 == len(queues):
                    columns = [pa.array(c) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(at, len(rows)), *columns], names=schema.names
                    )
                    at, rows, size = i + 1, [], 0

    return docs.select("doc_id", "queue", "text").mapInArrow(encode, schema)


def _period_rows(periods: int, with_ids: bool):
    """Cut documents at the period bounds of their queue."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch.to_pydict()
            out: list[tuple] = []
            for i, (queue, total, lo, n) in enumerate(zip(wide["queue"], wide["total"], wide["lo"], wide["tokens"])):
                at = lo
                while at < lo + n:
                    period = ((at + 1) * periods - 1) // total
                    upto = min(lo + n, total * (period + 1) // periods)
                    out.append((i, period, queue, total, at, at - lo, upto - at))
                    at = upto
            cols = list(zip(*out)) if out else [[]] * 7
            rows = [pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.string(), *[pa.int64()] * 4))]
            names = ["period", "queue", "total", "lo", "start", "length"]
            if with_ids:
                pick = pa.array(cols[0], pa.int64())
                ids = wide["ids"]
                rows += [
                    batch.column("doc_id").take(pick),
                    batch.column("tokens").take(pick),
                    pa.array([ids[r[0]][4 * r[5] : 4 * (r[5] + r[6])] for r in out], pa.binary()),
                ]
                names += ["doc_id", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(rows, names=names)

    return cut


def schedule(tokens: list[int], shares: list[float], deficits: list[float], first: int, window: int, quantum: int) -> list[tuple[int, int, int]]:
    """Deficit round-robin from position ``first`` until all queues are empty.

    Returns (queue number, length, position); no segment crosses a window bound.
    A queue is served when its deficit has reached a quantum or all that it
    still has; when none has, the one with the largest deficit fills the window.
    """
    left = np.array(tokens, dtype=np.int64)
    share, credit = np.array(shares), np.array(deficits, dtype=float)
    at, end, turn = first, first + int(left.sum()), 0
    out: list[list[int]] = []
    while at < end:
        room = min(window - at % window, end - at)
        opened = at
        credit += room * share
        while room:
            ready = np.flatnonzero((left > 0) & (credit >= np.minimum(quantum, left)))
            if len(ready):
                after = ready[ready >= turn]
                q = int(after[0] if len(after) else ready[0])
                take = min(int(credit[q]), int(left[q]), room)
            else:
                q = int(np.argmax(np.where(left > 0, credit, -np.inf)))
                take = min(quantum, int(left[q]), room)
            take = max(take, 1)
            turn = q + 1
            credit[q] -= take
            left[q] -= take
            if out and out[-1][0] == q and out[-1][2] >= opened:
                out[-1][1] += take
            else:
                out.append([q, take, at])
            at += take
            room -= take
    return [tuple(s) for s in out]


def _pack_period(periods: int, all_tokens: int, window: int, quantum: int, columns: list[str]):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["queue", "lo"], kind="stable")
        period, first = int(rows["period"].iloc[0]), int(rows["first"].iloc[0])
        grouped = list(rows.groupby("queue", sort=True))
        totals = [int(g["total"].iloc[0]) for _, g in grouped]
        segments = schedule(
            [int(g["length"].sum()) for _, g in grouped],
            [t / all_tokens for t in totals],
            [t * first / all_tokens - t * period // periods for t in totals],
            first,
            window,
            quantum,
        )
        sources = [iter(g[["doc_id", "start", "length", "doc_tokens", "ids"]].itertuples(index=False)) for _, g in grouped]
        open_rows = [(None, 0)] * len(sources)
        out = []
        for q, length, at in segments:
            while length:
                row, used = open_rows[q]
                if row is None:
                    row, used = next(sources[q]), 0
                take = min(length, row.length - used)
                ids = row.ids[4 * used : 4 * (used + take)]
                out.append((row.doc_id, row.start + used, take, zlib.crc32(ids), row.doc_tokens, at // window, at % window))
                used += take
                open_rows[q] = (None, 0) if used == row.length else (row, used)
                length -= take
                at += take
        return pd.DataFrame(out, columns=columns)

    return pack


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, window: int = WINDOW, quantum: int = QUANTUM, end_id: int = END_ID, period: int = PERIOD) -> DataFrame:
    """Pieces of all documents of ``docs`` (doc_id, text, source), packed gaplessly.

    One row per piece: its place in its document (``start``, ``length``), the crc32
    of its ids, its document's tokens, and its place in the result
    (``sequence_id``, ``offset``).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", queue_key("source").alias("queue"))
    table = stored(tokenized(docs, vocabulary, ranks, end_id), "tokens")
    id_type = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    by_part = stored(table.groupBy("queue", "part").agg(F.sum("tokens").alias("sum")), "token-sums")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = by_part.select(
        "queue",
        "part",
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"),
        F.sum("sum").over(Window.partitionBy("queue")).alias("total"),
    )
    all_tokens, rows = by_part.agg(F.sum("sum"), F.count("*")).first()
    if all_tokens is None:
        return spark.createDataFrame([], out)
    # One row for each task and queue: sent to the tasks if small, else joined by a shuffle.
    places = F.broadcast(places) if rows <= PLACES else places
    periods = -(-all_tokens // period)
    placed = table.join(places, ["queue", "part"]).withColumn("lo", F.col("base") + F.col("start"))
    narrow = "period long, queue string, total long, lo long, start long, length long"
    cuts = placed.select("queue", "total", "lo", "tokens").mapInArrow(_period_rows(periods, False), narrow)
    lengths = cuts.groupBy("period").agg(F.sum("length").alias("length"))
    firsts = prefix_sums(lengths, [], "period", "length", "first").select("period", "first")
    wide = T.StructType.fromDDL(narrow).add("doc_id", id_type).add("doc_tokens", "long").add("ids", "binary")
    slices = placed.select("doc_id", "queue", "total", "lo", "tokens", "ids").mapInArrow(_period_rows(periods, True), wide)
    return (
        slices.join(firsts, "period")
        .groupBy("period")
        .applyInPandas(_pack_period(periods, all_tokens, window, quantum, out.names), out)
    )
