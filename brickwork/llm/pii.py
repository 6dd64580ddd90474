"""Personal data by a character-level bidirectional LSTM with CRF transitions.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  Their
spans label windows of a sample of the texts (and rewritten forms of them: phone
numbers without the plus, cards in groups), from which the tagger learns.  It then
decodes overlapping windows of every text; each character takes the label of the
window in which it lies most centrally, and the spans of the joined labels that
pass the check of their kind and touch no base span are added.

Every kind needs a digit or an at sign, so windows without either hold no span and
are not decoded; all others are, over whole texts.

Defined results: null text is empty and has no spans; repeated rows give repeated
results; with nothing to learn from only base spans are returned; an empty table
gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm import tagger
from brickwork.llm.shared import small_batches
from brickwork.llm.tagger import KINDS, WIDTH

#: Sample of the fit: documents in expectation (half of them may hold a base span), and windows at most.
TRAIN_DOCS = 4000
TRAIN_WINDOWS = 1500
TRAIN_STEPS = 300
BATCH_WINDOWS = 64
STRIDE = WIDTH // 2
#: Windows decoded at once.
BATCH = 512

# The patterns of the base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Every base span matches one of these.
LIKELY = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){12}|\+[0-9][ ().0-9-]{7}"
EVIDENCE = re.compile(r"[0-9@]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def holds(kind: int, text: str) -> bool:
    """The check of a kind, beyond its pattern."""
    digits = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]+", text))
    if kind == 1:
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and int(p[-4:]) <= 255 and len(p) < 5 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_candidates(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans as (kind, start, end), in order, and the places of failed matches."""
    spans: list[Span] = []
    failed: list[tuple[int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            spans.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        place = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            ok = all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four)
            spans.append((1, place, place + size)) if ok else failed.append((place, place + size))
            place += size + 1
    for kind, pattern in ((2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            digits = _digits(m.group())
            if (13 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 9 <= len(digits) <= 15:
                spans.append((kind, m.start(), m.end()))
            elif len(digits) > 7:
                failed.append((m.start(), m.end()))
    return spans, failed


def base_spans(text: str) -> list[Span]:
    return base_candidates(text)[0]


def joined(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def window_starts(text: str) -> list[int]:
    """Starts of the windows, half a window apart, that hold a digit or an at sign."""
    out: set[int] = set()
    for m in EVIDENCE.finditer(text):
        first = max(m.start() // STRIDE - 1, 0)
        out.update(range(first, (m.end() - 1) // STRIDE + 1))
    return [STRIDE * w for w in sorted(out)]


def windows_of(text: str, starts: list[int]) -> np.ndarray:
    """Classes [n, WIDTH]; spaces stand beyond the end."""
    padded = np.append(tagger.classes_of(text), np.full(WIDTH, 32, np.uint8))
    return padded[np.array(starts, np.int64)[:, None] + np.arange(WIDTH)]


def reconcile(size: int, starts: list[int], labels: np.ndarray) -> list[Span]:
    """Spans of a whole text from the labels of its windows.

    A character belongs to the window in which it is farther from the border, or
    to the only one that covers it.
    """
    spans: list[Span] = []
    quarter = STRIDE // 2
    whole: dict[int, np.ndarray] = {}
    for start, own in zip(starts, labels):
        for half in (0, 1):
            at = start // STRIDE + half
            part = own[half * STRIDE : (half + 1) * STRIDE]
            if at not in whole:
                whole[at] = part.copy()
            elif half == 0:
                whole[at][quarter:] = part[quarter:]
    run_end, run = -1, []
    pieces: list[tuple[int, np.ndarray]] = []
    for at in sorted(whole):
        if at * STRIDE != run_end and run:
            pieces.append((run_end - STRIDE * len(run), np.concatenate(run)))
            run = []
        run.append(whole[at])
        run_end = (at + 1) * STRIDE
    if run:
        pieces.append((run_end - STRIDE * len(run), np.concatenate(run)))
    for offset, own in pieces:
        at = 0
        inside = np.flatnonzero(own)
        for i in inside:
            if i < at:
                continue
            kind = (int(own[i]) - 1) // 2
            at = i + 1
            while at < len(own) and own[at] == 2 + 2 * kind:
                at += 1
            spans.append((kind, offset + int(i), min(offset + at, size)))
    return spans


def added_spans(text: str, found: list[Span], base: list[Span]) -> list[Span]:
    """Tagged spans without surrounding space, that pass their check and touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for kind, a, b in found:
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip(" \t\r\n,;:")), a + len(piece.rstrip(" \t\r\n,;:."))
        # The first base span that ends after this one starts decides.
        at = int(np.searchsorted([t[1] for t in taken], a, "right")) if taken else 0
        clear = at >= len(taken) or taken[at][0] >= b
        if a < b and clear and holds(kind, text[a:b]):
            out.append((kind, a, b))
    return out


def _rewritten(piece: str, kind: int, draw: int) -> str | None:
    """Another form of a labelled span that no base pattern finds."""
    digits = _digits(piece)
    if kind == 3:
        local = digits[-10:] if len(digits) >= 10 else digits
        return (f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}")[draw % 3]
    if kind == 2 and len(digits) == 16:
        return (".", "/", "_")[draw % 3].join(digits[i : i + 4] for i in range(0, 16, 4))
    return None


def _labelled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(draw, window classes, labels) of texts: windows with spans, without, and rewritten."""
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans, failed = base_candidates(text)
            texts = [(text, spans, failed)]
            if spans:
                draw = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                pieces, moved, at = [], [], 0
                for kind, a, b in sorted(spans, key=lambda s: s[1]):
                    new = _rewritten(text[a:b], kind, draw)
                    if a < at or new is None:
                        continue
                    pieces.append(text[at:a])
                    begin = sum(map(len, pieces))
                    pieces.append(new)
                    moved.append((kind, begin, begin + len(new)))
                    at = b
                if moved:
                    changed = "".join(pieces) + text[at : at + WIDTH]
                    texts.append((changed, moved + [s for s in base_spans(changed) if not any(s[1] < m[2] and m[1] < s[2] for m in moved)], []))
            for line, own, skip in texts:
                starts = window_starts(line)
                if not starts:
                    continue
                classes = windows_of(line, starts)
                marks = np.zeros(len(line) + WIDTH, np.uint8)
                for kind, a, b in sorted(own, reverse=True):
                    marks[a], marks[a + 1 : b] = 1 + 2 * kind, 2 + 2 * kind
                labels = marks[np.array(starts)[:, None] + np.arange(WIDTH)]
                for start, x, y in zip(starts, classes, labels):
                    if any(a < start + WIDTH and start < b for a, b in skip):
                        continue
                    rows.append((x.tobytes(), y.tobytes()))
        columns = list(zip(*rows)) if rows else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["x", "y"])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> dict | None:
    """Parameters of the tagger, from the base spans of a sample of ``docs``."""
    # Texts that may hold a base span are drawn on their own: they may be rare.
    likely = F.coalesce(F.col("text").rlike(LIKELY), F.lit(False))
    rows = docs.select("text", likely.alias("likely"))
    found = {r["likely"]: r["count"] for r in rows.groupBy("likely").count().collect()}
    if not found.get(True):
        return None
    reach = {k: int(min(1.0, train_docs / 2 / n) * (1 << 30)) for k, n in found.items()}
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    sample = rows.filter(draw <= F.when(F.col("likely"), reach[True]).otherwise(reach.get(False, 0))).select("text")
    rows = sample.mapInArrow(_labelled_windows, "x binary, y binary").distinct()
    kind = F.when(F.expr("translate(hex(y), '0', '') = ''"), 0).otherwise(1)
    rows = rows.withColumn("kind", kind).withColumn("draw", F.xxhash64("x", "y"))
    # Three quarters of the windows hold a span.
    parts = [rows.filter(F.col("kind") == k).orderBy("draw").limit(n).toPandas() for k, n in ((1, train_windows * 3 // 4), (0, train_windows // 4))]
    if not len(parts[0]):
        return None
    x, y = (np.frombuffer(b"".join(c for p in parts for c in p[name]), np.uint8).reshape(-1, WIDTH) for name in "xy")
    return tagger.fit(x, y.astype(np.int64), epochs=-(-TRAIN_STEPS // -(-len(x) // BATCH_WINDOWS)), batch=BATCH_WINDOWS)


def spans_of(texts: list[str | None], model: dict | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and added spans of every text."""
    base = [base_spans(t or "") for t in texts]
    added: list[list[Span]] = [[] for _ in base]
    held: list[tuple[int, str, list[int]]] = []

    def settle() -> None:
        windows = np.concatenate([windows_of(t, s) for _, t, s in held])
        # Equal windows have equal labels.
        kinds, back = np.unique(windows, axis=0, return_inverse=True)
        labels = np.concatenate([tagger.decode(model, kinds[i : i + BATCH]) for i in range(0, len(kinds), BATCH)])[back.ravel()]
        at = 0
        for i, text, starts in held:
            found = reconcile(len(text), starts, labels[at : at + len(starts)])
            added[i] = added_spans(text, found, base[i])
            at += len(starts)

    count = 0
    for i, text in enumerate(texts):
        starts = window_starts(text) if model and text else []
        if starts:
            held.append((i, text, starts))
            count += len(starts)
            if count >= 8 * BATCH:
                settle()
                held, count = [], 0
    if held:
        settle()
    return base, added


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, ``base`` and ``added`` spans (kind, start, end) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("base", span), T.StructField("added", span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = spans_of(batch.column("text").to_pylist(), shared.value)
            out = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(own)] for own in side], arrow) for side in sides]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _text_of(spans: Column) -> Column:
    """kind:start:end, by kind as listed and start, comma-joined."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = find(docs, train(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.concat("base", "added")).alias("spans"),
    )


def _masked(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with each stretch of overlapping spans replaced by the name of its first kind."""
    if not spans:
        return text
    out, at, end = [], 0, 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by the name of its kind; ``n_chars`` follows the new text.

    Only the text goes to Python, which finds and masks in one pass; the other columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    small_batches(docs.sparkSession)

    def mask(texts: pa.Array) -> pa.Array:
        own = texts.to_pylist()
        base, added = spans_of(own, shared.value)
        return pa.array([_masked(t, [*b, *a]) for t, b, a in zip(own, base, added)], pa.string())

    out = docs.withColumn("text", F.arrow_udf(mask, T.StringType())("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
