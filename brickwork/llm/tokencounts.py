"""Token counts of whole texts, from piece counts of distinct pre-tokens.

A vocabulary splits a text into pre-tokens and each pre-token into pieces on its own,
so a text has as many tokens as its pre-tokens have pieces.  One pass over the texts
stores the pre-token frequencies of every document; the distinct pre-tokens of all
documents are split into pieces once each and only their number is kept; documents
get their sums by a join.  Token ids are never made.

Pre-tokens that stand in many documents are few: the commonest are sent to every
task, at most ``COMMON`` of at most ``COMMON_CHARS`` characters.  All others are joined
by a shuffle, where none can be hot, as the hot ones are among the former.

Splitting is the vocabulary's own normalizer and pre-tokenizer.  Where white space
separates pre-tokens (as is found out at the start), words between white space are
split on their own.  Where the vocabulary lowers letters and splits by a pattern, the
same pattern splits texts of printable characters below U+0300 directly: there are no
combining marks there, so composing changes nothing, and lower case of a letter does
not depend on its neighbours.  A word that may spell an added token, such as the mark
of a text's end, is kept whole and counted by the complete vocabulary, since added
tokens are looked for before anything else.

Defined results: null text is empty and has no bytes and no tokens; rows are counted
one by one, so repeated rows and ids, null ids too, give repeated results; texts of any
length are handled whole; an empty table gives an empty result; columns other than id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm.shared import SPACE, stored

#: Most pre-tokens that are sent to every task, and their longest.
COMMON, COMMON_CHARS = 1 << 17, 64
#: Words that a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 1 << 17, 64
#: Pre-tokens in one Arrow batch of frequencies.
BATCH_PIECES = 1 << 18
LIMIT = 2048
#: Any other character than white space and printable ones below U+0300.
UNUSUAL = re.compile(f"[^{SPACE}\\x21-\\x7E\\u00A1-\\u02FF]")
#: Byte-level characters: printable bytes stand for themselves, the others follow U+0100 in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
#: Leads a word that is counted by the complete vocabulary; no pre-token holds it.
WHOLE = "\x00"


def _own_pattern(settings: dict) -> regex.Pattern | None:
    """The pattern of a vocabulary that composes, lowers, splits by it, and maps bytes; None for all others."""
    lowered = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    if settings["normalizer"] != lowered or (settings["pre_tokenizer"] or {}).get("type") != "Sequence":
        return None
    steps = settings["pre_tokenizer"]["pretokenizers"]
    split = {"type": "Split", "behavior": "Removed", "invert": True}
    levels = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    if len(steps) != 2 or any(step.get(k) != v for step, want in zip(steps, (split, levels)) for k, v in want.items()):
        return None
    return regex.compile(steps[0]["pattern"]["Regex"]) if "Regex" in steps[0]["pattern"] else None


class PreTokens:
    """Pre-tokens of texts; ``pieces`` gives the number of tokens of one of them."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as file:
            settings = json.load(file)
        self.own = Tokenizer.from_file(vocabulary)
        self.own.no_truncation()
        self.own.no_padding()
        added = [t.content for t in self.own.get_added_tokens_decoder().values()]
        # The first two characters tell words that need a closer look.
        self.marks = tuple({a[:2] for a in added})
        self.words = re.compile(f"[^{SPACE}]+") if self._spaces_separate() else re.compile(r"(?s).+")
        self.pattern = _own_pattern(settings) if self._spaces_separate() else None
        self.known: dict[str, tuple[str, ...]] = {}

    def _split(self, text: str) -> tuple[str, ...]:
        if self.own.normalizer:
            text = self.own.normalizer.normalize_str(text)
        if not self.own.pre_tokenizer:
            return (text,)
        return tuple(p for p, _ in self.own.pre_tokenizer.pre_tokenize_str(text))

    def _spaces_separate(self) -> bool:
        parts = ["ab", "1", "c'd", "-"]
        alone = tuple(p for x in parts for p in self._split(x))
        return all(self._split(gap.join(["", *parts, ""])) == alone for gap in (" ", "\t", "\n", "\x0b", "\x0c", "\r", " \n "))

    def _usual(self, text: str) -> bool:
        return self.pattern is not None and not UNUSUAL.search(text) and not any(m in text for m in self.marks)

    def of_word(self, word: str) -> tuple[str, ...]:
        got = self.known.get(word)
        if got is None:
            got = (WHOLE + word,) if any(m in word for m in self.marks) else self._split(word)
            if len(word) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = got
        return got

    def counts(self, text: str) -> Counter[str]:
        if self._usual(text):
            found = Counter(self.pattern.findall(text.lower()))
            rest: dict[str, int] = {}
        else:
            found, rest = Counter(), {}
            for word, n in Counter(self.words.findall(text)).items():
                if self._usual(word):
                    for pre in self.pattern.findall(word.lower()):
                        found[pre] += n
                else:
                    rest[word] = n
        out = Counter({p if p.isascii() else p.encode().decode("latin-1").translate(BYTES): n for p, n in found.items()})
        for word, n in rest.items():
            for pre in self.of_word(word):
                out[pre] += n
        return out

    def pieces(self, pre: str) -> int:
        if pre.startswith(WHOLE):
            return len(self.own.encode(pre[1:], add_special_tokens=False).ids)
        return len(self.own.model.tokenize(pre))


def frequencies(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: a row number, doc_id, bytes, and the frequencies of its pre-tokens."""
    counted = T.ArrayType(T.StructType().add("pre", "string").add("times", "long"))
    schema = T.StructType().add("row", "long").add("doc_id", docs.schema["doc_id"].dataType).add("n_bytes", "long").add("counts", counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PreTokens(vocabulary)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("text")
            at, ends, pres, times = 0, [0], [], []
            for i in range(len(texts)):
                counts = own.counts(texts[i].as_py() or "")
                pres += counts.keys()
                times += counts.values()
                ends.append(len(pres))
                if len(pres) >= BATCH_PIECES or i + 1 == len(texts):
                    n = i + 1 - at
                    lists = pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()),
                        pa.StructArray.from_arrays([pa.array(pres, pa.string()), pa.array(times, pa.int64())], names=["pre", "times"]),
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(row, row + n), pa.int64()), *(batch.column(c).slice(at, n) for c in ("doc_id", "n_bytes")), lists],
                        names=schema.names,
                    )
                    at, row, ends, pres, times = i + 1, row + n, [0], [], []

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), "text").mapInArrow(count, schema)


def piece_counts(pres: DataFrame, vocabulary: str) -> DataFrame:
    """``pres`` (pre, times), one row per distinct pre-token, with the number of its pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PreTokens(vocabulary)
        for batch in batches:
            pieces = pa.array([own.pieces(p) for p in batch.column("pre").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], names=[*batch.schema.names, "pieces"])

    return pres.mapInArrow(count, T.StructType([*pres.schema.fields, T.StructField("pieces", T.LongType())]))


def common_and_rare(pieces: DataFrame, common: int) -> tuple[DataFrame, DataFrame]:
    """``pieces`` split at a frequency, so that at most ``common`` short pre-tokens are above it."""
    short = F.length("pre") <= COMMON_CHARS
    level = F.floor(F.log2("times")).cast("int")
    # One row for each power of two.
    levels = {r.level: r.n for r in pieces.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, room = 64, common
    for k in sorted(levels, reverse=True):
        room -= levels[k]
        if room < 0:
            break
        least = k
    often = short & (level >= least)
    return pieces.where(often), pieces.where(~often)


def counted(docs: DataFrame, vocabulary: str, limit: int = LIMIT, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for every row of ``docs``."""
    table = stored(frequencies(docs, vocabulary), "pretokens")
    each = table.select("row", F.inline("counts"))
    distinct = each.groupBy("pre").agg(F.count("*").alias("times"))
    pieces = stored(piece_counts(distinct, vocabulary), "pieces")
    often, rare = (x.select("pre", "pieces") for x in common_and_rare(pieces, common))
    part = F.sum(F.col("times") * F.col("pieces")).alias("tokens")
    # The tokens of a row are summed in the task that holds it, before anything is shuffled.
    sums = each.join(F.broadcast(often), "pre").groupBy("row").agg(part)
    others = each.join(F.broadcast(often.select("pre")), "pre", "left_anti")
    sums = sums.unionByName(others.join(rare, "pre").groupBy("row").agg(part))
    rows = table.select("row", "doc_id", "n_bytes", F.lit(0).cast("long").alias("tokens"))
    total = rows.unionByName(sums, allowMissingColumns=True).groupBy("row")
    total = total.agg(F.first("doc_id", True).alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
