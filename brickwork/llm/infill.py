"""Fill-in-the-middle texts, cut at exact ranks found in an indexable skip list.

A text is a sequence of units: a word with the white space before it, or the white
space at the end.  Two hashed ranks among the units bound the middle.  An indexable
skip list over the units answers where a rank lies: the bottom lane has a node for
every unit, each express lane a node for ``FAN`` nodes of the lane below, and every
node carries the units and the code points that it spans.  A search starts in the
topmost lane, passes nodes while their units fit into the rank that is left, adds up
their code points, and goes down a lane where the next node would pass the rank; so
both cuts are exact code-point positions after a few steps, at any length of text.

Only the text and two hashes go to Python, which returns three numbers; the pieces
are cut and joined by Spark.

Defined results: null text is empty; an empty text has no units and is plain; a null
id is hashed as empty text; repeated rows give repeated results; texts of any length
are handled whole; an empty table gives an empty result; columns other than id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nodes of a lane that one node of the lane above spans.
FAN = 16
SEED = 42
#: Hundredths of the texts that are transformed, and of those with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "lower", "upper")])


def unit_ends(text: str) -> np.ndarray:
    """Code-point ends of the units of ``text``, ascending."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.empty(0, np.int64)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    # A word ends before white space; the last unit, word or white space, ends with the text.
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(points))


class SkipList:
    """Lanes of (units, code points) that their nodes span; lane 0 has a node for every unit."""

    def __init__(self, ends: np.ndarray, fan: int = FAN):
        self.fan = fan
        lane = np.stack([np.ones(len(ends), np.int64), np.diff(ends, prepend=0)])
        self.lanes = [lane]
        while lane.shape[1] > fan:
            lane = np.add.reduceat(lane, np.arange(0, lane.shape[1], fan), axis=1)
            self.lanes.append(lane)

    def reach(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        node, left, passed = 0, rank, 0
        for units, points in reversed(self.lanes):
            node *= self.fan
            while left and node < len(units) and units[node] <= left:
                left -= int(units[node])
                passed += int(points[node])
                node += 1
        return passed


@F.arrow_udf(CUTS)
def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    rows = []
    for text, a, b in zip(texts, first.to_pylist(), second.to_pylist()):
        ends = unit_ends(text.as_py())
        lanes, n = SkipList(ends), len(ends)
        rows.append((n, *map(lanes.reach, sorted((a % (n + 1), b % (n + 1))))))
    columns = zip(*rows) if rows else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "lower", "upper"])


def _hashes(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def infilled(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Every text of ``docs`` (doc_id, text) in its form.

    Returns doc_id, n (units), form (plain, spm or psm), prefix_chars and middle_chars
    (code points, null if plain) and the text ``output``.
    """
    h = _hashes(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit("")).alias("text")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(mark)
    form = (
        F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= transformed), "plain")
        .when(F.col("h4") % 100 < suffix_first, "spm")
        .otherwise("psm")
    )
    rows = docs.select("doc_id", text, *[x.alias(f"h{k + 1}") for k, x in enumerate(h)])
    rows = rows.select("doc_id", "text", form.alias("form"), _cuts("text", "h1", "h2").alias("cut"))
    lower, upper = F.col("cut.lower").cast("int"), F.col("cut.upper").cast("int")
    prefix = F.substring("text", F.lit(1), lower)
    middle = F.substring("text", lower + 1, upper - lower)
    suffix = F.substring("text", upper + 1, F.length("text"))
    p, s, m = map(F.lit, (PREFIX, SUFFIX, MIDDLE))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(cut, F.col("cut.lower")).alias("prefix_chars"),
        F.when(cut, F.col("cut.upper") - F.col("cut.lower")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The original text of an output; no piece holds a mark, so the marks divide it uniquely."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def digests(docs: DataFrame) -> DataFrame:
    """``infilled`` with digests of the output and of the text rebuilt from it."""
    return infilled(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), hashed AS (
  SELECT doc_id, t, u, len(u) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM units
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), pieces AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""
