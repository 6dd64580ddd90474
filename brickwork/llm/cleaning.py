"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: it fails when it ends without sentence
punctuation and is short, when it is mostly separators, or when it carries a
boilerplate phrase.  Failed lines are removed, and a document that loses too
much of its text this way is rejected.  Whole-document counts (words, symbols,
repeated lines, repeated 8-word windows) are taken beside it.

Defined results: null text has no words and fails; empty lines neither pass nor
fail; repeated rows give repeated results; an empty table gives an empty result;
other columns are kept out of the way by nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.text import fence
from brickwork.llm.shared import SPACE

WINDOW = 8
MIN_WORDS = 20
#: Highest percentage of words in repeated windows.
REPEATED_PERCENT = 30
#: A line of fewer words must end in sentence punctuation.
SHORT_LINE = 8
#: Highest share of separator characters in a line, in percent.
SEPARATOR_PERCENT = 10
#: Least share of the text, in percent, that must survive.
KEPT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"

# Phrases of page furniture, in lower case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign up for our newsletter",
    "skip to content",
    "terms of service",
    "terms of use",
)


def _has_boilerplate(text: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | text.contains(phrase)
    return found


def _line_passes(line: Column, check_phrases: Column) -> Column:
    ends = line.rlike(rf"[.!?:;…。！？][\"'”’»)\]#*$%&|<>]*[{SPACE}]*$")
    is_long = line.rlike(rf"^[{SPACE}]*(?:[^{SPACE}]+[{SPACE}]+){{{SHORT_LINE - 1}}}[^{SPACE}]")
    separators = F.length(line) - F.length(F.regexp_replace(line, r"[|<>»•·#*$%&~^\\]", ""))
    navigation = separators * 100 > F.length(line) * SEPARATOR_PERCENT
    boilerplate = check_phrases & _has_boilerplate(F.lower(line))
    return (ends | is_long) & ~navigation & ~boilerplate


def _covered(at: Column) -> Column:
    """Words covered by windows that start at the ascending positions ``at``."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        at,
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` as the struct ``doc``, its counts, ``clean_text`` and the verdicts.

    Filters on the result are not pushed into the steps, which would repeat them.
    """
    rows = _judged(docs)
    return fence(rows, rows.columns)


def _judged(docs: DataFrame) -> DataFrame:
    """Steps that later ones use twice are columns of their own, so that they are
    computed once for a row.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", f"[{SPACE}]+"), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    rows = rows.withColumn("phrases", _has_boilerplate(F.lower("text")))
    n = F.size("words")
    rows = rows.select(
        "doc",
        "lines",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("lines", lambda x: _line_passes(x, F.col("phrases"))).alias("kept_lines"),
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(repeated, ordered))

    def twice(x: Column, k: Column) -> Column:
        last = F.size("ordered") - 1
        return ((k > 0) & (F.get("ordered", F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | (
            (k < last) & (F.get("ordered", F.least(k + 1, last))["h"] == x["h"])
        )

    at = F.array_sort(F.transform(F.filter("ordered", twice), lambda x: x["i"]))
    n_repeat = F.coalesce(_covered(at), F.lit(0)).cast("long")
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x))
    kept = F.aggregate("kept_lines", F.lit(0), lambda a, x: a + F.length(x))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    rows = rows.select(
        "doc",
        *counts,
        n_repeat.alias("n_repeat_words"),
        F.size("kept_lines").alias("n_kept_lines"),
        F.array_join("kept_lines", "\n").alias("clean_text"),
        (kept * 100 >= total * KEPT_PERCENT).alias("enough_left"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("enough_left"))


def quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return fence(_judged(docs.select("doc_id", "text")).select("doc.doc_id", *names), ("doc_id", *names))


_SQL_BOILERPLATE = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^{SPACE}]+') AS words FROM d),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
j AS (SELECT r, line, length(line) AS len,
        (regexp_matches(line, '[.!?:;…。！？]["''”’»)\]#*$%&|<>]*[{SPACE}]*$')
         OR len(regexp_extract_all(line, '[^{SPACE}]+')) >= {SHORT_LINE})
        AND NOT 100 * (length(line) - length(regexp_replace(line, '[|<>»•·#*$%&~^\\]', '', 'g'))) > {SEPARATOR_PERCENT} * length(line)
        AND NOT ({_SQL_BOILERPLATE}) AS ok
      FROM l WHERE regexp_matches(line, '[^{SPACE}]')),
k AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(len) AS total, coalesce(sum(len) FILTER (WHERE ok), 0) AS kept
      FROM j GROUP BY r),
i AS (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW}),
g AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM i),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
p AS (SELECT r, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - {WINDOW})) AS fresh FROM m WHERE c > 1),
q AS (SELECT r, sum(fresh) AS n FROM p GROUP BY r),
a AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
        CAST(coalesce(k.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(100 * k.kept >= {KEPT_PERCENT} * k.total, true) AS enough
      FROM w LEFT JOIN k USING (r) LEFT JOIN q USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words) AND enough AS kept
FROM a
"""
