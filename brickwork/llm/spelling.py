"""Variants of a spelling by a dictionary of pairs of trie nodes.

The nodes of the trie of all words are numbered, and so are those of the trie of all
reversed words.  A word without its i-th letter is then a pair of integers (node of
the prefix before it, node of the suffix after it); a word with a gap at i is the pair
of the prefix and the suffix that meet there.  Words with the same pair at a left-out
letter differ by one replaced letter.  A word whose gap has the pair of another word's
left-out letter is that word with a letter deleted.  No other words are near.

Numbering: words are range-sorted.  In sorted order a word opens the nodes beyond what
it shares with the word before it, so a range is numbered in one pass that holds one
path.  Where a range starts inside branches of earlier ranges, its first numbers stand
for nodes of the last path there; one row for each range (its first and last word)
carries this over.  A word's last node is always opened by the word itself and serves
as its number; these numbers ascend in code-point order.

No pair of words is ever emitted: a pair of nodes is shared by at most as many words as
the alphabet has letters, and each of them takes the size of the group and the best of
the others.  Of a run of equal letters only the first may be left out when a deletion
is looked for, so each near word is counted once.

Defined results: null text has no words; a null id is hashed as empty text; repeated
rows are counted as often as they occur; words of any length are handled; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word, least letters, least occurrences.
LEAST_CHARS, LEAST_COUNT = 6, 5
#: A form occurs at least this many times as often as its variant.
FACTOR = 5
#: One run in so many loses a letter.
DAMAGED = 199
#: Words of one range, and their characters.
RANGE_WORDS, RANGE_CHARS = 100_000, 4_000_000
#: Nodes in one Arrow batch.
BATCH_NODES = 1 << 20


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """word, n: the damaged runs of letters of all texts that are long and frequent enough."""
    # Greedy runs of at least the wanted length are whole maximal runs; shorter ones can only get shorter.
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(rf"[a-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "key", "run"))
    each = each.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run"))
    return (
        each.select(word.alias("word"))
        .where(F.length("word") >= least_chars)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_count)
    )


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _number_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted keys of one range, numbered from 0; the first word opens all of its own."""
    before, path, fresh = "", [], 0
    for batch in batches:
        keys = batch.column("key")
        at, held, paths = 0, 0, []
        for i in range(len(keys)):
            key = keys[i].as_py()
            kept = _shared(before, key)
            path = path[:kept] + list(range(fresh, fresh + len(key) - kept))
            fresh += len(key) - kept
            before = key
            paths.append(path)
            held += len(path)
            if held >= BATCH_NODES or i + 1 == len(keys):
                own = batch.slice(at, len(paths))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(paths, pa.list_(pa.int64()))], names=[*batch.schema.names, "nodes"])
                at, held, paths = i + 1, 0, []


def trie_nodes(words: DataFrame, key: Column, out: str, ranges: int) -> DataFrame:
    """word and the array ``out``: the numbers of its trie nodes, the root (0) first, along ``key``."""
    spark = words.sparkSession
    ranged = words.select("word", key.alias("key")).repartitionByRange(ranges, "key").sortWithinPartitions("key")
    ranged = ranged.select("word", "key", F.spark_partition_id().alias("part"))
    numbered = stored(ranged.mapInArrow(_number_range, "word string, key string, part int, nodes array<long>"), f"trie-{out}")
    own = F.max_by(F.struct("key", "nodes"), "key").alias("last")
    fresh = (F.max(F.array_max("nodes")) + 1).alias("fresh")
    # One row for each range.
    bounds = numbered.groupBy("part").agg(F.min("key").alias("first"), own, fresh).orderBy("part").collect()
    rows, base, before, path = [], 1, "", []
    for b in bounds:
        old = path[: _shared(before, b.first)]
        rows.append((b.part, base, old))
        path = [old[x] if x < len(old) else base + x for x in b.last.nodes]
        before = b.last.key
        base += b.fresh
    carried = F.broadcast(spark.createDataFrame(rows, "part int, base long, old array<long>"))
    number = F.transform("nodes", lambda x: F.when(x < F.size("old"), F.get("old", x.cast("int"))).otherwise(x + F.col("base")))
    return numbered.join(carried, "part").select("word", F.concat(F.array(F.lit(0).cast("long")), number).alias(out))


def word_paths(words: DataFrame, ranges: int) -> DataFrame:
    """word, n, its number ``id``, its nodes in both tries and its letters."""
    paths = words.join(trie_nodes(words, F.col("word"), "heads", ranges), "word")
    paths = paths.join(trie_nodes(words, F.reverse("word"), "tails", ranges), "word")
    return paths.select(F.element_at("heads", -1).alias("id"), "word", "n", "heads", "tails", F.split("word", "").alias("letters"))


def node_pairs(paths: DataFrame) -> DataFrame:
    """id, n and the pairs of nodes (p, s) of every word.

    ``skip`` tells a left-out letter from a gap, ``first`` the first of a run of equal letters.
    """
    size = F.size("heads") - 1

    def pair(i: Column, skip: int) -> Column:
        first = (i == 0) | (F.get("letters", i) != F.get("letters", i - 1)) if skip else F.lit(False)
        tail = F.get("tails", size - i - skip)
        return F.struct(F.get("heads", i).alias("p"), tail.alias("s"), F.lit(bool(skip)).alias("skip"), first.alias("first"))

    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, 1))
    gaps = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, 0))
    return paths.select("id", "n", F.inline(F.concat(skips, gaps)))


def near_words(pairs: DataFrame) -> DataFrame:
    """id, n_near and the best near word of every word that has one: most occurrences, then smallest number."""
    rank = F.struct("n", (-F.col("id")).alias("minus_id"))
    member = F.struct(rank.alias("rank"), "first")
    groups = pairs.groupBy("p", "s").agg(
        # At most one word has this gap; at most one word for each letter of the alphabet has this left-out letter.
        F.max(F.when(~F.col("skip"), rank)).alias("gap"),
        F.sort_array(F.collect_list(F.when(F.col("skip"), member)), asc=False).alias("skips"),
    )
    groups = groups.where((F.size("skips") > 1) | (F.col("gap").isNotNull() & (F.size("skips") > 0)))
    groups = groups.withColumn("longer", F.filter("skips", lambda m: m["first"]))
    hit = lambda who, count, best: F.struct((-who["minus_id"]).alias("id"), count.cast("long").alias("count"), best.alias("best"))
    best, second = F.get("skips", F.lit(0))["rank"], F.get("skips", F.lit(1))["rank"]
    replaced = F.when(F.size("skips") > 1, F.transform("skips", lambda m: hit(m["rank"], F.size("skips") - 1, F.when(m["rank"] == best, second).otherwise(best))))
    some = F.col("gap").isNotNull() & (F.size("longer") > 0)
    deleted = F.when(some, F.transform("longer", lambda m: hit(m["rank"], F.lit(1), F.col("gap"))))
    inserted = F.when(some, F.array(hit(F.col("gap"), F.size("longer"), F.get("longer", F.lit(0))["rank"])))
    none = F.array().cast("array<struct<id:bigint,count:bigint,best:struct<n:bigint,minus_id:bigint>>>")
    hits = F.concat(*[F.coalesce(x, none) for x in (replaced, deleted, inserted)])
    return groups.select(F.inline(hits)).groupBy("id").agg(F.sum("count").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame, most: int, factor: int = FACTOR, least: int = LEAST_COUNT) -> DataFrame:
    """id, root of every row of ``forms`` (id, form) by doubling the steps.

    Occurrences grow by ``factor`` with each form, so chains are as short as the logarithm of ``most``.
    """
    longest = int(math.log(max(most / least, 1), factor)) + 1
    up = forms.select("id", F.col("form").alias("root"))
    for k in range(max(longest - 1, 0).bit_length()):
        up = stored(up, f"forms-{k}")
        further = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        up = up.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return up


def grouped(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, factor: int = FACTOR, damaged: int = DAMAGED, range_words: int = RANGE_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (doc_id, text)."""
    words = stored(word_counts(docs, least_chars, least_count, damaged), "words")
    size = words.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars"), F.max("n").alias("most")).first()
    ranges = 1 + max(size.rows // range_words, size.chars // RANGE_CHARS)
    paths = stored(word_paths(words, ranges), "word-paths")
    near = near_words(node_pairs(paths))
    most, form = F.col("best.n"), -F.col("best.minus_id")
    better = most >= factor * F.col("n")
    ids = paths.select("id", "word", "n").join(near, "id", "left").select(
        "id",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(better, form).alias("form"),
        F.when(better, most).alias("form_n"),
    )
    ids = stored(ids, "near-words")
    forms = ids.where(F.col("form").isNotNull()).select("id", "form")
    up = roots(forms, size.most or least_count, factor, least_count)
    names = ids.select("id", "word")
    form_names = names.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    root_names = names.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    linked = forms.join(up, "id").join(form_names, "form").join(root_names, "root").select("id", "form_word", "root_word")
    return ids.join(linked, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )


SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT *, flatten(list_transform(string_split(id || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END)) AS bs
  FROM counted
), hashed AS (
  SELECT run, times, xor(list_reduce(bs, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, steps
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word
    FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n,
    CASE WHEN b.m >= 5 * w.n THEN (SELECT min(encode(x.other)) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS f
  FROM words w LEFT JOIN best b USING (word)
), forms AS (
  SELECT word, n, n_near, form_n, CASE WHEN f IS NOT NULL THEN decode(f) END AS form FROM formed
), walk(word, reached, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.reached WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
