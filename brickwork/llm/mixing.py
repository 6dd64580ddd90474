"""Mixing sources to target weights: hash order, prefix sums, exact cuts, repeated epochs.

Each document gets a key that is a hash of its id.  Within its source, documents
stand in key order; the leading bits of the key split a source into ranges that
are summed first, so the words before a document are the sum of earlier ranges
plus those before it in its own range.  A source is taken whole as often as its
budget allows, and the rest is cut at the exact word.

Defined results: null text has size 0; a null source is a source of its own,
after all others; rows with the same id and size are interchangeable; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickwork.llm.shared import SPACE, queue_key

WEIGHTS = (1, 2, 3)
#: A source is repeated at most so often.
EPOCHS = 3
#: Leading key bits that name a range.
RANGE_BITS = 12
SEED = "mix"


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def targets(sizes: DataFrame) -> DataFrame:
    """Target words of each source, from (queue, source_size).

    Weights repeat over the sources in order and share the total size.  A target
    above ``EPOCHS`` sizes stops there, and the others share what is left.  With
    the sources ordered by cap per weight, those before the first that stays
    below its cap are exactly the capped ones.
    """
    order = Window.orderBy("queue")
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * EPOCHS)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "queue")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("_level", (F.sum("source_size").over(everything) - F.col("_used")) / F.col("_weights"))
    free = F.col("_level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("_level", F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("queue"), F.col("_level").alias("level")))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight"))
    return rows.select("queue", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, carry: tuple[str, ...] = (), range_bits: int = RANGE_BITS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, and the ``carry`` columns.

    ``taken`` counts the words that the mix takes of the document, repeats included.
    """
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), id_text))
    rows = docs.select(
        "doc_id",
        queue_key("source").alias("queue"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    ).withColumn("range", F.shiftright("key", 60 - range_bits))
    by_range = rows.groupBy("queue", "range").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("queue").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_range.select("queue", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    goals = targets(by_range.groupBy("queue").agg(F.sum("sum").alias("source_size")))
    inside = Window.partitionBy("queue", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(ranges, ["queue", "range"]).join(goals, "queue")
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("base") - F.col("_in")))
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + part).cast("long").alias("taken"),
        *[F.col(f"_carry_{c}").alias(c if c not in ("doc_id", "size", "source_size", "target", "taken") else f"doc_{c}") for c in carry],
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of ``docs``.

    A document stands once for each whole time it is taken, and once more with
    its leading words where a source's budget ends inside it.  Documents without
    words carry nothing to mix and are left out.
    """
    names = docs.columns
    own = F.struct(*[F.col(c) for c in names]).alias("_row")
    rows = mix(docs.select("doc_id", "text", "source", own), carry=("_row",))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("_row", F.explode(copies).alias("_cut"))
    cut = F.array_join(F.slice(words(F.col("_row.text")), 1, F.greatest(F.col("_cut"), F.lit(1))), " ")
    text = F.when(F.col("_cut") < 0, F.col("_row.text")).otherwise(cut)
    replaced = {"text": text}
    if "n_chars" in names:
        replaced["n_chars"] = F.when(F.col("_cut") < 0, F.col("_row.n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[replaced.get(c, F.col("_row")[c]).alias(c) for c in names])


SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS queue,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT queue, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY queue),
w AS (SELECT queue, source_size, 1 + (row_number() OVER (ORDER BY queue) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS used,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights,
             sum(source_size) OVER () AS total
      FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - used AS DOUBLE) / CAST(weights AS DOUBLE) AS own FROM c),
f AS (SELECT own AS level FROM l WHERE own * weight <= cap ORDER BY CAST(cap AS DOUBLE) / weight, queue LIMIT 1),
t AS (SELECT queue, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target FROM l, f),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM b),
r AS (SELECT d.*, e.source_size, e.target, e.whole, e.budget - e.whole * e.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.queue ORDER BY substr(key, 1, 15), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e USING (queue))
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM r
"""
