"""Mixing sources to target weights by hash thresholds.

Each document has a 60-bit hash of its id and text. For each source the words of all documents are summed by
the first bits of the hash; the running sums tell in which of those buckets the source's budget ends. Only the
documents of that bucket are summed again, by the next bits, until the hash is used up: a threshold that is
exact to one hash. A document below its source's threshold is taken once more. Nothing is sorted by document.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` of all words;
no target passes ``most`` times its source's words, and what is above goes to the others by weight. A target
between k and k + 1 times the source's words takes each document k times and those below the threshold once more.

Defined cases: a null text has no words; rows without words are taken k times (their words are 0 anyway); rows
with equal ids and texts share a hash and are taken together; documents at the threshold are taken if that
brings the source nearer to its target; an empty table gives no rows. The number of sources is bounded by
``MOST_SOURCES``, above which the tables of sources are joined by shuffling instead of broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.llm.common import count_words
from hydrospark.plans.scratch import written

WEIGHTS = (3, 1, 2)
HEX_DIGITS = 15  # of the hash: 60 bits
STEP = 3  # hex digits by which a level refines: 4096 buckets
MOST_SOURCES = 10_000


def hash60(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of the md5 of id and text, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("\n", F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))), 1, HEX_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``sizes`` (source, source_size) to (source, source_size, target); ``share`` is a fraction.

    Sources fill up in the order of words for each weight; one is cut to ``most`` times its words if what is
    left for it is above that. Sums are whole numbers, so the order of adding does not matter. The table has
    one row for each source, so its windows may go to one task.
    """
    above, below = share
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    fill = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = sizes.withColumn("w", weight.cast("long"))
    t = t.withColumns({"all_size": F.sum("source_size").over(every), "all_w": F.sum("w").over(every), "size_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0))})
    rest = F.col("all_size") * above - F.col("size_before") * (most * below)
    t = t.withColumn("cut", F.col("source_size") * (most * below) * (F.col("all_w") - F.col("w_before")) < rest * F.col("w"))
    t = t.withColumns({"cut_size": F.sum(F.when(F.col("cut"), F.col("source_size")).otherwise(0)).over(every), "cut_w": F.sum(F.when(F.col("cut"), F.col("w")).otherwise(0)).over(every)})
    even = ((F.col("all_size") * above - F.col("cut_size") * (most * below)) * F.col("w")).cast("double") / ((F.col("all_w") - F.col("cut_w")) * below).cast("double")
    return t.select("source", "source_size", F.when(F.col("cut"), (F.col("source_size") * most).cast("double")).otherwise(even).alias("target"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_SOURCES else df


def thresholds(rows: DataFrame, wanted: DataFrame, n_sources: int) -> DataFrame:
    """``rows`` (source, size, h) and ``wanted`` (source, budget in words) to (source, below): hashes under ``below`` are taken."""
    at = wanted.select("source", "budget", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("done"))
    names = ["source", "budget", "base", "done"]
    for level in range(1, HEX_DIGITS // STEP + 1):
        width = 1 << 4 * (HEX_DIGITS - STEP * level)  # hashes in a bucket of this level
        last = level * STEP == HEX_DIGITS
        a = at.select(*[F.col(c).alias(f"a_{c}") for c in names])
        # the boundary bucket of each source so far; at first all hashes
        held = rows.join(_small(a, n_sources), rows["source"].eqNullSafe(a["a_source"]) & (rows["h"] >= F.col("a_base")) & (rows["h"] - F.col("a_base") < (width << 4 * STEP)))
        sums = held.groupBy("a_source", "a_budget", "a_base", "a_done", F.shiftright(F.col("h") - F.col("a_base"), width.bit_length() - 1).alias("b")).agg(F.sum("size").alias("size"))
        up = Window.partitionBy("a_source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("a_done") + F.coalesce(F.sum("size").over(up), F.lit(0)))
        # buckets that the budget holds whole; of the last level also one that it holds by more than half
        whole = (F.col("before") * 2 + F.col("size") <= F.col("a_budget") * 2) if last else (F.col("before") + F.col("size") <= F.col("a_budget"))
        top = sums.groupBy("a_source", "a_budget", "a_base", "a_done").agg(
            F.coalesce(F.max(F.when(whole, F.col("b") + 1)), F.lit(0)).alias("next"), F.min(F.when(~whole, F.col("b"))).alias("open"), F.max(F.when(whole, F.col("before") + F.col("size"))).alias("sum")
        )
        # a budget is less than its source has, so the boundary bucket exists on each level
        bucket = F.col("next") if last else F.col("open")
        at = written(top.select(F.col("a_source").alias("source"), F.col("a_budget").alias("budget"), (F.col("a_base") + bucket * width).alias("base"), F.coalesce("sum", "a_done").alias("done")), "mix-level")
    return at.select("source", F.col("base").alias("below"))


def plan_mix(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``narrow`` (source, size, h), a written table, to one row for each source:
    (p_source, source_size, target, times, below); a row is taken ``times`` times, and once more if its hash is under ``below``."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(targets(sizes, weights), "mix-targets")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("times", times)
    wanted = plan.select("source", (F.col("target") - F.col("times") * F.col("source_size")).alias("budget")).where("budget > 0")
    limits = thresholds(narrow, wanted, plan.count()).withColumnRenamed("source", "l_source")
    plan = plan.join(limits, F.col("source").eqNullSafe(F.col("l_source")), "left")
    return written(plan.select(F.col("source").alias("p_source"), "source_size", "target", "times", F.coalesce("below", F.lit(0)).alias("below")), "mix-plan")


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source, h) with the plan's columns and ``copies``, how often the mix takes the row."""
    found = rows.join(_small(plan, plan.count()), F.col("source").eqNullSafe(F.col("p_source")))
    return found.withColumn("copies", F.col("times") + (F.col("h") < F.col("below")).cast("long"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of each row, written: all that the mix is decided by."""
    return written(docs.select("doc_id", "source", count_words().alias("size"), hash60().alias("h")), "mix-rows")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row; ``taken`` counts the words that the mix takes of it."""
    rows = sized(docs)
    return copies(rows, plan_mix(rows, weights)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with the columns of ``docs``."""
    plan = plan_mix(sized(docs), weights)
    found = copies(docs.select(F.struct("*").alias("row"), "source", hash60().alias("h")), plan).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


#: DuckDB: cumulative words by hash within a source; a hash is taken if that brings the source nearer to its target.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws(chr(10), CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
f AS (SELECT *, sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w,
    coalesce(sum(source_size) OVER o, 0) AS size_before, coalesce(sum(w) OVER o, 0) AS w_before
    FROM w WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, source_size * 4 * (all_w - w_before) < (all_size * 3 - size_before * 4) * w AS cut FROM f),
e AS (SELECT *, sum(CASE WHEN cut THEN source_size ELSE 0 END) OVER () AS cut_size, sum(CASE WHEN cut THEN w ELSE 0 END) OVER () AS cut_w FROM c),
t AS (SELECT source, source_size, CASE WHEN cut THEN CAST(source_size * 2 AS DOUBLE)
    ELSE CAST((all_size * 3 - cut_size * 4) * w AS DOUBLE) / CAST((all_w - cut_w) * 2 AS DOUBLE) END AS target FROM e),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
r AS (SELECT source, h, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
x AS (SELECT r.source, r.h, CASE WHEN u.target - u.times * u.source_size > 0 AND r.before * 2 + r.size <= (u.target - u.times * u.source_size) * 2 THEN 1 ELSE 0 END AS more
    FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source)
SELECT d.doc_id, d.size, u.source_size, u.target, CAST(d.size * (u.times + x.more) AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""
