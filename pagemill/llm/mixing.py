"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. Inside a source longer documents are likelier: the rate of a
document, its copies on average, grows with the binary logarithm of its size and stops at MOST;
rates times sizes add up to the target. The whole part of a rate gives certain copies, the rest is
an inclusion probability p. All documents of a source are ranked by the odds of a reproducible
uniform number over the odds of their own p, and the lowest ranks are taken until the source's
remaining words are used up (fixed size in words; the last document is taken when that ends nearer
to the target).

The cut is found from sums per (source, 1/65536 of the rank scale) and then inside one such
slice only, so no source is gathered or sorted as a whole. A cut is one row per source and size
class (64 a source at most); taking is then a test on each row, with no join on documents.

Results for odd input: null text has size 0, and size-0 documents cost nothing; a null source is
a source of its own, last in order; rows that repeat doc_id share their fate; rows without
doc_id share one; an empty table gives an empty mix; texts of any length are only counted; columns
with other names, `size` or `copies` among them, pass through `mix` unread. A source with one long
document can miss its target by half that document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import text_of, word_count, written

WEIGHTS, SHARE, MOST, FAVOUR = (3, 1, 2), 1.5, 2, 4
SLICES = 65536


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> + target. The excess over most * size is shared again by weight.

    One row per source comes in; the windows run over that table only.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap"))
    ranked = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(W.unboundedPreceding, -1)
    t = t.select(
        "*", (F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))).alias("all"), F.sum("w").over(W.partitionBy()).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap0"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w0"),
        F.row_number().over(ranked).alias("k"),
    )
    t = t.withColumn("level", (F.col("all") - F.col("cap0")) / (F.col("all_w") - F.col("w0")))
    # the first source whose cap its share does not reach: all from there on share one level
    free = F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct("k", "level"))).over(W.partitionBy())
    t = t.withColumn("free", free)
    return t.select("source", "source_size", F.when(F.col("free").isNull() | (F.col("k") < F.col("free.k")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("free.level")).alias("target"))


def size_class(size: Column) -> Column:
    """The number of binary digits of a size, less one: sizes of one class differ by less than a factor of two."""
    return (F.length(F.bin(size)) - 1).cast("long")


def rates(classes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, __pm_k, words, source_size, target) -> + rate: copies that a document of the class takes on average.

    Within a source the rate grows with the class, rate = level * (class + FAVOUR), and stops at `most`; the level is such
    that rates times words add up to the target. One row per source and class comes in, at most 64 a source.
    """
    w, k = F.col("__pm_k") + FAVOUR, F.col("__pm_k")
    order = W.partitionBy("source").orderBy(k.desc())
    t = classes.withColumn("cap0", F.coalesce(F.sum(F.col("words") * most).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("rest", F.sum(w * F.col("words")).over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    t = t.withColumn("level", (F.col("target") - F.col("cap0")) / F.nullif(F.col("rest"), F.lit(0)))
    # the largest class whose rate stays below the stop: all classes from there on share one level
    t = t.withColumn("free", F.max(F.when(F.col("level") * w < most, F.struct(k.alias("k"), "level"))).over(W.partitionBy("source")))
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("free").isNull() | (k > F.col("free.k")), float(most)).otherwise(w * F.col("free.level"))
    return t.withColumn("rate", rate).drop("cap0", "rest", "level", "free")


def _rank(df: DataFrame, p: str) -> DataFrame:
    """Adds rank (random odds over inclusion odds) and its slice."""
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    df = df.withColumn("__pm_q", (u / (1 - u)) / F.nullif(F.col(p) / (1 - F.col(p)), F.lit(0.0)))
    return df.withColumn("__pm_b", F.least(F.lit(SLICES - 1), F.floor(F.col("__pm_q") / (1 + F.col("__pm_q")) * SLICES)).cast("int"))


def cuts(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(sizes, cuts): doc_id, source, size, class per row; and per source and class the target, whole copies, p and the source's cut."""
    sizes = docs.select("doc_id", "source", word_count(text_of()).alias("size"))
    sizes = written(sizes.withColumn("__pm_k", size_class(F.col("size"))), "sizes")
    classes = written(sizes.groupBy("source", "__pm_k").agg(F.sum("size").alias("words")), "classes")
    per = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    per = rates(_with(classes, per, "inner"), most)
    per = per.withColumn("whole", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.col("whole"))
    budget = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source"))
    per = written(per.withColumn("budget", budget), "targets")

    drawn = _rank(_with(sizes, per.filter("p > 0").select("source", "__pm_k", "p", "budget"), "inner"), "p")
    cum = F.sum("n").over(W.partitionBy("source").orderBy("__pm_b"))
    slices = drawn.groupBy("source", "budget", "__pm_b").agg(F.sum("size").alias("n")).withColumn("cum", cum)
    edge = slices.filter("cum > budget").groupBy("source").agg(F.min(F.struct("__pm_b", (F.col("cum") - F.col("n")).alias("before"))).alias("e"))
    edge = written(edge.select("source", F.col("e.__pm_b").alias("edge"), F.col("e.before").alias("before")), "edge")

    last = _with(drawn, edge, "inner").filter("__pm_b = edge").groupBy("source", "__pm_q", "doc_id", "budget", "before").agg(F.sum("size").alias("n"))
    after = F.col("before") + F.sum("n").over(W.partitionBy("source").orderBy("__pm_q", F.col("doc_id").asc_nulls_last()))
    last = last.withColumn("after", after).filter("after <= budget or (after - n < budget and after - budget < budget - (after - n))")
    cut = last.groupBy("source").agg(F.max(F.struct(F.col("__pm_q").alias("q"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"))).alias("cut"))
    return sizes, written(_with(_with(per, edge.drop("before"), "left"), cut, "left"), "cuts")


def _with(left: DataFrame, small: DataFrame, how: str) -> DataFrame:
    """Null-safe join on source, and on the class if both have it; Spark broadcasts the small table when its files are small enough."""
    by = ["source", *(["__pm_k"] if "__pm_k" in small.columns else [])]
    right = small.withColumnsRenamed({c: f"__pm_r_{c}" for c in by})
    return left.join(right, [F.col(c).eqNullSafe(F.col(f"__pm_r_{c}")) for c in by], how).drop(*[f"__pm_r_{c}" for c in by])


def copies(df: DataFrame, per: DataFrame) -> DataFrame:
    """Adds __pm_copies: how often the mix takes the row; df has source, doc_id and __pm_k."""
    df = _rank(_with(df, per.select("source", "__pm_k", F.struct(*[c for c in per.columns if c != "__pm_k"]).alias("__pm_s")), "left").withColumn("__pm_p", F.col("__pm_s.p")), "__pm_p")
    here = F.struct(F.col("__pm_q").alias("q"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"))
    s = "__pm_s."
    drawn = (F.col("__pm_p") > 0) & (F.col(s + "edge").isNull() | (F.col("__pm_b") < F.col(s + "edge")) | ((F.col("__pm_b") == F.col(s + "edge")) & F.coalesce(here <= F.col(s + "cut"), F.lit(False))))
    return df.withColumn("__pm_copies", F.col(s + "whole") + F.coalesce(drawn, F.lit(False)).cast("long"))


def plan_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per document."""
    sizes, per = cuts(docs)
    return copies(sizes, per).select("doc_id", "size", F.col("__pm_s.source_size").alias("source_size"), F.col("__pm_s.target").alias("target"), (F.col("__pm_copies") * F.col("size")).alias("taken"), F.col("__pm_copies").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, repeats included, with their own columns."""
    _, per = cuts(docs)
    taken = copies(docs.withColumn("__pm_k", size_class(word_count(text_of()))), per).filter("__pm_copies > 0")
    return taken.withColumn("__pm_i", F.explode(F.sequence(F.lit(1), F.col("__pm_copies")))).select(docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
a AS (SELECT *, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS total, sum(w) OVER () AS all_w,
  coalesce(CAST(sum(2 * source_size) OVER before AS BIGINT), 0) AS cap0, coalesce(sum(w) OVER before, 0) AS w0, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k FROM s
  WINDOW before AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap0) / (all_w - w0) AS level FROM a),
f AS (SELECT min(k) AS k0, min_by(level, k) AS level0 FROM l WHERE cap > w * level),
t AS (SELECT source, source_size, CASE WHEN k0 IS NULL OR k < k0 THEN CAST(cap AS DOUBLE) ELSE w * level0 END AS target FROM l, f),
g AS (SELECT source, length(bin(size)) - 1 AS k, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
h AS (SELECT g.*, k + 4 AS w, source_size, target FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, (target - coalesce(CAST(sum(2 * words) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
  / nullif(CAST(sum(w * words) OVER (PARTITION BY source ORDER BY k) AS BIGINT), 0) AS level FROM h),
x AS (SELECT source, max(k) AS k0, max_by(level, k) AS level0 FROM v WHERE level * w < 2 GROUP BY source),
r AS (SELECT v.*, CASE WHEN source_size = 0 THEN CAST(0 AS DOUBLE) WHEN k0 IS NULL OR k > k0 THEN CAST(2 AS DOUBLE) ELSE w * level0 END AS rate FROM v LEFT JOIN x ON v.source IS NOT DISTINCT FROM x.source),
p AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS p, target - CAST(sum(CAST(floor(rate) AS BIGINT) * words) OVER (PARTITION BY source) AS BIGINT) AS budget FROM r),
u AS (SELECT d.doc_id, d.size, p.*, (CAST(CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE AS u FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND length(bin(d.size)) - 1 = p.k),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM u),
c AS (SELECT *, CAST(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id) AS BIGINT) AS after FROM q)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM (
  SELECT *, whole + CASE WHEN p > 0 AND (after <= budget OR (after - size < budget AND after - budget < budget - (after - size))) THEN 1 ELSE 0 END AS copies FROM c)
"""
