"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of code points. The distinct
blocks are sorted and numbered, so a block's name is an integer that no other block has.
Adjacent names are paired, and the distinct pairs are sorted and numbered again, until one
name is left per document. Texts are equal exactly when level and name agree.

Names are assigned to distinct blocks (after map-side distinct), so a block that a third of
the corpus shares is one row there. Block texts are shuffled once. Occurrences find their
name by a 128-bit handle; a count over all names proves that no two share a handle, and if
two did, the join would be made on the block texts. Blocks and groups that many rows have are
joined in parts. The integers depend on how Spark deals the blocks, which texts share them doesn't.

Results for odd input: null text counts as empty; all empty texts form one group; rows that
repeat doc_id and text are one document, each row is returned, counts in group_size and has
the same `kept`; a null doc_id sorts after all others; a very long text is many blocks; an empty
table gives no rows. Other columns are ignored. Of rows that repeat the text that stays,
`drop_copies` keeps one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WS, joined_hot, text_of, written

BLOCK = 4096


def _blocks(norm):
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def _handle(block):
    return F.struct(F.xxhash64(F.lit(11), block).alias("k1"), F.xxhash64(F.lit(23), block).alias("k2"))


def _block_names(blocks: DataFrame) -> DataFrame:
    """(block) -> (k1, k2, name, block, times): distinct blocks, sorted and numbered, and how often each occurs."""
    named = blocks.groupBy("block").agg(F.count("*").alias("times")).sortWithinPartitions("block").withColumn("name", F.monotonically_increasing_id())
    return named.select(_handle(F.col("block")).alias("k"), "name", "block", "times").select("k.k1", "k.k2", "name", "block", "times")


def name_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, raw (hash of the text as it is), sha, level, name; one row per input row."""
    base = docs.select("doc_id", text_of().alias("t"))
    base = base.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.xxhash64("t").alias("raw"), F.regexp_replace("t", f"[{WS}]+", "").alias("norm"))
    cut = base.select("doc_id", "n_chars", "raw", "norm", _blocks(F.col("norm")).alias("blocks"))
    distinct = _block_names(cut.select(F.explode("blocks").alias("block")))
    names = written(distinct.drop("block"), "names")
    n, handles = names.agg(F.count("*"), F.count_distinct("k1", "k2")).first()
    exact = n == handles

    of_row = ["doc_id", "n_chars", "raw", "sha"]
    narrow = cut.select(
        "doc_id", "n_chars", "raw", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("h"), F.size("blocks").alias("n"),
        F.posexplode("blocks").alias("pos", "block"),
    ).select("*", _handle(F.col("block")).alias("k")).select("doc_id", "n_chars", "raw", "sha", "h", "n", "pos", "k.k1", "k.k2", *([] if exact else ["block"]))
    found = joined_hot(narrow, names, ["k1", "k2"], "times", ["doc_id", "pos"]) if exact else narrow.join(distinct.drop("k1", "k2"), "block")
    seq = written(found.select(*of_row, "h", "n", "pos", "name"), "sequence")

    most = seq.agg(F.max("n")).first()[0] or 0
    rows = [seq.filter("n = 1").select(*of_row, F.lit(0).alias("level"), "name")]
    if most > 1:
        whole = seq.filter("n > 1 and pos = 0").select(*of_row, "h")
        rows.append(whole.join(_pair_names(seq.filter("n > 1"), most).withColumnRenamed("doc_id", "id").withColumnRenamed("h", "hh"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hh"))).select(*of_row, "level", "name"))
    return reduce(DataFrame.unionByName, rows)


def _pair_names(seq: DataFrame, most: int) -> DataFrame:
    """(doc_id, h, n, pos, name) -> doc_id, h, level, name: pairs named until one is left."""
    now, done, level = seq.select("doc_id", "h", "n", "pos", "name"), [], 0
    while most > 1:
        level, most = level + 1, -(-most // 2)
        even = F.col("pos") % 2 == 0
        pairs = now.groupBy("doc_id", "h", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right")
        )
        named = pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn("name", F.monotonically_increasing_id())
        made = written(pairs.join(named, ["left", "right"]).select("doc_id", "h", "n", "pos", "name"), f"pairs{level}")
        done.append(made.filter("n = 1").select("doc_id", "h", F.lit(level).alias("level"), "name"))
        now = made.filter("n > 1")
    return reduce(DataFrame.unionByName, done)


def _copies(docs: DataFrame) -> DataFrame:
    """find_copies with raw."""
    rows = written(name_documents(docs), "identity")
    best = F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id")))
    groups = written(rows.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return joined_hot(rows, groups, ["level", "name"], "group_size", ["doc_id", "raw"]).select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.a"))).alias("kept"),
        F.col("sha").alias("text_sha256"), "raw",
    )


def find_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    return _copies(docs).drop("raw")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one per group of equal texts, with all their columns."""
    # rows of one doc_id may hold texts of one length that differ in white space: the least hash stays
    kept = _copies(docs).filter("kept").groupBy("doc_id", "text_sha256", "raw").agg(F.count("*").alias("same"))
    kept = kept.groupBy("doc_id", "text_sha256").agg(F.min(F.struct("raw", "same")).alias("k"))
    kept = written(kept.select(F.col("doc_id").alias("__pm_id"), F.col("k.raw").alias("__pm_raw"), F.col("k.same").alias("__pm_same")), "kept")
    found = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__pm_id")) & (F.xxhash64(text_of()) == F.col("__pm_raw")))
    if kept.filter("__pm_same > 1").isEmpty():
        return found.select(docs.columns)
    again = found.filter("__pm_same > 1").dropDuplicates(["__pm_id", "__pm_raw"])
    return found.filter("__pm_same = 1").unionByName(again).select(docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM r
"""
