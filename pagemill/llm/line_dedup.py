"""Line dedup by range-partitioned hashes.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Lines whose key
has MIN_KEY code points or more are rows of two 64-bit hashes of the key, document and place. The
rows are range-partitioned by hash and sorted by document (largest first) and place, so that each
task streams whole keys: the first document of a key keeps its lines, all others lose theirs if
MIN_DOCS documents or more hold the key. Documents get bitmaps, not texts: 64 lines a word, words
that keep every line left out.

A key with over 1 / (2 * partitions) of a sample of the rows is dealt in slices by document; its
slices' first documents and counts meet in a table of at most 2 * partitions keys, so a line that
every third document holds is streamed by many tasks. The sample decides only how rows are dealt:
slices of a key are always put together again, so the results are the same without it.

Results for odd input: null and empty texts are one empty line, which has a short key and stays;
rows that share a doc_id, null included, are one document in counts, and a null doc_id is the
smallest; each row is returned with its own lines; a very long text is as many rows as it has
lines; an empty table gives no rows. Other columns are ignored by `line_bitmaps` and kept by
`drop_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import text_of, written

MIN_KEY, MIN_DOCS, SAMPLE = 20, 3, 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_BLANK))
    # lower() is the fast way where no other letters are there to change
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(docs: DataFrame, min_key: int) -> DataFrame:
    """h1, h2, doc_id, raw (the text's hash), pos: one row per line with a key of min_key code points."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("raw"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    rows = rows.filter(F.length("line") >= min_key).select("doc_id", "raw", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_key)
    return rows.select(F.xxhash64(F.lit(11), "key").alias("h1"), F.xxhash64(F.lit(23), "key").alias("h2"), "doc_id", "raw", "pos")


def _hot(lines: DataFrame, parts: int) -> DataFrame:
    """h1, h2, slices: at most 2 * parts keys, those that hold more than 1 / (2 * parts) of the sampled rows."""
    # whole documents are not sampled together, so a line repeated inside one is seen in proportion
    seen = lines.filter(F.pmod(F.xxhash64("doc_id", "raw", "pos"), F.lit(SAMPLE)) == 0).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    seen = written(seen, "sampled")
    total = seen.agg(F.sum("n")).first()[0] or 0
    least = max(4, total // (2 * parts))
    return written(seen.filter(F.col("n") > least).select("h1", "h2", F.ceil(4 * F.col("n") / least).cast("int").alias("slices")), "hot")


def _losing(docs: DataFrame, min_key: int, min_docs: int) -> DataFrame:
    """doc_id, raw, pos of the lines that go."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = written(_lines(docs, min_key), "lines")
    hot = _hot(lines, parts)
    dealt = lines.join(hot, ["h1", "h2"], "left").withColumn("slice", F.coalesce(1 + F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"), F.lit(0))).drop("slices")
    ranged = dealt.repartitionByRange(parts, "h1", "h2", "slice")
    # both windows take the ranges as they are: no further shuffle
    group = W.partitionBy("h1", "h2", "slice")
    order = group.orderBy(F.col("doc_id").desc_nulls_last(), "raw", "pos")
    ranked = ranged.withColumn("nth", F.dense_rank().over(group.orderBy(F.col("doc_id").desc_nulls_last()))).withColumn("top", F.first("doc_id").over(order))
    ranked = ranked.withColumn("docs", F.max("nth").over(group))
    ranked = written(ranked.filter(f"slice > 0 or (nth > 1 and docs >= {min_docs})"), "ranked")
    cold = ranked.filter("slice = 0").select("doc_id", "raw", "pos")
    if hot.isEmpty():
        return cold
    each = ranked.filter("slice > 0 and nth = 1").groupBy("h1", "h2", "slice").agg(F.max("top").alias("top"), F.max("docs").alias("docs"))
    whole = written(each.groupBy("h1", "h2").agg(F.max("top").alias("best"), F.sum("docs").alias("all")).filter(F.col("all") >= min_docs), "whole")
    return cold.union(ranked.filter("slice > 0").join(whole, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("best"))).select("doc_id", "raw", "pos"))


def line_bitmaps(docs: DataFrame, min_key: int = MIN_KEY, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, raw (hash of the text), n_dropped, keep: the documents that lose lines.

    keep is a compressed bitmap: (word, bits) for each 64 lines of which some go, a set bit for each line that stays.
    """
    gone = _losing(docs, min_key, min_docs)
    # repeated rows mark the same lines: bits are joined, not added
    words = gone.groupBy("doc_id", "raw", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("lost"))
    word = F.struct("word", F.bitwise_not("lost").alias("bits"))
    return words.groupBy("doc_id", "raw").agg(F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(word)).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a compressed bitmap keeps."""
    # every word has its place in a plain array, so a line finds its bit without a search
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"])
    full = F.flatten(F.transform(keep, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - before(i) - 1), F.array(w["bits"]))))
    word = lambda words, i: F.coalesce(F.get(words, F.shiftright(i, 6)), F.lit(-1).cast("long"))
    return F.get(F.transform(F.array(full), lambda words: F.filter(lines, lambda x, i: F.getbit(word(words, i), i.bitwiseAND(63)) == 1)), 0)


def _with_bitmaps(docs: DataFrame, min_key: int, min_docs: int) -> DataFrame:
    maps = written(line_bitmaps(docs, min_key, min_docs), "bitmaps")
    maps = maps.select(F.col("doc_id").alias("__pm_id"), F.col("raw").alias("__pm_raw"), F.col("n_dropped").alias("__pm_dropped"), F.col("keep").alias("__pm_keep"))
    return docs.join(maps, F.col("doc_id").cast("long").eqNullSafe(F.col("__pm_id")) & (F.xxhash64(text_of()) == F.col("__pm_raw")), "left")


def _kept_text(text: Column) -> Column:
    return F.when(F.col("__pm_keep").isNull(), text).otherwise(F.array_join(kept_lines(F.split(text, "\n", -1), F.col("__pm_keep")), "\n"))


def drop_lines(docs: DataFrame, min_key: int = MIN_KEY, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the texts that are left; texts that lose nothing stay as they are, null included."""
    made = F.when(F.col("__pm_keep").isNull(), F.col("text")).otherwise(_kept_text(text_of()))
    return _with_bitmaps(docs, min_key, min_docs).withColumn("text", made).select(docs.columns)


def digest_lines(docs: DataFrame, min_key: int = MIN_KEY, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: one row per input row."""
    found = _with_bitmaps(docs.select("doc_id", "text"), min_key, min_docs)
    n = F.size(F.split(text_of(), "\n", -1)).cast("long")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_lines"), F.coalesce("__pm_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.sha2(_kept_text(text_of()), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
r AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.top AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id
"""
