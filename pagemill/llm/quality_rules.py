"""Quality rules with host verdicts.

Each document gets word, symbol, line and repeat counts and fails some rules. Failures are summed
by host (the column `source`); a Beta prior fitted to the hosts' rates by moments shrinks each
host's rate, so a host with few documents is not judged by chance. The moments are those of the
beta-binomial: what rates differ by chance alone is taken off their spread before the prior's
weight is read from it. Hosts whose shrunk rate is over `HOST_LIMIT` are rejected, and the verdict
is joined back to their documents.

All counting stays inside the row (arrays of the document's own words), so no words are shuffled;
only (host, documents, failures) is.

Results for odd input: null text has no words and fails; a null host is never judged and its
host_rate is null; an empty table gives no rows. Repeated rows are judged alike, each on its own,
and each counts for its host. A very long text is counted in its row. Columns with other names,
also those of the result, are ignored by `judge` and kept as they are by `keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WORD, text_of, written

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: A host is rejected over this shrunk rate; the prior weighs as much as so many documents, at least and at most.
HOST_LIMIT, WEIGHTS = 0.5, (1.0, 10_000.0)


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep + __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words.

    Windows are compared by a 64-bit hash of their words, inside one document only.
    """
    t = F.col("__t")
    df = docs.select(*keep, text_of().alias("__t"))
    df = df.select(
        *keep, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("__w"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("__n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("__lines"),
    )
    n = F.size("__w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW))))
    df = df.select(
        *keep, "__n_symbols", n.cast("long").alias("__n_words"), F.length(F.array_join("__w", "")).cast("long").alias("__word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"), windows.alias("__h"),
    )
    kept = [*keep, "__n_words", "__word_chars", "__n_symbols", "__n_dup_lines"]
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.select(*kept, F.when(again, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    starts = F.transform("__s", lambda x, j: F.when((F.get("__s", j - 1)["h"] == x["h"]) | (F.get("__s", j + 1)["h"] == x["h"]), x["i"]))
    df = df.select(*kept, F.sort_array(F.filter(starts, lambda x: x.isNotNull())).alias("__p"))
    covered = F.aggregate(F.transform("__p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("__n_repeat_words"))


def base_failed() -> Column:
    return (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT * F.col("__n_words"))


def rule_failed() -> Column:
    """What counts against a host: the base rules, a symbol in every tenth word, or mostly repeated lines."""
    return base_failed() | (10 * F.col("__n_symbols") > F.col("__n_words")) | (2 * F.col("__n_dup_lines") > F.col("__n_words"))


def prior_weight(hosts: int, n: int, k: int, second: float, squares: float) -> tuple[float, float]:
    """(mean, weight) of the Beta prior, from the number of hosts, documents n, failures k, the sum of k*k/n and that of n*n.

    `spread` is the weighted sum of squares of the rates about their mean, less what binomial draws with one common rate
    would give; its share of the most that it could be is 1 / (weight + 1).
    """
    mean = k / n if n else 0.0
    free, common = hosts - 1, mean * (1 - mean)
    room = common * (n - squares / n - free) if n else 0.0
    spread = second - n * mean * mean - common * free if n else 0.0
    share = spread / room if room > 1e-9 else 0.0
    return mean, min(max(1 / share - 1, WEIGHTS[0]), WEIGHTS[1]) if share > 1e-9 else WEIGHTS[1]


def host_verdicts(counts: DataFrame, host: str = "source") -> DataFrame:
    """(host) -> __host, __rate, __host_bad. The moments that leave the cluster are one row."""
    per = counts.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("n"), F.sum(rule_failed().cast("long")).alias("k"))
    per = written(per, "hosts")
    n, k = (F.col(c).cast("double") for c in "nk")
    moments = per.agg(F.count("*"), F.sum("n"), F.sum("k"), F.sum(k * k / n), F.sum(n * n)).first()
    mean, weight = prior_weight(*(x or 0 for x in moments))
    rate = (F.col("k") + mean * weight) / (F.col("n") + weight)
    return per.select("__host", rate.alias("__rate"), (rate > HOST_LIMIT).alias("__host_bad"))


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every document with base_failed, kept and host_rate, the shrunk rate of its host."""
    counts = written(with_counts(docs, ["doc_id", "source"]), "counts")
    judged = counts.join(host_verdicts(counts), F.col("source") == F.col("__host"), "left")
    return judged.select(
        "doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce("__host_bad", F.lit(False))).alias("kept"), F.round("__rate", 6).alias("host_rate"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with their own columns. Counts are made once and written with the rows."""
    cols = docs.columns
    counts = written(with_counts(docs, cols), "judged")
    judged = counts.join(host_verdicts(counts), F.col("source") == F.col("__host"), "left")
    return judged.filter(~base_failed() & ~F.coalesce("__host_bad", F.lit(False))).select(cols)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS c FROM g),
p AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM h WHERE c > 1),
r AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
k AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_words AS failed FROM b),
o AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS k FROM k WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT count(*) - 1 AS free, CAST(sum(n) AS DOUBLE) AS n, sum(k) / sum(n) AS mean, sum(k * k / n) AS second, sum(CAST(n AS DOUBLE) * n) AS squares FROM o),
y AS (SELECT mean, (second - n * mean * mean - mean * (1 - mean) * free) / nullif(mean * (1 - mean) * (n - squares / n - free), 0) AS share FROM m),
x AS (SELECT mean, CASE WHEN share > 1e-9 THEN least(greatest(1 / share - 1, 1), 10000) ELSE 10000 END AS weight FROM y),
v AS (SELECT source, (k + mean * weight) / (n + weight) AS rate FROM o, x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept, round(rate, 6) AS host_rate FROM k LEFT JOIN v USING (source)
"""
