r"""License scans by canonical digest lookup.

A text is normalised: lower case, copyright lines dropped, equivalent spellings made one,
punctuation and white space reduced to single blanks. Entire texts (the document, its paragraphs
between blank lines, its lines, its sentences that begin with a license opening, on one line or
wrapped, and the spans from a published text's or header's first words to its last) are hashed and
hash-joined to the digests of known license texts. Wrapping and comment signs don't count.

The table of known texts is fixed and small (hundreds of rows), so Spark broadcasts it by its size.

Whole texts are sought in the normalised words: the text is cut behind every closing phrase, and in each part
every opening begins a candidate that ends with the part. Sentences over line ends are found likewise, between
ends of sentences. Only as many characters before an end are read as the longest known text has once normalised,
so marks, comment signs and blanks of any length lose nothing, and a text that repeats an opening stays cheap.

Results for odd input: a null doc_id is kept, and rows that share a doc_id are told apart by their texts; a long
text is scanned whole; an empty table gives no rows; null or empty text has no license; repeated rows give equal
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import text_of, written
from pagemill.llm.license_texts import DIGESTS, SPANS

#: License statements as published, by SPDX identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
]
#: Equivalent spellings, as pattern and word.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("copyright holder", "copyright owner"), ("per cent", "percent"), (r"\(c\)|\x{a9}", "copyright"), ("http:", "https:")]
WANTED = "(?i)licen[cs]e|permission"
SENTENCE = r"(?i)((?:licen[cs]ed under|released under|this program is licen[cs]ed|permission )[^\n]*?[.:;])(?:[^0-9A-Za-z]|\z)"
#: How a sentence over line ends opens, in normalised words; it may also run past a semicolon.
OPENING = "licensed under|released under|this program is licensed|permission "
#: Normalised characters of the longest statement and of the longest published text (GPL-3.0 has 33,000).
LONGEST_STATEMENT, LONGEST_TEXT = max(len(words) for _, words in KNOWN), 40_000
#: The spellings of several words, which a line end may part.
WRAPPED_SPELLINGS = [("copyright holder", "copyright owner"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent")]
HOLDS = f"{WANTED}|redistribution[^A-Za-z0-9]+and[^A-Za-z0-9]+use|cc0 1|altered[^A-Za-z0-9]+from"
COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|\x{a9})[^\n]*"


def normalised(text: Column) -> Column:
    """Words of a text without the lines that begin as copyright lines."""
    return F.trim(F.regexp_replace(_spelled(F.regexp_replace(F.lower(text), COPYRIGHT, "\n")), "[^a-z0-9]+", " "))


def _spelled(text: Column) -> Column:
    for pattern, word in SPELLINGS:
        text = F.regexp_replace(text, pattern, word)
    return text


def _whole_words(text: Column) -> Column:
    """Words of a whole text, copyright lines too; ends of sentences become a line feed, or a tab for a semicolon."""
    out = F.regexp_replace(_spelled(F.lower(text)), r"[\n\t]", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[.:](?=[^0-9a-z]|\z)", "\n"), r";(?=[^0-9a-z]|\z)", "\t")
    return _joined(F.regexp_replace(out, r"[^a-z0-9\n\t]+", " "))


def _joined(words: Column) -> Column:
    for parted, word in WRAPPED_SPELLINGS:
        words = F.replace(words, F.lit(parted), F.lit(word))
    return words


def _openings(parts: Column, opening: str, longest: int) -> Column:
    """Digests of all texts that begin with an opening inside a part and end with it."""
    begun = F.lit(f"(?s)(?<![a-z0-9])(?=((?:{opening}).*))")
    # One character more than the longest: what the cut makes of a word's rest is too long for any known text.
    tails = lambda p: F.regexp_extract_all(F.right(F.rtrim(p), F.lit(longest + 1)), begun, F.lit(1))
    return F.flatten(F.transform(parts, lambda p: F.transform(tails(p), lambda s: F.sha2(s, 256))))


def _sentences(words: Column, ends: str) -> Column:
    """Digests of the sentences over line ends; the rest behind the last end is none."""
    parts = F.split(words, ends, -1)
    spaced = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.trim(F.regexp_replace(p, "[^a-z0-9]+", " ")))
    return _openings(F.transform(spaced, _joined), OPENING, LONGEST_STATEMENT)


def _texts(words: Column) -> Column:
    """Digests of all spans from a published text's first words to its next last words."""
    none = F.array().cast("array<string>")

    def of(first: str, last: str) -> Column:
        parts = F.filter(F.split(words, f"(?<={last})", -1), lambda p: p.endswith(last))
        return F.when(words.contains(first) & words.contains(last), _openings(parts, first, LONGEST_TEXT)).otherwise(none)

    return F.concat(*(of(first, last) for first, last in SPANS))


def known(spark: SparkSession) -> DataFrame:
    table = spark.createDataFrame(KNOWN, "license string, known string")
    return table.select("license", F.sha2(normalised(F.col("known")), 256).alias("digest")).union(spark.createDataFrame(DIGESTS, "license string, digest string")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (identifiers, sorted, comma-joined), n_licenses: one row per input row."""
    t = F.col("t")
    found_by = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    pieces = F.concat(F.array(t), F.split(t, r"\n\s*\n", -1), F.split(t, "\n", -1), found_by(SENTENCE))
    wanted = F.array_distinct(F.filter(pieces, lambda p: p.rlike(WANTED)))
    holds, words, plain = F.col("holds"), F.col("words"), F.col("plain")
    df = docs.select("doc_id", text_of().alias("t")).withColumn("holds", t.rlike(HOLDS)).withColumn("words", F.when(holds, _whole_words(t)))
    df = df.withColumn("plain", _joined(F.trim(F.regexp_replace(words, "[^a-z0-9]+", " "))))
    statements = F.transform(wanted, lambda p: F.sha2(normalised(p), 256))
    digests = F.array_distinct(F.concat(statements, _sentences(words, "[\n\t]"), _sentences(words, "\n"), _texts(plain)))
    df = written(df.select("doc_id", F.when(holds, F.xxhash64(t)).alias("h"), F.when(holds, digests).alias("digests")), "digests")
    found = df.filter("h is not null").select("doc_id", "h", F.explode("digests").alias("digest")).join(known(docs.sparkSession), "digest")
    found = found.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("hh")).agg(F.array_sort(F.collect_set("license")).alias("found"))
    return df.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hh")), "left").select(
        "doc_id", F.coalesce(F.array_join("found", ","), F.lit("")).alias("licenses"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licenses")
    )


def _sql(text: str) -> str:
    out = rf"regexp_replace(lower({text}), '{COPYRIGHT}', chr(10), 'g')"
    for pattern, word in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{word}', 'g')"
    return f"sha256(trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')))"


ORACLE = (
    "WITH k(license, t) AS (VALUES " + ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN) + rf"""),
n AS (SELECT DISTINCT license, {_sql('t')} AS digest FROM k),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, unnest(list_concat([t], regexp_split_to_array(t, '\n\s*\n'), string_split(t, chr(10)), regexp_extract_all(t, '{SENTENCE}', 1))) AS p FROM d),
f AS (SELECT DISTINCT doc_id, license FROM p JOIN n ON n.digest = {_sql('p')} WHERE regexp_matches(p, '{WANTED}')),
g AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses, count(*) AS n FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses FROM d LEFT JOIN g USING (doc_id)
"""
)
