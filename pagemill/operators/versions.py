"""Versions, retention and run lists. Windows rank keys, times and hashes; contents meet the rows that stay by a join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import slugify
from pagemill.functions.urls import site_folder

KEEP_HISTORY, KEEP_RUNS, KEEP_SITE_RUNS = 120, 800, 240


def page_signature(*columns: str) -> Column:
    """A hash over the format version and the content columns; nulls stay visible."""
    return F.sha2(F.to_json(F.struct(F.lit(4).alias("v"), *columns), {"ignoreNullFields": "false"}), 256)


def latest_version(versions: DataFrame) -> DataFrame:
    """site, slug and the newest row's other columns."""
    rest = [c for c in versions.columns if c not in ("site", "slug", "collected_at")]
    newest = versions.groupBy("site", "slug").agg(F.max(F.struct("collected_at", *rest)).alias("v"))
    return newest.select("site", "slug", "v.collected_at", *[f"v.{c}" for c in rest])


def new_versions(articles: DataFrame, latest: DataFrame) -> DataFrame:
    """Articles whose signature differs from the stored one; only keys and signatures are joined."""
    old = latest.select("site", "slug", F.col("signature").alias("__old"))
    return articles.join(old, ["site", "slug"], "left").filter(F.col("__old").isNull() | (F.col("__old") != F.col("signature"))).drop("__old")


def changed_versions(history: DataFrame) -> DataFrame:
    """For a backfill: rows that differ from the one before, per article in time order."""
    before = F.lag("signature").over(W.partitionBy("site", "slug").orderBy("collected_at"))
    return history.withColumn("__old", before).filter(F.col("__old").isNull() | (F.col("__old") != F.col("signature"))).drop("__old")


def masked_content(ext: Column, content: Column) -> Column:
    date = F.regexp_replace(content, r"(^|\n)DATE: [^\n]*", "$1DATE: #")
    return F.when(ext == "md", F.regexp_replace(date, r"(^|\n)collectedAt: [^\n]*", "$1collectedAt: #")).when(ext == "txt", date).otherwise(content)


def _kept(history: DataFrame, group: list[Column], narrow: list[Column], keep: int) -> DataFrame:
    """The newest `keep` rows of each group; of rows with equal keys and times those with the least digests."""
    digest = F.sha2(F.coalesce("content", F.lit("-")), 256)
    rows = history.select("site", "slug", "ext", "collected_at", digest.alias("__digest"), *narrow)
    nth = F.row_number().over(W.partitionBy(*group).orderBy(F.col("collected_at").desc(), "__digest"))
    stay = rows.withColumn("__nth", nth).filter(F.col("__nth") <= keep).groupBy("site", "slug", "ext", "collected_at", "__digest").agg(F.count("*").alias("__times"))
    keys = ("site", "slug", "ext", "collected_at")
    stay = stay.select(*[F.col(c).alias(f"__{c}") for c in keys], "__digest", "__times")
    found = history.join(stay, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), keys, digest == F.col("__digest")))
    # rows that repeat key, time and content: as many as the ranking kept
    return found.dropDuplicates([*keys, "__digest"]).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))).select(*history.columns)


def cap_history(history: DataFrame, keep: int = KEEP_HISTORY) -> DataFrame:
    """The newest versions of each article and format."""
    return _kept(history, [F.col(c) for c in ("site", "slug", "ext")], [], keep)


def dedupe_history(history: DataFrame) -> DataFrame:
    """Among equal contents (dates masked) of an article and format the newest stays."""
    same = F.sha2(masked_content(F.col("ext"), F.col("content")), 256).alias("__same")
    return _kept(history, [F.col(c) for c in ("site", "slug", "ext", "__same")], [same], 1)


#: What an article is written as.
FORMATS = ["md", "txt", "json"]


def format_versions(articles: DataFrame, latest: DataFrame) -> DataFrame:
    """site, slug, ext, collected_at, content, signature: the files that a run has to write.

    articles: site, slug, collected_at, signature and a text per format. latest: site, slug, ext, signature, digest (sha256 of what is
    stored). An article whose signature is the stored one writes nothing; of a changed one, each format whose text is
    the stored one writes nothing. Only keys and digests of what is stored are read, and one row per article and format is joined.
    """
    old = latest.groupBy("site", "slug").agg(F.max("signature").alias("__old"), F.map_from_entries(F.collect_list(F.struct("ext", "digest"))).alias("__digests"))
    changed = articles.join(old, ["site", "slug"], "left").filter(~F.col("signature").eqNullSafe(F.col("__old")))
    files = F.explode(F.array(*[F.struct(F.lit(x).alias("ext"), F.col(x).alias("content")) for x in FORMATS]))
    rows = changed.select("site", "slug", "collected_at", "signature", "__digests", files.alias("f")).select("site", "slug", "f.ext", "collected_at", "f.content", "signature", "__digests")
    stored = F.try_element_at("__digests", F.col("ext"))
    return rows.filter(~F.sha2("content", 256).eqNullSafe(stored)).drop("__digests")


def article_files(articles: DataFrame, documents: DataFrame) -> DataFrame:
    """site, slug, collected_at, signature, md, txt, json: both documents of an article, and its columns as JSON.

    articles: page_id, site, slug, collected_at, signature and the article's columns. documents: page_id, md, txt.
    """
    rest = [c for c in articles.columns if c not in ("page_id", "site", "slug", "collected_at", "signature")]
    made = articles.withColumn("json", F.concat(F.to_json(F.struct(*rest), {"ignoreNullFields": "false", "pretty": "true"}), F.lit("\n")))
    return made.join(documents, "page_id").select("site", "slug", "collected_at", "signature", *FORMATS)


def exportable_pages(pages: DataFrame) -> DataFrame:
    """Per run the article pages, or its first page if it has none."""
    run = W.partitionBy("run_id")
    df = pages.withColumn("__any", F.max("is_article").over(run)).withColumn("__nth", F.row_number().over(run.orderBy("order")))
    return df.filter(F.col("is_article") | (~F.col("__any") & (F.col("__nth") == 1))).drop("__any", "__nth")


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names of sorted families: the slug, or the first number from 2 that makes a free name. Below a slug's last number all are taken."""
    family, taken, last = None, set(), {}
    for pdf in batches:
        names = []
        for at, slug in zip(pdf["__family"], pdf["slug"], strict=True):
            if at != family:
                family, taken, last = at, set(), {}
            n = last.get(slug, 1)
            while (name := slug if n == 1 else f"{slug}-{n}") in taken:
                n += 1
            last[slug] = n
            taken.add(name)
            names.append(name)
        yield pdf[["__family", "slug", "__nth"]].assign(__dir=names)


def assign_article_dirs(pages: DataFrame) -> DataFrame:
    """Adds slug and dir: the slug, with -2, -3... for repeats inside a run and site, skipping names that are taken.

    Only slugs that are alike but for numbers at their end can meet: a family. Families in which a numbered name meets another
    title's slug are named by a small helper that reads their keys as a sorted stream; all others need one window. A null run or
    site is one of its own. Of pages with equal run, site, slug and order either may be first.
    """
    root = F.regexp_replace("slug", "(-[0-9]+)+$", "").alias("root")
    df = pages.withColumn("slug", slugify(F.col("title"))).withColumn("__family", F.to_json(F.struct("run_id", "site", root), {"ignoreNullFields": "false"}))
    df = df.withColumn("__nth", F.row_number().over(W.partitionBy("__family", "slug").orderBy("order")))
    df = df.withColumn("dir", F.when(F.col("__nth") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("__nth").cast("string"))))
    keys = df.select("__family", "slug", "__nth", "order", "dir")
    # one slug's names all differ, so a name met twice is a slug that another one's number made
    clash = keys.groupBy("__family", "dir").agg(F.count("*").alias("n")).filter("n > 1").select("__family").distinct()
    rows = keys.drop("dir").join(clash, "__family", "left_semi").repartition("__family").sortWithinPartitions("__family", "order", "slug")
    named = rows.mapInPandas(_named, "__family string, slug string, __nth int, __dir string")
    rest = [c for c in pages.columns if c not in ("slug", "dir")]
    return df.join(named, ["__family", "slug", "__nth"], "left").select(*rest, "slug", F.coalesce("__dir", "dir").alias("dir"))


def run_record(pages: DataFrame) -> DataFrame:
    return pages.groupBy("run_id").agg(F.count("*").alias("crawled_pages"), F.count_if("is_article").alias("article_files"), F.min("collected_at").alias("created_at"))


def site_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("site").agg(F.count("*").alias("runs"), F.sum("crawled_pages").alias("crawled_pages"), F.sum("article_files").alias("article_files"))


def list_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def cap_runs(runs: DataFrame, overall: int = KEEP_RUNS, per_site: int = KEEP_SITE_RUNS) -> DataFrame:
    """The newest overall, then per site; the first cut bounds the window."""
    nth = F.row_number().over(W.partitionBy("site").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    return list_runs(runs, overall).withColumn("__nth", nth).filter(F.col("__nth") <= per_site).drop("__nth")


def upsert_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    return runs.join(new.select("id"), "id", "left_anti").unionByName(new)


def site_scope(scope: Column) -> Column:
    """The folder that a typed site means: an empty scope has none, a plain host is its own, anything else is read as a URL."""
    raw = F.lower(F.trim(F.coalesce(scope, F.lit(""))))
    folder = lambda u: site_folder(u)
    return F.when(raw == "", None).when(F.contains(raw, F.lit("://")), folder(raw)).when(raw.rlike("^[a-z0-9.-]+$"), raw).otherwise(folder(F.concat(F.lit("https://"), raw)))


def purge_site(df: DataFrame, scope: str) -> DataFrame:
    """df without the rows of a site; the scope `all` leaves none, and one that names no site leaves all."""
    if scope.strip().lower() == "all":
        return df.limit(0)
    return df.filter(F.coalesce(F.col("site") != site_scope(F.lit(scope)), F.lit(True)))
