"""Links of pages, the link graph, and breadth-first selection."""

from __future__ import annotations

import tempfile
from functools import cache
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import urls as U

#: Links scanned of a page; the bound of a walk's queue by pages to select, and its least.
MAX_LINKS, QUEUE_PER_PAGE, LEAST_QUEUE = 400, 25, 60


def page_links(articles: DataFrame) -> DataFrame:
    """page_id, page_url, link_pos, url: in scope, unwrapped, distinct in first-seen order. The parser has resolved the hrefs."""
    df = articles.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.arrays_zip("hrefs", "resolved")).alias("at", "a")).filter(U.is_supported_href(F.col("a.hrefs")))
    df = df.withColumn("link", U.unwrap_archive_url(U.scoped_link(F.col("a.resolved"), F.col("page_url")))).filter(F.col("link").isNotNull())
    first = df.groupBy("page_id", "page_url", F.col("link").alias("url")).agg(F.min("at").alias("at"))
    return first.select("page_id", "page_url", F.row_number().over(W.partitionBy("page_id").orderBy("at")).alias("link_pos"), "url")


def link_errors(articles: DataFrame) -> DataFrame:
    """page_id, bad_hrefs: supported hrefs that can't be resolved."""
    pairs = F.arrays_zip("hrefs", "resolved")
    return articles.select("page_id", F.size(F.filter(pairs, lambda a: U.is_supported_href(a["hrefs"]) & a["resolved"].isNull())).alias("bad_hrefs"))


def link_edges(links: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    return links.filter(F.col("link_pos") <= max_links)


def link_degree(edges: DataFrame) -> DataFrame:
    """url, out_degree, in_degree; the edges are read once."""
    ends = F.explode(F.array(F.struct(F.col("page_url").alias("url"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct("url", F.lit(0).alias("out"), F.lit(1).alias("into"))))
    return edges.select(ends.alias("e")).groupBy(F.col("e.url").alias("url")).agg(F.sum("e.out").alias("out_degree"), F.sum("e.into").alias("in_degree"))


def top_linked(edges: DataFrame, limit: int = 20) -> DataFrame:
    """url, in_degree: the pages with most links to them."""
    return edges.groupBy("url").agg(F.count("*").alias("in_degree")).orderBy(F.col("in_degree").desc(), "url").limit(limit)


@cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; a temporary folder serves a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or _temporary()).rstrip('/')}/{label}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends in a table in the shared folder."""
    df.write.parquet(path := shared_path(df.sparkSession, "level"))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _enqueue(limit: int):
    """The links of a level that find a place in the queue, and the number each gets in it.

    A root's pages of a level and their links are at most max_pages and MAX_LINKS, so a group is small. When the entry numbered q
    is scanned, q entries have left the queue: it holds the number of all entries so far, less q.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "link_pos", "url"])
        last, seen, out = int(pdf["pushed"].iat[0]), set(), []
        for place, url in zip(pdf["place"], pdf["url"], strict=True):
            if url not in seen and last - place < limit:
                last += 1
                seen.add(url)
                out.append((pdf["root"].iat[0], url, last))
        return pd.DataFrame(out, columns=["root", "url", "place"])

    return run


def crawl_select(pages: DataFrame, edges: DataFrame, roots: DataFrame, max_pages: int = 10, queue_limit: int | None = None) -> DataFrame:
    """root, url, order: pages in the order of a first-in first-out walk from each root.

    pages: url, ok. edges: src, link_pos, dst. A page that is absent or not ok takes no place and its
    links are not followed; a root that fails selects nothing. A level is one equi-join on the source
    and one anti-join with what was queued before. A URL finds the page stored under it, or under it
    with a fragment; a root with a fragment finds its page, keeps its own URL, and may meet that page
    again by a link. An archive root gives its original URL and follows no links. The queue has a
    bound: while it is full a page's links are passed by, and a later page may queue them again.
    """
    limit = queue_limit or max(max_pages * QUEUE_PER_PAGE, LEAST_QUEUE)
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    named = pages.filter("ok").select("url", F.explode(F.array(F.struct(F.col("url").alias("k"), F.lit(0).alias("r")), F.struct(bare("url").alias("k"), F.lit(1).alias("r")))).alias("n"))
    known = cut(named.groupBy(F.col("n.k").alias("key")).agg(F.min(F.struct("n.r", "url")).alias("p")).select("key", F.col("p.url").alias("page")))
    tries = roots.select("root").distinct().select("root", F.posexplode(F.array(F.col("root"), bare("root"))).alias("r", "key"))
    start = tries.join(known, "key").groupBy("root").agg(F.min(F.struct("r", "page")).alias("p"))
    one = F.lit(1).cast("long")
    front = cut(start.select("root", F.col("root").alias("url"), F.col("p.page").alias("page"), one.alias("order"), one.alias("place")))
    chosen, queued = front.drop("place"), front.select("root", "url", "place")
    front = front.filter(U.archive_original_url(F.col("root")).isNull())
    shown = lambda df: df.select(U.unwrap_archive_url(F.col("root")).alias("root"), U.unwrap_archive_url(F.col("url")).alias("url"), "order")
    while True:
        links = front.join(edges, front["page"] == edges["src"]).filter(U.queue_scope(F.col("dst"), F.col("root")))
        found = links.select("root", F.col("dst").alias("url"), "place", F.col("link_pos").cast("long").alias("link_pos")).join(queued.select("root", "url"), ["root", "url"], "left_anti")
        pushed = queued.groupBy("root").agg(F.max("place").alias("pushed"))
        new = cut(found.join(pushed, "root").groupBy("root").applyInPandas(_enqueue(limit), "root string, url string, place long"))
        if new.isEmpty():
            return shown(chosen)
        queued = cut(queued.union(new))
        had = chosen.groupBy("root").agg(F.max("order").alias("had"))
        rank = F.row_number().over(W.partitionBy("root").orderBy("place"))
        live = new.join(known.withColumnRenamed("key", "url"), "url").withColumn("rank", rank).join(had, "root").select("root", "url", "page", (F.col("had") + F.col("rank")).alias("order"), "place")
        front = cut(live.filter(F.col("order") <= max_pages))
        if front.isEmpty():
            return shown(chosen)
        chosen = cut(chosen.unionByName(front.drop("place")))
