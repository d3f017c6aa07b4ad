"""Queries over pages, runs and article files made from `documents`, whose SQL knows what went into them.

Each document becomes a page whose parts vary with its number, so that the rules for metadata, roots, links, tables and images
meet all their branches; SQL makes the expected result from the document, not from the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import gates as G
from pagemill.operators import html_nodes as H
from pagemill.operators import links as L
from pagemill.operators import versions as V
from pagemill.plans.queries import S_RUNS, query, runs, s_any, s_collapse, s_slug, table
from pagemill.sources import io

SCORE_CAP = 20_000


def shown(text: Column) -> Column:
    """Text as it stands in HTML, within quotes too."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def documents(spark, d: str) -> DataFrame:
    """page_id, url, lang, source, lines: what pages are made of."""
    k, blank = F.col("doc_id"), lambda c, to="": F.coalesce(c, F.lit(to))
    return table(spark, d, "documents").select(k.alias("page_id"), cat("https://h", k % 9, ".example.org/d/e").alias("url"), blank("lang", "und").alias("lang"), blank("source").alias("source"), F.split(blank("text"), "\n", -1).alias("lines"))


def page(docs: DataFrame, made, first: str = "<html><body><article>\n", last: str = "\n</article></body></html>") -> DataFrame:
    """page_id, url, html: every line of a document as `made` writes it, from the line and its number."""
    return docs.select("page_id", "url", cat(first, F.array_join(F.transform("lines", made), "\n"), last).alias("html"))


S_DOCS = """d AS (SELECT doc_id AS page_id, doc_id AS k, 'https://h' || doc_id % 9 || '.example.org' AS origin, coalesce(lang, 'und') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT page_id, k, origin, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d)"""


@query(f"""WITH {S_DOCS}, m AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'Head ' || k END AS head, 'Outside and longer ' || k AS outside, k % 5 = 4 AS out FROM d),
n AS (SELECT *, length({s_collapse("concat_ws(chr(10), head, 'Sub ' || lang, array_to_string(lines, chr(10)))")}) AS chars FROM m)
SELECT page_id, {s_collapse("'D' || k || ' & ' || lang")} AS title, {s_collapse("'About ' || source")} AS description, coalesce(CASE WHEN k % 3 = 0 THEN '2024-01-0' || (k % 9 + 1) END, CASE WHEN k % 2 = 0 THEN '2022-05-06' END) AS published_at,
  CASE WHEN k % 3 = 0 THEN '2024-01-0' || (k % 9 + 1) WHEN k % 3 = 1 THEN '2023-02-03' WHEN k % 2 = 0 THEN '2022-05-06' END AS published_at_readable,
  coalesce(head, CASE WHEN out THEN outside WHEN k % 4 = 1 THEN 'Shared ' || k END, {s_collapse("'D' || k || ' & ' || lang")}) AS article_title,
  CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE CASE WHEN chars >= {SCORE_CAP} THEN 4 ELSE 5 END END AS root,
  concat_ws('|', head, {s_collapse("'Sub ' || lang")}, CASE WHEN out THEN outside END) AS headings FROM n""")
def page_facts(spark, d):
    """Titles, descriptions, dates, headings and the chosen root of pages with and without each of them, in five kinds of containers."""
    k = F.col("page_id")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    head = cat(
        "<html><head><title> D", k, "  &amp; ", shown(F.col("lang")), '\n</title><meta name="description" content=" About  ', shown(F.col("source")), ' ">',
        F.when(k % 3 == 0, cat('<meta property="article:published_time" content="2024-01-0', k % 9 + 1, '">')).when(k % 3 == 1, '<meta name="publish-date" content="2023-02-03">').otherwise(""),
        F.when(k % 4 == 1, cat('<meta property="og:title" content="Shared ', k, '">')).otherwise(""), "</head><body>\n",
    )
    time = F.when(k % 2 == 0, '<time datetime="2022-05-06"></time>').otherwise("")
    start, end = pick(5, "<article>", "<div data-post-id=7>", '<div class="x available-content">', "<main>", "<main>"), pick(5, "</article>", "</div>", "</div>", "</main>", "</main>")
    body = cat(start, time, F.when(k % 4 == 0, cat("<h1>Head ", k, "</h1>\n")).otherwise(""), "<h2>Sub ", shown(F.col("lang")), "</h2>\n", F.array_join(F.transform("lines", lambda x: cat("<p>", shown(x), "</p>")), "\n"), end)
    outside = F.when(k % 5 == 4, cat("\n<h1>Outside and longer ", k, "</h1>")).otherwise("")
    parsed = H.parsed_pages(documents(spark, d).select("page_id", "url", cat(head, body, outside, "\n</body></html>").alias("html")))
    return parsed.select("page_id", "title", "description", F.col("published").alias("published_at"), H.published_at_readable().alias("published_at_readable"), H.article_title().alias("article_title"), "root", F.array_join(H.headings(), "|").alias("headings"))


@query(f"""WITH {S_DOCS}, t AS (SELECT page_id, i, CASE i % 3 WHEN 0 THEN origin || '/a/b?i=' || i WHEN 1 THEN 'https://other.example.net/x#f' ELSE 'https://q.r/s' END AS target, {s_collapse("'zq ' || line || ' zq'")} AS said FROM l),
m AS (SELECT page_id, i, '[zq](' || target || ')' || said[3:] || ' `kode' || i || 'x`' AS x FROM t)
SELECT page_id, count(*) AS blocks, md5(string_agg(x, chr(10) ORDER BY i)) AS blocks_md5 FROM m WHERE NOT {s_any("lower(x)", G.SCRIPT_MARKERS)} GROUP BY page_id""")
def inline_texts(spark, d):
    """Lines with a code and with a link to the page's own origin, to another and to an archive's copy; the label stands before the link too, where it is replaced."""
    href = lambda i: F.when(i % 3 == 0, cat("/a/b?i=", i, "#top")).when(i % 3 == 1, "https://Other.example.net:443/x#f").otherwise("https://archive.ph/2024.01.02-030405/https://q.r/s")
    pages = page(documents(spark, d), lambda x, i: cat("<p>zq ", shown(x), ' <a href="', href(i), '">zq</a>\n<code>kode', i, "x</code></p>"))
    blocks = H.raw_blocks(H.parsed_pages(pages), inline=True).groupBy("page_id").agg(F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    return blocks.select("page_id", "blocks", F.md5(F.array_join(F.transform("b", lambda x: x["text"]), "\n")).alias("blocks_md5"))


@query(f"""WITH {S_DOCS}, c AS (SELECT page_id, i, list_transform(string_split(line, '. '), lambda x: {s_collapse("x")}) AS cells FROM l),
r AS (SELECT *, row_number() OVER w AS n, max(len(cells)) OVER (PARTITION BY page_id) AS width FROM c WHERE list_bool_or(list_transform(cells, lambda x: x <> '')) WINDOW w AS (PARTITION BY page_id ORDER BY i)),
f AS (SELECT page_id, n, width, '| ' || array_to_string(list_concat(list_transform(cells, lambda x: trim(replace(x, '|', '\\|'))), list_transform(range(width - len(cells)), lambda x: '')), ' | ') || ' |' AS line FROM r),
g AS (SELECT page_id, n, line || CASE WHEN n = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(width), lambda x: ':---'), ' | ') || ' |' ELSE '' END AS line FROM f)
SELECT page_id, count(*) AS rows, md5(string_agg(line, chr(10) ORDER BY n)) AS table_md5 FROM g GROUP BY page_id""")
def page_tables(spark, d):
    """Each document as a table with a row per line and a cell per sentence; rows without text go, short ones are filled, bars are escaped."""

    def row(x: Column, i: Column) -> Column:
        tag = F.when(i == 0, "th").otherwise("td")
        return cat("<tr>", F.array_join(F.transform(F.split(shown(x), "[.] ", -1), lambda c: cat("<", tag, ">", c, "</", tag, ">")), ""), "</tr>")

    pages = page(documents(spark, d), row, "<html><body><article><table>\n", "\n</table></article></body></html>")
    return H.raw_blocks(H.parsed_pages(pages), inline=True).filter("tag = 'table'").select("page_id", (F.size(F.split("text", "\n", -1)) - 1).cast("long").alias("rows"), F.md5("text").alias("table_md5"))


@query(f"""WITH {S_DOCS}, p AS (SELECT page_id, i, 0 AS part, NULL AS src, NULL AS alt FROM l WHERE i % 2 = 0 AND NOT {s_any("lower(line)", G.SCRIPT_MARKERS)}
  UNION ALL SELECT page_id, i, 1, CASE i % 5 WHEN 0 THEN origin || '/i/' || i || '.png' WHEN 1 THEN origin || '/d/b/' || i || '.jpg' ELSE 'https://cdn.x.y/' || i || '.webp' END, CASE WHEN i % 5 = 0 THEN {s_collapse("line")} ELSE '' END FROM l WHERE i % 5 < 3),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i, part) AS block_order, row_number() OVER (PARTITION BY page_id, part ORDER BY i) AS n FROM p)
SELECT page_id, CAST(n AS INTEGER) AS "order", CAST(block_order AS INTEGER) AS block_order, src, md5(alt) AS alt_md5 FROM n WHERE part = 1""")
def page_images(spark, d):
    """Images among paragraphs, with their source in src, data-src or srcset; data URLs and SVG are noise."""

    def made(x: Column, i: Column) -> Column:
        source = F.when(i % 5 == 0, cat('src="/i/', i, '.png" alt="', shown(x), '"')).when(i % 5 == 1, cat('data-src="b/', i, '.jpg"')).when(i % 5 == 2, cat('srcset="//cdn.x.y/', i, '.webp 1x, z.webp 2x"'))
        source = source.when(i % 5 == 3, 'src="data:image/png;base64,AA"').otherwise('src="q.SVG"')
        return cat(F.when(i % 2 == 0, cat("<p>P", i, " ", shown(x), "</p>\n")).otherwise(""), "<img ", source, ">")

    blocks = H.raw_blocks(H.parsed_pages(page(documents(spark, d), made))).withColumn("caption", F.lit(""))
    return H.collect_images(blocks).select("page_id", "order", "block_order", "src", F.md5("alt").alias("alt_md5"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text, lang, source")
def page_signatures(spark, d):
    """Signatures agree exactly where all columns do; a null is no empty text."""
    signed = table(spark, d, "documents").select("doc_id", V.page_signature("text", "lang", "source").alias("signature"))
    return signed.groupBy("signature").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("signature")


_TITLE = "CASE doc_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'a 2' WHEN 2 THEN 'a-2-2' WHEN 3 THEN coalesce(lang, '') ELSE coalesce(source, '') || ' ' || doc_id % 4 END"


@query(f"""WITH RECURSIVE p AS (SELECT doc_id // 40 AS run_id, doc_id % 2 AS side, doc_id, {s_slug(_TITLE)} AS slug FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY run_id, side ORDER BY doc_id) AS n FROM p),
w AS (SELECT run_id, side, n, doc_id, slug AS dir, [slug] AS taken FROM q WHERE n = 1
  UNION ALL SELECT run_id, side, n, doc_id, dir, list_append(taken, dir) FROM (SELECT w.run_id, w.side, q.n, q.doc_id, w.taken,
    list_filter(list_prepend(q.slug, list_transform(range(2, len(w.taken) + 3), lambda x: q.slug || '-' || x)), lambda x: NOT list_contains(w.taken, x))[1] AS dir FROM w JOIN q ON q.run_id = w.run_id AND q.side = w.side AND q.n = w.n + 1))
SELECT doc_id, dir FROM w""")
def clashing_dirs(spark, d):
    """Runs of 40 documents whose titles meet the numbered names of others."""
    docs = table(spark, d, "documents").select((F.col("doc_id") / 40).cast("long").alias("run_id"), (F.col("doc_id") % 2).cast("string").alias("site"), F.col("doc_id").alias("order"), F.expr(_TITLE).alias("title"))
    return V.assign_article_dirs(docs).select(F.col("order").alias("doc_id"), "dir")


@query(f"WITH {S_RUNS} SELECT CAST(id AS VARCHAR) AS id, site, CAST(crawled_pages AS INTEGER) AS crawled, CAST(article_files AS INTEGER) AS articles FROM r")
def stored_runs(spark, d):
    """Run records written as JSON lines by site, and read back; every other one without its site, which the root URL gives."""
    path = L.shared_path(spark, "runs")
    df = runs(spark, d).select(F.col("id").cast("string").alias("id"), "site", cat("https://", F.col("site"), "/x").alias("rootUrl"), F.col("crawled_pages").alias("crawledPages"), F.col("article_files").alias("articleFiles"))
    io.write_runs(df.withColumn("site", F.when(F.col("id").cast("long") % 2 == 0, F.col("site"))), path)
    return io.read_runs(spark, path, lines=True).select("id", "site", F.col("crawledPages").alias("crawled"), F.col("articleFiles").alias("articles"))


@query("""WITH f AS (SELECT doc_id, coalesce(source, 'none') AS site, coalesce(text, '') AS t, unnest(['md', 'txt', 'json']) AS ext FROM documents WHERE source IS DISTINCT FROM (SELECT min(source) FROM documents)),
v AS (SELECT *, 'r1' AS run, CASE ext WHEN 'json' THEN '{}' || t ELSE t END AS content FROM f UNION ALL SELECT *, 'r2', CASE ext WHEN 'md' THEN t || '!' ELSE '{"n":2}' || t END FROM f WHERE doc_id % 2 = 0 AND ext <> 'txt')
SELECT site, 'd' || doc_id AS slug, ext, run, md5(content) AS content, run = max(run) OVER (PARTITION BY doc_id, ext) AS latest FROM v""")
def article_store(spark, d):
    """Two runs into a store, the second of which changes two formats of every other article, and a purge of the first site; its history, and which versions are the latest."""
    store = io.ArticleStore(spark, L.shared_path(spark, "store"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("site"), cat("d", F.col("doc_id")).alias("slug"), F.coalesce("text", F.lit("")).alias("t"))
    again = docs.filter("doc_id % 2 = 0")
    made = lambda df, run, mark, json: df.select("site", "slug", F.timestamp_seconds(F.lit(run)).alias("collected_at"), F.sha2(F.concat("t", F.lit(mark)), 256).alias("signature"), F.concat("t", F.lit(mark)).alias("md"), F.col("t").alias("txt"), F.concat(F.lit(json), "t").alias("json"))
    store.publish(made(docs, 1, "", "{}"), "r1")
    store.publish(made(again, 2, "!", '{"n":2}'), "r2")
    store.purge(table(spark, d, "documents").agg(F.min("source")).first()[0])
    latest = store.current().select("site", "slug", "ext", F.col("digest").alias("now"))
    # contents become digests before rows meet
    versions = store.history().select("site", "slug", "ext", "run", F.md5("content").alias("content"), "digest")
    return versions.join(latest, ["site", "slug", "ext"]).select("site", "slug", "ext", "run", "content", (F.col("digest") == F.col("now")).alias("latest"))
