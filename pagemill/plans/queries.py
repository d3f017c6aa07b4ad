"""The registered queries over pages, links, versions, subtitles and request logs, and their SQL.

Lines of `documents` stand in for content blocks, `conversations` for subtitle files, and `events`
for request logs; every query reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import gates as G
from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.operators import blocks as B
from pagemill.operators import captures as K
from pagemill.operators import html_nodes as H
from pagemill.operators import links as L
from pagemill.operators import requests as R
from pagemill.operators import subtitles as S
from pagemill.operators import versions as V

QUERIES: dict = {}
ORACLES: dict = {}
SKIP, STOP, SECTION_STOP = ["the", "de", "la"], ["tion in", "la de"], ["que", "of"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- SQL twins of the text columns


def s_list(items: list[str]) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def s_collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{X.SPACE}', ' ', 'g'))"


def s_key(x: str) -> str:
    return s_collapse(f"translate(lower({s_collapse(x)}), '*_`#>[]()', '         ')")


def s_slug(x: str) -> str:
    s = rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s-]', '', 'g'))"
    s = rf"regexp_replace(regexp_replace({s}, '\s+', '-', 'g'), '-+', '-', 'g')"
    return f"coalesce(nullif(regexp_replace({s}, '^-|-$', '', 'g'), ''), 'untitled-article')"


def s_any(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, n.replace("'", "''")) for n in needles) + ")"


def s_begins(x: str, markers: list[str]) -> str:
    return "(" + " OR ".join("{0} = '{1}' OR starts_with({0}, '{1} ')".format(x, m.replace("'", "''")) for m in markers) + ")"


def s_ui_noise(t: str, k: str) -> str:
    menu = rf"trim(regexp_replace(replace({k}, '*', ' '), '\s+', ' ', 'g'))"
    return rf"""({k} IN {s_list(G.UI_TEXTS)} OR starts_with({k}, '© ') OR regexp_matches({k}, '^(en|id|home|menu)$') OR {s_any(k, G.UI_PARTS)} OR {s_any(t, ["history←priornext→", "history<priornext>"])}
  OR {k} = 'advertisement' OR starts_with({k}, 'advertisement ') OR regexp_matches({k}, '^[a-z0-9.-]+\s+is\s+blocked$') OR regexp_matches(trim({t}), '(?i)^\[[^\]]+\]\(https?://[^)]+\)$')
  OR regexp_matches(trim({t}), '(?i)^-\s+\[[^\]]+›\]\(https?://[^)]+\)$') OR regexp_matches({menu}, '^({G.MENU_WORDS})(\s+\*?\s*({G.MENU_WORDS}))*$'))"""


# --- pages


def s_entities(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


S_PAGES = rf"""a AS (SELECT page_id, url, {s_collapse(s_entities("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
  {s_collapse(s_entities("regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} AS h1,
  list_transform(string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:], lambda p: {s_collapse(s_entities("regexp_replace(split_part(p, '</p>', 1), '<[^>]*>', '', 'g')"))}) AS p FROM pages),
b AS (SELECT page_id, url, title, coalesce(nullif(h1, ''), title) AS article_title, p FROM a),
c AS (SELECT *, array_to_string(list_filter(p, lambda x: x <> '' AND x <> article_title AND lower(x) NOT IN {s_list(G.NOISE_TEXTS)} AND NOT {s_any("lower(x)", G.SCRIPT_MARKERS)}), chr(10) || chr(10)) AS body FROM b),
s AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '[^a-z0-9.-]', '-', 'g') AS site, length(body) > 250 AND NOT {s_any("lower(body)", G.SCRIPT_MARKERS)} AS is_article FROM c)"""


@query(f"WITH {S_PAGES} SELECT site, count(*) AS pages, count(*) FILTER (is_article) AS articles, CAST(sum(length(body)) AS BIGINT) AS body_chars FROM s GROUP BY site")
def site_articles(spark, d):
    df = H.articles(table(spark, d, "pages"))
    df = df.select(U.site_folder(F.col("url")).alias("site"), "article_body_text", H.is_article().alias("is_article"))
    return df.groupBy("site").agg(F.count("*").alias("pages"), F.count_if("is_article").alias("articles"), F.sum(F.length("article_body_text")).alias("body_chars"))


@query(rf"""WITH {S_PAGES} SELECT page_id, title, article_title, {s_slug('article_title')} AS slug, site, md5(body) AS body_md5, is_article, {s_any("lower(title || chr(10) || body)", G.BLOCKED)} AS blocked,
  length(trim(body)) < 120 AND (trim(body) = '' OR (lower(trim(body)) = lower(trim(title)) AND title <> '' AND lower(trim(article_title)) = lower(trim(title)))) AS unreadable FROM s""")
def page_articles(spark, d):
    df = H.articles(table(spark, d, "pages"))
    t, a, b = F.col("title"), F.col("article_title"), F.col("article_body_text")
    return df.select("page_id", "title", "article_title", X.slugify(a).alias("slug"), U.site_folder(F.col("url")).alias("site"), F.md5(b).alias("body_md5"), H.is_article().alias("is_article"), G.is_blocked(t, b).alias("blocked"), G.is_unreadable(t, a, b).alias("unreadable"))


@query(rf"""WITH {S_PAGES} SELECT page_id, count(*) AS blocks, md5(string_agg(x, chr(10) ORDER BY i)) AS blocks_md5 FROM (SELECT page_id, article_title, unnest(p) AS x, unnest(range(len(p))) AS i FROM s)
  WHERE x <> '' AND x <> article_title AND lower(x) NOT IN {s_list(G.NOISE_TEXTS)} AND NOT {s_any("lower(x)", G.SCRIPT_MARKERS)} GROUP BY page_id""")
def page_raw_blocks(spark, d):
    df = H.raw_blocks(H.parsed_pages(table(spark, d, "pages"))).filter("type = 'text'")
    made = df.groupBy("page_id").agg(F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    return made.select("page_id", "blocks", F.md5(F.array_join(F.transform("b", lambda x: x["text"]), "\n")).alias("blocks_md5"))


S_LINKS = r"""h AS (SELECT page_id, url AS page_url, unnest(x) AS href, unnest(range(len(x))) AS place FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x FROM pages)),
u AS (SELECT *, lower(regexp_extract(page_url, '^([A-Za-z]+://[^/?#]+)', 1)) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS url FROM h WHERE href <> '' AND NOT starts_with(href, '#')),
f AS (SELECT page_id, page_url, url, min(place) AS place FROM u GROUP BY ALL),
e AS (SELECT page_id, page_url, row_number() OVER (PARTITION BY page_id ORDER BY place) AS link_pos, url FROM f)"""


@query(f"WITH {S_LINKS} SELECT page_id, page_url, link_pos, url FROM e WHERE link_pos <= 400")
def link_edges(spark, d):
    return L.link_edges(L.page_links(H.articles(table(spark, d, "pages"))))


@query(f"""WITH {S_LINKS}, o AS (SELECT page_url AS url, count(*) AS n FROM e GROUP BY 1), i AS (SELECT url, count(*) AS n FROM e GROUP BY 1)
  SELECT url, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM o FULL JOIN i USING (url)""")
def link_degree(spark, d):
    return L.link_degree(L.link_edges(L.page_links(H.articles(table(spark, d, "pages")))))


S_ORIGIN = "lower(regexp_extract({}, '^([A-Za-z]+://[^/?#]+)', 1))"


@query(f"""WITH RECURSIVE p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages),
n AS (SELECT url, page_id % 7 <> 3 AS ok, [lead(url, 2) OVER w, lead(url, 1) OVER w] AS next FROM p WINDOW w AS (PARTITION BY host ORDER BY page_id)),
w AS (SELECT min_by(url, page_id) AS root, [min_by(url, page_id)] AS queue, [min_by(url, page_id)] AS seen, CAST([] AS VARCHAR[]) AS got FROM p GROUP BY host
  UNION ALL SELECT root, list_concat(queue[2:], new), list_concat(seen, new), CASE WHEN ok THEN list_append(got, queue[1]) ELSE got END
  FROM (SELECT w.*, n.ok, list_filter(CASE WHEN n.ok THEN n.next ELSE [] END, lambda x: x IS NOT NULL AND NOT list_contains(w.seen, x) AND {S_ORIGIN.format("x")} = {S_ORIGIN.format("w.root")}) AS new
    FROM w JOIN n ON n.url = w.queue[1] WHERE len(w.got) < 10))
SELECT root, unnest(got) AS url, unnest(range(1, len(got) + 1)) AS "order" FROM w WHERE len(queue) = 0 OR len(got) = 10""")
def crawl_select(spark, d):
    """Each page links to the next two of its host; a walk from every host's first page."""
    pages = table(spark, d, "pages").select("page_id", "url", U.host(F.col("url")).alias("host"))
    from pyspark.sql import Window as W

    w = W.partitionBy("host").orderBy("page_id")
    near = pages.select(F.col("url").alias("src"), F.array(F.lead("url", 2).over(w), F.lead("url", 1).over(w)).alias("next"))
    edges = near.select("src", F.posexplode("next").alias("link_pos", "dst")).filter("dst is not null")
    roots = pages.groupBy("host").agg(F.min_by("url", "page_id").alias("root")).select("root")
    return L.crawl_select(pages.select("url", (F.col("page_id") % 7 != 3).alias("ok")), edges, roots)


@query(f"""WITH RECURSIVE {S_LINKS}, g AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS i, count(*) OVER (PARTITION BY host) AS many FROM g),
a AS (SELECT url, host, row_number() OVER (PARTITION BY host ORDER BY url) - 1 AS i FROM (SELECT DISTINCT e.url, g.host FROM e JOIN g USING (page_id))),
s AS (SELECT a.url, k.page_id FROM a JOIN k ON k.host = a.host AND a.i % k.many = k.i UNION SELECT url, page_id FROM k),
l AS (SELECT page_id, list(url ORDER BY link_pos) AS next FROM e WHERE link_pos <= 400 GROUP BY page_id),
n AS (SELECT s.url, s.page_id % 7 <> 3 AS ok, coalesce(next, []) AS next FROM s LEFT JOIN l USING (page_id)),
w AS (SELECT url AS root, [url] AS queue, [url] AS seen, CAST([] AS VARCHAR[]) AS got FROM k WHERE i = 0 AND page_id % 7 <> 3
  UNION ALL SELECT root, list_concat(queue[2:], new), list_concat(seen, new), CASE WHEN ok THEN list_append(got, queue[1]) ELSE got END
  FROM (SELECT w.*, n.ok, list_filter(CASE WHEN n.ok THEN n.next ELSE [] END, lambda x: NOT list_contains(w.seen, x) AND {S_ORIGIN.format("x")} = {S_ORIGIN.format("w.root")})[1 : greatest(0, 9 - len(w.queue))] AS new
    FROM w JOIN n ON n.url = w.queue[1] WHERE len(w.got) < 12))
SELECT root, unnest(got) AS url, unnest(range(1, len(got) + 1)) AS "order" FROM w WHERE len(queue) = 0 OR len(got) = 12""")
def crawl_links(spark, d):
    """A walk over the links of the pages themselves, with a queue of 8: each link leads to one of its host's pages, dealt in the order of URLs."""
    from pyspark.sql import Window as W

    pages = table(spark, d, "pages")
    edges = L.cut(L.link_edges(L.page_links(H.articles(pages))))
    host = lambda: W.partitionBy("host")
    known = pages.select("page_id", "url", U.host(F.col("url")).alias("host"))
    known = known.withColumn("i", F.row_number().over(host().orderBy("page_id")) - 1).withColumn("many", F.count("*").over(host()))
    names = edges.join(known.select("page_id", "host"), "page_id").select("url", "host").distinct().withColumn("at", F.row_number().over(host().orderBy("url")) - 1)
    many = known.groupBy("host").agg(F.first("many").alias("all"))
    led = names.join(many, "host").select("url", "host", (F.col("at") % F.col("all")).alias("i")).join(known.select("host", "i", "page_id"), ["host", "i"]).select("url", "page_id")
    served = L.cut(led.union(known.select("url", "page_id")).distinct())
    links = served.join(edges.select("page_id", "link_pos", F.col("url").alias("dst")), "page_id").select(F.col("url").alias("src"), "link_pos", "dst")
    return L.crawl_select(served.select("url", (F.col("page_id") % 7 != 3).alias("ok")), links, known.filter("i = 0").select(F.col("url").alias("root")), 12, 8)


@query(rf"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '[^a-z0-9.-]', '-', 'g') AS site, url || '::' || page_id AS key, false AS archived, true AS supported,
  lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) = 'http://ththre.example.com' AS in_scope FROM pages""")
def url_rules(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.site_folder(u).alias("site"), U.request_key(u, F.col("page_id")).alias("key"), U.is_archive_host(U.host(u)).alias("archived"), U.is_supported_href(u).alias("supported"), U.queue_scope(u, F.lit("http://ththre.example.com/")).alias("in_scope"))


S_ORIGIN_OF = "lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1))"


@query(f"""WITH o AS (SELECT page_id, {S_ORIGIN_OF} AS o FROM pages)
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN o || '/a/b.png' WHEN 1 THEN o || '/c.png?x=1#f' WHEN 2 THEN regexp_extract(o, '^([a-z]+):', 1) || '://cdn.x.y/z.png' WHEN 3 THEN 'https://other.z/q%20r.svg' WHEN 4 THEN 'data:image/png;base64,AA==' ELSE '' END AS src,
  page_id % 6 IN (3, 4) AS noise FROM o""")
def media_urls(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(U.origin(F.col("url")), F.lit("/d/e.html")).alias("url"))
    given = F.get(F.array(*[F.lit(x) for x in ("/a/b.png", "../c.png?x=1#f", "//cdn.x.y/z.png", "HTTPS://Other.z:443/q r.svg", "data:image/png;base64,AA==", "")]), (F.col("page_id") % 6).cast("int"))
    src = pages.select("page_id", U.media_url(given, F.col("url")).alias("src"))
    return src.select("page_id", "src", G.is_noise_image_src(F.col("src")).alias("noise"))


@query(f"""WITH o AS (SELECT page_id, url, {S_ORIGIN_OF} AS o FROM pages)
  SELECT page_id, page_id % 7 NOT IN (3, 4, 5, 6) AS supported, page_id % 7 IN (0, 1) AS archived, CASE page_id % 7 WHEN 0 THEN o || '/w' WHEN 1 THEN o || '/v?q=a+b' END AS original FROM o""")
def archive_links(spark, d):
    """Links to an archive's copies (plain, and percent-encoded in a query), a look-alike host, and hrefs that are no links."""
    k, o = F.col("page_id") % 7, U.origin(F.col("url"))
    encoded = F.replace(F.replace(o, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F"))
    href = F.when(k == 0, F.concat(F.lit("https://archive.ph/2024.01.02-030405/"), o, F.lit("/w)."))).when(k == 1, F.concat(F.lit("https://www.Archive.today/?url="), encoded, F.lit("%2Fv%3Fq%3Da+b"))).when(k == 2, F.concat(F.lit("https://notarchive.is/2024/"), o))
    href = href.when(k == 3, "mailto:a@b.c").when(k == 4, "#top").when(k == 5, "javascript:void(0)").otherwise("")
    return table(spark, d, "pages").select("page_id", href.alias("h")).select("page_id", U.is_supported_href(F.col("h")).alias("supported"), F.coalesce(U.is_archive_host(U.host(F.col("h"))), F.lit(False)).alias("archived"), U.archive_original_url(F.col("h")).alias("original"))


@query("""SELECT page_id, page_id % 4 = 1 AS challenge, page_id % 4 = 2 AS rejected, page_id % 4 IN (0, 3) AS noise_table FROM pages""")
def capture_gates(spark, d):
    """Whole pages with and without the marks of a check page, a refusing archive, and the tables of its toolbar."""
    k = F.col("page_id") % 4
    pages = table(spark, d, "pages").withColumn("h", F.concat(F.regexp_replace("html", "(?i)captcha|No results|turnstile", "x"), F.when(k == 1, "<p>Checking your BROWSER</p>").when(k == 2, "No results").otherwise("no results")))
    cells = F.when(k == 0, "| 0% | 50% | 100% |").when(k == 3, "archive.today  *webpage* capture").when(k == 1, "| 10% | 100% |").otherwise("| 0% | 1000% |")
    return pages.select("page_id", G.is_challenge_html(F.col("h")).alias("challenge"), G.is_archive_reject(F.col("h")).alias("rejected"), G.is_noise_table(F.regexp_replace(cells, "today  [*]", "today")).alias("noise_table"))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages)
  SELECT page_id, host, CASE WHEN ends_with(host, '.example.com') THEN 'com' WHEN ends_with(host, '.example.net') THEN 'net' ELSE 'none' END AS rule FROM p""")
def host_rules(spark, d):
    rules = spark.createDataFrame([("example.com", "com", 1), ("example.net", "net", 2)], "host string, rule string, rank int")
    pages = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("h"))
    return U.host_rule(pages, "h", rules, "none").select("page_id", F.col("h").alias("host"), "rule")


@query("SELECT page_id, url FROM pages WHERE regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '[^a-z0-9.-]', '-', 'g') <> 'ththre.example.com'")
def purge_site(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", U.site_folder(F.col("url")).alias("site"))
    return V.purge_site(pages, "http://ththre.example.com/x").select("page_id", "url")


S_CAPTURES = f"""v AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN '' ELSE body END AS b0 FROM s),
r0 AS (SELECT *, {s_any("lower(title || chr(10) || b0)", G.BLOCKED)} AS x0, {s_any("lower(title || chr(10) || body)", G.BLOCKED)} AS x FROM v),
r1 AS (SELECT *, page_id % 4 = 0 AND (x0 OR length(b0) < 160) AND length(body) > greatest(80, length(b0)) AS rendered FROM r0),
r2 AS (SELECT *, NOT rendered AND page_id % 4 = 2 AND x0 AND NOT x AND length(body) > 160 AS mirror FROM r1),
r3 AS (SELECT *, CASE WHEN rendered THEN 'rendered' WHEN mirror THEN 'mirror' ELSE 'direct' END AS stage, CASE WHEN rendered OR mirror THEN body ELSE b0 END AS b FROM r2)"""


@query(f"""WITH {S_PAGES}, {S_CAPTURES} SELECT url, stage, title, b AS body, {s_any("lower(title || chr(10) || b)", G.BLOCKED)}
  OR (length(trim(b)) < 120 AND (trim(b) = '' OR (title <> '' AND lower(trim(b)) = lower(trim(title)) AND lower(trim(article_title)) = lower(trim(title))))) AS failed FROM r3""")
def arbitrate_captures(spark, d):
    """Captures of a page: the page itself as direct, and its text as rendered and mirror form for some. Pages of one URL stay apart."""
    a = H.articles(table(spark, d, "pages")).select("page_id", "url", "title", "article_title", F.col("article_body_text").alias("body"))
    k, direct = F.col("page_id"), F.col("variant") == "direct"
    other = F.when(k % 4 == 0, F.array(F.lit("rendered"))).when(k % 2 == 0, F.array(F.lit("mirror"))).otherwise(F.array().cast("array<string>"))
    # pages are parsed once, for all forms
    forms = a.withColumn("variant", F.explode(F.concat(F.array(F.lit("direct")), other)))
    return K.arbitrate_captures(forms.withColumn("body", F.when(direct & (k % 3 == 0), "").otherwise(F.col("body")))).drop("page_id")


@query(rf"""WITH {S_PAGES}, h AS (SELECT page_id, url, title, h1, array_to_string(list_filter(list_concat([h1], p), lambda x: x <> ''), chr(10) || chr(10)) AS body FROM a)
  SELECT page_id, coalesce(nullif(h1, ''), title) AS article_title, md5(body) AS body_md5, CAST(h1 <> '' AS INTEGER) AS headings, length(body) > 160 AS is_article FROM h WHERE length(body) >= 160 AND (h1 <> '' OR title <> '')""")
def readable_articles(spark, d):
    """Pages as a reader view shows them, whole: without the operator's bound on blocks."""
    r = H.readable_article(H.parsed_pages(table(spark, d, "pages")), None)
    return r.select("page_id", "article_title", F.md5("article_body_text").alias("body_md5"), F.size("headings").alias("headings"), "is_article")


@query(rf"""SELECT doc_id AS page_id, {s_collapse("split_part(text, chr(10), 1)")} AS title, {s_collapse("text")} AS body FROM documents WHERE length({s_collapse("text")}) >= 10 AND doc_id % 5 <> 0""")
def structured_articles(spark, d):
    t = F.regexp_replace("text", "\n+", " ")
    kind = F.when(F.col("doc_id") % 5 == 0, "WebSite").otherwise("NewsArticle")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.array(F.lit("{broken"), F.to_json(F.struct(kind.alias("@type"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"), t.alias("articleBody")))).alias("jsonld"))
    return K.structured_article(docs).select("page_id", "title", "body")


@query(f"SELECT url, title, {s_collapse('text')} AS body FROM (SELECT 'doc:' || doc_id AS url, 'Doc ' || doc_id AS title, text FROM documents) WHERE {s_collapse('text')} <> ''")
def rendered_articles(spark, d):
    docs = table(spark, d, "documents")
    raw = F.concat(F.lit("Title: Doc "), F.col("doc_id").cast("string"), F.lit("\n\nMarkdown Content:\n"), F.regexp_replace("text", r"\s*\n\s*", "\n"))
    return K.rendered_article(docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), raw.alias("raw_text"))).select("url", "title", "body")


def rendered_docs(spark, d) -> DataFrame:
    """Documents in the proxy's form: their lines as paragraphs, headings, images, linked images, rules, links and blank lines."""
    docs = table(spark, d, "documents")
    place = lambda i: (i + F.col("doc_id")) % 8
    no = lambda i: i.cast("string")
    line = lambda x, i: (
        F.when(place(i) == 1, F.concat(F.lit("## "), x)).when(place(i) == 2, F.concat(F.lit("  ![alt "), no(i), F.lit("](https://x.y/i.png) "))).when(place(i) == 3, F.lit("[![](/p.png)](https://x.y/t)"))
        .when(place(i) == 4, F.when(F.col("doc_id") % 2 == 0, "-----").otherwise("Loading diagram...")).when(place(i) == 5, F.concat(F.lit("see [the *link*](https://l.k) "), x)).when(place(i) == 6, F.when(F.col("doc_id") % 3 == 0, " ").otherwise("![none]()")).otherwise(x)
    )
    made = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line), "\n")
    title = F.when(F.col("doc_id") % 4 == 0, "URL Source: x").otherwise(F.concat(F.lit("Title:  Doc "), F.col("doc_id").cast("string")))
    marker = F.when(F.col("doc_id") % 9 != 5, "\n\nMarkdown Content:\n").otherwise("\n\n")
    return docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), F.concat(title, marker, made).alias("raw_text"))


_IMG, _LNK = r"'^!\[(.*?)\]\((.*?)\)$'", r"'^\[!\[(.*?)\]\((.*?)\)\]\((.*?)\)$'"
S_RENDERED = rf"""b AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents WHERE doc_id % 9 <> 5)),
w AS (SELECT doc_id, i, CASE (i + doc_id) % 8 WHEN 1 THEN '## ' || x WHEN 2 THEN '![alt ' || i || '](https://x.y/i.png)' WHEN 3 THEN '[![](/p.png)](https://x.y/t)' WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN '-----' ELSE 'Loading diagram...' END
  WHEN 5 THEN 'see [the *link*](https://l.k) ' || x WHEN 6 THEN CASE WHEN doc_id % 3 = 0 THEN '' ELSE '![none]()' END ELSE x END AS t FROM b),
t AS (SELECT doc_id, i, regexp_replace(t, '^{X.SPACE}|{X.SPACE}$', '', 'g') AS t FROM w),
m AS (SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 4 <> 0 THEN 'Doc ' || doc_id ELSE '' END, ''), {s_collapse(r"regexp_extract(regexp_replace(string_agg(t, chr(10) ORDER BY i), '^\s+', ''), '(?m)^#{{1,6}}\s*(.+)$', 1)".replace("{{", "{").replace("}}", "}"))}) AS title FROM t GROUP BY doc_id),
k AS (SELECT *, CASE WHEN regexp_matches(t, {_IMG}) THEN 'image' WHEN regexp_matches(t, {_LNK}) THEN 'linked' WHEN t = '' OR t = 'Loading diagram...' OR regexp_matches(t, '^[-=*]{{3,}}$') THEN 'end' ELSE 'text' END AS kind FROM t),
g AS (SELECT *, count(*) FILTER (kind <> 'text') OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM k),
p AS (SELECT doc_id, min(i) AS i, string_agg(t, ' ' ORDER BY i) AS t FROM g WHERE kind = 'text' GROUP BY doc_id, g),
c AS (SELECT doc_id, i, {s_collapse(r"regexp_replace(regexp_replace(regexp_replace(t, '^#{1,6}\s*', ''), '^[-*_]{3,}$', ''), '\[(.*?)\]\((.*?)\)', '\1', 'g')")} AS text FROM p),
q AS (SELECT doc_id, i, 'text' AS type, 'p' AS tag, text, NULL AS src, NULL AS alt, NULL AS caption FROM c WHERE text <> '' UNION ALL
  SELECT doc_id, i, 'image', NULL, NULL, regexp_extract(t, {_IMG}, 2), regexp_extract(t, {_IMG}, 1), '' FROM k WHERE kind = 'image' AND regexp_extract(t, {_IMG}, 2) <> '' UNION ALL
  SELECT doc_id, i, 'image', NULL, NULL, regexp_extract(t, {_LNK}, 2), 'image', regexp_extract(t, {_LNK}, 3) FROM k WHERE kind = 'linked'),
r AS (SELECT q.*, m.title, count(*) FILTER (type = 'text') OVER (PARTITION BY doc_id) AS texts, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM q JOIN m USING (doc_id))"""


@query(f"WITH {S_RENDERED} SELECT 'doc:' || doc_id AS url, CAST(pos AS INTEGER) AS pos, type, tag, text, src, alt, caption FROM r WHERE title <> '' AND texts > 0")
def rendered_blocks(spark, d):
    return K.rendered_blocks(rendered_docs(spark, d))


@query(f"WITH {S_RENDERED} SELECT 'doc:' || doc_id AS url, any_value(title) AS title, arg_min(text, pos) FILTER (type = 'text') AS description, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (type = 'text')) AS body_md5, count(*) FILTER (type = 'image') AS images FROM r WHERE title <> '' AND texts > 0 GROUP BY doc_id")
def rendered_documents(spark, d):
    return K.rendered_article(rendered_docs(spark, d)).select("url", "title", "description", F.md5("body").alias("body_md5"), F.col("image_count").cast("long").alias("images"))


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN coalesce(nullif({s_collapse("h")}, ''), 'a.b') WHEN 1 THEN coalesce(nullif({s_collapse("h")}, ''), 'a.b') WHEN 2 THEN 'a.b' WHEN 3 THEN 'Untitled' ELSE 'a.b' END AS title
  FROM (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS h FROM documents)""")
def document_titles(spark, d):
    """Documents as Markdown with a title in front matter, in a title line, in no place, and with a front matter that doesn't end."""
    docs = table(spark, d, "documents").withColumn("h", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)))
    k = F.col("doc_id") % 5
    md = F.when(k == 0, F.concat(F.lit("---\nsource: x\nTITLE: '"), F.col("h"), F.lit("'\n---\nBody"))).when(k == 1, F.concat(F.lit("Text\nTitle:  "), F.col("h"), F.lit("\nmore"))).when(k == 4, "--- \ntitle: never ends\n").otherwise("# Heading\n\ntitle: x")
    url = F.when(k == 3, "").otherwise("https://A.b:81/x")
    return docs.select("doc_id", X.document_title(md, url).alias("title"))


# --- blocks


def lines(spark, d) -> DataFrame:
    df = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    image = F.col("pos") % 6 == 4
    tag = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("h"), (1 + (F.col("page_id") + F.col("pos")) % 4).cast("string"))).when(F.col("pos") % 7 == 3, "li").otherwise("p")
    none = F.lit(None).cast("string")
    return df.select("page_id", "pos", F.when(image, "image").otherwise("text").alias("type"), F.when(~image, tag).alias("tag"), F.when(~image, F.col("text")).alias("text"), F.when(image, F.concat(F.lit("/i"), F.col("pos").cast("string"), F.when(F.col("pos") % 4 == 0, ".svg").otherwise(".png"))).alias("src"), none.alias("alt"), none.alias("caption"))


S_LINES = f"""d AS (SELECT doc_id AS page_id, string_split(text, chr(10)) AS a FROM documents),
l0 AS (SELECT page_id, unnest(a) AS x, CAST(unnest(range(len(a))) AS INTEGER) AS pos FROM d),
l AS (SELECT page_id, pos, CASE WHEN pos % 6 = 4 THEN 'image' ELSE 'text' END AS type, CASE WHEN pos % 6 = 4 THEN NULL WHEN pos % 5 = 0 THEN 'h' || (1 + (page_id + pos) % 4) WHEN pos % 7 = 3 THEN 'li' ELSE 'p' END AS tag,
  CASE WHEN pos % 6 <> 4 THEN x END AS text, CASE WHEN pos % 6 = 4 THEN '/i' || pos || CASE WHEN pos % 4 = 0 THEN '.svg' ELSE '.png' END END AS src FROM l0),
k0 AS (SELECT *, {s_key("text")} AS key, CASE WHEN starts_with(tag, 'h') THEN CAST(tag[2] AS INTEGER) END AS level FROM l),
k AS (SELECT *, type = 'text' AND NOT ({s_collapse("text")} = '' OR {s_ui_noise("coalesce(text, '')", "key")} OR coalesce(level IS NOT NULL AND length(text) >= 24 AND (ends_with(text, '…') OR ends_with(text, '...')), false)) AS live FROM k0)"""
_LEVELS = " OR ".join(f"coalesce(max(CASE WHEN start AND level = {i} THEN pos END) OVER r >= coalesce(max(CASE WHEN head AND NOT start AND level <= {i} THEN pos END) OVER r, -1), false)" for i in range(1, 7))
S_SKIP = f"""{S_LINES}, m AS (SELECT *, live AND level IS NOT NULL AS head, live AND level IS NOT NULL AND {s_begins("key", SKIP)} AS start FROM k),
hid AS (SELECT *, {_LEVELS} AS hidden FROM m WINDOW r AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)), b6 AS (SELECT * FROM hid WHERE NOT (hidden AND type = 'text'))"""
S_STOP = f"""{S_SKIP}, st AS (SELECT *, min(CASE WHEN live AND ({s_any("key", STOP)} OR (level IS NOT NULL AND {s_begins("key", SECTION_STOP)})) THEN pos END) OVER (PARTITION BY page_id) AS stop FROM b6),
b7 AS (SELECT * FROM st WHERE stop IS NULL OR pos < stop)"""
S_LONG = f"""{S_STOP}, b8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, CASE WHEN type = 'text' AND length(key) >= 24 THEN key ELSE '#' || pos END ORDER BY pos) AS nth FROM b7 WHERE type = 'image' OR live) WHERE nth = 1)"""
S_ADJ = f"""{S_LONG}, b9 AS (SELECT * FROM (SELECT *, lag(type) OVER w AS pt, lag(key) OVER w AS pk FROM b8 WINDOW w AS (PARTITION BY page_id ORDER BY pos)) WHERE NOT coalesce(type = 'text' AND key <> '' AND pt = 'text' AND pk = key, false))"""
S_IMG = f"""{S_ADJ}, b5 AS (SELECT * FROM b9 WHERE NOT (type = 'image' AND ends_with(src, '.svg'))),
f10 AS (SELECT *, min(CASE WHEN type = 'text' THEN pos END) OVER (PARTITION BY page_id) AS first FROM b5),
b10 AS (SELECT * FROM (SELECT *, count(*) FILTER (type = 'image' AND pos < first) OVER (PARTITION BY page_id) AS early FROM f10) WHERE NOT coalesce(type = 'image' AND pos < first AND early >= 3, false)),
f11 AS (SELECT * EXCLUDE (first, early), min(CASE WHEN type = 'text' AND NOT starts_with(tag, 'h') THEN pos END) OVER (PARTITION BY page_id) AS first FROM b10),
b11 AS (SELECT * FROM (SELECT *, count(*) FILTER (type = 'image' AND pos < first) OVER (PARTITION BY page_id) AS early FROM f11) WHERE NOT coalesce(type = 'image' AND pos < first AND early >= 3, false))"""
_LIVE = "type = 'image' or live"


@query(f"WITH {S_LINES} SELECT page_id, pos, key, live, {s_slug('text')} AS slug, lower(text) IN {s_list(G.NOISE_TEXTS)} OR {s_any('lower(text)', G.SCRIPT_MARKERS)} AS noise FROM k WHERE type = 'text'")
def text_rules(spark, d):
    t = F.col("text")
    return B.mark_blocks(lines(spark, d)).filter("type = 'text'").select("page_id", "pos", "key", "live", X.slugify(t).alias("slug"), G.is_noise_text(t).alias("noise"))


#: A walk over each page's blocks in order: the level of the section that is skipped (0: none), whether the row is hidden, and whether all has stopped.
S_WALK = f"""WITH RECURSIVE {S_LINES}, e AS (SELECT page_id, pos, type, key, live, coalesce(level, 0) AS level, live AND level IS NOT NULL AND {s_begins("key", SKIP)} AS opens,
  live AND ({s_any("key", STOP)} OR (level IS NOT NULL AND {s_begins("key", SECTION_STOP)})) AS ends, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM k),
v AS (SELECT DISTINCT page_id, 0::BIGINT AS n, -1 AS pos, '' AS key, 0 AS skip, false AS hidden, false AS stopped FROM e UNION ALL
  SELECT page_id, n, pos, key, skip, type = 'text' AND skip > 0, stopped OR (ends AND NOT (type = 'text' AND skip > 0)) FROM (
    SELECT e.*, v.stopped, CASE WHEN NOT e.live OR e.level = 0 THEN v.skip WHEN v.skip > 0 AND e.level > v.skip THEN v.skip WHEN e.opens THEN e.level ELSE 0 END AS skip FROM v JOIN e ON e.page_id = v.page_id AND e.n = v.n + 1))"""


@query(f"{S_WALK} SELECT page_id, pos, key FROM v WHERE n > 0 AND NOT hidden")
def skipped_sections(spark, d):
    return B.drop_skipped_sections(B.mark_blocks(lines(spark, d)), SKIP).select("page_id", "pos", "key")


@query(f"{S_WALK} SELECT page_id, pos, key FROM v WHERE n > 0 AND NOT hidden AND NOT stopped")
def stopped_blocks(spark, d):
    return B.stop_at_marker(B.drop_skipped_sections(B.mark_blocks(lines(spark, d)), SKIP), STOP, SECTION_STOP).select("page_id", "pos", "key")


@query(f"WITH {S_LONG} SELECT page_id, pos, key FROM b8")
def deduped_long_blocks(spark, d):
    df = B.stop_at_marker(B.drop_skipped_sections(B.mark_blocks(lines(spark, d)), SKIP), STOP, SECTION_STOP).filter(_LIVE)
    return B.dedupe_long_blocks(df).select("page_id", "pos", "key")


@query(f"WITH {S_ADJ} SELECT page_id, pos, key FROM b9")
def deduped_adjacent_blocks(spark, d):
    df = B.stop_at_marker(B.drop_skipped_sections(B.mark_blocks(lines(spark, d)), SKIP), STOP, SECTION_STOP).filter(_LIVE)
    return B.dedupe_adjacent_blocks(B.dedupe_long_blocks(df)).select("page_id", "pos", "key")


@query(f"WITH {S_IMG} SELECT page_id, pos, type, tag, md5(coalesce(text, src)) AS content FROM b11")
def cleaned_blocks(spark, d):
    return B.clean_blocks(lines(spark, d), SKIP, STOP, SECTION_STOP).select("page_id", "pos", "type", "tag", F.md5(F.coalesce("text", "src")).alias("content"))


@query(f"""WITH {S_LINES}, n AS (SELECT *, count(*) FILTER (type = 'image') OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS no, {s_collapse('text')} AS c FROM l),
r AS (SELECT page_id, pos, CASE WHEN type = 'image' THEN '![img](' || src || ')' WHEN c = '' AND NOT starts_with(tag, 'h') AND tag <> 'li' THEN '' WHEN starts_with(tag, 'h') THEN repeat('#', greatest(2, CAST(tag[2] AS INTEGER))) || ' ' || c WHEN tag = 'li' THEN '- ' || c ELSE c END AS md FROM n)
SELECT page_id, md5(string_agg(md, chr(10) || chr(10) ORDER BY pos)) AS md5, count(*) AS blocks FROM r WHERE md <> '' GROUP BY page_id""")
def rendered_markdown(spark, d):
    return B.blocks_to_markdown(lines(spark, d)).select("page_id", F.md5("markdown").alias("md5"), F.col("rendered").alias("blocks"))


@query(f"WITH {S_LINES} SELECT page_id, count(*) FILTER (type = 'image') AS images, count(*) FILTER (type = 'text') AS texts FROM l GROUP BY page_id")
def block_counts(spark, d):
    return lines(spark, d).groupBy("page_id").agg(F.count_if(F.col("type") == "image").alias("images"), F.count_if(F.col("type") == "text").alias("texts"))


@query("SELECT event_id, strftime(ts, '%-m/%-d/%Y, %-I:%M:%S %p') AS shown, strftime(ts, '%Y-%m-%d_%H-%M-%S-') || lpad(CAST(CAST(floor(microsecond(ts) / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || 'Z' AS slug FROM events")
def dates(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", X.display_date(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("shown"), X.timestamp_slug(ts).alias("slug"))


_HEAD = f"'{'=' * 80}' || chr(10) || 'TITLE: ' || article_title || chr(10) || 'SOURCE: ' || url || chr(10) || 'DATE: 1/2/2024, 3:04:05 AM' || chr(10) || '{'=' * 80}' || chr(10) || chr(10)"


@query(rf"""WITH {S_PAGES}, x AS (SELECT page_id, article_title, unnest(p) AS x, unnest(range(len(p))) AS i FROM s),
k AS (SELECT *, {s_key("x")} AS key FROM x WHERE x <> '' AND x <> article_title AND lower(x) NOT IN {s_list(G.NOISE_TEXTS)} AND NOT {s_any("lower(x)", G.SCRIPT_MARKERS)}),
l AS (SELECT * FROM k WHERE NOT {s_ui_noise("x", "key")}),
t AS (SELECT * FROM l WHERE NOT EXISTS (FROM l AS e WHERE e.page_id = l.page_id AND e.i <= l.i AND {s_any("e.key", B.STOP)})),
u AS (SELECT * FROM t WHERE length(key) < 24 OR NOT EXISTS (FROM t AS e WHERE e.page_id = t.page_id AND e.i < t.i AND e.key = t.key)),
v AS (SELECT * FROM (SELECT *, lag(key) OVER (PARTITION BY page_id ORDER BY i) AS before FROM u) WHERE key = '' OR before IS NULL OR before <> key),
m AS (SELECT page_id, string_agg({s_collapse("x")}, chr(10) || chr(10) ORDER BY i) AS md FROM v GROUP BY page_id),
z AS (SELECT page_id, url, article_title, coalesce(md, body) AS shown FROM s LEFT JOIN m USING (page_id))
SELECT page_id, regexp_replace({_HEAD} || '# ' || article_title || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || shown, '\s+$', '') || chr(10) AS markdown, {_HEAD} || shown || chr(10) AS "text" FROM z""")
def article_documents(spark, d):
    """Each page as a Markdown and a text document; pages are parsed once, into a written table."""
    parsed = L.cut(H.parsed_pages(table(spark, d, "pages")))
    blocks = B.clean_blocks(H.raw_blocks(parsed, inline=True).withColumn("caption", F.lit("")))
    return B.article_documents(H.article_columns(parsed), blocks, F.lit("2024-01-02 03:04:05"))


# --- versions and runs


def history(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("site"), F.col("lang").alias("slug"), F.when(F.col("doc_id") % 2 == 0, "md").otherwise("txt").alias("ext"), F.col("doc_id").alias("collected_at"), F.concat(F.lit("DATE: "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("content"), F.md5("text").alias("signature"))


S_HIST = "h AS (SELECT source AS site, lang AS slug, CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'txt' END AS ext, doc_id AS collected_at, text, md5(text) AS signature FROM documents)"


@query(f"WITH {S_HIST} SELECT site, slug, max(collected_at) AS collected_at, max_by(signature, collected_at) AS signature FROM h GROUP BY ALL")
def latest_versions(spark, d):
    return V.latest_version(history(spark, d).select("site", "slug", "collected_at", "signature"))


@query(f"WITH {S_HIST}, n AS (SELECT site, slug, max(collected_at) AS m FROM h WHERE collected_at % 3 = 0 GROUP BY ALL), o AS (SELECT h.site, h.slug, h.signature FROM h JOIN n ON h.site = n.site AND h.slug = n.slug AND h.collected_at = n.m) SELECT h.site, h.slug, collected_at FROM h LEFT JOIN o ON h.site = o.site AND h.slug = o.slug WHERE collected_at % 3 <> 0 AND (o.signature IS NULL OR o.signature <> h.signature)")
def new_versions(spark, d):
    h = history(spark, d).select("site", "slug", "collected_at", "signature")
    return V.new_versions(h.filter("collected_at % 3 != 0"), V.latest_version(h.filter("collected_at % 3 = 0"))).select("site", "slug", "collected_at")


@query(f"WITH {S_HIST} SELECT site, slug, collected_at FROM (SELECT *, lag(signature) OVER (PARTITION BY site, slug ORDER BY collected_at) AS o FROM h) WHERE o IS NULL OR o <> signature")
def changed_versions(spark, d):
    return V.changed_versions(history(spark, d).select("site", "slug", "collected_at", "signature"))[["site", "slug", "collected_at"]]


@query(f"WITH {S_HIST}, c AS (SELECT *, row_number() OVER (PARTITION BY site, slug, ext ORDER BY collected_at DESC) AS n FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY site, slug, ext, text ORDER BY collected_at DESC) AS m FROM c WHERE n <= 20) SELECT site, slug, ext, collected_at FROM k WHERE m = 1")
def retained_history(spark, d):
    return V.dedupe_history(V.cap_history(history(spark, d), 20)).select("site", "slug", "ext", "collected_at")


@query("""WITH f AS (SELECT doc_id, source AS site, unnest(['md', 'txt', 'json']) AS ext, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, t || CASE ext WHEN 'md' THEN CASE WHEN doc_id % 2 = 0 THEN ' new' ELSE '' END WHEN 'txt' THEN CASE WHEN doc_id % 5 = 0 THEN ' new' ELSE '' END ELSE '{}' || doc_id END AS content FROM f)
SELECT site, 'd' || doc_id AS slug, ext, md5(content) AS content FROM n WHERE doc_id % 3 = 2 OR (doc_id % 4 <> 0 AND content <> t)""")
def format_versions(spark, d):
    """A run over stored articles: a third are new, a quarter have the stored signature; of the others the formats whose text has changed."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("site"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("slug"), F.coalesce("text", F.lit("")).alias("t"))
    new = lambda k: F.concat("t", F.when(F.col("doc_id") % k == 0, " new").otherwise(""))
    signed = F.md5(F.concat("t", F.when(F.col("doc_id") % 4 != 0, "later").otherwise("")))
    run = docs.select("site", "slug", F.lit(2).alias("collected_at"), signed.alias("signature"), new(2).alias("md"), new(5).alias("txt"), F.concat("t", F.lit("{}"), F.col("doc_id").cast("string")).alias("json"))
    stored = docs.filter("doc_id % 3 != 2").select("site", "slug", F.md5("t").alias("signature"), F.sha2("t", 256).alias("digest"), F.explode(F.array(*map(F.lit, V.FORMATS))).alias("ext"))
    return V.format_versions(run, stored).select("site", "slug", "ext", F.md5("content").alias("content"))


def run_pages(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("order"), (F.col("event_type") == "click").alias("is_article"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("site"), F.col("event_type").alias("title"), F.unix_micros(F.col("ts").cast("timestamp")).alias("collected_at"))


S_RUNS = "p AS (SELECT user_id AS run_id, event_id AS ord, event_type = 'click' AS is_article, 's' || (user_id % 7) AS site, event_type AS title, epoch_us(ts) AS collected_at FROM events), r AS (SELECT site, run_id AS id, count(*) AS crawled_pages, count(*) FILTER (is_article) AS article_files, min(collected_at) AS created_at FROM p GROUP BY ALL)"


def runs(spark, d) -> DataFrame:
    p = run_pages(spark, d)
    return V.run_record(p).withColumnRenamed("run_id", "id").withColumn("site", F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))


@query(f"WITH {S_RUNS} SELECT run_id, ord AS \"order\" FROM (SELECT *, bool_or(is_article) OVER (PARTITION BY run_id) AS any_article, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS n FROM p) WHERE is_article OR (NOT any_article AND n = 1)")
def exportable_pages(spark, d):
    return V.exportable_pages(run_pages(spark, d)).select("run_id", "order")


@query(rf"WITH {S_RUNS}, s AS (SELECT *, {s_slug('title')} AS slug FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY run_id, site, slug ORDER BY ord) AS n FROM s) SELECT run_id, ord AS \"order\", CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS dir FROM n".replace('\\"', '"'))
def article_dirs(spark, d):
    return V.assign_article_dirs(run_pages(spark, d)).select("run_id", "order", "dir")


@query(f"WITH {S_RUNS} SELECT id, site, crawled_pages, article_files, created_at FROM r")
def run_records(spark, d):
    return runs(spark, d)


@query(f"WITH {S_RUNS} SELECT site, count(*) AS runs, CAST(sum(crawled_pages) AS BIGINT) AS crawled_pages, CAST(sum(article_files) AS BIGINT) AS article_files FROM r GROUP BY site")
def site_summary(spark, d):
    return V.site_summary(runs(spark, d))


@query(f"WITH {S_RUNS} SELECT id, site, crawled_pages, article_files, created_at FROM r ORDER BY created_at DESC, id DESC LIMIT 20")
def list_runs(spark, d):
    return V.list_runs(runs(spark, d))


@query(f"WITH {S_RUNS}, t AS (SELECT * FROM r ORDER BY created_at DESC, id DESC LIMIT 100) SELECT id, site FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY created_at DESC, id DESC) AS n FROM t) WHERE n <= 9")
def cap_runs(spark, d):
    return V.cap_runs(runs(spark, d), 100, 9).select("id", "site")


@query(f"WITH {S_RUNS} SELECT id, CASE WHEN id % 4 = 0 THEN 'new' ELSE site END AS site FROM r")
def upsert_runs(spark, d):
    r = runs(spark, d).select("id", "site")
    return V.upsert_runs(r, r.filter("id % 4 = 0").withColumn("site", F.lit("new")))


# --- request logs


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, true AS allowed, 0::BIGINT AS wait, [t] AS acc FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE greatest(1, CAST(ceil((live[1] + 129600000000 - t) / 1000000) AS BIGINT)) END, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END
  FROM (SELECT e.user_id, e.event_id, e.n, e.t, list_filter(r.acc, lambda x: e.t - x < 129600000000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, allowed, wait AS retry_after_s FROM r""")
def rate_limit(spark, d):
    return R.rate_limit(table(spark, d, "events"), 36 * 3600, 3)


@query("""WITH RECURSIVE e AS (SELECT event_type || '::' || user_id % 5 AS key, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type || '::' || user_id % 5 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, event_id, n, false AS hit, t + 21600000000 AS until FROM e WHERE n = 1
  UNION ALL SELECT e.key, e.event_id, e.n, e.t < r.until, CASE WHEN e.t < r.until THEN r.until ELSE e.t + 21600000000 END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT key, event_id, hit FROM r""")
def ttl_cache_hits(spark, d):
    key = F.concat(F.col("event_type"), F.lit("::"), (F.col("user_id") % 5).cast("string"))
    return R.ttl_cache_hits(table(spark, d, "events").select(key.alias("key"), "event_id", "ts"))


@query("SELECT CAST(event_id AS VARCHAR) AS key, epoch_us(ts) AS created_us FROM events WHERE ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 200")
def live_entries(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("created_at"))
    return R.live_entries(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), 21600, 200).select("key", F.unix_micros("created_at").alias("created_us"))


# --- subtitles


def subtitle_files(spark, d, vtt: bool = False) -> DataFrame:
    """One file per conversation: a cue per turn, its text the turn's first line, every third one said twice."""
    c = table(spark, d, "conversations")
    said = F.concat(F.lit("<i>"), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("</i>"))
    cue = F.concat(F.lit("" if vtt else "7\n"), F.lit("00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":05" + (".250" if vtt else ",250") + " --> 01:00:00"), F.lit("\n"), said, F.lit("\n\n"))
    cue = F.when(F.col("turn") % 3 == 1, F.concat(cue, cue)).otherwise(cue)
    made = c.groupBy(F.col("conv_id").alias("video_id"), F.lit("en").alias("lang")).agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("x")))).alias("a"))
    return made.select("video_id", "lang", F.concat(F.lit("WEBVTT\nKind: captions\n\n" if vtt else ""), F.array_join(F.transform("a", lambda x: x["x"]), "")).alias("raw"))


S_CUES = f"""c AS (SELECT conv_id AS video_id, turn, '00:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':05' AS start, {s_collapse("split_part(text, chr(10), 1)")} AS text, unnest(range(CASE WHEN turn % 3 = 1 THEN 2 ELSE 1 END)) AS rep FROM conversations),
u AS (SELECT * FROM c WHERE text <> ''), n AS (SELECT *, lag(start) OVER w AS ps, lag(text) OVER w AS pt FROM u WINDOW w AS (PARTITION BY video_id ORDER BY turn, rep)), q AS (SELECT * FROM n WHERE ps IS NULL OR ps <> start OR pt <> text)"""


@query(f"WITH {S_CUES} SELECT video_id, start, text, count(*) AS n FROM u GROUP BY ALL")
def srt_cues(spark, d):
    return S.srt_cues(subtitle_files(spark, d)).groupBy("video_id", "start", "text").agg(F.count("*").alias("n"))


@query(f"WITH {S_CUES} SELECT video_id, start, text, count(*) AS n FROM u GROUP BY ALL")
def vtt_cues(spark, d):
    return S.vtt_cues(subtitle_files(spark, d, vtt=True)).groupBy("video_id", "start", "text").agg(F.count("*").alias("n"))


@query(f"WITH {S_CUES}, t AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY turn, rep) AS p FROM q) SELECT video_id, md5(string_agg(text, chr(10) ORDER BY turn, rep)) AS transcript FROM t WHERE p IS NULL OR p <> text GROUP BY video_id")
def transcript_plain(spark, d):
    return S.transcript_plain(S.normalize_cues(S.srt_cues(subtitle_files(spark, d)))).select("video_id", F.md5("transcript").alias("transcript"))


@query(f"WITH {S_CUES} SELECT video_id, md5(string_agg('[' || start || '] ' || text, chr(10) ORDER BY turn, rep)) AS transcript FROM q GROUP BY video_id")
def transcript_timestamped(spark, d):
    return S.transcript_timestamped(S.normalize_cues(S.vtt_cues(subtitle_files(spark, d, vtt=True)))).select("video_id", F.md5("transcript").alias("transcript"))


@query(f"""WITH {S_CUES}, t AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY turn, rep) AS p FROM q),
  pl AS (SELECT video_id, string_agg(text, chr(10) ORDER BY turn, rep) AS x FROM t WHERE p IS NULL OR p <> text GROUP BY video_id), ti AS (SELECT video_id, string_agg('[' || start || '] ' || text, chr(10) ORDER BY turn, rep) AS x FROM q WHERE video_id % 5 <> 0 GROUP BY video_id),
  v AS (SELECT DISTINCT conv_id AS video_id, 'Talk ' || conv_id AS title, 'https://v.w/' || conv_id AS source FROM conversations),
  h AS (SELECT v.*, '{"=" * 80}' || chr(10) || 'TITLE: ' || title || chr(10) || 'SOURCE: ' || source || chr(10) || 'LANGUAGE: en' || chr(10) || '{"=" * 80}' || chr(10) || chr(10) AS head, 'Source: ' || source || chr(10) || chr(10) || 'Language: en' || chr(10) || chr(10) AS about,
    coalesce(nullif(ti.x, ''), '{S.NO_TIMES}') AS timed, coalesce(pl.x, '') AS plain FROM v LEFT JOIN pl USING (video_id) LEFT JOIN ti USING (video_id))
  SELECT video_id, md5(head || '# ' || title || chr(10) || chr(10) || about || '## Transcript With Timestamp' || chr(10) || chr(10) || timed || chr(10) || chr(10)) AS markdown,
    md5(head || title || chr(10) || chr(10) || about || 'Transcript' || chr(10) || chr(10) || plain || chr(10) || chr(10)) AS "text" FROM h""")
def subtitle_documents(spark, d):
    """The Markdown document with times, and the text one without; every fifth video has no times."""
    cues = S.normalize_cues(S.srt_cues(subtitle_files(spark, d)))
    plain, timed = S.transcript_plain(cues), S.transcript_timestamped(cues).filter("video_id % 5 != 0")
    named = lambda x: F.concat(F.lit(x), F.col("conv_id").cast("string"))
    videos = table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), F.lit("en").alias("lang"), named("Talk ").alias("title"), named("https://v.w/").alias("source")).distinct()
    md, txt = S.subtitle_documents(videos, plain, timed), S.subtitle_documents(videos, plain, timed, include_timestamp=False)
    return md.select("video_id", F.md5("markdown").alias("markdown")).join(txt.select("video_id", F.md5("text").alias("text")), "video_id")


@query("""WITH c AS (SELECT conv_id AS video_id, count(*) AS n FROM conversations GROUP BY 1)
  SELECT video_id, CASE n % 3 WHEN 0 THEN 'de,en,es-MX,fr' WHEN 1 THEN 'en,es,fr' ELSE 'ja,ko' END AS codes, CASE n % 3 WHEN 0 THEN 'es-MX,en' WHEN 1 THEN 'en' ELSE 'ja,ko' END AS chosen,
  CASE n % 3 WHEN 0 THEN 'es-MX' WHEN 1 THEN 'en' ELSE 'ja' END AS best, CASE n % 3 WHEN 0 THEN 'es-MX' WHEN 1 THEN 'en' ELSE 'ja' END AS original FROM c""")
def language_choices(spark, d):
    """Videos with manual and automatic languages, by their number of turns: the original by its base part, by its own name, and unknown."""
    talk = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg((F.count("*") % 3).alias("k"))
    kinds = spark.createDataFrame([(0, ["de", " en "], ["fr", "es-MX", "en"], "ES"), (1, ["en", "es"], ["fr"], "en"), (2, [], ["ko", "ja"], None)], "k long, m array<string>, a array<string>, original string")
    names = lambda c: F.map_from_arrays(c, F.transform(c, lambda x: F.lit("u")))
    rows = talk.join(kinds, "k")
    langs, told = S.subtitle_languages(rows.select("video_id", names(F.col("m")).alias("manual"), names(F.col("a")).alias("auto"))), rows.select("video_id", "original")
    listed = lambda df, by, name: df.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "code"))), lambda x: x["code"]), ",").alias(name))
    best, first = S.best_language(langs, told).withColumnRenamed("code", "best"), S.original_language(langs, told).withColumnRenamed("code", "original")
    return listed(langs, "rank", "codes").join(listed(S.preferred_languages(langs, told), "choice", "chosen"), "video_id").join(best, "video_id").join(first, "video_id")
