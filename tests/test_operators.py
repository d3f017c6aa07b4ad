"""Fixtures and sequential models for what the driver tables don't show."""

import random
import re
import time
from collections import Counter, defaultdict
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.functions import gates, text, urls
from pagemill.operators import blocks as B
from pagemill.operators import captures, html_nodes, links, requests, subtitles, versions
from pagemill.sources import io
from pagemill.streaming import jobs


def values(spark, f, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_text_columns(spark):
    assert values(spark, text.collapse, [" a  b\t", None]) == ["a b", ""]
    assert values(spark, text.slugify, ["Hello,  World! -- x", "...", None]) == ["hello-world-x", "untitled-article", "untitled-article"]
    assert values(spark, text.frontmatter_title, ['---\ntitle: "A b"\n---\ntext', "none"]) == ["A b", None]
    assert values(spark, text.display_date, ["2024-01-02 03:04:05", "soon"]) == ["1/2/2024, 3:04:05 AM", "soon"]


def test_urls(spark):
    assert values(spark, urls.archive_original_url, ["https://archive.ph/2024/https://a.b/c).", "https://a.b/https://c.d"]) == ["https://a.b/c", None]
    assert values(spark, urls.site_folder, ["https://WWW.A.b:8080/x", "bad", "https://archive.ph/o/x/http://q.w/e"]) == ["www.a.b", "unknown-site", "q.w"]
    df = spark.createDataFrame([("./api", "https://A.b/docs/x"), ("/für", "https://a.b"), ("http://[", "https://a.b"), ("mailto:x", "https://a.b/")], "h string, b string")
    assert [r[0] for r in df.select(urls.resolve_url("h", "b")).collect()] == ["https://a.b/docs/api", "https://a.b/f%C3%BCr", None, "mailto:x"]


def test_gates(spark):
    assert values(spark, gates.is_noise_table, ["0% to 100%", "10%"]) == [True, False]
    assert values(spark, gates.is_noise_text, ["Share", "I like JavaScript", "fine"]) == [True, True, False]
    assert values(spark, gates.is_ui_noise, ["[a](https://b.c)", "x.com is blocked", "en", "A text."]) == [True, True, True, False]


def test_html(spark):
    html = "<title>a <b>x</b></title><nav><h1>Nav</h1></nav><main><h1>The Long Title</h1><p>One <a href='/l'>link</a><p>Two<table><tr><td>a<td>b</table><img srcset='/i.png 2x'><p>share<p>Ready for more?<p>After</main>"
    pages = spark.createDataFrame([(1, "https://a.b/x", html), (2, "u", None)], "page_id long, url string, html string")
    parsed = html_nodes.parsed_pages(pages)
    row = parsed.filter("page_id = 1").first()
    assert row["title"] == "a <b>x</b>" and row["main_h1"] == "The Long Title"
    got = [(r["tag"], r["text"]) for r in html_nodes.raw_blocks(parsed).filter("page_id = 1").orderBy("pos").collect()]
    assert got == [("p", "One link"), ("p", "Two"), ("table", "ab"), ("img", None)]


def test_blocks_against_sequential_model(spark):
    rng = random.Random(5)
    words = ["Trending in", "Body text that is long enough to be unique", "short", "Other", "see all", "Trending in tech", "share"]
    rows = [(p, k, "image" if rng.random() < 0.2 else "text", rng.choice(["p", "h2", "h3"]), rng.choice(words)) for p in range(120) for k in range(12)]
    df = spark.createDataFrame([(p, k, t, g if t == "text" else None, x if t == "text" else None, "/a.png" if t == "image" else None, None, None) for p, k, t, g, x in rows], "page_id long, pos int, type string, tag string, text string, src string, alt string, caption string")
    marked = {(r["page_id"], r["pos"]): r for r in B.mark_blocks(df).collect()}
    want = []
    for p in range(120):
        level, seen, last = None, set(), None
        for k in range(12):
            r = marked[p, k]
            if r["type"] == "image":
                want.append((p, k))
                last = None
                continue
            if not r["live"]:
                continue
            starts = r["level"] is not None and (r["key"] == "trending in" or r["key"].startswith("trending in "))
            if level is not None and r["level"] is not None and r["level"] <= level:
                level = None
            if starts and level is None:
                level = r["level"]
            if level is not None:
                continue
            if "see all" in r["key"]:
                break
            if len(r["key"]) >= 24:
                if r["key"] in seen:
                    continue
                seen.add(r["key"])
            if r["key"] == last:
                continue
            last = r["key"]
            want.append((p, k))
    kept = B.dedupe_adjacent_blocks(B.dedupe_long_blocks(B.stop_at_marker(B.drop_skipped_sections(B.mark_blocks(df))).filter("type = 'image' or live")))
    assert sorted((r["page_id"], r["pos"]) for r in kept.collect()) == sorted(want)


def test_cues(spark):
    raw = "1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i> there\n\n00:03 --> 00:04\nlost\n00:05 --> 00:06\nkept\n42\n\nstray\n"
    files = spark.createDataFrame([("v", "en", raw)], "video_id string, lang string, raw string")
    assert [(r["start"], r["text"]) for r in subtitles.srt_cues(files).orderBy("pos").collect()] == [("00:00:01", "Hi there"), ("00:00:05", "kept")]
    assert [r["text"] for r in subtitles.vtt_cues(files).orderBy("pos").collect()] == ["Hi there", "kept 42"]


def test_languages(spark):
    meta = spark.sql("select 'v' video_id, map('es','x','en','x') manual, map('id','x','fr','x','en','x') auto")
    langs = subtitles.subtitle_languages(meta)
    assert [r["code"] for r in langs.orderBy("rank").collect()] == ["en", "es", "fr", "id"]
    orig = spark.createDataFrame([("v", "es-MX")], "video_id string, original string")
    assert [r["code"] for r in subtitles.preferred_languages(langs, orig).orderBy("choice").collect()] == ["es", "en", "id"]
    assert subtitles.best_language(langs, orig).first()["code"] == "es"


def test_captures(spark):
    long = "word " * 80
    rows = [("u", "direct", "t", "t", ""), ("u", "mirror", "m", "m", long), ("b", "direct", "Just a moment", "x", long), ("k", "direct", "t", "a", long), ("r", "direct", "t", "t", "t"), ("r", "rendered", "q", "q", "z" * 100)]
    got = {r["url"]: (r["stage"], r["title"], r["failed"]) for r in captures.arbitrate_captures(spark.createDataFrame(rows, "url string, variant string, title string, article_title string, body string")).collect()}
    assert got == {"u": ("direct", "t", True), "b": ("direct", "Just a moment", True), "k": ("direct", "t", False), "r": ("rendered", "t", False)}


def test_structured(spark):
    scripts = ["{bad", '[null, {"@type": "WebSite"}, {"@type": ["Thing", "NewsArticle"], "headline": "A&nbsp;B", "articleBody": "Para one.\\nPara two."}]']
    parsed = spark.createDataFrame([(1, scripts), (2, ['{"@graph": []}'])], "page_id long, jsonld array<string>")
    assert [(r["title"], r["body"]) for r in captures.structured_article(parsed).collect()] == [("A B", "Para one.\n\nPara two.")]


def test_article_dirs(spark):
    df = spark.createDataFrame([(1, i, "s", t) for i, t in enumerate(["a", "a-2", "a", "b"])], "run_id long, order long, site string, title string")
    assert [r["dir"] for r in versions.assign_article_dirs(df).orderBy("order").collect()] == ["a", "a-2", "a-3", "b"]


def test_article_dirs_in_order(spark):
    """Against names given one by one: null runs and sites, families of numbered titles, an empty table."""
    pick = random.Random(5)
    rows = [(pick.choice([1, 2, None]), i, pick.choice(["s", None]), pick.choice(["a", "a-2", "a-2-2", "A 3", "b", "b-2", "", None])) for i in range(300)]
    pick.shuffle(rows)
    schema, taken, want = "run_id long, order long, site string, title string", {}, {}
    for run, i, site, title in sorted(rows, key=lambda r: r[1]):
        slug, names = (title or "").lower().replace(" ", "-") or "untitled-article", taken.setdefault((run, site), set())
        want[i] = next(x for x in [slug, *(f"{slug}-{n}" for n in range(2, 400))] if x not in names)
        names.add(want[i])
    got = versions.assign_article_dirs(spark.createDataFrame(rows, schema))
    assert got.columns == ["run_id", "order", "site", "title", "slug", "dir"]
    assert {r["order"]: r["dir"] for r in got.collect()} == want and got.count() == 300
    assert versions.assign_article_dirs(spark.createDataFrame([], schema)).count() == 0


def test_crawl(spark):
    rng = random.Random(1)
    names = [f"https://h.x/{i}" for i in range(30)]
    edges = sorted({(a, b) for a in names for b in rng.sample(names, 3)})
    rows = [(a, i, b) for i, (a, b) in enumerate(edges)]
    bad = set(rng.sample(names[1:], 6))
    queue, queued, got = [names[0]], {names[0]}, []
    while queue and len(got) < 12:
        u = queue.pop(0)
        if u in bad:
            continue
        got.append(u)
        for _, _, b in sorted(r for r in rows if r[0] == u):
            if b not in queued:
                queued.add(b)
                queue.append(b)
    pages = spark.createDataFrame([(n, n not in bad) for n in names], "url string, ok boolean")
    df = links.crawl_select(pages, spark.createDataFrame(rows, "src string, link_pos int, dst string"), spark.createDataFrame([(names[0],)], "root string"), 12)
    assert [r["url"] for r in df.orderBy("order").collect()] == got


def test_runs_source_and_export(spark, tmp_path):
    (tmp_path / "runs.json").write_text('[{"id": "1", "site": "", "rootUrl": "https://A.b/x"}, {"id": "2", "site": "s"}]')
    assert {r["id"]: r["site"] for r in io.read_runs(spark, str(tmp_path / "runs.json")).collect()} == {"1": "a.b", "2": "s"}
    (tmp_path / "v.en.srt").write_text("1")
    (tmp_path / "v.en.vtt").write_text("2")
    assert [(r["video_id"], r["lang"], r["raw"]) for r in io.read_subtitles(spark, str(tmp_path / "v.en.*")).collect()] == [("v", "en", "1")]
    df = spark.createDataFrame([("s", None)], "site string, x string")
    io.write_articles(df, str(tmp_path / "out"))
    assert io.export_page_json(df).first()[0] == '{"site":"s","x":null}'


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"event_id": range(6), "user_id": [1] * 6, "ts": pd.to_datetime([0, 10, 20, 59, 60, 61], unit="s")})
    src = spark.createDataFrame(rows)
    src.write.parquet(str(tmp_path / "in"))
    batch = {r["event_id"]: r["allowed"] for r in requests.rate_limit(src, 60, 3).collect()}
    assert batch == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False}
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    later = lambda df: df.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))  # noqa: E731  (a watermark begins at 1970-01-01 00:00)
    q = jobs.stream_rate_limit(later(stream), 60, 3).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()} == batch
    keyed = lambda df: df.select(F.col("user_id").cast("string").alias("key"), "event_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))  # noqa: E731  (a watermark begins at 1970-01-01 00:00)
    q = jobs.stream_ttl_cache(keyed(stream), 30).writeStream.format("memory").queryName("cached").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    hits = {r["event_id"]: r["hit"] for r in requests.ttl_cache_hits(keyed(src), 30).collect()}
    assert {r["event_id"]: r["hit"] for r in spark.table("cached").collect()} == hits and len(set(hits.values())) == 2
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    stream = spark.readStream.schema(pages.schema).option("pathGlobFilter", "pages.parquet").parquet("/root/testdata/sf0.001")
    for k in range(2):
        jobs.incremental_extract(stream, str(tmp_path / "versions"), str(tmp_path / f"ck{k}")).awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "versions"))
    assert got.count() == got.select("url").distinct().count() == pages.count()


def test_incremental_extract_keeps_equal_titles_and_earlier_captures(spark, tmp_path):
    page = lambda body: f"<title>Same</title><article><h1>Same</h1><p>{body}</p></article>"
    day = lambda k: datetime(2024, 1, k)
    first = [(1, "https://a.b/x", page("one"), day(1)), (2, "https://a.b/y", page("one"), day(1)), (3, "https://a.b/x", page("two"), day(3)), (4, "https://a.b/x", page("two"), day(2)), (5, "https://a.b/z", None, day(1))]
    second = [(6, "https://a.b/x", page("two"), day(5)), (7, "https://a.b/y", page("new"), day(5)), (8, "https://a.b/z", None, day(6))]
    schema = "page_id long, url string, html string, collected_at timestamp"
    want = [("x", "one", 1), ("x", "two", 2), ("y", "one", 1), ("z", "", 1)]
    for rows, more in ((first, []), (second, [("y", "new", 5)]), ([], [])):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.incremental_extract(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(90)
        want = sorted([*want, *more])
        got = spark.read.schema(jobs.VERSION).parquet(str(tmp_path / "out")).collect()
        assert sorted((r["url"][-1], r["content"], r["collected_at"].day) for r in got) == want


def test_readable_article(spark):
    said = "Some words that go on for quite a while. " * 3
    html = f"<title>Page</title><meta name='publish-date' content=''><meta name='date' content=' 2024-01-02 '><meta name='description' content=' D  e '><nav><p>nav</p></nav><main><h2>Head</h2><p>{said}</p><h2>Head</h2><figure><img src='/a.png' alt=' A '><figcaption>Seen</figcaption></figure><h4>no</h4><p>share</p><p>{said}</p></main>"
    pages = [(1, "https://a.b/x", html), (2, "https://a.b/y", "<title>T</title><p>short</p>"), (3, "https://a.b/z", "<article>" + "<p>" + "</p><p>".join(f"w{i} word" for i in range(600)) + "</p></article>"), (4, "https://a.b/q", None)]
    got = {r["page_id"]: r for r in html_nodes.readable_article(html_nodes.parsed_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()}
    r = got[1]
    assert set(got) == {1} and (r["title"], r["article_title"], r["headings"], r["description"], r["published_at"], r["is_article"]) == ("Page", "Head", ["Head"], "D e", "2024-01-02", True)
    assert r["article_body_text"] == "\n\n".join(["Head", said.strip(), "Head", "Seen", "share", said.strip()])
    assert [tuple(i) for i in r["images"]] == [("https://a.b/a.png", "A", 1, 4)]
    titled = [(3, "https://a.b/z", "<title>Many</title>" + pages[2][2])]
    (r,) = html_nodes.readable_article(html_nodes.parsed_pages(spark.createDataFrame(titled, "page_id long, url string, html string"))).collect()
    assert r["article_title"] == "Many" and r["article_body_text"].count("\n\n") == html_nodes.MAX_BLOCKS - 1


def test_cascade_with_forced_browser_rejects_and_overlay(spark):
    long = "word " * 80
    rows = [
        ("f", "direct", "t", "a", long, "", ["h"], ["l"]), ("f", "browser", "b", "b", "z" * 100, "<p>", ["x"], ["y"]), ("a", "direct", "captcha", "c", "", "", [], []), ("a", "archive", "r", "r", long, "g-recaptcha", [], []), ("a", "browser", "q", "q", long, "Turnstile", [], []),
        ("o", "direct", "Old", "Old", "tiny", "", ["h1"], ["l1"]), ("o", "rendered", "New", "New", "z" * 100, "", ["no"], ["no"]), ("n", "rendered", "New", "New", "z" * 100, "", ["no"], ["no"]),
    ]
    df = spark.createDataFrame(rows, "url string, variant string, title string, article_title string, body string, html string, headings array<string>, links array<string>")
    got = {r["url"]: (r["stage"], r["title"], r["headings"], r["links"], r["failed"]) for r in captures.arbitrate_captures(df).collect()}
    assert got == {"f": ("direct", "t", ["h"], ["l"], False), "a": ("direct", "captcha", [], [], True), "o": ("rendered", "Old", ["h1"], ["l1"], False), "n": ("rendered", "New", ["New"], [], False)}
    forced = {r["url"]: r["stage"] for r in captures.arbitrate_captures(df, force_browser=True).collect()}
    assert forced["f"] == "browser" and forced["o"] == "rendered"


def test_crawl_roots_with_fragments_and_archives(spark):
    a, b, top, old = "https://h.x/a", "https://h.x/b", "https://h.x/a#top", "https://archive.ph/2024/https://o.x/p"
    pages = spark.createDataFrame([(a, True), ("https://h.x/b#end", True), (old, True)], "url string, ok boolean")
    edges = spark.createDataFrame([(a, 0, b), ("https://h.x/b#end", 0, a), (old, 0, "https://archive.ph/2024/https://o.x/q")], "src string, link_pos int, dst string")
    got = sorted(map(tuple, links.crawl_select(pages, edges, spark.createDataFrame([(top,), (old,), ("https://none.x/",)], "root string")).collect()))
    assert got == [(top, top, 1), (top, b, 2), (top, a, 3)][:0] + sorted([("https://o.x/p", "https://o.x/p", 1), (top, top, 1), (top, b, 2), (top, a, 3)])


def test_links_are_resolved_once(spark):
    html = "<a href='/w?x=1#f'>a</a><a href='http://['>b</a><a href='mailto:x'>c</a><a href='/w?x=1'>d</a><a href='//other.y/z'>e</a><a href='g h'>f</a>"
    parsed = html_nodes.articles(spark.createDataFrame([(1, "https://A.b/d/e", html)], "page_id long, url string, html string"))
    edges = links.page_links(parsed)
    assert [(r["link_pos"], r["url"]) for r in edges.orderBy("link_pos").collect()] == [(1, "https://a.b/w?x=1"), (2, "https://a.b/d/g%20h")]
    assert links.link_errors(parsed).first()["bad_hrefs"] == 1
    assert {r["url"]: (r["out_degree"], r["in_degree"]) for r in links.link_degree(edges).collect()}["https://A.b/d/e"] == (2, 0)
    plan = links.link_degree(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") <= 2 and links.top_linked(edges, 1).count() == 1  # the adaptive plan shows each node once more


def test_small_rules(spark):
    keys = spark.createDataFrame([(" HTTP://A.b:80/x y ", 3), ("not a url ", 1), (None, 2)], "u string, n int")
    assert [r[0] for r in keys.select(urls.request_key(F.col("u"), F.col("n"))).collect()] == ["http://a.b/x%20y::3", "not a url::1", "::2"]
    docs = spark.createDataFrame([("u", "Title: T\n\nMarkdown Content:\nText\n![ A ](i.png)\n[![](j.png)](https://t.u)\n![x]()\n")], "url string, raw_text string")
    assert [tuple(r) for r in captures.rendered_images(docs).orderBy("order").collect()] == [("u", 1, "i.png", "A", ""), ("u", 2, "j.png", "image", "https://t.u")]
    langs = subtitles.subtitle_languages(spark.sql("select v video_id, map('es','x') manual, map('en-GB','x','fr','x') auto from values ('a'), ('b'), ('c') t(v)"))
    told = spark.createDataFrame([("a", "EN_gb"), ("b", "fr-CA"), ("c", "xx")], "video_id string, original string")
    assert {r[0]: r[1] for r in subtitles.original_language(langs, told).collect()} == {"a": "en-GB", "b": "fr", "c": "es"}
    entries = spark.sql("select k key, timestamp_seconds(t) created_at from values ('a', 0), ('b', 40), ('c', 41) v(k, t)")
    now = F.timestamp_seconds(F.lit(100))
    live = lambda **kw: [r[0] for r in requests.live_entries(entries, now, 60, 9, **kw).collect()]
    assert live() == ["c"] and live(session=True) == ["c", "b"] and requests.live_count(entries, now, 60, True).first()[0] == 2


def test_requests_stream_in_order(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, None, 3]), rng.randrange(400)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s int").withColumn("ts", F.timestamp_seconds("s")).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {r["event_id"]: r["allowed"] for r in requests.rate_limit(df, 50, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, taken = {}, {}
    for i, user, s in sorted(rows, key=lambda r: (r[2], r[0])):
        ok, _, taken[user] = requests.accept(s, taken.get(user, []), 50, 4)
        want[i] = ok
    assert got == want
    plan = requests.rate_limit(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("MapInPandas") < plan.index("Sort [user_id") < plan.index("hashpartitioning(user_id")


def test_article_documents(spark):
    html = (
        "<title>T</title><article><h1>The Title</h1><p>See the <a href='/b#x'>next page</a> and <code>run x</code>, <a href='https://archive.ph/2024/https://c.d/e'>old</a>, <a href=''>none</a>.</p>"
        "<table><tr><th>a|b<th>c</tr><tr><td></td></tr><tr><td>1</td></tr></table><hr><img src='pics/one.png' alt=' A  b '><p>Last words of the page.</p><pre>x\u00a0= 1\r\ny</pre></article>"
    )
    pages = spark.createDataFrame([(1, "https://a.b/x/y", html), (2, "https://a.b/z", "<title>Only</title>"), (3, "https://a.b/n", None)], "page_id long, url string, html string")
    parsed = html_nodes.parsed_pages(pages)
    raw = html_nodes.raw_blocks(parsed, inline=True).withColumn("caption", F.lit(" https://c.d "))
    lines = {r["tag"]: r["text"] for r in raw.collect() if r["tag"] in ("table", "hr", "pre")}
    assert lines == {"table": "| a\\|b | c |\n| :--- | :--- |\n| 1 |  |", "hr": "------", "pre": "x = 1\ny"}
    assert [tuple(r) for r in html_nodes.collect_images(raw).collect()] == [(1, "https://a.b/x/pics/one.png", "A b", "https://c.d", 1, 4)]
    columns, day = html_nodes.article_columns(parsed), F.lit("2024-01-02 03:04:05")
    bar = "=" * 80
    head = lambda title, page: f"{bar}\nTITLE: {title}\nSOURCE: https://a.b/{page}\nDATE: 1/2/2024, 3:04:05 AM\n{bar}\n\n"
    body = "See the [next page](https://a.b/b) and `run x`, [old](https://c.d/e), none.\n\n" + lines["table"] + "\n\n------\n\n![A b](https://a.b/x/pics/one.png){}\n\nLast words of the page.\n\n```\nx = 1\ny\n```"
    md = {r[0]: r[1] for r in B.article_markdown(columns, raw, day).collect()}
    assert md[1] == head("The Title", "x/y") + "# The Title\n\nSource: https://a.b/x/y\n\n" + body.format("\n\n_Gambar 1: [Sumber gambar](https://c.d)_") + "\n"
    assert md[2] == head("Only", "z") + "# Only\n\nSource: https://a.b/z\n"
    told = columns.withColumn("description", F.lit("D")).withColumn("article_body_text", F.lit("p  q\n\nr"))
    txt = {r[0]: r[1] for r in B.article_text(told, raw, day).collect()}
    assert txt[1] == head("The Title", "x/y") + "_D_\n\n* * *\n\n" + body.format("\n_Gambar 1: https://c.d_") + "\n"
    assert txt[2] == head("Only", "z") + "_D_\n\n* * *\n\np  q\n\nr\n" and set(txt) == {1, 2, 3}


def test_article_body_stops_and_structured_articles(spark):
    told = '[null, {"@type": "WebPage"}, {"@type": ["NewsArticle"], "headline": "Told", "articleBody": "%s\\n\\nTwo  two.", "datePublished": "2024-05-06", "image": [{"url": "a.png"}, "b.png"]}]' % ("word " * 36)
    page = "<title>T</title><article><h1>Head</h1><p>First words.</p><table><tr><td>a<td>b</tr></table><p>Discussion about this post</p><p>A comment.</p></article>"
    rows = [(1, "https://a.b/x", page), (1, "https://a.b/y", f"<script type='application/ld+json'>{told}</script><script type='application/ld+json'>{{broken</script>{page}"), (2, "https://a.b/z", None)]
    df = html_nodes.articles(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("is_article", html_nodes.is_article())
    got = {r["url"][-1]: r for r in df.collect()}
    assert got["x"]["article_body_text"] == "First words.\n\n| a | b |\n| :--- | :--- |" and got["x"]["article_title"] == "Head" and not got["x"]["is_article"]
    y = got["y"]
    assert (y["article_title"], y["published_at"], y["article_body_text"], y["is_article"], y["structured"]) == ("Told", "2024-05-06", ("word " * 36).strip() + "\n\nTwo two.", True, True)
    assert got["z"]["article_body_text"] == "" and not got["z"]["structured"]


def test_signature_covers_blocks_and_images(spark):
    told = "<script type='application/ld+json'>{\"@type\": \"Article\", \"articleBody\": \"Ten or more words here.\", \"image\": \"%s.png\"}</script>"
    page = "<article><h1>Head</h1><h2>Part</h2><p>See <a href='/b'>this</a> and more.</p><img src='one.png' alt='A'></article>"
    changed = [page, page.replace("one", "two"), page.replace("'A'", "'B'"), page.replace("h2", "h3"), page.replace("/b", "/c"), told % "a" + page, told % "b" + page]
    rows = [(1, "https://a.b/x", html) for html in [*changed, page]]
    got = [r["signature"] for r in jobs.article_rows(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), F.current_timestamp()).collect()]
    assert len(set(got)) == len(changed) and got[0] == got[-1]


def test_deep_pages_parse_in_linear_time():
    deep = "<article><p>" + "<div><b><a href='q'>x" * 4000 + "<p>" + "y<p>" * 500
    began = time.process_time()
    got = html_nodes.parse_page(deep, "https://a.b")
    assert time.process_time() - began < 5 and len(got["hrefs"]) == 4000 and [n["text"] for n in got["nodes"]][-2:] == ["y", ""]


def test_dropped_elements_hold_no_nodes(spark):
    html = "<meta property='description' content='no'><meta name='description' content=' D  e '><time>x</time><time datetime='2024'></time><main><p>Seen<script>var p = '<p>';</script> twice</p><noscript><p>Unseen <a href='/u'>u</a></p></noscript><ul><li>One<ul><li>Two <code>c</code></ul><li>Three</ul></main>"
    got = html_nodes.parse_page(html, "https://a.b")
    assert [(n["tag"], n["text"], n["codes"]) for n in got["nodes"]] == [("p", "Seen twice", []), ("li", "OneTwo c", ["c"]), ("li", "Two c", ["c"]), ("li", "Three", [])]
    assert (got["description"], got["published"], got["dates"], got["hrefs"]) == ("D e", None, ["", "", "", "2024"], [])


def test_body_holds_inline_markdown_and_structured_pages_have_their_own_blocks(spark):
    told = '{"@type": "Article", "headline": "Told", "articleBody": "Para one, told.\\nPara two.", "image": ["a.png", "a.png", "b.png"]}'
    page = "<article><h1>Head</h1><p>See <a href='/b#x'>this page</a> and <code>run</code>.</p><img src='c.png' alt='C'><p>ready for <b>more?</b></p><p>After</p></article>"
    rows = [(1, "https://a.b/x", page), (2, "https://a.b/y", f"<script type='application/ld+json'>{told}</script>{page}"), (3, "https://a.b/z", None)]
    parsed = html_nodes.parsed_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    body = {r["page_id"]: r["article_body_text"] for r in html_nodes.article_columns(parsed).collect()}
    assert body == {1: "See [this page](https://a.b/b) and `run`.", 2: "Para one, told.\n\nPara two.", 3: ""}
    blocks = html_nodes.raw_blocks(parsed, inline=True)
    assert sorted(tuple(r) for r in blocks.filter("page_id = 2").collect()) == [(2, 0, "text", "p", "Para one, told.", None, None), (2, 1, "text", "p", "Para two.", None, None), (2, 2, "image", "img", None, "a.png", "image"), (2, 3, "image", "img", None, "b.png", "image")]
    assert [tuple(r)[2:] for r in blocks.filter("page_id = 1").collect()] == [("text", "p", body[1], None, None), ("image", "img", None, "https://a.b/c.png", "C")]
    md = {r[0]: r[1] for r in B.article_markdown(html_nodes.article_columns(parsed), blocks.withColumn("caption", F.lit("")), F.lit("2024-01-02 03:04:05")).collect()}
    assert md[2].endswith("# Told\n\nSource: https://a.b/y\n\nPara one, told.\n\nPara two.\n\n![image](a.png)\n\n![image](b.png)\n")
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_white_space_and_keys_against_python(spark):
    white = " \t\n\x0b\f\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
    rng, marks = random.Random(4), "*_`#>[]()"
    letters = [*white, *marks, *"abZ09-.~!", "\x85", "\xa1", "\u167f", "\u200b", "\xe9", "\u03a3", "\U0001f600", " ", "  "]
    items = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", None]
    blanks = str.maketrans({c: " " for c in white})
    plain = [" ".join(x for x in (t or "").translate(blanks).split(" ") if x) for t in items]
    assert values(spark, text.collapse, items) == plain and values(spark, text.is_blank, items) == [p == "" for p in plain]
    symbols = str.maketrans({c: " " for c in marks})
    assert values(spark, text.noise_key, items) == [" ".join(x for x in p.lower().translate(symbols).split(" ") if x) for p in plain]


def rendered_model(raw):
    """The line automaton of rendered captures, step by step: None, or (title, blocks)."""
    space = r"[\s\ufeff]+"
    norm = lambda s: re.sub(space, " ", s).strip(" ")
    if "Markdown Content:" not in raw:
        return None
    md = raw[raw.index("Markdown Content:") + 17 :].strip()
    blocks, held = [], []

    def flush():
        text = re.sub(r"^#{1,6}\s*", "", " ".join(held))
        text = norm(re.sub(r"\[(.*?)\]\((.*?)\)", r"\1", re.sub(r"^[-*_]{3,}$", "", text)))
        if text:
            blocks.append(("text", "p", text, None, None, None))
        held.clear()

    for line in re.split(r"\r?\n", md):
        line = line.strip()
        image, linked = re.match(r"^!\[(.*?)\]\((.*?)\)$", line), re.match(r"^\[!\[(.*?)\]\((.*?)\)\]\((.*?)\)$", line)
        if image or linked:
            flush()
            m = image or linked
            if norm(m[2]):
                blocks.append(("image", None, None, norm(m[2]), norm(m[1]) or "image", "" if image else norm(m[3])))
        elif not line or re.match(r"^[-=*]{3,}$", line) or line == "Loading diagram...":
            flush()
        else:
            held.append(line)
    flush()
    title = re.search(r"^Title:\s*(.+)$", raw, re.M)
    title = norm(title[1]) if title else ""
    title = title or norm((re.search(r"^#{1,6}\s*(.+)$", md, re.M) or ["", ""])[1])
    return (title, blocks) if title and any(b[0] == "text" for b in blocks) else None


def test_rendered_captures_against_line_automaton(spark):
    rng = random.Random(8)
    lines = ["Text of a line", "  more\ttext ", "", "", "## Heading [a](b)", "#No blank", "---", "***", "* * *", "===", "Loading diagram...", "![alt](i.png)", "![ ](/j.png?a=(b))", "![x]()", "[![p](q.png)](https://t)", "[![](q.png)]( )", "[link](u) and ![in](line.png) text", "Markdown Content:", "Title: later", "___", "[-](u)", "a\u00a0b", "![a](b)](c)", "- item"]
    heads = ["Title: T  t\n", "Title:\n\nNext line\n", "", "URL Source: x\n", "Title: \n"]
    raws = [rng.choice(heads) + rng.choice(["\nMarkdown Content:", "\nMarkdown Content:\n", "\n"]) + rng.choice(["\n", "\r\n"]).join(rng.choices(lines, k=rng.randrange(0, 14))) for _ in range(600)] + ["", None, "no title, no marker", "Markdown Content:\n# Only heading", "Markdown Content:\n![a](b)"]
    docs = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "url string, raw_text string")
    got = {int(r["url"]): (r["title"], [tuple(b) for b in r["blocks"]]) for r in captures.rendered_article(docs).collect()}
    want = {i: m for i, r in enumerate(raws) if (m := rendered_model(r or ""))}
    assert got == want and 200 < len(want) < 600
    one = captures.rendered_article(docs.filter("url = '%d'" % min(want))).first()
    texts = [b[2] for b in want[min(want)][1] if b[0] == "text"]
    assert one["body"] == "\n\n".join(texts) and one["description"] == texts[0]


def test_titles_of_documents(spark):
    mds = ['---\nTitle:  "Hello   World"\n---\nBody', "---\ntitle: 'x'\n---", "---\ntitle: x\n--- no end", "a\nTitle: In  text\nb", "# H", None, "---\ntitle: ''\n---\n"]
    assert values(spark, text.frontmatter_title, mds) == ["Hello World", "x", None, None, None, None, None]
    assert values(spark, lambda c: text.document_title(c, F.lit("https://u@A.b:1/x")), mds) == ["Hello World", "x", "a.b", "In text", "a.b", "a.b", "a.b"]
    assert values(spark, lambda c: text.document_title(c, F.lit(None)), ["# H"]) == ["Untitled"]


def test_subtitle_documents(spark):
    videos = spark.createDataFrame([("v", "en", "My talk", "https://v"), ("w", "id", None, None)], "video_id string, lang string, title string, source string")
    plain = spark.createDataFrame([("v", "en", "one\ntwo")], "video_id string, lang string, transcript string")
    timed = spark.createDataFrame([("v", "en", "[00:00:01] one ")], "video_id string, lang string, transcript string")
    bar = "=" * 80
    rows = {r["video_id"]: r for r in subtitles.subtitle_documents(videos, plain, timed).collect()}
    assert rows["v"]["markdown"] == f"{bar}\nTITLE: My talk\nSOURCE: https://v\nLANGUAGE: en\n{bar}\n\n# My talk\n\nSource: https://v\n\nLanguage: en\n\n## Transcript With Timestamp\n\n[00:00:01] one\n\n"
    assert f"Transcript With Timestamp\n\n{subtitles.NO_TIMES}\n\n" in rows["w"]["text"] and rows["w"]["text"].startswith(f"{bar}\nTITLE: \nSOURCE: \nLANGUAGE: id\n")
    shown = {r["video_id"]: r["text"] for r in subtitles.subtitle_documents(videos, plain, timed, include_timestamp=False).collect()}
    assert shown["v"].endswith("My talk\n\nSource: https://v\n\nLanguage: en\n\nTranscript\n\none\ntwo\n\n") and shown["w"].endswith("Transcript\n\n\n\n")


def test_versions_by_format_and_store(spark, tmp_path):
    day, store = lambda k: datetime(2024, 1, k), io.ArticleStore(spark, str(tmp_path / "store"))
    schema = "site string, slug string, collected_at timestamp, signature string, md string, txt string, json string"
    runs = [
        [("s", "a", day(1), "1", "m1", "t1", "j1"), ("s", "b", day(1), "1", "m", "t", "j"), ("u", "c", day(1), "1", "m", "t", "j")],
        [("s", "a", day(2), "1", "m1 later", "t1 later", "j1 later"), ("s", "b", day(2), "2", "m", "t2", "j2")],  # a: only its date; b: not its Markdown
        [("s", "a", day(3), "3", "m3", "t1", "j3"), ("v", "d", day(3), "1", "m", None, "j")],
    ]
    for k, rows in enumerate(runs):
        for _ in range(1 + (k > 0)):  # a run that is lost and runs again writes the same
            store.publish(spark.createDataFrame(rows, schema), f"r{k}")
    latest = {(r["site"], r["slug"], r["ext"]): (r["content"], r["signature"], r["collected_at"].day) for r in store.latest().collect()}
    assert latest == {
        ("s", "a", "md"): ("m3", "3", 3), ("s", "a", "txt"): ("t1", "3", 1), ("s", "a", "json"): ("j3", "3", 3), ("s", "b", "md"): ("m", "2", 1), ("s", "b", "txt"): ("t2", "2", 2), ("s", "b", "json"): ("j2", "2", 2),
        ("u", "c", "md"): ("m", "1", 1), ("u", "c", "txt"): ("t", "1", 1), ("u", "c", "json"): ("j", "1", 1), ("v", "d", "md"): ("m", "1", 3), ("v", "d", "json"): ("j", "1", 3),
    }
    history = sorted((r["run"], r["slug"], r["ext"], r["content"]) for r in store.history().collect())
    assert [h for h in history if h[0] != "r0"] == [("r1", "b", "json", "j2"), ("r1", "b", "txt", "t2"), ("r2", "a", "json", "j3"), ("r2", "a", "md", "m3"), ("r2", "d", "json", "j"), ("r2", "d", "md", "m")] and len(history) == 15
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    before = files()
    assert len(store.purge("https://S/x")) == 2 and store.latest().filter("site = 's'").isEmpty()
    assert files() == {p: t for p, t in before.items() if "site=s" not in str(p)} and store.history().count() == 5
    with pytest.raises(ValueError):
        store.purge("  ")
    assert store.purge("ALL") and store.latest().isEmpty() and store.history().isEmpty()
    store.publish(spark.createDataFrame(runs[0], schema), "again")
    assert store.latest().count() == 9


def test_site_scopes(spark):
    assert values(spark, versions.site_scope, [" A.b ", "HTTPS://A.b/x", "a.b/x?y", "", None, "all"]) == ["a.b", "a.b", "a.b", None, None, "all"]
    df = spark.createDataFrame([("a.b",), ("c",), (None,)], "site string")
    assert [versions.purge_site(df, x).count() for x in ("all", "a.b", "", "https://c/y", "zz")] == [0, 2, 3, 2, 3]


def test_history_cuts_against_lists(spark):
    rng = random.Random(9)
    rows = [(rng.choice("st"), rng.choice("ab"), rng.choice(["md", "txt", "json"]), rng.randrange(12), rng.choice(["", "x\n"]) + f"DATE: {rng.randrange(3)}\n" + rng.choice(["collectedAt: 1", "collectedAt: 2", "text"])) for _ in range(150)]
    df = spark.createDataFrame(rows, "site string, slug string, ext string, collected_at int, content string")
    got = Counter(tuple(r) for r in versions.cap_history(df, 5).collect())
    per = defaultdict(list)
    for r in rows:
        per[r[:3]].append(r[3])
    assert {k: sorted(v, reverse=True)[:5] for k, v in per.items()} == {k: sorted([r[3] for r in got.elements() if r[:3] == k], reverse=True) for k in per} and not got - Counter(rows)
    same = defaultdict(list)
    for s, g, e, t, c in rows:
        masked = re.sub(r"(^|\n)DATE: [^\n]*", r"\1#", c) if e != "json" else c
        masked = re.sub(r"(^|\n)collectedAt: [^\n]*", r"\1#", masked) if e == "md" else masked
        same[s, g, e, masked].append(t)
    left = versions.dedupe_history(df).collect()
    assert sorted((r["site"], r["slug"], r["ext"], r["collected_at"]) for r in left) == sorted((*k[:3], max(v)) for k, v in same.items())
    plan = versions.cap_history(df, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("content" in line for line in plan.splitlines() if "Window " in line)


def test_walks_with_a_full_queue(spark):
    """A first-in first-out walk, step by step, where most pages fail and the queue is often full."""
    for seed, limit, most in ((1, 5, 12), (2, 3, 40), (3, 60, 10)):
        rng = random.Random(seed)
        names = [f"https://h.x/{i}" for i in range(400)]
        rows = [(a, i, b) for a in names for i, b in enumerate(rng.sample(names, 9))]
        bad = set(rng.sample(names[1:], 330))
        out = defaultdict(list)
        for a, _, b in rows:
            out[a].append(b)
        want = []
        for root in names[:2]:
            queue, queued, got, failed = [root], {root}, [], 0
            while queue and len(got) < most:
                u = queue.pop(0)
                if u in bad:
                    failed += 1
                    if u == root:
                        break
                    continue
                got.append(u)
                for b in out[u]:
                    if len(queue) >= limit:
                        break
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
            want += [(root, u, k + 1) for k, u in enumerate(got)]
        pages = spark.createDataFrame([(n, n not in bad) for n in names], "url string, ok boolean")
        walk = links.crawl_select(pages, spark.createDataFrame(rows, "src string, link_pos int, dst string"), spark.createDataFrame([(n,) for n in names[:2]], "root string"), most, limit)
        assert sorted(map(tuple, walk.collect())) == sorted(want)


def test_queue_bound_by_default(spark):
    """2 pages to select: 60 places in the queue. The first page's links fill it, so its 61st is passed by until a later page has it."""
    names = [f"https://h.x/{i:03d}" for i in range(100)]
    rows = [(names[0], i, n) for i, n in enumerate(names[1:])] + [(names[60], 0, names[99])]
    pages = spark.createDataFrame([(n, k in (0, 60, 99)) for k, n in enumerate(names)], "url string, ok boolean")
    walk = lambda many: [r["url"][-3:] for r in links.crawl_select(pages, spark.createDataFrame(rows, "src string, link_pos int, dst string"), spark.createDataFrame([(names[0],)], "root string"), many).orderBy("order").collect()]
    assert walk(2) == ["000", "060"] and walk(3) == ["000", "060", "099"]


def test_reader_region(spark):
    said, linked = "Words of the story go on, and on, for a while. " * 3, "<a href='/x'>More of the same kind of headline</a> "
    pages = [
        # no article, no main: the body would take the teasers, the comments and the footer
        f"<body><div class='teasers'><p>{linked * 4}</p><p>{linked * 4}</p></div><div><div id='c1'><h2>Head</h2><p>{said}</p><p>{said}</p><ul><li>item</li></ul></div></div><div class='comments'><p>{said}</p><p>{said}</p><p>{said}</p></div><div class='footer'><p>{said}</p></div></body>",
        # an article element that is a teaser only
        f"<body><article><p>Short teaser of a text.</p></article><section class='story-content'><h1>T</h1><p>{said}</p><p>{said}</p><p>{said}</p></section><aside><p>{said}</p></aside></body>",
        # nothing scores: the chosen root
        "<body><main><h1>Only</h1><li>" + said + said + "</li></main></body>",
        # equal scores: the first
        f"<body><table><tr><td><h3>A</h3><p>{said}{said}</p></td><td><h3>B</h3><p>{said}{said}</p></td></tr></table></body>",
    ]
    df = spark.createDataFrame([(i, "https://a.b/", f"<title>t</title>{h}") for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["article_title"], r["article_body_text"].count("Words of the story") // 3, r["headings"]) for r in html_nodes.readable_article(html_nodes.parsed_pages(df)).collect()}
    assert got == {0: ("Head", 2, ["Head"]), 1: ("T", 3, ["T"]), 2: ("Only", 2, ["Only"]), 3: ("A", 2, ["A"])}
    deep = "<div>" * 20_000 + "<p>" + said + "</p>"
    began = time.time()
    html_nodes.parse_page(deep)
    assert time.time() - began < 20


def test_store_holds_contents_once(spark, tmp_path):
    rng, store = random.Random(3), io.ArticleStore(spark, str(tmp_path / "store"))
    texts = ["".join(rng.choices("0123456789abcdef", k=9000)) for _ in range(40)]
    rows = [(f"s{i % 3}", f"a{i}", datetime(2024, 1, 1), str(i), t, t, "{}" + t) for i, t in enumerate(texts)]
    schema, key = "site string, slug string, collected_at timestamp, signature string, md string, txt string, json string", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    store.publish(spark.createDataFrame(rows, schema).coalesce(1), "r0")
    assert spark.conf.get(key) == before
    assert {(r["site"], r["slug"], r["ext"], r["content"]) for r in store.latest().collect()} == {(s, a, x, c) for s, a, _, _, *files in rows for x, c in zip(("md", "txt", "json"), files, strict=True)}
    assert sum(p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet")) < 1.5 * sum(map(len, texts))


def test_store_run_again_keeps_versions_of_half_changed_articles(spark, tmp_path):
    schema = "site string, slug string, collected_at timestamp, signature string, md string, txt string, json string"
    store, day = io.ArticleStore(spark, str(tmp_path / "store")), lambda k: datetime(2024, 1, k)
    first = [("s", "x", day(1), "1", "m", "t", "j"), ("s", "y", day(1), "1", "m", "t", "j"), (None, "z", day(1), "1", "m", "t", "j")]
    second = [("s", "x", day(2), "2", "m2", "t2", "j2"), ("s", "y", day(2), "2", "m", "t2", "j2")]
    store.publish(spark.createDataFrame(first, schema), "r0")
    seen = lambda: [sorted(map(str, t.collect())) for t in (store.latest(), store.history())]
    store.publish(spark.createDataFrame(second, schema), "r1")
    once = seen()
    store.publish(spark.createDataFrame(second, schema), "r1")
    assert seen() == once and (len(once[0]), len(once[1])) == (9, 14)


def test_titles_stay_in_their_line(spark):
    mds = ["a\nTitle:  \nmore", "Title:\n\nTitle: q", "---\ntitle:\nauthor: me\n---\n", "Title: a\u0085b c\rd\r\nx", "---\ntitle: 'a b'\r\n---\n"]
    assert values(spark, text.line_title, mds) == [None, None, None, "a\u0085b c d", None]
    assert values(spark, text.frontmatter_title, mds) == [None, None, None, None, "a b"]
