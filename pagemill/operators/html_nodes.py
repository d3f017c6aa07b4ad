"""HTML pages to node rows and page facts, by one small vectorised helper over html.parser."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import urls as U
from pagemill.functions.gates import STOP_TEXTS, is_article_page, is_author_label, is_noise_image_src, is_noise_text
from pagemill.functions.text import collapse
from pagemill.operators.captures import first_article

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "iframe", "svg"}
BLOCKS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre", "table", "hr", "img"]
#: Tags of the second extractor, and how many blocks and characters it takes.
READABLE, MAX_BLOCKS, MIN_READABLE = ["h1", "h2", "h3", "p", "li", "blockquote", "pre", "img", "figcaption"], 500, 160
NODES = {*BLOCKS, "figcaption"}
CLOSES_P = NODES - {"img"} | {"div", "section", "article", "main", "ul", "ol", "header", "footer", "nav", "form", "figure"}
#: Marks that an element passes on to what it holds.
WITHIN = {"nav": 1, "header": 1, "footer": 1, "article": 2, "main": 4}
ROOTS = ["article", "main article", "[data-post-id]", ".available-content", "main", "body"]
_STR, _ARR = T.StringType(), T.ArrayType(T.StringType())
NODE = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("tag", _STR), T.StructField("text", _STR), T.StructField("in_nav", T.BooleanType()), T.StructField("roots", T.ArrayType(T.IntegerType())), T.StructField("src", _STR), T.StructField("full", _STR), T.StructField("alt", _STR), T.StructField("links", T.ArrayType(_ARR)), T.StructField("codes", _ARR), T.StructField("cells", T.ArrayType(_ARR))])
PARSED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", _STR), T.StructField("title", _STR), T.StructField("description", _STR), T.StructField("published", _STR), T.StructField("dates", _ARR), T.StructField("og_title", _STR), T.StructField("jsonld", _ARR), T.StructField("hrefs", _ARR), T.StructField("resolved", _ARR), T.StructField("article_h1", _STR), T.StructField("main_h1", _STR), T.StructField("long_h1", _STR), T.StructField("root", T.IntegerType()), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("extract_error", _STR)])


class Element:
    """at and last: the places in document order of the element and of what follows its subtree; begin, end: its text's pieces."""

    __slots__ = ("tag", "attrs", "parts", "parent", "under", "at", "last", "begin", "end")

    def __init__(self, tag, attrs, parent=None):
        self.tag, self.attrs, self.parts, self.parent = tag, attrs, [], parent


class Tree(HTMLParser):
    """A tree with void elements, implied ends of p, li, tr, td and option, and title as text only.

    The depths of open elements are kept by tag, so that an end tag finds its element without a walk.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root, self.scripts, self.depths = Element("#root", {}), [], defaultdict(list)
        self.open = [self.root]

    def _deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths[t]), default=0)

    def _end(self, depth: int) -> None:
        while len(self.open) > depth:
            self.depths[self.open.pop().tag].pop()

    def _close(self, tags, stop):
        depth = self._deepest(tags)
        if depth > self._deepest(stop):
            self._end(depth)

    def handle_starttag(self, tag, attrs):
        if self.open[-1].tag in ("title", "textarea"):
            self.open[-1].parts.append(self.get_starttag_text() or "")
            return
        if tag in CLOSES_P:
            self._close(("p",), ("td", "th", "button"))
        if tag == "li":
            self._close(("li",), ("ul", "ol"))
        elif tag in ("tr", "td", "th", "option"):
            self._close(("td", "th") if tag in ("td", "th") else (tag,), ("table", "select"))
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        self.open[-1].parts.append(e)
        if tag == "script":
            self.scripts.append(e)
        if tag not in VOID:
            self.depths[tag].append(len(self.open))
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.open[-1].tag in ("title", "textarea") and tag != self.open[-1].tag:
            self.open[-1].parts.append(f"</{tag}>")
        elif self.depths[tag]:
            self._end(self.depths[tag][-1])

    def handle_data(self, data):
        self.open[-1].parts.append(data)

    def shown(self) -> tuple[list[Element], list[str]]:
        """Elements outside dropped ones in document order, and the pieces of their text; one pass over the tree."""
        live, said, stack = [], [], [(self.root, 0)]
        while stack:
            e, under = stack.pop()
            if isinstance(e, str):
                said.append(e)
            elif under is None:
                e.last, e.end = len(live), len(said)
            elif e.tag not in DROPPED:
                e.under, e.at, e.begin = under, len(live), len(said)
                live.append(e)
                stack.append((e, None))
                stack.extend((x, under | WITHIN.get(e.tag, 0)) for x in reversed(e.parts))
        return live, said


def squeeze(s: str) -> str:
    return " ".join(s.replace("﻿", " ").split())


#: Of the reader view: elements that hold an article, their paragraphs, and the words in class or id that speak for or against one.
HOLDERS, PROSE, SHORT = {"div", "section", "article", "main", "td", "body"}, ("p", "pre", "blockquote"), 25
FOR, AGAINST = ("article", "content", "entry", "story", "post-body", "main-text"), ("comment", "sidebar", "footer", "header", "menu", "promo", "related", "share", "teaser", "cookie", "banner", "widget")


def region(live: list[Element], said: list[str]) -> Element | None:
    """The element that holds the article: most paragraph text at or right below it, little of it in links.

    Every paragraph of SHORT characters gives its parent one point and one for each hundred characters that are in no link, and its
    grandparent half of that; class and id add or take away a third, and the whole shrinks by the share of linked text. Sums of text
    and linked text by place make each share two subtractions, so the pass is linear. Of equal scores the first element has it.
    """
    edge = [0] * (len(said) + 1)
    for e in live:
        if e.tag == "a":
            edge[e.begin] += 1
            edge[e.end] -= 1
    text, linked, inside = [0], [0], 0
    for k, s in enumerate(said):
        inside += edge[k]
        n = len(s.strip())
        text.append(text[-1] + n)
        linked.append(linked[-1] + (n if inside else 0))
    points: dict[int, float] = defaultdict(float)
    for e in live:
        if e.tag in PROSE and not e.under & WITHIN["nav"] and (n := text[e.end] - text[e.begin]) >= SHORT:
            own = 1 + (n - linked[e.end] + linked[e.begin]) / 100
            for up, part in ((e.parent, 1.0), (e.parent and e.parent.parent, 0.5)):
                if up is not None and up.tag in HOLDERS:
                    points[up.at] += own * part
    best, most = None, 0.0
    for at in sorted(points):
        e = live[at]
        name, n = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".lower(), max(1, text[e.end] - text[e.begin])
        hint = any(w in name for w in FOR) + (e.tag in ("article", "main")) - 2 * any(w in name for w in AGAINST)
        score = points[at] * (1 + hint / 3) * (1 - (linked[e.end] - linked[e.begin]) / n)
        if score > most:
            best, most = e, score
    return best


def _is_root(e: Element, selector: str) -> bool:
    if selector == "main article":
        return e.tag == "article" and bool(e.under & WITHIN["main"])
    if selector == "[data-post-id]":
        return "data-post-id" in e.attrs
    if selector == ".available-content":
        return "available-content" in e.attrs.get("class", "").split()
    return e.tag == selector


def _resolved(href: str, base: str | None) -> str:
    try:
        return (U.normalise(urljoin(base or "", href)) or href) if href else ""
    except ValueError:
        return href


def _link(href: str, base: str | None) -> str | None:
    """The href resolved as links are: null if it can't be read."""
    try:
        return U.normalise(urljoin(base or "", href.strip()))
    except ValueError:
        return None


def parse_page(html: str, url: str | None = None) -> dict:
    """Facts and nodes of a page in time linear in the page and in the texts given out."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    live, said = tree.shown()
    tagged = defaultdict(list)
    for e in live:
        tagged["td" if e.tag == "th" else e.tag].append(e)
    places = {tag: [e.at for e in es] for tag, es in tagged.items()}

    def text(e: Element) -> str:
        return "".join(said[e.begin : e.end])

    def inside(e: Element, tag: str) -> list[Element]:
        at = places.get(tag, [])
        return tagged[tag][bisect_right(at, e.at) : bisect_left(at, e.last)]

    def meta(key: str, name: str) -> str:
        return squeeze(next((e.attrs.get("content", "") for e in tagged["meta"] if e.attrs.get(key) == name), ""))

    def inner_h1(outer: str) -> str | None:
        return next((t for e in tagged["h1"] if e.under & WITHIN[outer] for t in [squeeze(text(e))] if t), None)

    roots = [next((e for e in live if _is_root(e, s)), None) for s in ROOTS]
    # the place after the roots stands for the reader view's region, which no score of a root sees
    shown = [*roots, region(live, said)]
    scores = [-1 if r is None else len(inside(r, "p")) * 200 + min(len(squeeze(text(r))), 20_000) for r in roots]
    linked = [e for e in tagged["a"] if "href" in e.attrs]
    links = {e.at: [squeeze(text(e)), _resolved(squeeze(e.attrs["href"]), url)] for e in linked}
    nodes = []
    for e in live:
        if e.tag in NODES:
            src = e.attrs.get("src", e.attrs.get("data-src")) if e.tag == "img" else None
            if e.tag == "img" and src is None:
                src = e.attrs.get("srcset", "").split(",")[0].strip().split(" ")[0]
            nodes.append({
                "pos": len(nodes), "tag": e.tag, "text": text(e).replace("\r\n", "\n").strip() if e.tag == "pre" else squeeze(text(e)), "in_nav": bool(e.under & WITHIN["nav"]),
                "roots": [k for k, r in enumerate(shown) if r is not None and r.at <= e.at < r.last], "src": src, "full": src and _resolved(src, url), "alt": e.attrs.get("alt"),
                "links": [links[a.at] for a in inside(e, "a") if a.at in links], "codes": [squeeze(text(c)) for c in inside(e, "code")],
                "cells": [[squeeze(text(c)) for c in inside(r, "td")] for r in inside(e, "tr")] if e.tag == "table" else None,
            })
    times, published = [squeeze(e.attrs.get("datetime", "")) for e in tagged["time"]], meta("property", "article:published_time")
    return {
        "title": squeeze(text(tagged["title"][0])) if tagged["title"] else "", "description": meta("name", "description"), "published": published or next(iter(times), "") or None, "og_title": meta("property", "og:title"),
        "dates": [published, meta("name", "publish-date"), meta("name", "date"), next(filter(None, times), "")],
        "jsonld": ["".join(x for x in e.parts if isinstance(x, str)) for e in tree.scripts if e.attrs.get("type") == "application/ld+json"],
        "hrefs": [e.attrs["href"] for e in linked], "resolved": [_link(e.attrs["href"], url) for e in linked], "article_h1": inner_h1("article"), "main_h1": inner_h1("main"), "long_h1": max((n["text"] for n in nodes if n["tag"] == "h1"), key=len, default=None) or None, "root": scores.index(max(scores)), "nodes": nodes, "extract_error": None,
    }


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 200):
            out = []
            for page_id, url, html in pdf.iloc[at : at + 200].itertuples(index=False):
                try:
                    out.append({"page_id": page_id, "url": url} | parse_page(html or "", url))
                except Exception as e:  # one broken page must not fail the job
                    out.append({"page_id": page_id, "url": url, "extract_error": repr(e)[:200]})
            yield pd.DataFrame(out, columns=[f.name for f in PARSED.fields])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """One row per page with its facts and nodes; html goes no further."""
    return pages.select("page_id", "url", "html").mapInPandas(_parse, PARSED)


def html_nodes(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "root", F.explode("nodes").alias("n")).select("page_id", "root", "n.*")


def article_title() -> Column:
    return F.coalesce("article_h1", "main_h1", "long_h1", F.nullif(F.col("og_title"), F.lit("")), F.col("title"))


def headings() -> Column:
    return F.transform(F.filter("nodes", lambda n: n["tag"].isin("h1", "h2") & (n["text"] != "")), lambda n: n["text"])


def _replace_first(text: Column, label: Column, made: Column) -> Column:
    at = F.position(label, text)
    return F.when(at > 0, F.concat(F.left(text, at - 1), made, F.substr(text, at + F.length(label)))).otherwise(text)


def inline_markdown(text: Column, links: Column, codes: Column, page_url: Column) -> Column:
    """Text in which the first place of each link label, then of each code text, is written as Markdown.

    links: [label, resolved href] in order. Targets on the page's own origin lose their fragment; archive links are unwrapped.
    """
    named = F.filter(links, lambda a: (a[0] != "") & (a[1] != ""))
    target = lambda href: U.unwrap_archive_url(F.coalesce(U.scoped_link(href, page_url), href))
    linked = F.aggregate(named, text, lambda t, a: _replace_first(t, a[0], F.concat(F.lit("["), a[0], F.lit("]("), target(a[1]), F.lit(")"))))
    return F.aggregate(F.filter(codes, lambda c: c != ""), linked, lambda t, c: _replace_first(t, c, F.concat(F.lit("`"), c, F.lit("`"))))


def table_markdown(cells: Column) -> Column:
    """Rows of cells as a Markdown table as wide as its widest row; empty rows are left out, no rows give an empty text."""
    rows = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    full = F.transform(rows, lambda r: line(F.concat(F.transform(r, lambda c: F.trim(F.replace(c, F.lit("|"), F.lit("\\|")))), F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit(":---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(full, 1, 1), F.array(rule), F.slice(full, F.lit(2), F.size(full))), "\n")).otherwise("")


def with_blocks(parsed: DataFrame, inline: bool = True) -> DataFrame:
    """Adds __title, __told (the page's first JSON-LD article) and __blocks, its content in order, all within the row.

    A page with a JSON-LD article has that article's paragraphs, then its images; others the nodes of the chosen root that are
    content, up to a stop text. With `inline`, links, code and tables are Markdown, as in the body text; else they are plain.
    """
    blank = lambda x: F.coalesce(x, F.lit(""))
    prose = lambda tag: ~tag.isin("img", "table", "hr")

    def made(n: Column) -> Column:
        tag, text = n["tag"], n["text"]
        if inline:
            plain = F.when(tag == "table", table_markdown(n["cells"])).when(tag == "hr", "------").when(tag == "pre", F.trim(F.replace(text, F.lit("\u00a0"), F.lit(" "))))
            text = plain.otherwise(inline_markdown(text, n["links"], n["codes"], F.col("url")))
        return F.struct(n["pos"].alias("pos"), tag.alias("tag"), F.when(tag != "img", text).alias("text"), n["src"].alias("given"), n["full"].alias("src"), n["alt"].alias("alt"))

    def keep(n: Column) -> Column:
        tag, text = n["tag"], n["text"]
        said = (text != "") & ~is_noise_text(text) & (text != F.col("__title")) & ~is_author_label(tag, text)
        return F.when(tag == "img", (blank(n["given"]) != "") & ~is_noise_image_src(n["given"])).when(tag == "hr", True).when(tag == "table", text != "").otherwise(said)

    def block(pos: Column, tag: Column, text: Column, src: Column, alt: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), F.when(tag == "img", "image").otherwise("text").alias("type"), tag.alias("tag"), text.alias("text"), src.alias("src"), alt.alias("alt"))

    none = F.lit(None).cast("string")
    df = parsed.withColumn("__title", collapse(article_title())).withColumn("__told", first_article(F.col("jsonld")))
    inner = F.filter("nodes", lambda n: F.array_contains(n["roots"], F.col("root")) & ~n["in_nav"] & n["tag"].isin(BLOCKS))
    df = df.withColumn("__nodes", F.filter(F.transform(F.when(F.col("__told").isNull(), inner), made), keep))
    # the array stays in place; what is cut is all from the first stop text on
    df = df.withColumn("__stop", F.get(F.filter("__nodes", lambda n: prose(n["tag"]) & F.lower(n["text"]).isin(STOP_TEXTS)), 0)["pos"])
    own = F.transform(F.filter("__nodes", lambda n: F.col("__stop").isNull() | (n["pos"] < F.col("__stop"))), lambda n: block(n["pos"], n["tag"], n["text"], n["src"], n["alt"]))
    words, pictures = F.split("__told.body", "\n\n"), F.col("__told.images")
    told = F.concat(
        F.transform(words, lambda p, i: block(i, F.lit("p"), p, none, none)),
        F.transform(F.coalesce(pictures, F.array().cast("array<string>")), lambda u, i: block(F.size(words) + i, F.lit("img"), none, u, F.lit("image"))),
    )
    return df.withColumn("__blocks", F.coalesce(told, own, F.array().cast("array<struct<pos:int,type:string,tag:string,text:string,src:string,alt:string>>"))).drop("__nodes", "__stop")


def raw_blocks(parsed: DataFrame, inline: bool = False) -> DataFrame:
    """page_id, pos, type, tag, text, src, alt: the blocks of with_blocks as rows; no shuffle."""
    # the outer form: an inner explode tests the array's size below, which would make it again
    return with_blocks(parsed, inline).select("page_id", F.explode_outer("__blocks").alias("b")).filter("b is not null").select("page_id", "b.*")


def published_at_readable() -> Column:
    """The first date that is there: the article's own, publish-date, date, then a time element."""
    return F.get(F.filter("dates", lambda d: d != ""), 0)


def readable_article(parsed: DataFrame, most: int | None = MAX_BLOCKS) -> DataFrame:
    """page_id, url, title, description, headings, article_title, article_body_text, images, published_at, is_article: what a reader view shows.

    The first `most` blocks (None: all) with text or source of the page's region, or of the chosen root where no element has paragraphs,
    outside navigation. No row without a title or with a shorter text than MIN_READABLE.
    """
    scored = F.exists("nodes", lambda n: F.array_contains(n["roots"], F.lit(len(ROOTS))))
    held = F.filter("nodes", lambda n: F.array_contains(n["roots"], F.when(scored, F.lit(len(ROOTS))).otherwise(F.col("root"))) & ~n["in_nav"] & n["tag"].isin(READABLE))
    made = F.transform(held, lambda n: F.struct(n["tag"].alias("tag"), collapse(F.when(n["tag"] == "img", n["full"]).otherwise(n["text"])).alias("text"), collapse(n["alt"]).alias("alt")))
    filled = F.filter(made, lambda n: n["text"] != "")
    df = parsed.withColumn("b", filled if most is None else F.slice(filled, 1, most))
    head = F.transform(F.filter("b", lambda n: n["tag"].isin("h1", "h2", "h3")), lambda n: n["text"])
    body = F.array_join(F.transform(F.filter("b", lambda n: n["tag"] != "img"), lambda n: n["text"]), "\n\n")
    images = F.transform(F.filter(F.transform("b", lambda n, i: F.struct(n["text"].alias("src"), n["alt"].alias("alt"), (i + 1).alias("block_order"), n["tag"].alias("tag"))), lambda n: n["tag"] == "img"), lambda n, i: F.struct(n["src"].alias("src"), n["alt"].alias("alt"), (i + 1).alias("order"), n["block_order"].alias("block_order")))
    title = F.coalesce(F.get(head, 0), F.col("title"))
    df = df.select(
        "page_id", "url", F.coalesce(F.nullif("title", F.lit("")), title).alias("title"), collapse(F.col("description")).alias("description"), F.array_distinct(head).alias("headings"),
        title.alias("article_title"), body.alias("article_body_text"), images.alias("images"), published_at_readable().alias("published_at"),
    )
    return df.filter((F.col("article_title") != "") & (F.length("article_body_text") >= MIN_READABLE)).withColumn("is_article", F.length("article_body_text") > MIN_READABLE)


def collect_images(blocks: DataFrame) -> DataFrame:
    """page_id, src, alt, caption, order, block_order: the images of each page; block_order counts all its blocks from 1."""
    place = W.partitionBy("page_id").orderBy("pos")
    image = (F.col("type") == "image") & (collapse(F.col("src")) != "")
    df = blocks.withColumn("block_order", F.row_number().over(place)).withColumn("order", F.count_if(image).over(place.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return df.filter(image).select("page_id", *[collapse(F.col(c)).alias(c) for c in ("src", "alt", "caption")], F.col("order").cast("int").alias("order"), "block_order")


def articles(pages: DataFrame) -> DataFrame:
    """page_id, url, title, description, published_at, article_title, article_body_text, headings, hrefs, extract_error, structured."""
    return article_columns(parsed_pages(pages))


def article_columns(parsed: DataFrame, blocks: bool = False) -> DataFrame:
    """A page's first JSON-LD article, or else its text blocks, as Markdown, up to a stop text. With `blocks`, also its ordered blocks and images as JSON."""
    df = with_blocks(parsed)
    made, told = F.col("__told").isNotNull(), lambda k: F.nullif(F.col(f"__told.{k}"), F.lit(""))
    body = F.array_join(F.transform(F.filter("__blocks", lambda n: n["type"] == "text"), lambda n: n["text"]), "\n\n")
    shown = F.to_json(F.transform("__blocks", lambda n: F.struct(n["tag"].alias("tag"), n["text"].alias("text"), n["src"].alias("src"), collapse(F.coalesce(n["alt"], F.lit(""))).alias("alt"))))
    return df.select(
        "page_id", "url", "title", F.coalesce(told("description"), "description").alias("description"), F.coalesce("__told.published_at", "published").alias("published_at"), F.coalesce(told("title"), "__title").alias("article_title"),
        body.alias("article_body_text"), headings().alias("headings"), "hrefs", "resolved", "extract_error", made.alias("structured"), *([shown.alias("content_blocks")] if blocks else []),
    )


def is_article() -> Column:
    """A structured article has more than 160 characters; other pages have the usual rule."""
    body = F.col("article_body_text")
    return F.when(F.col("structured"), F.length(body) > 160).otherwise(is_article_page(body))
