"""Structured data, rendered text, and the choice among captures of one URL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.gates import is_archive_reject, is_blocked, is_challenge_html, is_unreadable
from pagemill.functions.text import collapse, collapse_entity, strip


def articles_of(jsonld: Column) -> Column:
    """The JSON-LD articles of a page's scripts in order: structs of title, description, body, published_at and images."""
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    listed = lambda v, path: F.coalesce(get(v, path, "array<variant>"), F.array(get(v, path, "variant")))
    items = F.flatten(F.transform(F.filter(jsonld, lambda raw: F.try_parse_json(raw).isNotNull()), lambda raw: listed(F.try_parse_json(raw), "$")))
    kinds = lambda v: F.coalesce(F.array_join(get(v, "$['@type']", "array<string>"), " "), get(v, "$['@type']"), F.lit(""))
    text = lambda v, path: collapse_entity(F.coalesce(get(v, path), F.lit("")))
    paragraphs = lambda v: F.filter(F.transform(F.split(get(v, "$.articleBody"), r"\n+"), collapse_entity), lambda p: p != "")
    images = lambda v: F.array_distinct(F.filter(F.transform(listed(v, "$.image"), lambda i: F.coalesce(get(i, "$.url"), get(i, "$"))), lambda u: u != ""))
    made = lambda v: F.struct(text(v, "$.headline").alias("title"), text(v, "$.description").alias("description"), F.array_join(paragraphs(v), "\n\n").alias("body"), get(v, "$.datePublished").alias("published_at"), images(v).alias("images"))
    fits = lambda v: v.isNotNull() & kinds(v).rlike("(?i)article|newsarticle|blogposting") & (F.length(text(v, "$.articleBody")) >= 10)
    return F.transform(F.filter(items, fits), made)


def first_article(jsonld: Column) -> Column:
    """The first of articles_of, null if there is none."""
    return F.get(articles_of(jsonld), 0)


def structured_article(parsed: DataFrame) -> DataFrame:
    """page_id, title, description, body, published_at: the first JSON-LD article of each page that has one."""
    told = parsed.select("page_id", first_article(F.col("jsonld")).alias("a")).filter("a is not null")
    return told.select("page_id", "a.title", "a.description", "a.body", "a.published_at")


#: Where the proxy's text begins, its name for a title, and a line that stands for a picture to come.
MARKER, _TITLE, _LOADING = "Markdown Content:", r"(?m)^Title:\s*(.+)$", "Loading diagram..."
_IMAGE, _LINKED, _RULE = r"^!\[(.*?)\]\((.*?)\)$", r"^\[!\[(.*?)\]\((.*?)\)\]\((.*?)\)$", r"^[-=*]{3,}$"


def _pieces(markdown: Column) -> Column:
    """Paragraphs and image lines in order; an image line begins with a tab, which no paragraph does.

    Lines are trimmed and hold no line feed, so a line feed can stand for the end of a paragraph: lines of text are joined by
    blanks, all other lines end what stands before them. One pass, however many lines a paragraph has.
    """
    lines = F.transform(F.split(strip(markdown), r"\r?\n", -1), strip)
    picture = lambda x: x.rlike(_IMAGE) | x.rlike(_LINKED)
    marked = F.transform(lines, lambda x: F.when(picture(x), F.concat(F.lit("\n\t"), x, F.lit("\n"))).when((x == "") | x.rlike(_RULE) | (x == _LOADING), "\n").otherwise(x))
    cut = F.split(F.array_join(marked, " "), "\n", -1)
    return F.filter(F.transform(cut, lambda x: F.when(x.startswith("\t"), F.rtrim(x)).otherwise(F.trim(x))), lambda x: x != "")


def _block(piece: Column) -> Column:
    """A typed block of a piece: an image with its caption, or a paragraph without heading marks and with links as their labels."""
    line = F.substring(piece, 2, 1 << 30)
    image, plain = piece.startswith("\t"), line.rlike(_IMAGE)
    part = lambda i: collapse(F.when(plain, F.regexp_extract(line, _IMAGE, i)).otherwise(F.regexp_extract(line, _LINKED, i)))
    bare = F.regexp_replace(F.regexp_replace(piece, r"^#{1,6}\s*", ""), r"^[-*_]{3,}$", "")
    text = collapse(F.regexp_replace(bare, r"\[(.*?)\]\((.*?)\)", "$1"))
    some = lambda c: F.when(image, c)
    return F.struct(
        F.when(image, "image").otherwise("text").alias("type"), F.when(~image, "p").alias("tag"), F.when(~image, text).alias("text"), some(part(2)).alias("src"),
        some(F.coalesce(F.nullif(part(1), F.lit("")), F.lit("image"))).alias("alt"), some(F.when(plain, "").otherwise(collapse(F.regexp_extract(line, _LINKED, 3)))).alias("caption"),
    )


def rendered_article(docs: DataFrame) -> DataFrame:
    """url, title, description, body, blocks, image_count from the proxy's text form (title line, marker, lines of Markdown).

    Everything after the first marker is content. A row needs the marker, a title (of the title line, else of the first heading)
    and a paragraph; the description is the first paragraph. Blocks keep the order of text and images.
    """
    raw = F.coalesce("raw_text", F.lit(""))
    at = F.instr(raw, MARKER)
    df = docs.filter(at > 0).select("url", collapse(F.regexp_extract(raw, _TITLE, 1)).alias("__title"), strip(F.substr(raw, at + len(MARKER))).alias("__md"))
    filled = lambda b: F.when(b["type"] == "text", b["text"] != "").otherwise(b["src"] != "")
    df = df.withColumn("blocks", F.filter(F.transform(_pieces(F.col("__md")), _block), filled))
    texts = F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"])
    head = collapse(F.regexp_extract("__md", r"(?m)^#{1,6}\s*(.+)$", 1))
    df = df.withColumn("__texts", texts).select(
        "url", F.coalesce(F.nullif("__title", F.lit("")), head).alias("title"), F.get("__texts", 0).alias("description"), F.array_join("__texts", "\n\n").alias("body"), "blocks",
        F.size(F.filter("blocks", lambda b: b["type"] == "image")).alias("image_count"),
    )
    return df.filter("title != '' and description is not null")


def rendered_blocks(docs: DataFrame) -> DataFrame:
    """url, pos, type, tag, text, src, alt, caption: the blocks of rendered_article as rows."""
    return rendered_article(docs).select("url", F.posexplode("blocks").alias("pos", "b")).select("url", "pos", "b.*")


def rendered_images(docs: DataFrame) -> DataFrame:
    """url, order, src, alt, caption: the images of rendered_article in order; the target of a linked image is its caption."""
    images = F.filter("blocks", lambda b: b["type"] == "image")
    return rendered_article(docs).select("url", F.posexplode(images).alias("at", "b")).select("url", (F.col("at") + 1).alias("order"), "b.src", "b.alt", "b.caption")


#: (name, runs when, accepts when) after the direct capture; lengths in code points.
_LATE = [("readable", "bad or len < 160", "not cand_blocked and (bad or cand_len > len)"), ("rendered", "len is null or blocked or len < 160", "cand_len > 80 and (len is null or cand_len > len)"), ("mirror", "len is null or blocked", "not cand_blocked and cand_len > 160"), ("archive", "len is null or blocked", "not cand_blocked and cand_len > 160"), ("browser", "bad", "not cand_blocked and cand_len > 160")]


def arbitrate_captures(captures: DataFrame, force_browser: bool = False) -> DataFrame:
    """url, stage, title, body, failed, and kept columns: the cascade over direct, readable, rendered, mirror, archive and browser captures.

    captures: url, variant, title, article_title, body; optional html, description, published_at, headings, links (arrays), and
    page_id: captures of a URL then meet those of the same page only, as a URL may be stored more than once, and page_id goes first.
    Archive captures whose html is a check page, and browser captures whose html is a challenge, are left out. With
    force_browser a browser capture of more than 80 characters goes first. One shuffle by page and url: captures are pivoted to a
    column per variant (the longest of each), then the stages are a chain of column conditions. A rendered capture laid
    over a page keeps its title, headings and links.
    """
    more = [c for c in ("description", "published_at", "headings", "links") if c in captures.columns]
    if "html" in captures.columns:
        html, variant = F.coalesce("html", F.lit("")), F.col("variant")
        captures = captures.filter(~((variant == "archive") & is_archive_reject(html)) & ~((variant == "browser") & is_challenge_html(html)))
    one = F.struct(F.length("body").alias("len"), "title", "article_title", "body", *more)
    names = ["direct", *[n for n, _, _ in _LATE]]
    by = [c for c in ("page_id", "url") if c in captures.columns]
    wide = captures.groupBy(*by).agg(*[F.max(F.when(F.col("variant") == n, one)).alias(n) for n in names])
    forced = (F.col("browser.len") > 80) if force_browser else F.lit(False)
    now = F.when(forced, F.col("browser")).otherwise(F.col("direct"))
    state = wide.withColumn("now", now).withColumn("stage", F.when(forced, "browser").when(F.col("direct").isNotNull(), "direct"))

    def step(df: DataFrame, rule) -> DataFrame:
        name, runs, accepts = rule
        blocked = lambda s: F.coalesce(is_blocked(F.col(f"{s}.title"), F.col(f"{s}.body")), F.lit(False))
        df = df.withColumn("blocked", blocked("now")).withColumn("len", F.col("now.len")).withColumn("cand_len", F.col(f"{name}.len")).withColumn("cand_blocked", blocked(name))
        df = df.withColumn("bad", F.col("now").isNull() | F.col("blocked") | is_unreadable(F.col("now.title"), F.col("now.article_title"), F.col("now.body")))
        take = F.coalesce(F.col(name).isNotNull() & F.expr(runs) & F.expr(accepts), F.lit(False))
        put = F.col(name)
        if name == "rendered":
            kept = {"title": F.coalesce("now.title", "rendered.title"), "headings": F.when(F.col("now").isNull(), F.array("rendered.title")).otherwise(F.col("now.headings")) if "headings" in more else None, "links": F.when(F.col("now").isNull(), F.array().cast("array<string>")).otherwise(F.col("now.links")) if "links" in more else None}
            put = F.struct(*[kept[c].alias(c) if c in kept else F.col(f"rendered.{c}") for c in ("len", "title", "article_title", "body", *more)])
        df = df.withColumn("take", take)
        return df.withColumn("now", F.when(F.col("take"), put).otherwise(F.col("now"))).withColumn("stage", F.when(F.col("take"), name).otherwise(F.col("stage")))

    out = reduce(step, _LATE, state)
    failed = F.col("now").isNull() | is_blocked(F.col("now.title"), F.col("now.body")) | is_unreadable(F.col("now.title"), F.col("now.article_title"), F.col("now.body"))
    return out.select(*by, "stage", "now.title", "now.body", F.coalesce(failed, F.lit(True)).alias("failed"), *[f"now.{c}" for c in more])
