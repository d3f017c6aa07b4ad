"""Block cleaning with window functions, and rendering to Markdown and text.

Blocks are rows (page_id, pos, type, tag, text, src, alt, caption). All windows share one hash
shuffle by page_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.gates import is_noise_image, is_noise_table, is_truncated_heading, is_ui_noise
from pagemill.functions.text import HEADING, collapse, contains_any, display_date, is_blank, noise_key

# Where an article ends, and which sections are skipped.
STOP = ["discussion about this post", "ready for more?", "toplatestdiscussions", "temukan kumpulan riset terkait", "see all", "berikut sebaran masalahnya", "related stories"]
SECTION_STOP = ["related content", "site index", "site information navigation"]
SECTION_SKIP = ["editors picks", "editors' picks", "editors’ picks", "trending in"]


def _page():
    return W.partitionBy("page_id")


def _run():
    return _page().orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)


def _begins(key: Column, markers: list[str]) -> Column:
    return reduce(lambda a, m: a | (key == m) | key.startswith(f"{m} "), markers, F.lit(False))


def mark_blocks(blocks: DataFrame) -> DataFrame:
    """Adds key, level (of headings) and live (text rows that are no noise)."""
    text, tag, key = F.coalesce("text", F.lit("")), F.lower(F.coalesce("tag", F.lit(""))), F.col("key")
    is_text = F.col("type") == "text"
    noise = F.when(tag == "table", is_noise_table(text, key)).when(tag == "hr", F.lit(False)).otherwise(is_blank(text) | is_ui_noise(text, key) | is_truncated_heading(tag, text))
    df = blocks.withColumn("key", F.when(tag == "hr", F.lit("")).otherwise(noise_key(text)))
    return df.withColumn("level", F.when(is_text & tag.rlike(HEADING), F.substring(tag, 2, 1).cast("int"))).withColumn("live", is_text & ~noise)


def drop_skipped_sections(marked: DataFrame, skip: list[str] = SECTION_SKIP) -> DataFrame:
    """Hides text from a skip heading to the next live heading of its rank or higher; images stay."""
    head = F.col("live") & F.col("level").isNotNull()
    start = head & _begins(F.col("key"), skip)
    hidden = F.lit(False)
    for level in range(1, 7):
        begun = F.max(F.when(start & (F.col("level") == level), F.col("pos"))).over(_run())
        ended = F.max(F.when(head & ~start & (F.col("level") <= level), F.col("pos"))).over(_run())
        hidden = hidden | F.coalesce(begun >= F.coalesce(ended, F.lit(-1)), F.lit(False))
    return marked.withColumn("hidden", hidden).filter(~(F.col("hidden") & (F.col("type") == "text"))).drop("hidden")


def stop_at_marker(marked: DataFrame, stop: list[str] = STOP, section_stop: list[str] = SECTION_STOP) -> DataFrame:
    hit = F.col("live") & (contains_any(F.col("key"), stop) | (F.col("level").isNotNull() & _begins(F.col("key"), section_stop)))
    at = F.min(F.when(hit, F.col("pos"))).over(_page())
    return marked.withColumn("stop", at).filter(F.col("stop").isNull() | (F.col("pos") < F.col("stop"))).drop("stop")


def dedupe_long_blocks(marked: DataFrame, least: int = 24) -> DataFrame:
    long = (F.col("type") == "text") & (F.length("key") >= least)
    nth = F.row_number().over(W.partitionBy("page_id", F.when(long, F.col("key")).otherwise(F.concat(F.lit("#"), F.col("pos").cast("string")))).orderBy("pos"))
    return marked.withColumn("nth", nth).filter(F.col("nth") == 1).drop("nth")


def dedupe_adjacent_blocks(marked: DataFrame) -> DataFrame:
    """Drops a text whose previous row is the same text; any image breaks the run."""
    before = F.lag(F.struct("type", "key")).over(_page().orderBy("pos"))
    same = (F.col("type") == "text") & (F.col("key") != "") & (F.col("prev.type") == "text") & (F.col("prev.key") == F.col("key"))
    return marked.withColumn("prev", before).filter(~F.coalesce(same, F.lit(False))).drop("prev")


def trim_leading_images(blocks: DataFrame, narrative: bool = False) -> DataFrame:
    """Drops the images before the first text when there are three or more; `narrative` skips headings, rules and tables."""
    counts = (F.col("type") == "text") & (~F.col("tag").rlike("^(h[1-6]|hr|table)$") if narrative else F.lit(True))
    first = F.min(F.when(counts, F.col("pos"))).over(_page())
    image = (F.col("type") == "image") & (F.col("pos") < F.col("first"))
    return blocks.withColumn("first", first).withColumn("early", F.count_if(image).over(_page())).filter(~F.coalesce(image & (F.col("early") >= 3), F.lit(False))).drop("first", "early")


def clean_blocks(blocks: DataFrame, skip=SECTION_SKIP, stop=STOP, section_stop=SECTION_STOP) -> DataFrame:
    """All steps in their order. The stop is tested before the skip hides, on rows outside skipped sections."""
    df = drop_skipped_sections(mark_blocks(blocks), skip)
    df = stop_at_marker(df, stop, section_stop).filter((F.col("type") == "image") | F.col("live"))
    df = dedupe_adjacent_blocks(dedupe_long_blocks(df))
    df = df.filter(~((F.col("type") == "image") & is_noise_image(F.col("src"), F.col("alt"), F.col("caption"))))
    return trim_leading_images(trim_leading_images(df), narrative=True).drop("key", "level", "live")


def render_block_md(tag: Column, text: Column) -> Column:
    t = F.lower(tag)
    raw = F.trim(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    fence = F.when(F.contains(raw, F.lit("```")), "````").otherwise("```")
    hashes = F.repeat(F.lit("#"), F.greatest(F.lit(2), F.try_to_number(F.substring(t, 2, 1), F.lit("9")).cast("int")))
    lead = F.when(t.rlike(HEADING), F.concat(hashes, F.lit(" "))).when(t == "blockquote", "> ").when(t == "li", "- ").otherwise("")
    return F.when(t == "hr", "------").when(t == "table", raw).when(t == "pre", F.concat(fence, F.lit("\n"), raw, F.lit("\n"), fence)).otherwise(F.concat(lead, collapse(text)))


def _noted(caption: Column, plain: bool) -> Column:
    return caption if plain else F.when(caption.rlike("(?i)^https?://"), F.concat(F.lit("[Sumber gambar]("), caption, F.lit(")"))).otherwise(caption)


def blocks_to_markdown(blocks: DataFrame, plain: bool = False, unnamed: str = "img") -> DataFrame:
    """page_id, markdown, rendered (how many blocks it has): rendered blocks in order, images numbered among those kept; `unnamed` stands for a missing alt text."""
    return blocks_to_both(blocks, unnamed).select("page_id", F.col("plain" if plain else "markdown").alias("markdown"), "rendered")


def blocks_to_both(blocks: DataFrame, unnamed: str = "img") -> DataFrame:
    """page_id, markdown, plain, rendered: as blocks_to_markdown, with captions as links and as plain text, in one pass.

    A block is rendered once; an image's caption is put behind it, in either form, when the page is put together.
    """
    image = F.col("type") == "image"
    number = F.count_if(image).over(_run())
    alt = F.coalesce(F.nullif(collapse(F.col("alt")), F.lit("")), F.replace(F.lit(unnamed), F.lit("{}"), F.col("no").cast("string")))
    picture = F.concat(F.lit("!["), alt, F.lit("]("), F.col("src"), F.lit(")"))
    made = F.when(image, picture).otherwise(render_block_md(F.col("tag"), F.col("text")))
    rows = blocks.withColumn("no", number).select("page_id", "pos", made.alias("md"), F.when(image, collapse(F.col("caption"))).alias("cap"), "no")
    all_of = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "md", "cap", "no"))).alias("b"))
    # empty texts go here, where each text is made already
    kept = all_of.select("page_id", F.filter("b", lambda x: x["md"] != "").alias("b"))
    note = lambda x, plain: F.concat(F.lit("\n" if plain else "\n\n"), F.lit("_Gambar "), x["no"].cast("string"), F.lit(": "), _noted(x["cap"], plain), F.lit("_"))
    joined = lambda plain: F.array_join(F.transform("b", lambda x: F.concat(x["md"], F.when(F.coalesce(x["cap"], F.lit("")) != "", note(x, plain)).otherwise(""))), "\n\n")
    return kept.filter(F.size("b") > 0).select("page_id", joined(False).alias("markdown"), joined(True).alias("plain"), F.size("b").cast("long").alias("rendered"))


_BAR = "=" * 80


def _header() -> Column:
    bar = F.lit(_BAR)
    return F.concat_ws("\n", bar, F.concat(F.lit("TITLE: "), "article_title"), F.concat(F.lit("SOURCE: "), "url"), F.concat(F.lit("DATE: "), "shown"), bar, F.lit("\n"))


def article_documents(articles: DataFrame, blocks: DataFrame, collected_at: Column) -> DataFrame:
    """page_id, markdown, text: both documents of an article, from blocks rendered once.

    Markdown: header, title, source, description and cleaned blocks, without blocks the body's paragraphs. Text: header,
    description and cleaned blocks with plain captions, without blocks the body as it is.
    """
    shown = display_date(F.coalesce(F.col("published_at"), collected_at))
    described = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("_"), "description", F.lit("_\n\n* * *\n\n"))).otherwise("")
    body = lambda c: F.nullif(F.trim(c), F.lit(""))
    df = articles.join(blocks_to_both(blocks), "page_id", "left").withColumns({"shown": shown, "described": described})
    paragraphs = F.filter(F.transform(F.split("article_body_text", "\n\n"), lambda p: collapse(p)), lambda p: p != "")
    md = F.concat(_header(), F.lit("# "), "article_title", F.lit("\n\nSource: "), "url", F.lit("\n\n"), "described", F.coalesce(body("markdown"), F.array_join(paragraphs, "\n\n"), F.lit("")))
    txt = F.concat(_header(), "described", F.coalesce(body("plain"), "article_body_text", F.lit("")), F.lit("\n"))
    return df.select("page_id", F.concat(F.regexp_replace(md, r"\s+\z", ""), F.lit("\n")).alias("markdown"), txt.alias("text"))


def article_markdown(articles: DataFrame, blocks: DataFrame, collected_at: Column) -> DataFrame:
    return article_documents(articles, blocks, collected_at).select("page_id", F.col("markdown").alias("document"))


def article_text(articles: DataFrame, blocks: DataFrame, collected_at: Column) -> DataFrame:
    return article_documents(articles, blocks, collected_at).select("page_id", F.col("text").alias("document"))
