"""Text columns: white space, noise keys, slugs, dates. Lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OTHER = r"\t-\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_WHITE = rf"\s{_OTHER}"
#: White space as browsers have it; the same pattern works in Java and RE2.
SPACE = f"[{_WHITE}]+"
HEADING = "^h[1-6]$"


def _runs(more: str = "") -> str:
    """Runs of white space (and `more`) that are not one blank already.

    The first test, of two ranges, turns most characters away; what it lets by is looked at again from behind.
    """
    return rf"[[^!-\x{{9f}}\x{{a1}}-\x{{167f}}]{more}](?:(?<=[{_OTHER}{more}])[{_WHITE}{more}]*|(?<= )[{_WHITE}{more}]+)"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _runs(), " "))


def collapse_entity(c: Column) -> Column:
    """collapse, with a literal &nbsp; as a blank."""
    return collapse(F.replace(c, F.lit("&nbsp;"), F.lit(" ")))


def noise_key(c: Column) -> Column:
    """Lower case; Markdown's symbols count as white space. A byte order mark goes first, as a final sigma looks past it."""
    plain = F.replace(F.coalesce(c, F.lit("")), F.lit("\ufeff"), F.lit(" "))
    return F.trim(F.regexp_replace(F.lower(plain), _runs(r"*_`#>\[\]()"), " "))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{_WHITE}]")


def slugify(title: Column, empty: str = "untitled-article", most: int | None = None) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9\s-]", "")
    s = F.regexp_replace(F.regexp_replace(F.trim(s), r"\s+", "-"), "-+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    s = F.left(s, F.lit(most)) if most else s
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(empty))


def display_date(raw: Column) -> Column:
    """M/d/yyyy, h:mm:ss AM in the session's zone (UTC); unparsable text as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(raw), "M/d/yyyy, h:mm:ss a"), raw)


def timestamp_slug(ts: Column, run_id: bool = False) -> Column:
    s = F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")
    return s if run_id else F.replace(s, F.lit("T"), F.lit("_"))


def contains_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"\A[{_WHITE}]+|[{_WHITE}]+\z", "")


def frontmatter_title(md: Column) -> Column:
    """The title line of a block between two lines of dashes at the start, in any case, without one pair of quotes; null if there is none."""
    block = F.regexp_extract(md, r"(?s)\A---\s*\n(.*?)\n---(?:\s*\n|\s*\z)", 1)
    title = strip(F.regexp_extract(block, r"(?imd)^title:(.*)$", 1))
    return F.nullif(collapse(F.regexp_replace(title, "\\A[\"']|[\"']\\z", "")), F.lit(""))


def line_title(md: Column) -> Column:
    """The text of the first line that begins with Title:, null if there is none. Lines end at line feeds; a title never comes from the next one."""
    return F.nullif(collapse(F.regexp_extract(md, r"(?md)^Title:(.*)$", 1)), F.lit(""))


def document_title(md: Column, url: Column) -> Column:
    """The title of a Markdown document: of its front matter, else of its title line, else the host of its URL, else Untitled."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return F.coalesce(frontmatter_title(md), line_title(md), host, F.lit("Untitled"))
