"""URL columns. Root-relative links are resolved by columns, others by one vectorised helper."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Hosts of one archive service.
ARCHIVE_HOSTS = ["archive.is", "archive.today", "archive.ph", "archive.li", "archive.md", "archive.vn", "archive.fo"]
_PORTS = {"http": 80, "https": 443}


def is_supported_href(href: Column) -> Column:
    h = F.coalesce(href, F.lit(""))
    return ~((h == "") | h.startswith("#") | h.startswith("mailto:") | h.startswith("javascript:"))


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def origin(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))


def is_archive_host(name: Column) -> Column:
    return F.lower(F.trim(name)).rlike("^(.*[.])?(" + "|".join(h.replace(".", "[.]") for h in ARCHIVE_HOSTS) + ")$")


def archive_original_url(url: Column) -> Column:
    """The first URL inside an archive link, else null. A plus stays a plus."""
    inner = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^#]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B"))), inner)
    found = F.regexp_replace(F.regexp_extract(plain, r"""(?i)(https?://[^\s"'<>]+)""", 1), r"[)\],.]+$", "")
    return F.when(is_archive_host(host(url)) & (found != ""), found)


def unwrap_archive_url(url: Column) -> Column:
    return F.coalesce(archive_original_url(url), url)


def site_folder(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(host(unwrap_archive_url(url)), "[^a-z0-9.-]", "-"), F.lit("unknown-site"))


@F.pandas_udf(StringType())
def _normalised(url: pd.Series) -> pd.Series:
    return pd.Series([normalise(u) if u else None for u in url], dtype="object")


def request_key(url: Column, n: Column) -> Column:
    """The normalised URL, or what was given without blanks at its ends if it is none, and n."""
    given = F.trim(F.coalesce(url, F.lit("")))
    return F.concat(F.coalesce(F.when(given.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), _normalised(given)), given), F.lit("::"), n.cast("string"))


def queue_scope(url: Column, root: Column) -> Column:
    """Same origin; a /docs root keeps /docs; a post root keeps its own path only."""
    p, r = path(url), path(root)
    docs = lambda x: (x == "/docs") | x.startswith("/docs/")
    inside = F.when(docs(r), docs(p)).when(F.contains(r, F.lit("/post/")) | r.rlike(r"/p-\d+"), p == r).otherwise(True)
    return F.coalesce((origin(url) == origin(root)) & inside, F.lit(False))


def normalise(url: str) -> str | None:
    """Lower-case scheme and host, no default port, percent-encoded path and query; None if it has no host."""
    try:
        s = urlsplit(url)
        name = (s.hostname or "").encode("idna").decode() if s.hostname and not s.hostname.isascii() else s.hostname
        if s.scheme and s.scheme not in _PORTS:
            return url
        if not name:
            return None
        port = f":{s.port}" if s.port and s.port != _PORTS.get(s.scheme) else ""
        keep = "/:@!$&'()*+,;=-._~%[]|"
        return urlunsplit((s.scheme, name + port, quote(s.path or "/", keep), quote(s.query, keep + "?/"), quote(s.fragment, keep + "?/")))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    def one(h, b):
        try:
            return normalise(urljoin(b, h.strip()))
        except (ValueError, AttributeError):
            return None

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)], dtype="object")


def media_url(src: Column, page_url: Column) -> Column:
    """An image's source against its page, fragment and other hosts kept; what can't be resolved stays as it is."""
    return F.when(F.coalesce(src, F.lit("")) == "", src).otherwise(F.coalesce(resolve_url(src, page_url), src))


def scoped_link(resolved: Column, root: Column) -> Column:
    """Without fragment, same origin as root, else null."""
    bare = F.regexp_replace(resolved, "#.*$", "")
    return F.when(origin(bare) == origin(root), bare)


def host_rule(df: DataFrame, host_col: str, rules: DataFrame, default: str) -> DataFrame:
    """Adds `rule`: of the longest suffix of the host that rules(host, rule, rank) holds, exact first, by rank.

    Suffixes are exploded, so this is an equi-join; the rule list is small and Spark may broadcast it by size.
    """
    parts = F.split(F.lower(F.col(host_col)), "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = df.select(host_col).filter(F.col(host_col).isNotNull()).distinct()
    hit = hosts.select(host_col, F.posexplode(tails).alias("cut", "tail")).join(rules, F.col("tail") == rules["host"])
    best = hit.groupBy(host_col).agg(F.min_by("rule", F.struct(F.col("cut") > 0, "rank")).alias("rule"))
    return df.join(best, host_col, "left").withColumn("rule", F.coalesce("rule", F.lit(default)))
