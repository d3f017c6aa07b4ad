"""Quality gates and noise predicates, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import HEADING, collapse, contains_any, noise_key

# Texts and markers that pages show as furniture.
NOISE_TEXTS = ["subscribe", "sign in", "share", "comments", "restacks", "like", "likes", "masuk", "buat tulisan", "beranda", "tentang kami", "pedoman media siber", "ketentuan & kebijakan privasi", "panduan komunitas", "peringkat penulis", "cara menulis di kumparan", "informasi kerja sama", "bantuan", "iklan", "karir", "instagram", "facebook", "tiktok", "youtube", "whatsapp", "x", "topics", "sections", "more", "for ieee members", "ieee spectrum", "follow ieee spectrum", "support ieee spectrum"]
SCRIPT_MARKERS = ["window.", "function(", "javascript", "datadog", "cloudflare", "json.parse("]
STOP_TEXTS = ["discussion about this post", "ready for more?"]
UI_TEXTS = ["subscribe", "sign in", "share", "comments", "restacks", "like", "likes", "toplatestdiscussions", "see all", "ready for more?", "skip to content", "support us", "unduh data", "bagikan tautan", "pilihan editor", "search", "cari", "search cari", "search search", "jadi kawan m", "proyeksengsaranasional", "share full article", "topics", "sections", "more", "for ieee members", "ieee spectrum", "follow ieee spectrum", "support ieee spectrum"]
UI_PARTS = ["made with flourish", "archive.todaywebpage capture", "history priornext", "saved from history", "saved from", "create a chart", "create a hierarchy graph", "create a pictogram chart", "create an account", "exclusive for ieee members", "learn more about ieee", "ieee spectrum account", "enjoy more free content and benefits", "saving articles to read later requires", "the institute content is only available for members", "adding your response to an article requires", "access thousands of articles completely free", "access thousands of articles"]
MENU_WORDS = "artikel|reportase|ide & esai|multimedia|cerita foto|video|siniar|serial|tentang kami"
BLOCKED = ["just a moment", "security verification", "verify you are not a bot", "are you a robot", "unusual activity", "access denied", "captcha"]
CHALLENGE = ["just a moment", "security verification", "verify you are not a bot", "enable javascript and cookies to continue", "checking your browser", "turnstile", "captcha"]
ARCHIVE_REJECT = ["Please complete the security check to access", "g-recaptcha", "No results"]
IMAGE_MARKERS = ["cdn.userway.org", "/quote-1.svg", "/logo-", "logo-", "/avatars/", "spin_wh.svg", "body_wh.svg"]
IMAGE_PATHS = ["/uikit-assets/assets/icons/", "/uikit-assets/assets/logos/", "/avatars/", "w_32,h_32", "w_36,h_36", "w_64,h_64"]


def is_script_noise(text: Column) -> Column:
    return contains_any(F.lower(text), SCRIPT_MARKERS)


def is_noise_text(text: Column) -> Column:
    return F.lower(text).isin(NOISE_TEXTS) | is_script_noise(text)


def is_noise_image_src(src: Column) -> Column:
    s = F.lower(src)
    return s.startswith("data:image/") | s.endswith(".svg") | contains_any(s, IMAGE_PATHS)


def is_author_label(tag: Column, text: Column) -> Column:
    c = collapse(text)
    return tag.isin("h1", "h2") & (c != "") & (F.size(F.split(c, " ")) <= 5) & (c == F.upper(c)) & ~F.contains(c, F.lit("."))


def is_article_page(body: Column, least: int = 250) -> Column:
    return (F.length(body) > least) & ~is_script_noise(body)


def is_blocked(title: Column, body: Column) -> Column:
    return contains_any(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))), BLOCKED)


def is_unreadable(title: Column, article_title: Column, body: Column) -> Column:
    t, a, b = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (title, article_title, body))
    return (F.length(b) < 120) & ((b == "") | ((t != "") & (b == t) & (a == t)))


def is_challenge_html(html: Column) -> Column:
    return contains_any(F.lower(html), CHALLENGE)


def is_archive_reject(html: Column) -> Column:
    return contains_any(html, ARCHIVE_REJECT)


def is_ui_noise(text: Column, key: Column | None = None) -> Column:
    """key: a column that holds noise_key(text), so that it is computed once."""
    key, raw = noise_key(text) if key is None else key, F.trim(text)
    return (
        key.isin(UI_TEXTS) | key.startswith("© ") | key.isin("en", "id", "home", "menu") | contains_any(key, UI_PARTS) | contains_any(text, ["history←priornext→", "history<priornext>"])
        | (key == "advertisement") | key.startswith("advertisement ") | key.rlike(r"^[a-z0-9.-]+\s+is\s+blocked$")
        | raw.rlike(r"(?i)^\[[^\]]+\]\(https?://[^)]+\)$") | raw.rlike(r"(?i)^-\s+\[[^\]]+›\]\(https?://[^)]+\)$")
        | key.rlike(f"^({MENU_WORDS})( ({MENU_WORDS}))*$")  # a key holds no other white space and no *
    )


def is_truncated_heading(tag: Column, text: Column) -> Column:
    return tag.rlike(HEADING) & (F.length(text) >= 24) & (text.endswith("…") | text.endswith("..."))


def is_noise_table(text: Column, key: Column | None = None) -> Column:
    key = noise_key(text) if key is None else key
    return contains_any(key, ["archive.todaywebpage capture", "history priornext"]) | (key.rlike(r"(^|\s)0%(\s|$)") & key.rlike(r"(^|\s)100%(\s|$)"))


def is_noise_image(src: Column, alt: Column, caption: Column) -> Column:
    s, a, c = (F.lower(collapse(x)) for x in (src, alt, caption))
    return (s == "") | s.endswith(".svg") | s.startswith("data:image/") | F.contains(s, F.lit("/scr.png")) | contains_any(s, IMAGE_MARKERS) | a.rlike(r"^image\s*\d+") | c.rlike(r"^https?://[^/]+/?$")
