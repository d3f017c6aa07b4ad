"""Personal data by patterns and a semi-Markov conditional random field.

Base spans come from four patterns (email, ip, card, phone) with their checks. The field finds what
these miss: national phone numbers, cards of 15 digits or with other separators, written-out or
spaced e-mail addresses, addresses of IP version 6. It looks at runs of chunks of non-white-space
text that hold a digit, `@`, `+` or a written `(at)` or `[dot]`, with the chunks beside the latter. A
segment is up to LONGEST such chunks in a row, scored by features of the whole span (shape, groups
of digits, checks), of the whole word before it, of numbers on both sides, and by the type before. Only segments
that could be personal data have a type: with an @ or its written form, of 7 to 19 digits and number
marks, or one chunk in the form of an IP address. One dynamic program per run chooses boundaries and
types together; its spans are added where they touch no base span.

The field is trained by maximum likelihood on EXAMPLES made sentences with marked personal data and
look-alikes (dates, versions, prices, book and order numbers, card numbers with a wrong check digit);
see `pii_examples`. It reads nothing of the corpus, so a text's spans depend on that text alone.

Results for odd input: null text is empty and has no spans; a null doc_id is kept; repeated rows are
each returned; an empty table gives no rows; other columns are ignored. A run is decoded whole: a
chunk that no typed segment can hold is other, so the program runs between such chunks only, with the
scores of LONGEST chunks at a time and ten bytes a chunk for the way back.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import small_batches, text_of, written
from pagemill.llm.pii_examples import KINDS, examples

EXAMPLES, LONGEST, STEPS, RATE, FADE = 1200, 6, 60, 0.5, 1e-3
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
_WRITTEN = re.compile(r"[(\[{](?:at|dot)[)\]}]", re.IGNORECASE)
_TRIGGER = re.compile(r"[0-9@+]|" + _WRITTEN.pattern, re.IGNORECASE)
#: Chunks that need their neighbours: a bare @ or a written one.
_JOINER = re.compile(r"@|" + _WRITTEN.pattern, re.IGNORECASE)
_NUMBER = set("+0123456789 -()./")
_TRIM = "\"'.,;:!?()[]{}<>*#$%&|"
_MAIL = re.compile(r"[^\W_][\w.%+-]*@[^\W_][\w-]*(?:\.[\w-]+)+")
_DATE = re.compile(r"(?:[0-9]{1,4}([./-])[0-9]{1,2}\1[0-9]{2,4})|(?:[12][0-9]{3}[-/][12][0-9]{3})")
_TIME = re.compile(r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?")
_AMOUNT = re.compile(r"[0-9]{1,3}(?:([.,])[0-9]{3})+(?:(?!\1)[.,][0-9]+)?|[0-9]+[.,][0-9]+|[0-9]+")
#: Words before a number that tell its kind.
CUES = [
    re.compile("tel|phone|call|fax|mobil|handy|cell|whatsapp|ring|anruf|dial|reach", re.IGNORECASE), re.compile("card|visa|master|amex|karte|carte|tarjeta|credit|pay", re.IGNORECASE),
    re.compile("mail|write|contact|kontakt", re.IGNORECASE), re.compile("ip|host|server|address|router|gateway|dns|ping", re.IGNORECASE),
    re.compile("no|nr|num|order|isbn|version|page|seite|ref|id|invoice|item|serial|ticket|part|code|model|volume|art", re.IGNORECASE),
]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the patterns, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of chunks that hold a trigger or stand beside a lone or written @, ends trimmed of punctuation."""
    out: list[list[tuple[int, int]]] = []
    chunks, last, last_joins, at = [], -2, False, -1
    for m in _CHUNK.finditer(text):
        at += 1
        s = m[0]
        joins = bool(_JOINER.fullmatch(s))
        if joins or last_joins or _TRIGGER.search(s):
            if joins and last != at - 1 and chunks:
                last = _put(out, text, *chunks[-1], at - 1, last)
            last = _put(out, text, *m.span(), at, last)
        last_joins, chunks = joins, [m.span()]
    return out


def _put(out: list, text: str, a: int, b: int, at: int, last: int) -> int:
    """Adds the chunk number `at`, text[a:b], to the last run or to a new one; the number of the last chunk that is in one."""
    if not _JOINER.fullmatch(text, a, b):
        s = text[a:b]
        left = len(s) - len(s.lstrip(_TRIM))
        if left and s[left - 1] == "(" and ")" in s:
            left -= 1
        right = len(s) - len(s.rstrip(_TRIM))
        if "::" in s:  # a short address may begin or end with it
            left -= 2 * (s[max(0, left - 2) : left] == "::")
            right -= 2 * (s[len(s) - right :][:2] == "::")
        a, b = a + left, b - right
    if a < b:
        if last != at - 1:
            out.append([])
        out[-1].append((a, b))
        return at
    return last


def _version_6(s: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def features(span: str, before: str, left: bool = False, right: bool = False) -> list[float]:
    """Whole-span features, which only complete spans show, and what the word before and plain numbers on either side tell."""
    d = digits_of(span)
    n, groups = len(d), [len(g) for g in re.findall("[0-9]+", span)]
    mail = re.sub(r"\s*" + _WRITTEN.pattern + r"\s*", lambda m: "@" if "at" in m[0].lower() else ".", span, flags=re.IGNORECASE) if _WRITTEN.search(span) else span
    mail, parts = re.sub(r"\s*@\s*", "@", mail), span.split(".")
    letters, number = any(c.isalpha() for c in span), set(span) <= _NUMBER
    whole = number and (n < 2 or luhn(d))
    quad = len(parts) == 4 and all(0 < len(p) <= 3 and p.isdigit() and p.isascii() for p in parts)
    marks = set(span) - set("0123456789")
    cards = groups in ([4, 4, 4, 4], [4, 4, 4, 4, 3], [4, 6, 5]) or len(groups) == 1
    cues = [bool(c.search(before)) for c in CUES]
    looks = bool(_DATE.fullmatch(span) or _TIME.fullmatch(span) or _AMOUNT.fullmatch(span))
    book = n in (10, 13) and len(groups) >= 4 and (n == 10 or d[:3] in ("978", "979"))
    listed = any(_AMOUNT.fullmatch(x) and not x.isdigit() for x in span.split()) and " " in span
    # a trunk prefix, or the groups of a national number; what follows are no single digits
    lead = span[0] in "0(" and len(groups) in (2, 3) and min(groups[1:]) >= 3 and 2 <= groups[0] <= 5
    bare = groups in ([3, 3, 4], [3, 4], [4, 7], [4, 6], [4, 3, 4])
    local = number and not book and not looks and not listed and 7 <= n <= 12 and (lead or bare)
    beside = left or right
    flags = [
        True, bool(_MAIL.fullmatch(mail)), "@" in mail and not _MAIL.fullmatch(mail), letters and "@" not in mail, bool(re.search(r"\s", mail)) and letters,
        quad and all(int(p) <= 255 for p in parts), quad, span.count(":") >= 2 and _version_6(span), span.count(":") >= 2 and not _version_6(span),
        16 <= n <= 19 and whole, n == 15 and whole and d[:2] in ("34", "37"), 13 <= n <= 19 and not whole, 13 <= n <= 19 and cards, 13 <= n <= 19 and len(marks) <= 1, 13 <= n <= 19,
        span[0] == "+" and number and 8 <= n <= 15, span[0] == "+" and not 8 <= n <= 15, local, local and cues[0], local and cues[4], local and not cues[4] and not beside, local and lead and "(" in span, local and beside and "(" not in span, number and 8 <= n <= 15 and span[:2] == "00" and not listed, looks, listed, book, n > 19, n < 7, n == 0,
        span.count("(") != span.count(")"), bool(re.search(r"[,;:!?][\s]|[.]\s", span)), number and " " in span, len(groups) > 5, number, left, right, number and min(groups, default=9) == 1 and span[0] != "+", *cues,
    ]
    return list(map(float, flags))


WIDTH = len(features("x", ""))


def _shapes(text: str, run: list[tuple[int, int]]) -> list[tuple[int, bool, bool, bool]]:
    """Of each chunk: digits, whether it is a number with its marks, has an @ in any form, looks like an IP address."""
    out = []
    for a, b in run:
        s = text[a:b]
        out.append((len(digits_of(s)), set(s) <= _NUMBER, "@" in s or bool(_WRITTEN.search(s)), s.count(":") >= 2 or s.count(".") == 3))
    return out


def _widths(text: str, run: list[tuple[int, int]], shapes: list, i: int) -> list[int]:
    """The lengths, in chunks, of the segments from chunk i that could have a type."""
    out, digits, number, mail = [], 0, True, False
    for w in range(min(LONGEST, len(run) - i)):
        n, is_number, has_mail, address = shapes[i + w]
        digits, number, mail = digits + n, number and is_number, mail or has_mail
        if mail or (w == 0 and address) or (number and 7 <= digits <= 19 and set(text[run[i][0] : run[i + w][1]]) <= _NUMBER):
            out.append(w + 1)
        elif not number or digits > 19:
            # only a later @ could still help, and it needs its neighbours alone
            if not any(shapes[j][2] for j in range(i + w + 1, min(i + LONGEST, len(run)))):
                break
    return out


def _word_before(text: str, a: int) -> str:
    end = len(text[:a].rstrip()) if a and text[a - 1].isspace() and text[max(0, a - 2) : a].isspace() else a - 1 if a and text[a - 1].isspace() else a
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:end]


def _plain(text: str, run: list[tuple[int, int]], i: int) -> bool:
    return 0 <= i < len(run) and text[run[i][0] : run[i][1]].replace(".", "").isdigit()


def _row(text: str, run: list[tuple[int, int]], i: int, w: int, before: str, left: bool) -> list[float]:
    return features(text[run[i][0] : run[i + w - 1][1]], before, left, _plain(text, run, i + w))


#: Scores kept for number spans of one run; beyond that they are made anew.
KEPT = 50_000
_SHAPE = str.maketrans("123456789", "0" * 9)


def _number_key(span: str) -> tuple | None:
    """What features() sees of a span of digits and number marks: equal keys have equal features. None for other spans."""
    if not set(span) <= _NUMBER or span.count(".") >= 3:
        return None
    d = digits_of(span)
    return span.translate(_SHAPE), span[0] == "0", span[:2] == "00", d[:3] in ("978", "979"), d[:2] in ("34", "37"), len(d) >= 13 and luhn(d), bool(_DATE.fullmatch(span))


def span_features(text: str, run: list[tuple[int, int]]) -> np.ndarray:
    """[start, chunks - 1] -> features; zeros beyond the run's end and where a segment can have no type."""
    out, shapes = np.zeros((len(run), LONGEST, WIDTH)), _shapes(text, run)
    for i, (a, _) in enumerate(run):
        before, left = _word_before(text, a), _plain(text, run, i - 1)
        for w in _widths(text, run, shapes, i):
            out[i, w - 1] = _row(text, run, i, w, before, left)
    return out


def scores_of(x: np.ndarray, weights: dict) -> np.ndarray:
    """[..., start, chunks - 1, type] of span_features; type 0 is other, single chunks only, and scores nothing."""
    n = x.shape[-3]
    typed = np.where(x[..., :1] > 0, x @ weights["span"].T, -np.inf)
    out = np.concatenate([np.zeros((*x.shape[:-1], 1)), typed], axis=-1)
    out[..., 1:, 0] = -np.inf
    out[..., np.arange(n)[:, None] + np.arange(LONGEST) >= n, :] = -np.inf
    return out


def decode(text: str, run: list[tuple[int, int]], weights: dict) -> list[tuple[str, int, int]]:
    """The best segmentation of a run: boundaries and types together."""
    out, shapes, i, n, known = [], _shapes(text, run), 0, len(run), {}
    widths = [_widths(text, run, shapes, k) for k in range(n)]
    while i < n:
        end = j = i
        while j < n and (widths[j] or j < end):
            end = max(end, j + max(widths[j], default=1))
            j += 1
        if j > i:
            out += _island(text, run, i, j, widths, weights, known)
        i = j + 1
    return out


def _island(text: str, run: list[tuple[int, int]], first: int, last: int, widths: list[list[int]], weights: dict, known: dict) -> list[tuple[str, int, int]]:
    """The best cut of the chunks from first to last, before and behind which all is other."""
    k, span, step = len(KINDS) + 1, weights["span"], weights["next"].tolist()
    n, types = last - first, range(len(KINDS) + 1)
    best = {0: [0.0] + [-np.inf] * (k - 1)}
    back = np.zeros((n + 1, k, 2), np.int8)
    for i in range(n):
        now = best.pop(i)
        into = [max((now[p] + step[p][y], -p) for p in types) for y in types]
        at = best.setdefault(i + 1, [-np.inf] * k)
        if into[0][0] > at[0]:
            at[0], back[i + 1, 0] = into[0][0], (1, -into[0][1])
        if widths[first + i]:
            before, left = _word_before(text, run[first + i][0]), _plain(text, run, first + i - 1)
            told = tuple(bool(c.search(before)) for c in CUES)
        for w in widths[first + i]:
            at = best.setdefault(i + w, [-np.inf] * k)
            key = _number_key(text[run[first + i][0] : run[first + i + w - 1][1]])
            key = key and (key, told, left, _plain(text, run, first + i + w))
            if key is None or (scores := known.get(key)) is None:
                scores = (span @ np.array(_row(text, run, first + i, w, before, left))).tolist()
                if key and len(known) < KEPT:
                    known[key] = scores
            for y, score in enumerate(scores, 1):
                if into[y][0] + score > at[y]:
                    at[y], back[i + w, y] = into[y][0] + score, (w, -into[y][1])
    final = best[n] if last == len(run) else [v + step[y][0] for y, v in enumerate(best[n])]
    out, j, y = [], n, max(types, key=lambda y: final[y])
    while j:
        w, before = map(int, back[j, y])
        if y:
            out.append((KINDS[y - 1], run[first + j - w][0], run[first + j - 1][1]))
        j, y = j - w, before
    return out[::-1]


def cut_of(run, spans) -> list[tuple[int, int, int]] | None:
    """The run cut as the marked spans have it: (start, end, type) in chunks; None where a span doesn't fill chunks."""
    starts, ends = {a: i for i, (a, _) in enumerate(run)}, {b: i + 1 for i, (_, b) in enumerate(run)}
    cut = {}
    for kind, a, b in spans:
        if a < run[-1][1] and b > run[0][0]:
            if a not in starts or b not in ends or ends[b] - starts[a] > LONGEST:
                return None
            cut[starts[a]] = (starts[a], ends[b], KINDS.index(kind) + 1)
    out, i = [], 0
    while i < len(run):
        out.append(cut.get(i, (i, i + 1, 0)))
        i = out[-1][1]
    return out


def _sums(a: np.ndarray, axis) -> np.ndarray:
    """log of the sum of exponentials, with nothing (-inf) for an empty sum."""
    top = np.maximum(a.max(axis=axis, keepdims=True), -1e300)
    with np.errstate(divide="ignore"):
        return np.squeeze(np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top, axis)


def expected(x: np.ndarray, sizes: np.ndarray, weights: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the sum over all segmentations, expected span features by type, expected steps) of runs padded to one length."""
    many, n, k = len(x), x.shape[1], len(KINDS) + 1
    scores = scores_of(x, weights)
    scores[(np.arange(n)[:, None] + np.arange(LONGEST))[None] >= sizes[:, None, None]] = -np.inf
    fore, into = np.full((many, n + 1, k), -np.inf), np.full((many, n, k), -np.inf)
    fore[:, 0, 0] = 0.0
    for j in range(n + 1):
        if j:
            fore[:, j] = _sums(np.stack([into[:, i] + scores[:, i, j - i - 1] for i in range(max(0, j - LONGEST), j)]), 0)
        if j < n:
            into[:, j] = _sums(fore[:, j, :, None] + weights["next"], 1)
    aft, on = np.full((many, n + 1, k), -np.inf), np.full((many, n, LONGEST, k), -np.inf)
    aft[np.arange(many), sizes] = 0.0
    for i in range(n - 1, -1, -1):
        for w in range(min(LONGEST, n - i)):
            on[:, i, w] = scores[:, i, w] + aft[:, i + w + 1]
        back = _sums(_sums(on[:, i], 1)[:, None, :] + weights["next"], 2)
        aft[:, i] = np.where((sizes == i)[:, None], 0.0, back)
    total = _sums(fore[np.arange(many), sizes], 1)
    p = np.exp(into[:, :, None] + on - total[:, None, None, None])
    steps = np.exp(fore[:, :n, :, None] + weights["next"] + _sums(on, 2)[:, :, None, :] - total[:, None, None, None])
    return total, np.einsum("bnlk,bnlf->kf", p[..., 1:], x), steps.sum(axis=(0, 1))


def train(marked: list[tuple[str, list[tuple[str, int, int]]]]) -> dict:
    """Weights by gradient ascent on the mean log-likelihood of all runs of texts with marked spans."""
    fit = [(span_features(t, r), g) for t, spans in marked for r in runs(t) if (g := cut_of(r, spans))]
    weights = {"span": np.zeros((len(KINDS), WIDTH)), "next": np.zeros((len(KINDS) + 1, len(KINDS) + 1))}
    weights["span"][:, 0] = -1.0
    if not fit:
        return weights
    sizes = np.array([len(x) for x, _ in fit])
    x = np.zeros((len(fit), sizes.max(), LONGEST, WIDTH))
    seen = {k: np.zeros_like(v) for k, v in weights.items()}
    for r, (own, gold) in enumerate(fit):
        x[r, : len(own)] = own
        before = 0
        for i, j, y in gold:
            seen["next"][before, y] += 1
            if y:
                seen["span"][y - 1] += own[i, j - i - 1]
            before = y
    scale = {k: np.full(v.shape, 1e-8) for k, v in weights.items()}
    for _ in range(STEPS):
        _, spans, steps = expected(x, sizes, weights)
        for k, v in weights.items():
            g = (seen[k] - (spans if k == "span" else steps)) / len(fit) - FADE * v
            scale[k] += g * g
            v += RATE * g / np.sqrt(scale[k])
    return weights


@cache
def trained(size: int = EXAMPLES, seed: int = 1) -> dict:
    """The field fitted to made examples; the same on every call."""
    return train(examples(size, seed))


def spans_of(text: str, weights: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans): the field's spans are added where no base span is touched."""
    base = base_spans(text)
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    touched = lambda a, b: (k := bisect_left(starts, b)) > 0 and ends[k - 1] > a
    extra = []
    for run in runs(text):
        if not all(touched(*c) for c in run):
            extra += [x for x in decode(text, run, weights) if not touched(x[1], x[2])]
    both = sorted(base + extra, key=lambda x: (KINDS.index(x[0]), x[1]))
    return base, both


_RESULT = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def _scan(weights: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            out = [spans_of(text, weights) for text in batch["t"].to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in out], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(show(base).encode()).hexdigest() for base, _ in out], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, sha, pa.array([show(both) for _, both in out], pa.string())], _RESULT)

    return run


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest and all spans: one row per input row."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    with small_batches(docs.sparkSession):
        return written(read.mapInArrow(_scan(trained()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"), "private")
