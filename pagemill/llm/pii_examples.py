"""Made sentences with marked personal data, and look-alikes that are none: what the field is fitted to.

Everything is drawn from one seeded generator, so the same size and seed give the same sentences.
"""

from __future__ import annotations

import ipaddress
import random
from collections.abc import Callable

KINDS = ("email", "ip", "card", "phone")
#: Words around an item; what stands before it, by kind.
PLAIN = "the a of and we saw in for with das und der les de una por it was on to from this then people often new".split()
BEFORE = {
    "email": ["mail", "write to", "e-mail:", "contact", "Kontakt:"], "ip": ["host", "server", "from", "IP:", "gateway"], "card": ["card", "Visa", "card number", "paid with", "Karte"],
    "phone": ["call", "phone", "Tel.", "Telefon:", "mobile", "fax", "reach us at"], "none": ["order", "No.", "page", "version", "ISBN", "invoice", "in", "about", "item", "ref"],
}
NAMES, PLACES, ENDS = "jo anna max li.wei m.k sara_b jörg.müller olga-p tom99 info".split(), "example mail firma shop-24 uni corp lab".split(), "com org de net io co.uk".split()


def luhn_digit(digits: str) -> str:
    """The check digit after these digits."""
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _digits(r: random.Random, n: int, first: str = "0123456789") -> str:
    return r.choice(first) + "".join(r.choice("0123456789") for _ in range(n - 1))


def _email(r: random.Random) -> str:
    name, place, end = r.choice(NAMES), r.choice(PLACES), r.choice(ENDS)
    at, dot = r.choice(["@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", " (AT) "]), "."
    if "t" in at.lower():
        dot = r.choice([".", at.replace("at", "dot").replace("AT", "DOT")])
    return f"{name}{at}{place}{dot}{end}"


def _ip(r: random.Random) -> str:
    if r.random() < 0.4:
        return ".".join(str(r.randrange(256)) for _ in range(4))
    made = ipaddress.IPv6Address(r.getrandbits(128) & ~(((1 << 16 * r.randrange(0, 5)) - 1) << 32))
    short = f"{r.choice(['fe80', '2001:db8', 'fd00:1', 'ff02', '2a02:8108', '2001:db8:0:1'])}::{r.choice(['', f'{r.randrange(1, 65536):x}', f'{r.randrange(65536):x}:{r.randrange(1, 65536):x}'])}"
    return r.choice([made.compressed, made.exploded, made.compressed.upper(), short, "::1", f"::ffff:{r.randrange(1, 65536):x}"])


def _card(r: random.Random) -> str:
    if r.random() < 0.35:
        d = r.choice(["34", "37"]) + _digits(r, 12)
        parts = (4, 6, 5)
    else:
        d, parts = _digits(r, 15, "3456"), (4, 4, 4, 4)
    d += luhn_digit(d)
    return _grouped(d, parts, r.choice(["", " ", "-", ".", "/"]))


def _grouped(d: str, parts: tuple[int, ...], mark: str) -> str:
    out, at = [], 0
    for n in parts:
        out.append(d[at : at + n])
        at += n
    return mark.join(out)


def _phone(r: random.Random) -> str:
    area, line = _digits(r, 3, "23456789"), _digits(r, 7, "23456789")
    shapes: list[Callable[[], str]] = [
        lambda: f"+{r.randrange(1, 99)} ({area}) {line[:3]}-{line[3:]}", lambda: f"+{r.randrange(1, 99)} {area} {line}", lambda: f"({area}) {line[:3]}-{line[3:]}", lambda: f"{area}-{line[:3]}-{line[3:]}",
        lambda: f"{area}.{line[:3]}.{line[3:]}", lambda: f"0{area}/{line}", lambda: f"0{area} {line}", lambda: f"(0{area[:2]}) {line}", lambda: f"(0{area}) {line[:4]}-{line[4:]}",
        lambda: f"00{r.randrange(10, 99)} {area} {line}", lambda: f"0{area[:2]} {line[:3]} {line[3:]}", lambda: f"{area} {line[:3]} {line[3:]}",
    ]
    return r.choice(shapes)()


def _wrong_card(r: random.Random) -> str:
    d = _digits(r, 15)
    d += str((int(luhn_digit(d)) + r.randrange(1, 10)) % 10)
    return _grouped(d, (4, 4, 4, 4), r.choice(["", " ", "-"]))


def _look_alike(r: random.Random) -> str:
    n = r.randrange
    shapes: list[Callable[[], str]] = [
        lambda: str(n(1900, 2030)), lambda: str(n(1, 1000)), lambda: f"{n(1, 999)},{n(100, 999)}.{n(10, 99)}", lambda: f"{n(1, 99)}.{n(100, 999)},{n(10, 99)}", lambda: f"{n(1, 100)}%",
        lambda: f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}", lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1990, 2030)}", lambda: f"{n(1, 13)}/{n(1, 29)}/{n(90, 100)}", lambda: f"{n(0, 24)}:{n(10, 60)}", lambda: f"{n(0, 24)}:{n(10, 60)}:{n(10, 60)}",
        lambda: f"{n(0, 9)}.{n(0, 20)}", lambda: f"{n(0, 9)}.{n(0, 20)}.{n(0, 20)}", lambda: f"v{n(1, 9)}.{n(0, 9)}", lambda: ".".join(str(n(0, 30)) for _ in range(5)), lambda: f"{n(256, 999)}.{n(0, 255)}.{n(0, 255)}.{n(256, 999)}",
        lambda: f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", lambda: f"{n(0, 9)}-{n(100, 999)}-{n(10000, 99999)}-{n(0, 9)}", lambda: _wrong_card(r), lambda: _wrong_card(r), lambda: _digits(r, n(20, 30)),
        lambda: f"{n(1000, 9999)} {n(1000, 9999)}", lambda: f"@{r.choice(NAMES)}", lambda: f"+{n(1, 30)}", lambda: f"{n(1, 9)}+{n(1, 9)}", lambda: f"+{n(1, 9)} {n(10, 99)} {n(1, 9)}", lambda: "C++11",
        lambda: ":".join(f"{n(0, 256):02x}" for _ in range(6)), lambda: f"{r.getrandbits(160):040x}", lambda: f"{n(1, 90)}.{n(1000, 9999)}, {n(1, 90)}.{n(1000, 9999)}", lambda: f"{n(1, 9)}:{n(1, 9)}", lambda: f"{n(1950, 1999)}-{n(2000, 2020)}",
        lambda: " ".join(f"{r.random():.{n(1, 4)}f}" for _ in range(n(2, 7))), lambda: " ".join(f"{n(0, 40)}.{n(10, 999)}" for _ in range(n(2, 6))), lambda: " ".join(f"{n(1, 32):02d}" for _ in range(n(2, 8))),
        lambda: " ".join(str(n(1, 10 ** n(1, 7))) for _ in range(n(3, 9))), lambda: f"{n(1, 32):02d} {n(1, 13):02d} {n(1900, 2030)}", lambda: f"{n(1, 99)} {n(100, 999)} {n(100, 999)}",
        lambda: f"{n(1, 99)}-{n(100, 999)}", lambda: " ".join(str(n(0, 10)) for _ in range(n(2, 7))), lambda: " ".join(f"{n(1, 9)}{r.choice('abx')}" for _ in range(n(2, 5))), lambda: f"{n(1, 99)}a {_wrong_card(r)}", lambda: _digits(r, n(6, 13)), lambda: f"({n(1, 99)})",
        lambda: " ".join(str(n(100, 1000)) for _ in range(n(2, 5))), lambda: f"{n(1, 9)}x{n(10, 99)}", lambda: f"B{n(100, 999)}-{n(1000, 9999)}", lambda: f"§ {n(1, 99)}", lambda: f"{n(10000, 99999)} {n(1, 99)}",
    ]
    return r.choice(shapes)()


def _in_numbers(r: random.Random) -> tuple[str, str, str]:
    """A number in brackets or with a country's code, and the plain numbers on both sides."""
    area, line = _digits(r, 3, "23456789"), _digits(r, 7, "23456789")
    item = r.choice([f"({area}) {line[:3]}-{line[3:]}", f"(0{area}) {line[:4]}-{line[4:]}", f"(0{area[:2]}) {line[:3]}-{line[3:]}"])
    side = lambda: " ".join(str(r.randrange(10 ** r.randrange(1, 4))) for _ in range(r.randrange(1, 5)))
    return side() + " ", item, " " + side()


_MAKE = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "none": _look_alike}


def examples(size: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(sentence, spans) pairs: one to three items with words between; half of the items are look-alikes."""
    r, out = random.Random(seed), []
    for _ in range(size):
        text, spans = "", []
        for _ in range(r.randrange(1, 4)):
            kind = r.choice([*KINDS, *["none"] * len(KINDS)])
            words = r.choices(PLAIN, k=r.randrange(1, 5))
            cue = r.choice(BEFORE[kind]) if r.random() < 0.6 else r.choice(PLAIN)
            text += " ".join([*words, cue]) + " "
            lead, item, tail = "", _MAKE[kind](r), ""
            if kind == "phone" and r.random() < 0.2:
                lead, item, tail = _in_numbers(r)
            elif kind == "none" and r.random() < 0.1:
                # a phone's form behind a word that says what it is
                item = _phone(r).lstrip("+(").replace(")", "")
                text += r.choice(["order", "No.", "invoice", "item", "ref", "serial", "ticket"]) + " "
            text += lead
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + tail + r.choice(["", "", ".", ",", "!", " ###"]) + " "
        out.append((text + r.choice(PLAIN), spans))
    return out
