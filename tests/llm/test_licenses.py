"""Whole licence texts and wrapped statements, against a plain walk over words, at any length and with odd rows."""

import hashlib
import os
import random
import re
import time

import pytest
from llm.test_corpus import APACHE, BSD2, LGPL

from pagemill.llm import licenses
from pagemill.llm.license_texts import DIGESTS, SPANS

SCHEMA = "doc_id long, text string"


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert len(rows) == len(texts) and all(r["n_licenses"] == len([x for x in r["licenses"].split(",") if x]) for r in rows)
    return [r["licenses"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def words_of(text):
    text = text.lower()
    for pattern, word in licenses.SPELLINGS:
        text = re.sub(pattern.replace("\\x{a9}", "\xa9"), word, text)
    text = re.sub("[^a-z0-9]+", " ", text).strip()
    for parted, word in licenses.WRAPPED_SPELLINGS:
        text = text.replace(parted, word)
    return text


def walked(text):
    """Licences of the spans that begin at any opening and end with the next closing phrase."""
    text, names, by = words_of(text), set(), {}
    for name, digest in DIGESTS:
        by.setdefault(digest, set()).add(name)
    for first, last in SPANS:
        for m in re.finditer(f"(?<![a-z0-9]){first}", text):
            end = text.find(last, m.end())
            if end >= 0:
                names |= by.get(hashlib.sha256(text[m.start() : end + len(last)].encode()).hexdigest(), set())
    return names


def test_whole_texts_equal_a_plain_walk(spark):
    r = random.Random(7)
    phrases = [p for span in SPANS for p in span]
    texts = []
    for _ in range(60):
        parts = [r.choice([APACHE, BSD2, LGPL, BSD2.replace("LOSS OF USE", "LOSS"), *r.sample(phrases, 3)]) for _ in range(r.randint(1, 6))]
        texts.append(r.choice([" ", "\n\n", "\n# "]).join(p.replace(" ", r.choice([" ", "\n", "  ", "\n * "])) for p in parts))
    got = found(spark, texts)
    assert [set(g.split(",")) - {""} >= walked(t) for g, t in zip(got, texts, strict=True)] == [True] * len(texts)
    statements = {name for name, _ in licenses.KNOWN}
    assert all((set(g.split(",")) - {""}) - walked(t) <= statements for g, t in zip(got, texts, strict=True))
    assert sum(bool(walked(t)) for t in texts) > 30


def test_no_length_loses_a_text(spark):
    spread = lambda text, gap: text.replace(" ", "\n" + gap)
    wide = "#" + " " * 9000
    texts = [spread(APACHE, wide), spread(BSD2, wide), spread(LGPL, wide), spread("Released under the MIT License.", wide), "x " * 300_000 + LGPL + " y" * 300_000]
    assert found(spark, texts) == ["Apache-2.0", "BSD-2-Clause", "LGPL-2.1-or-later", "MIT", "LGPL-2.1-or-later"]
    path = "/usr/share/common-licenses/GPL-3"
    if os.path.exists(path):
        assert found(spark, [spread(open(path).read().split("How to Apply These")[0], "//" + " " * 40)]) == ["GPL-3.0"]


def test_repeated_openings_stay_cheap(spark):
    opening, last = SPANS[5]
    texts = [f"{opening} " * 30_000 + last, "released under " * 60_000 + "the MIT License.", (f"{opening} " * 500 + f"{last} ") * 30]
    began = time.time()
    assert found(spark, texts) == ["", "MIT", ""]
    assert time.time() - began < 60


def test_an_opening_counts_from_its_nearest_and_any_place(spark):
    texts = [
        "Licensed under what? Released under the MIT License.",
        "licensed under, or rather released under\nthe MIT License. And so on",
        "So released under\nthe MIT License",
        "unreleased under\nthe MIT License.",
        "Redistribution and use in source and binary forms. " + BSD2,
    ]
    assert found(spark, texts) == ["MIT", "MIT", "", "", "BSD-2-Clause"]


@pytest.mark.parametrize("parts", [1, 3])
def test_odd_rows(spark, parts):
    mit, rows = "Released under the MIT License.", []
    rows = [(None, mit, "a"), (None, None, "b"), (1, "", None), (1, mit, None), (2, mit, "c"), (2, mit, "c"), (3, "License. " * 50_000 + mit, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string").repartition(parts)
    got = licenses.scan(docs)
    assert got.columns == ["doc_id", "licenses", "n_licenses"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, "MIT", 1), (None, "", 0), (1, "", 0), (1, "MIT", 1), (2, "MIT", 1), (2, "MIT", 1), (3, "MIT", 1)], key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0
