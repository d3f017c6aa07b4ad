"""Phrases, manifests and line dedup: brute force, forced cuts and rounds, odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pagemill.llm import collocations, line_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, key int"


def frame(spark, rows):
    """Rows of (doc_id, text, lang), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, "s", None if t is None else len(t), "x", 7) for i, t, g in rows], SCHEMA)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


# --- phrases


def phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        ranked = []
        for p, a in often.items():
            if 100 * held[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def texts(seed, many=300):
    rng = random.Random(seed)
    words = ["the", "of", "Café", "x y", "a\x1cb", "red", "fox", "Über", "new", "york"]
    weights = [30, 12, 3, 2, 1, 5, 5, 1, 8, 8]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 40))) + rng.choice(["", ".", ", the end", "\nnew\tyork"]), rng.choice(["en", "en", "en", "de", None, "und"])) for i in range(many)]
    return rows + [(900, None, "en"), (901, "", None), (None, "the of the of", "en"), (902, "New York " * 500, "de"), (902, "New York " * 500, "de"), (903, " \t ", "fr")]


@pytest.mark.parametrize("sizes", [{}, {"budget": 40, "fan": 3, "chunk": 700}, {"budget": 5, "fan": 2, "chunk": 100}])
def test_phrases_against_brute_force(spark, sizes):
    """The small sizes cut groups by two, three and four words, and long texts into slices."""
    rows = texts(3)
    got = collocations.collocations(frame(spark, rows), least=6, top=25, **sizes).collect()
    assert sorted(tuple(r) for r in got) == phrases(rows, 6, 25)


def test_phrases_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, " ", "en"), (3, "a b", "en")])).count() == 0


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits: 2000000 * a / (l + r) with counts near 2**62."""
    df = spark.sql("select cast(4611686018427387904 as long) a, cast(4611686018427387905 as long) l, cast(4611686018427387909 as long) r")
    wide = "cast({} as decimal(19,0))"
    assert df.selectExpr(f"(cast(2000000 as decimal(7,0)) * {wide.format('a')}) div ({wide.format('l')} + {wide.format('r')})").first()[0] == 2000000 * 2**62 // (2**63 + 6)


# --- manifests


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n = row
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(map(show, (doc_id, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def proof(tree, at):
    steps = []
    for level in tree[:-1]:
        first = at // 8 * 8
        steps.append((at - first, level[first:at] + level[at + 1 : first + 8]))
        at //= 8
    return steps


def manifest(rows):
    by = defaultdict(list)
    for i, t, g in rows:
        row = (i, t, g, "s", None if t is None else len(t))
        by[g].append((i is not None, i or 0, leaf(row), row))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    top, out = levels([trees[g][-1][0] for g in langs]), []
    for k, g in enumerate(langs):
        for at, (_, _, own, row) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            steps = proof(trees[g], at) + proof(top, k)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            now = leaf((row[0], row[1] and lower(row[1]), *row[2:])) if hit else own
            for place, others in steps:
                now = h([*others[:place], now, *others[place:]])
            out.append((row[0], own, trees[g][-1][0], top[-1][0], h(x for _, o in steps for x in o), now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_against_brute_force(spark, height):
    """Height 1 makes up to 88 partitions a tree: three rounds, ragged at every level."""
    rng = random.Random(height)
    langs = ["en"] * 20 + ["de"] * 3 + [None, "v", "", "fr"]
    rows = [(i, None if i % 7 == 0 else rng.choice(["Text", "TEXT é", "", "low"]) * (i % 5), rng.choice(langs)) for i in range(900)]
    rows += [(5000, "alone", "zz"), (None, "No id", "en"), (None, None, None), (7000, "Twice", "de"), (7000, "Twice", "de"), (7001, "A" * 200_000, "de")]
    got = merkle.manifest(frame(spark, rows), height).collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifest(rows)


@pytest.mark.parametrize("n", [1, 8, 9, 63, 64, 65, 73])
def test_manifest_of_one_tree(spark, n):
    rows = [(i, f"Row {i}", "en") for i in range(n)]
    assert sorted((tuple(r) for r in merkle.manifest(frame(spark, rows), 1).collect()), key=repr) == manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0


# --- lines


def lines(rows, min_key=20, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            holders[lower(x.strip(strip))].add(i)
    best = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(k) >= min_key and len(v) >= min_docs}
    out = []
    for i, t, _ in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if best.get(lower(x.strip(strip)), i) == i]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows(seed):
    rng = random.Random(seed)
    some = ["A line that many documents share with others", "  a LINE that many documents share with others\t", "Größe und Länge einer ganzen Zeile", "gRößE und länge einer ganzen zeile ", "short", "", "exactly twenty chars", "only nineteen chars", " no break space is no white space"]
    rows = [(i, "\n".join(rng.choice(some) if rng.random() < 0.6 else f"own line number {rng.randrange(400)} of all" for _ in range(rng.randrange(1, 12))), "en") for i in range(250)]
    long = "\n".join(rng.choice([some[0], f"long document line {k:09d}"]) for k in range(5000))
    return rows + [(1000, None, None), (1001, "", "en"), (None, some[0] + "\n" + some[6], "en"), (1002, rows[3][1], "en"), (1002, rows[3][1], "en"), (1002, some[0] + "\nx", "en"), (1003, long, "de"), (-5, "\n\n" + some[0], "en")]


@pytest.mark.parametrize("slices", [0, 1])
def test_lines_against_brute_force(spark, monkeypatch, slices):
    """With every row in the sample the shared lines are dealt in slices; without, each is one group."""
    monkeypatch.setattr(line_dedup, "SAMPLE", 1 if slices else 1 << 40)
    rows = line_rows(slices)
    assert sorted((tuple(r) for r in line_dedup.digest_lines(frame(spark, rows)).collect()), key=repr) == lines(rows)


def test_bitmaps_and_texts(spark):
    shared = "this line stands in every document"
    rows = [(1, f"{shared}\nmine", "en"), (2, "\n".join([*map(str, range(130)), shared]), "en"), (3, f"last\n{shared}\n{shared}", "en"), (4, None, "en")]
    docs = frame(spark, rows)
    maps = {r["doc_id"]: (r["n_dropped"], [(w["word"], w["bits"]) for w in r["keep"]]) for r in line_dedup.line_bitmaps(docs).collect()}
    assert maps == {1: (1, [(0, ~1)]), 2: (1, [(2, ~4)])}
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs).collect()}
    assert left == {1: "mine", 2: "\n".join(map(str, range(130))), 3: rows[2][1], 4: None}
    assert line_dedup.drop_lines(docs).columns == docs.columns


def test_lines_of_nothing(spark):
    assert line_dedup.digest_lines(frame(spark, [])).count() == 0
