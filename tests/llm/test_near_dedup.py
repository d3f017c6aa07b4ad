"""Near-dedup against all pairs of sets: on families of copies, with buckets of every size, and on the whole of sf0.1."""

import random

import duckdb
import numpy as np
import pytest

from pagemill.llm import near_dedup


def families(seed, groups, size, shared=0):
    """Texts of 90 words with a few words changed; `shared` words are the same in all families."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(4000)]
    common = rng.choices(vocabulary, k=shared)
    for _ in range(groups):
        base = common + rng.choices(vocabulary, k=90 - shared)
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 7)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows


def expected(rows):
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("block,shingles,spread", [(1024, 1 << 21, 1024), (1024, 600, 2), (2, 100, 5)])
def test_groups_by_brute_force_for_blocks_of_any_size(spark, monkeypatch, block, shingles, spread):
    """Small bounds send buckets through second bands and dealt blocks; the components stay the same."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SHINGLES", shingles)
    monkeypatch.setattr(near_dedup, "SPREAD", spread)
    rows = families(3, 10, 14) + [(i + 1000, t) for i, t in families(4, 8, 6, shared=55)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.find_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected(rows)


def test_a_pair_with_one_shared_band_in_a_crowded_bucket_is_linked(spark):
    """Two texts at exactly 0.75 share one band only, and more than BLOCK texts that are like no other share it too."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(100_000)]
    low = lambda text: near_dedup.minima(near_dedup.shingle_set(text)).reshape(near_dedup.BANDS, near_dedup.ROWS)
    same = []
    while len(same) != 1:
        x = rng.sample(words, 109)
        mins = low(" ".join(x))
        for _ in range(500):
            y = list(x)
            for k in range(3):
                y[rng.randrange(8 + 35 * k, 30 + 35 * k)] = rng.choice(words)
            same = [b for b, eq in enumerate((low(" ".join(y)) == mins).all(axis=1)) if eq]
            if len(same) == 1:
                break
    a, b, band = " ".join(x), " ".join(y), mins[same[0]]
    # where the shingles of the shared minima are: other texts hold these words, and words of their own
    held = [k for k in range(105) if np.isin(low(" ".join(x[k : k + 5]))[same[0]], band).any()]

    def others(n):
        while n:
            text = " ".join(w for k in rng.sample(held, len(held)) for w in [*x[k : k + 5], *rng.sample(words, 2)])
            if (low(text)[same[0]] == band).all():
                n -= 1
                yield text

    family = next(others(1))
    texts = [family, *(f"{family} {w}" for w in rng.sample(words, 40)), *others(near_dedup.BLOCK + 30)]
    rows = list(enumerate(t for t in texts if (low(t)[same[0]] == band).all()))
    assert len(rows) > near_dedup.BLOCK + 50
    rows += [(9001, a), (9002, b)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.find_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9001] == got[9002] == 9001 and got == expected(rows)


def test_dealt_blocks_hold_every_pair_between_components(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(2)
    rows = [("0,5", 7, i, rng.randrange(1, 900), 1 if rng.random() < 0.6 else rng.randrange(2, 9)) for i in range(60)]
    big = spark.createDataFrame(rows, "path string, key long, id long, n long, comp long")
    blocks, seen = {}, []
    for r in near_dedup._dealt(near_dedup._sided(big)).collect():
        blocks.setdefault((r["i"], r["j"]), []).append(r)
    for group in blocks.values():
        assert len(group) < 40
        seen += [frozenset((x["id"], y["id"])) for x in group if x["left"] for y in group if y["right"] and x["comp"] != y["comp"] and (x["major"] or x["id"] < y["id"])]
    want = [frozenset((a[2], b[2])) for a in rows for b in rows if a[2] < b[2] and a[4] != b[4]]
    assert sorted(map(sorted, seen)) == sorted(map(sorted, want))


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, k) for k in range(300, 360)] + [(k, k + 1) for k in range(400, 430)]
    comp = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["id"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == c for x, c in comp.items())


def test_a_doc_id_with_several_texts_links_them(spark):
    a, b = families(5, 2, 1)
    rows = [(1, a[1]), (2, b[1]), (3, a[1]), (3, b[1]), (4, None), (None, a[1]), (5, "x y")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dedup.find_near(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 5, True)]


def test_recall_on_a_whole_table(spark):
    """All links of 10,000 documents, found from an inverted list of shingles: every component is the same (recall 1.0)."""
    d = "/root/testdata/sf0.1/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}')")
    want = dict(con.sql(f"SELECT doc_id, component_id FROM ({near_dedup.ORACLE})").fetchall())
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.find_near(spark.read.parquet(d)).collect()}
    assert len({c for i, c in want.items() if c != i}) > 300 and got == want
