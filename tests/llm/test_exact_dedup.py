"""Block names under colliding handles, hot groups, and which row of a group stays."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import common, exact_dedup


def table(spark, seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, rng.randrange(20), None]), rng.choice(["", "ab", "hot"]) + "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 2, 9, 30]))), f"x{i}", i) for i in range(n)]
    rows += [(1000 + i, " h o t " * 4, "same", i) for i in range(150)] + [(7, None, "n", 1), (7, None, "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, raw long"), rows


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[norm])
        out.append((doc_id, best[3], len(groups[norm]), doc_id == best[3] and len(text or "") == -best[0], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("handles", ["as they are", "colliding"])
def test_groups_by_brute_force(spark, monkeypatch, handles):
    monkeypatch.setattr(exact_dedup, "BLOCK", 3)
    monkeypatch.setattr(exact_dedup, "joined_hot", lambda *a: common.joined_hot(*a, hot=10))
    if handles == "colliding":  # then names are found by the block texts
        monkeypatch.setattr(exact_dedup, "_handle", lambda b: F.struct((F.length(b) % 2).cast("long").alias("k1"), F.lit(1).cast("long").alias("k2")))
    docs, rows = table(spark, 4)
    assert sorted(map(tuple, exact_dedup.find_copies(docs).collect()), key=repr) == expected(rows)


def test_one_row_of_each_group_stays(spark):
    for seed in (5, 6):
        docs, rows = table(spark, seed, 120)
        left = exact_dedup.drop_copies(docs)
        assert left.columns == docs.columns
        got = left.collect()
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        assert sorted(norm(r["text"]) for r in got) == sorted({norm(t) for _, t, *_ in rows})
        best = {sha: (keep, kept) for _, keep, _, kept, sha in expected(rows)}
        for r in got:
            assert r["doc_id"] == best[hashlib.sha256(norm(r["text"]).encode()).hexdigest()][0]
            assert tuple(r) in rows
