"""Host verdicts and unequal inclusion, on tables in which both decide."""

import math

import pytest
from pyspark.sql import functions as F

from pagemill.llm import common, mixing, quality_rules

GOOD = " ".join(f"word{i}" for i in range(60))
BAD = "spam " * 60


def test_host_verdicts_follow_size_and_prior(spark):
    shape = {**{f"good{i}": (40, i % 3) for i in range(120)}, "bad": (60, 45), "small": (3, 2), None: (50, 45)}
    rows, n = [], 0
    for host, (docs, fails) in shape.items():
        for k in range(docs):
            rows.append((n, BAD if k < fails else GOOD, host, "x"))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    got = quality_rules.judge(docs).collect()
    by = {r["doc_id"]: r for r in got}
    for i, text, host, _ in rows:
        assert by[i]["base_failed"] == (text == BAD)
        assert by[i]["kept"] == (text == GOOD and host != "bad"), (host, by[i])
    rate = {host: by[next(i for i, _, h, _ in rows if h == host)]["host_rate"] for host in shape}
    assert rate[None] is None and rate["bad"] > 0.6 and rate["small"] < 0.5 < 2 / 3
    left = quality_rules.keep_good(docs)
    assert left.columns == docs.columns and left.count() == sum(r["kept"] for r in got)


def test_prior_takes_chance_off_the_spread():
    """All hosts alike: binomial spread alone must leave the heaviest prior; hosts at 0 or 1 leave the lightest."""
    alike = [(10, 2 + (i % 3 - 1)) for i in range(60)]
    split = [(10, 10 * (i % 2)) for i in range(60)]
    weights = []
    for hosts in (alike, split):
        n, k = sum(a for a, _ in hosts), sum(b for _, b in hosts)
        weights.append(quality_rules.prior_weight(len(hosts), n, k, sum(b * b / a for a, b in hosts), sum(a * a for a, _ in hosts))[1])
    assert weights == [quality_rules.WEIGHTS[1], quality_rules.WEIGHTS[0]]
    # by definition: the method of moments for the beta-binomial, computed from rates
    hosts = [(20, 2), (40, 20), (10, 1), (80, 60)]
    n, k = sum(a for a, _ in hosts), sum(b for _, b in hosts)
    m = k / n
    s = sum(a * (b / a - m) ** 2 for a, b in hosts)
    rho = (s - m * (1 - m) * 3) / (m * (1 - m) * (n - sum(a * a for a, _ in hosts) / n - 3))
    mean, weight = quality_rules.prior_weight(4, n, k, sum(b * b / a for a, b in hosts), sum(a * a for a, _ in hosts))
    assert mean == pytest.approx(m) and weight == pytest.approx(1 / rho - 1)


def test_inclusion_differs_inside_a_source(spark):
    rows = [(i, " ".join(["w"] * (2 ** (i % 10) + i % 3)), "ab"[i % 20 == 0]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, per = mixing.cuts(docs)
    per = per.collect()
    for source in "ab":
        mine = sorted((r["__pm_k"], r["rate"], r["words"]) for r in per if r["source"] == source)
        target = next(r["target"] for r in per if r["source"] == source)
        assert sum(rate * words for _, rate, words in mine) == pytest.approx(target)
        free = [(k, rate) for k, rate, _ in mine if rate < mixing.MOST]
        assert all(rate / (k + mixing.FAVOUR) == pytest.approx(free[0][1] / (free[0][0] + mixing.FAVOUR)) for k, rate in free)
    plan = mixing.copies(*mixing.cuts(docs)).collect()
    by = {}
    for r in plan:
        by.setdefault((r["source"], r["__pm_k"]), []).append(r["__pm_copies"])
    for r in per:
        taken = by[r["source"], r["__pm_k"]]
        assert set(taken) <= {r["whole"], r["whole"] + 1}
        assert abs(sum(taken) / len(taken) - r["rate"]) < 5 * math.sqrt(0.25 / len(taken)) + 0.02
    assert len({round(r["p"], 6) for r in per if r["source"] == "a"}) > 3


def test_hot_keys_are_dealt(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    right = common.written(left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "right")
    plain, dealt = left.join(right, ["k"]), common.joined_hot(left, right, ["k"], "n", ["id"], hot=100)
    assert sorted(map(tuple, plain.select("id", "k", "top").collect())) == sorted(map(tuple, dealt.select("id", "k", "top").collect()))
    common.remove(right)
    with pytest.raises(Exception):
        spark.read.parquet(right.inputFiles()[0]).count()
