"""Quality scores by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; the unlabelled texts are documents without
regard to any label. The model minimises the non-negative unbiased risk
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
with the logistic loss. It is additive: each text statistic is cut at its quantiles and every bin
has a weight, so a score is a sum of column expressions and needs no Python on the executors.
The class prior is estimated from positives and unlabelled texts alone: among texts that a first model
ranks highest nearly all are positive, so the share of the unlabelled over that of the positives
above a threshold falls to the prior there; the least such ratio is taken. The logistic loss
makes the scores probabilities. Rows labelled 0 are never fitted to.

Only statistics of the text are inputs. At most SAMPLE positives and SAMPLE unlabelled documents,
chosen by hash, are used for fitting; every document is scored.

Results for odd input: null and empty texts get a score like any other; documents without label
too; labels that contradict each other make no trusted positive; a null doc_id is not held out;
without any trusted positive all scores are one half; repeated rows are scored each; an empty table
gives no rows; a very long text is counted in its row; columns with other names are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WORD, fitting_sample, text_of, written

SAMPLE, BINS, STEPS, RATE, FADE, REACH = 20_000, 12, 400, 0.1, 1e-3, 0.3
THRESHOLD, FOLDS = 0.3, 5
FEATURES = ["words", "word_length", "symbols", "bars", "cries", "upper", "digits", "distinct", "lines", "stops", "others"]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its text. Characters are counted per word, so length matters little."""
    t = F.col("t")
    df = docs.select("doc_id", text_of().alias("t"))
    df = df.select("doc_id", "t", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"))
    per = F.greatest(F.size("w"), F.lit(1)).cast("double")
    only = lambda chars: (F.length(F.regexp_replace(t, f"[^{chars}]+", "")) / per)
    return df.select(
        "doc_id", F.log1p(F.size("w").cast("double")).alias("words"), (F.length(F.array_join("w", "")) / per).alias("word_length"),
        only("#*$%&<>{}=~^").alias("symbols"), only("|").alias("bars"), only("!?").alias("cries"), only("A-Z").alias("upper"), only("0-9").alias("digits"),
        (F.size(F.array_distinct("w")) / per).alias("distinct"), only(r"\n").alias("lines"), only(".,;").alias("stops"), only(r"@/+_\[\]\\").alias("others"),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def minimise(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the non-negative risk's minimum, by Adam on one-hot rows (a bias is the last weight)."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    up = lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, STEPS + 1):
        fp, fu = p @ w, u @ w
        gain = prior * p.T @ (up(fp) - 1) / len(p)
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        grad = u.T @ up(fu) / len(u) - prior * p.T @ up(fp) / len(p)
        g = (gain + grad if rest >= 0 else -grad) + FADE * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def class_prior(fp: np.ndarray, fu: np.ndarray) -> float:
    """Of scores of positives and of unlabelled texts: the least ratio of the shares above a threshold, over thresholds that at least REACH of the positives pass."""
    cut = np.quantile(fp, np.linspace(0.0, 1 - REACH, 40))
    return float(np.clip(min((fu >= t).mean() / (fp >= t).mean() for t in cut), 0.02, 0.98))


def fit(stats: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """(cuts per feature, bin weights per feature, bias)."""
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality")).filter("doc_id is not null and quality is not null")
    known = written(known.filter("quality = 1").select("doc_id"), "known")
    train = stats.filter(~held_out(F.col("doc_id")))
    trusted = fitting_sample(known, known.count(), SAMPLE, 5).select("doc_id")
    p = train.join(trusted, "doc_id", "left_semi").select(*FEATURES).limit(SAMPLE).toPandas().to_numpy(float)
    if not len(p):
        return [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), 0.0
    u = fitting_sample(train, stats.count(), SAMPLE, 5).select(*FEATURES).toPandas().to_numpy(float)
    cuts = [np.unique(np.quantile(u[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(len(FEATURES))]
    cuts = [np.unique(np.r_[c, np.quantile(u[:, k], [0.02, 0.05, 0.95, 0.98])]) for k, c in enumerate(cuts)]
    hot = lambda x: np.hstack([np.eye(len(c) + 1)[np.searchsorted(c, x[:, k], side="left")] for k, c in enumerate(cuts)])
    p, u = hot(p), hot(u)
    first = minimise(p, u, 0.5)
    w = minimise(p, u, class_prior(p @ first[:-1], u @ first[:-1]))
    weights, at = [], 0
    for c in cuts:
        weights.append(w[at : at + len(c) + 1])
        at += len(c) + 1
    return cuts, weights, float(w[-1])


def score(cuts: list[np.ndarray], weights: list[np.ndarray], bias: float) -> Column:
    total = F.lit(bias)
    for name, c, w in zip(FEATURES, cuts, weights, strict=True):
        x, part = F.col(name), None
        for edge, value in zip(c, w, strict=False):
            part = F.when(x <= float(edge), float(value)) if part is None else part.when(x <= float(edge), float(value))
        total = total + (part.otherwise(float(w[-1])) if part is not None else F.lit(float(w[-1])))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    stats = written(statistics(docs), "statistics")
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(*fit(stats, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
