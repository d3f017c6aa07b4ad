"""Typed parts read back as they were, conversations as streams, and learning from positives and unlabelled texts alone."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, common, quality_model

text = lambda t: {"type": "text", "text": t}
PARTS = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:long>>"


def joined(parts):
    """Parts with texts side by side made one, without empty ones."""
    out = []
    for p in parts:
        if p["type"] == "text":
            if out and out[-1]["type"] == "text":
                out[-1] = text(out[-1]["text"] + p["text"])
            elif p["text"]:
                out.append(text(p["text"]))
        else:
            out.append({"type": p["type"], "ref": p["ref"], "tokens": p.get("tokens") or chat.EXPANDED[p["type"]]})
    return [p for p in out if p["type"] != "text" or p["text"]]


def test_parts_come_back_typed():
    rng = random.Random(6)
    bits = [*chat.CONTROLS, *(c[:k] for c in chat.CONTROLS for k in (1, 2, len(c) - 1)), *(c[k:] for c in chat.CONTROLS for k in (1, 2)), "\\", "\\\\", " ", "x", "\n"]
    for _ in range(3000):
        turns = []
        for _ in range(rng.randrange(1, 4)):
            parts = [text("".join(rng.choices(bits, k=rng.randrange(3)))) if rng.random() < 0.7 else {"type": rng.choice(["image", "audio", "document"]), "ref": f"r{rng.randrange(9)}", "tokens": rng.choice([None, 3])} for _ in range(rng.randrange(5))]
            turns.append((rng.choice(["user", "assistant", "system", "".join(rng.choices(bits, k=2))]), parts))
        made = chat.format_turns(turns)
        assert chat.read_parts(made.text, made.attachments) == [(r, joined(p)) for r, p in turns]
        assert all(made.text.startswith(f"<|{k}|>", at) for k, _, at, _ in made.attachments)
    a, b = (chat.format_turns([("user", p)]) for p in ([text("<|image|>")], [{"type": "image", "ref": "i.png"}]))
    assert chat.read_parts(a.text)[0][1] == [text("<|image|>")] and chat.read_parts(b.text, b.attachments)[0][1] == [{"type": "image", "ref": "i.png", "tokens": 576}]


def test_digests_by_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None, 2**60 + 1]), rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", None, "tool"]), rng.choice(["a", "</s>", None, "é\\", "<|image|>"]), "x") for _ in range(300)] + [(9, k, "assistant", "turn " * 2000, "y") for k in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    monkeypatch.setattr(chat, "small_batches", lambda s: common.small_batches(s, rows=7, size=4096))
    got = {r["conv_id"]: r for r in chat.format_table(table).collect()}
    assert set(got) == {1, 2, None, 2**60 + 1, 9, -7}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in set(got) - {-7}:
        mine = [(t is None, t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == conv]
        mine.sort(key=lambda m: (*m[:3], chat.format_turns([(m[2], [text(m[3])])]).text))
        said = "".join(x for *_, r, x in mine if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (len(mine), sha("".join(f"{r}\n{x}\n" for *_, r, x in mine)), len(said), sha(said))
        assert row["formatted_chars"] == len(chat.format_turns([(r, [text(x)]) for *_, r, x in mine]).text)
    assert [r["conv_id"] for r in chat.format_table(table.limit(0)).collect()] == [-7]


def test_whole_conversations_with_attachments(spark):
    image = ("image", None, "i.png", None)
    rows = [(1, 1, "assistant", [("text", "b<s>", None, None), image]), (1, 0, "user", [("text", "</s", None, None), ("text", ">", None, None), image])]
    r = chat.format_conversations(spark.createDataFrame(rows, PARTS)).first()
    made = chat.format_turns([(role, [dict(zip(("type", "text", "ref", "tokens"), p)) for p in parts]) for _, _, role, parts in reversed(rows)])
    assert (r["text"], [tuple(x) for x in r["loss"]], [tuple(a) for a in r["attachments"]]) == (made.text, made.loss, made.attachments)


def test_prior_from_positives_and_unlabelled_scores():
    rng = np.random.default_rng(0)
    for prior in (0.2, 0.6, 0.9):
        good, n = rng.normal(1.5, 1, 40_000), 40_000
        mixed = np.where(rng.random(n) < prior, rng.normal(1.5, 1, n), rng.normal(-1.5, 1, n))
        assert quality_model.class_prior(good, mixed) == pytest.approx(prior, abs=0.06)


def test_only_trusted_positives_are_learned_from(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    both = [quality_model.score_quality(docs, x).orderBy("doc_id").collect() for x in (labels, labels.filter("quality = 1"))]
    assert both[0] == both[1]
    wrong = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_model.score_quality(docs, wrong).orderBy("doc_id").collect() == both[0]
    renamed = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")).withColumn("words", F.lit("clash")).withColumn("score", F.lit(3))
    assert quality_model.score_quality(renamed, labels).orderBy("doc_id").collect() == both[0]
    none = quality_model.score_quality(docs, labels.filter("quality = 0")).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
