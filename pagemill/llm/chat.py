"""Chat formatting with typed content parts.

A turn holds parts (text, image, audio, document). A visitor flattens them in order: texts are
escaped, every other part becomes a placeholder, its reference is recorded with the place and the
number of tokens it expands to. Texts side by side are joined before they are escaped, so no control
string of the template occurs inside texts, nor across two of them: a backslash is put after its
first character (backslashes are doubled), which `unescape` undoes. `read_parts` gives the typed
parts back: a placeholder that a text spells out stays text.
The loss mask is a list of code-point ranges over the formatted text: assistant texts only.

Turns are formatted one by one, where they are. A conversation's pieces are then read by one task
in the order of its turns, as a stream: its size costs time and sorting, not memory. Only
`format_conversations` makes one row of a conversation.

Results for odd input: turns are ordered by turn, then role and text, null turns last; a null role
or text is empty; repeated rows are repeated turns; a null conv_id is a conversation of its own; an
empty table gives conversation -7 alone; long texts go through in batches of a few megabytes; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import small_batches, written

#: The control strings of the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>", "<|image|>", "<|audio|>", "<|document|>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_PLACEHOLDER = re.compile(r"<\|(image|audio|document)\|>")
_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)
#: Tokens that stand for an attachment where its part names no count: a 24 x 24 grid of patches, 30 s at 25 a second, one page.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass
class Formatted:
    """What the visitor builds: the text, the loss ranges and the attachments."""

    pieces: list[str] = field(default_factory=list)
    size: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)

    def put(self, s: str) -> None:
        self.pieces.append(s)
        self.size += len(s)

    def visit_text(self, text: str) -> None:
        self.put(escape(text))

    def visit_attachment(self, part: dict) -> None:
        self.attachments.append((part["type"], part.get("ref") or "", self.size, part.get("tokens") or EXPANDED[part["type"]]))
        self.put(f"<|{part['type']}|>")

    def visit(self, parts: list[dict]) -> None:
        for texts, run in groupby(parts, lambda p: p["type"] == "text"):
            if texts:
                self.visit_text("".join(p.get("text") or "" for p in run))
            else:
                for part in run:
                    self.visit_attachment(part)

    def turn(self, role: str, parts: list[dict]) -> None:
        before, after = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}.get(role, (f"<|turn|>{escape(role)}<|text|>", "<|end|>"))
        self.put(before)
        start = self.size
        self.visit(parts)
        if role == "assistant":
            self.loss.append((start, self.size))
        self.put(after)

    @property
    def text(self) -> str:
        return "".join(self.pieces)


def format_turns(turns: list[tuple[str, list[dict]]]) -> Formatted:
    out = Formatted()
    for role, parts in turns:
        out.turn(role, parts)
    return out


def read_parts(text: str, attachments: list[tuple[str, str, int, int]] = ()) -> list[tuple[str, list[dict]]]:
    """(role, typed parts) of every turn of a formatted text. Texts side by side come back as one, empty ones not at all."""
    turns, at, left = [], 0, iter(attachments)
    ends = {"[INST]": "[/INST]", "<s>": "</s>", "<|turn|>": "<|end|>"}
    while at < len(text):
        start = _CONTROL.match(text, at)
        stop = text.index(ends[start[0]], start.end())
        body = text[start.end() : stop]
        if start[0] == "<|turn|>":
            role, _, body = body.partition("<|text|>")
        else:
            role, body = "user" if start[0] == "[INST]" else "assistant", body[1:-1]
        parts, done = [], 0
        for m in [*_PLACEHOLDER.finditer(body), None]:
            if plain := unescape(body[done : m.start() if m else len(body)]):
                parts.append({"type": "text", "text": plain})
            if m:
                known = next(left, (m[1], None, 0, None))
                parts.append({"type": m[1], "ref": known[1], "tokens": known[3]})
                done = m.end()
        turns.append((unescape(role), parts))
        at = stop + len(ends[start[0]])
    return turns


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation; attachments show as their placeholders."""
    return [(role, "".join(p["text"] if p["type"] == "text" else f"<|{p['type']}|>" for p in parts)) for role, parts in read_parts(text)]


_ATTACHMENT = pa.struct([("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
_PIECES = "conv_id long, turn long, role string, text string, loss_start long, loss_end long, attachments array<struct<type:string,ref:string,at:long,tokens:long>>"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def _format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [format_turns([turn]) for turn in zip(batch["role"].to_pylist(), batch["parts"].to_pylist(), strict=True)]
        loss = [m.loss[0] if m.loss else (None, None) for m in made]
        kept = [[dict(zip(("type", "ref", "at", "tokens"), a, strict=True)) for a in m.attachments] for m in made]
        arrays = [batch["conv_id"], batch["turn"], batch["role"], pa.array([m.text for m in made], pa.string()), *(pa.array([x[k] for x in loss], pa.int64()) for k in (0, 1)), pa.array(kept, pa.list_(_ATTACHMENT))]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "role", "text", "loss_start", "loss_end", "attachments"])


class _Digest:
    """What is kept of the conversation that is being read."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.counts = [0] * 5

    def add(self, text: str, loss: tuple, attachments: list) -> None:
        code = lambda s: s.encode("utf-8", "surrogatepass")
        for role, said in read_back(text):
            self.turns.update(code(f"{role}\n{said}\n"))
            self.counts[0] += 1
        plain = unescape(text[loss[0] : loss[1]]) if loss[0] is not None else ""
        self.loss.update(code(plain))
        for k, n in enumerate((len(plain), len(text), len(attachments), sum(a["tokens"] for a in attachments)), 1):
            self.counts[k] += n

    def row(self) -> tuple:
        turns, plain, chars, n, tokens = self.counts
        return self.conv_id, turns, self.turns.hexdigest(), plain, self.loss.hexdigest(), chars, n, tokens


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of conversations and turns -> one row per conversation; a conversation may span many batches."""
    now, names = None, [c.split()[0] for c in _DIGESTS.split(", ")]
    types = [pa.string() if "string" in c else pa.int64() for c in _DIGESTS.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        out = []
        for conv_id, text, a, b, kept in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end", "attachments")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now:
                    out.append(now.row())
                now = _Digest(conv_id)
            now.add(text, (a, b), kept)
        if out:
            yield made(out)
    if now:
        yield made([now.row()])


def text_parts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts: a table with plain text as one text part per turn."""
    text = F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.array(text).alias("parts"))


def format_pieces(parts: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, loss_start, loss_end, attachments: each turn formatted by itself; places count from the turn's start."""
    return parts.select("conv_id", "turn", "role", "parts").mapInArrow(_format_rows, _PIECES)


def _in_order() -> list:
    return [F.col("turn").isNull(), "turn", "role", "text"]


def format_conversations(parts: DataFrame) -> DataFrame:
    """conv_id, text, loss ranges and attachment references: one row per conversation."""
    place = W.partitionBy("conv_id").orderBy(*_in_order())
    size = F.length("text").cast("long")
    rows = format_pieces(parts).withColumn("n", F.row_number().over(place)).withColumn("start", F.sum(size).over(place.rowsBetween(W.unboundedPreceding, W.currentRow)) - size)
    moved = F.transform("attachments", lambda x: F.struct(x["type"].alias("type"), x["ref"].alias("ref"), (x["at"] + F.col("start")).alias("at"), x["tokens"].alias("tokens")))
    loss = F.when(F.col("loss_start").isNotNull(), F.array(F.col("start") + F.col("loss_start"), F.col("start") + F.col("loss_end")))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "text", loss.alias("loss"), moved.alias("kept")))).alias("p"))
    return rows.select("conv_id", F.array_join("p.text", "").alias("text"), F.filter("p.loss", lambda x: x.isNotNull()).alias("loss"), F.flatten("p.kept").alias("attachments"))


def format_table(rows: DataFrame) -> DataFrame:
    """The digests of each formatted conversation, with conversation -7 added."""
    said = F.lit("</s>[INST] ok [/INST]")
    extra = rows.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    parts = text_parts(rows.select("conv_id", "turn", "role", "text")).unionByName(text_parts(extra))
    with small_batches(rows.sparkSession):
        ordered = format_pieces(parts).repartition("conv_id").sortWithinPartitions("conv_id", *_in_order())
        return written(ordered.mapInArrow(_digests, _DIGESTS), "digests")
