"""Packing token sequences with the sum-of-squares rule.

Documents are tokenised (ids, then one end id), only longer ones are cut, and every piece goes
to the place that makes the sum over residual gaps of the squared number of open bins smallest.
Pieces are dealt evenly, whatever their document, into groups of about GROUP; each group is packed
by itself, longest pieces first, so the work spreads and a group leaves only its last bins open.

Arrow splits about BYTES of text at a time and numbers the distinct chunks, so Python sees each once.
Words repeat, so each Python worker keeps the ids of up to CACHE chunks of non-white-space text.
White space is the tokenizer's: Arrow's own also holds U+001C to U+001F, which have ids.
The tokenizer never joins across white space, nor letters with the punctuation after them, and
ignores case, which a test checks against whole texts; an unknown chunk is thus looked up as its
letters and its tail first. The cache is a speed-up only: chunks beyond it are tokenised each time.

Results for odd input: null and empty texts give one piece holding the end id; repeated rows are
packed once each; a null doc_id is kept; a very long text is cut into pieces, in order; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import small_batches, text_of, written

LENGTH, END, GROUP, CACHE, BYTES = 4096, 1, 50_000, 300_000, 1_000_000
TOKENIZER = "word_bpe_49k.json"
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The tokenizer's white space, and what only Arrow takes for it.
_BLANK, _NOT_BLANK = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]", "[\\x1c-\\x1f]"
_TAIL = ".,;:!?*#$%&|-"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long"


def _encoded(chunks: list[str], tokenizer, ends: np.ndarray) -> dict[str, bytes]:
    """Ids of chunks, as bytes. Chunks of letters only share one call; each ends at its first word-end id."""
    plain, other = [], []
    for c in chunks:
        (plain if _PLAIN.fullmatch(c) else other).append(c)
    if plain:
        ids = np.array(tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) == len(plain):
            raw, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
            out = {c: raw[cuts[k] : cuts[k + 1]] for k, c in enumerate(plain)}
        else:
            out, other = {}, plain + other
    else:
        out = {}
    made = tokenizer.encode_batch_fast(other, add_special_tokens=False)
    return out | {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(other, made, strict=True)}


def _ids_of(chunks: list[str], tokenizer, ends: np.ndarray, cache: dict[str, bytes]) -> list[bytes]:
    """Ids of each of these distinct chunks. What is not known is looked up as letters and tail first."""
    out = list(map(cache.get, chunks))
    missing = [k for k, v in enumerate(out) if v is None]
    pairs = []
    for k in missing:
        c = chunks[k]
        letters = c.rstrip(_TAIL)
        pairs.append((letters.lower(), c[len(letters) :]) if _LETTERS.fullmatch(letters) else (c, ""))
    known = {p: cache.get(p) for pair in pairs for p in pair}
    made = _encoded([p for p, v in known.items() if v is None], tokenizer, ends)
    known |= made
    for k, (letters, tail) in zip(missing, pairs, strict=True):
        out[k] = known[letters] + known[tail] if tail else known[letters]
    room = max(0, CACHE - len(cache))
    cache.update(islice(made.items(), room))
    room = max(0, CACHE - len(cache))
    cache.update((chunks[k], out[k]) for k in islice(missing, room))
    return out


def token_arrays(texts: pa.Array, tokenizer, ends: np.ndarray, cache: dict[str, bytes]) -> list[np.ndarray]:
    """Ids of each text, then END. White space separates chunks whose ids don't depend on one another."""
    odd = pc.any(pc.match_substring_regex(texts, _NOT_BLANK)).as_py()
    split = pc.split_pattern_regex(texts, _BLANK) if odd else pc.utf8_split_whitespace(texts)
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    raw = _ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), tokenizer, ends, cache)
    ids, sizes = np.frombuffer(b"".join(raw), "<u4"), np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    codes = coded.indices.to_numpy()
    n = sizes[codes]
    to = np.concatenate([[0], np.cumsum(n)])
    # the ids of chunk k are those of its distinct chunk, moved to where k begins
    flat = ids[np.repeat((np.cumsum(sizes) - sizes)[codes] - to[:-1], n) + np.arange(to[-1])]
    stops = to[bounds[1:] - bounds[0]]
    return np.split(np.insert(flat, stops, END), stops[:-1] + np.arange(1, len(stops)))


@cache
def _loaded(name: str):
    """The tokenizer, which ids end a word, and the cache of this Python worker, which serves many tasks."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return tokenizer, word_ends(tokenizer), {}


def word_ends(tokenizer) -> np.ndarray:
    vocab = tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
    return ends


def _slices(texts: pa.Array) -> list[int]:
    """Where to cut a batch so that each part has about BYTES of text; a longer text is alone or ends a part."""
    part = np.cumsum(pc.binary_length(texts).to_numpy()) // BYTES
    return [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]


def tokenised(name: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, ends, known = _loaded(name)
        for batch in batches:
            cuts = _slices(batch["t"]) if len(batch) else [0]
            for at, to in zip(cuts, cuts[1:]):
                row, piece, start, size, crc = [], [], [], [], []
                for k, ids in enumerate(token_arrays(batch["t"][at:to], tokenizer, ends, known), at):
                    for no, begin in enumerate(range(0, len(ids), length)):
                        part = ids[begin : begin + length]
                        row.append(k), piece.append(no), start.append(begin), size.append(len(part)), crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. Open bins are counted by gap; any bin of a gap will do."""
    count, stacks = np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        # closing a bin of gap n costs 1 - 2 N(n); moving gap h to h - n costs 2 (N(h - n) - N(h) + 1); opening costs 2 N(size - n) + 1
        cost = 2 * (count[: size - n] - count[n:size] + 1)
        if len(cost):
            cost[0] = 1 - 2 * count[n]
            cost[count[n:size] == 0] = np.iinfo(np.int64).max
            h = n + int(cost.argmin())
        if not len(cost) or not count[h] or cost[h - n] > (2 * count[size - n] + 1 if n < size else 0):
            bins[k], h, offsets[k] = made, size, 0
            made += 1
        else:
            count[h] -= 1
            bins[k], offsets[k] = stacks[h].pop(), size - h
        if h > n:
            count[h - n] += 1
            stacks[h - n].append(bins[k])
    return bins, offsets


def _packed(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = list(batches)  # one group: about GROUP narrow rows
        if parts and sum(map(len, parts)):
            pdf = pd.concat(parts, ignore_index=True)
            bins, offsets = sum_of_squares(pdf["length"].to_numpy(), length)
            yield pdf.assign(sequence_id=bins + (TaskContext.get().partitionId() << 32), offset=offsets)

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    with small_batches(docs.sparkSession):
        pieces = written(read.mapInArrow(tokenised(tokenizer, length), _PIECES), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    return pieces.repartition(groups).mapInPandas(_packed(length), _PLACED)
