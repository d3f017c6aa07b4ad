"""Phrase collocations from depth-truncated suffix trees, built group by group.

Every word begins a suffix of at most DEPTH words that ends with its piece. The suffixes are cut
vertically, by their first words, into groups that fit a memory budget, and the subtree of each
group is built on its own: its suffixes are sorted, each run of equal first words is a node, and a
node's count is the total of the leaves below it. Prefixes grow elastically: all suffixes are dealt
by their first word into FAN groups; a group with over BUDGET different suffixes is dealt again by
one word more, in parts of about BUDGET suffixes, until each group fits. So a word that begins a
third of all suffixes is cut by its second word, and that by its third. The nodes above a cut get
their counts from the parts, summed. Below, a subtree is followed only where its count can reach
MIN_COUNT.

Suffixes travel as blocks, one row per task, language and group: the block's words, and columns of
numbers into them with the times each suffix occurs, sorted and compressed. Equal suffixes of a
block are one entry, at every cut again.

Phrases are then rows with exact counts. A phrase's cuts look up both parts, and the longer phrases
give the largest of their counts to what lies in them, by joins and sums over frequent phrases only.

Results for odd input: null text is empty; a null language is `und`; repeated rows count each time;
without words nothing is returned; an empty table gives no rows; a long text is read in slices that end
where a piece ends, so only one piece must fit in memory. doc_id and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import joined_hot, small_batches, text_of, written

DEPTH, MIN_COUNT, TOP, UNKNOWN = 4, 30, 2000, "und"
#: Bytes of text to a block of suffixes; groups to a cut; different suffixes that one task takes at once.
CHUNK, FAN, BUDGET = 8 << 20, 128, 1 << 19
_SPACE, _END = 32, 10
_TO = bytes(_SPACE if c == 9 else _END if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = "lang string, slot string, rows long, total long, words binary, codes binary"


def suffixes(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The different words of a text, and a row of DEPTH numbers per word: it and the words behind it in its piece, from 1; 0 is none."""
    raw = np.frombuffer(text.translate(_TO), np.uint8)
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = (raw != _SPACE) & (raw != _END)
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    n = len(starts)
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[word[1:-1]])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(raw == _END), starts)
    out = np.zeros((DEPTH, n), np.int32)
    out[0] = np.asarray(coded.indices) + 1
    for d in range(1, min(DEPTH, n)):
        out[d, : n - d] = np.where(piece[d:] == piece[: n - d], out[0, d:], 0)
    return coded.dictionary, out


def merged(codes: np.ndarray, counts: np.ndarray | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of codes in order, and the sums of their counts."""
    n, width = codes.shape[1], max(1, int(words).bit_length())
    if not n:
        return codes, np.zeros(0, np.int64)
    fit = max(1, 63 // width)
    keys = []
    for i in range(0, DEPTH, fit):
        key = codes[i].astype(np.int64)
        for row in codes[i + 1 : i + fit]:
            key = (key << width) | row
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(n, bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, n)) if counts is None else np.add.reduceat(counts[order], first)
    return codes[:, order[first]], total


def _hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _slots(words: pa.Array, codes: np.ndarray, depth: int, fan: int) -> np.ndarray:
    """The group of each suffix, by its first `depth` words."""
    h = np.append(np.uint64(0), _hashes(words))
    mix = np.full(codes.shape[1], depth, np.uint64)
    with np.errstate(over="ignore"):
        for row in codes[:depth]:
            mix = (mix ^ h[row]) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
    return (mix % np.uint64(fan)).astype(np.int16)


def blocks(lang: str, path: str, words: pa.Array, codes: np.ndarray, counts: np.ndarray, depth: int, fan: int) -> Iterator[tuple]:
    """Rows of _BLOCK: the suffixes dealt by their first `depth` words."""
    if not codes.shape[1]:
        return
    slots = _slots(words, codes, depth, fan)
    order = np.argsort(slots, kind="stable")
    codes, counts, slots = codes[:, order], counts[order], slots[order]
    cuts = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
    place = np.zeros(len(words) + 1, np.uint32)
    for a, b in zip(cuts, [*cuts[1:], len(slots)], strict=True):
        own = codes[:, a:b]
        used = np.zeros(len(words) + 1, bool)
        used[own] = True
        used[0] = False
        at = np.flatnonzero(used)
        place[at] = np.arange(1, len(at) + 1)
        kind = np.uint16 if len(at) < 1 << 16 else np.uint32
        said = b" ".join(words.take(pa.array(at - 1)).to_pylist())
        data = place[own].astype(kind).tobytes() + counts[a:b].astype(np.int64).tobytes()
        yield lang, f"{path}{int(slots[a])}.", b - a, int(counts[a:b].sum()), said, len(data).to_bytes(8, "big") + pa.compress(data, "zstd", asbytes=True)
        place[at] = 0


def unpacked(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Blocks put together: words, codes and counts."""
    words, each = [], []
    for said, rows, data in zip(*(table[c].to_pylist() for c in ("words", "rows", "codes")), strict=True):
        own, size = said.split(b" "), int.from_bytes(data[:8], "big")
        kind = np.uint16 if len(own) < 1 << 16 else np.uint32
        raw = pa.decompress(data[8:], size, "zstd", asbytes=True)
        cut = DEPTH * rows * np.dtype(kind).itemsize
        each.append((len(own), np.frombuffer(raw[:cut], kind).reshape(DEPTH, rows), np.frombuffer(raw[cut:], np.int64)))
        words += own
    coded = pa.array(words, pa.binary()).dictionary_encode()
    known, at, codes = np.append(np.int32(0), np.asarray(coded.indices) + np.int32(1)), 0, []
    for n, own, _ in each:
        here = np.append(np.int32(0), known[at + 1 : at + n + 1])
        codes.append(here[own])
        at += n
    return coded.dictionary, np.concatenate(codes, axis=1), np.concatenate([c for _, _, c in each])


def nodes(words: pa.Array, codes: np.ndarray, counts: np.ndarray, least: int, above: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, codes, count) of the tree's nodes with `least` occurrences, below depth `above`; codes and counts as `merged` gives them."""
    for depth in range(1, DEPTH + 1):
        live = codes[depth - 1] > 0
        codes, counts = codes[:, live], counts[live]
        if not codes.shape[1]:
            return
        new = np.append(True, (codes[:depth, 1:] != codes[:depth, :-1]).any(axis=0))
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts, first)
        often = total >= least
        if depth > above:
            yield depth, codes[:depth, first[often]], total[often]
        keep = np.repeat(often, np.diff(np.append(first, len(counts))))
        codes, counts = codes[:, keep], counts[keep]


def _phrases(lang: str, words: pa.Array, codes: np.ndarray, counts: np.ndarray, least: int, above: int, below: int = DEPTH) -> pa.Table:
    said = [(d, pc.binary_join_element_wise(*[words.take(pa.array(row - 1)) for row in c], b" "), f) for d, c, f in nodes(words, codes, counts, least, above) if d <= below]
    phrase = pa.chunked_array([p for _, p, _ in said], pa.binary()).cast(pa.string())
    size = np.concatenate([np.full(len(f), d, np.int32) for d, _, f in said]) if said else np.zeros(0, np.int32)
    total = np.concatenate([f for _, _, f in said]) if said else np.zeros(0, np.int64)
    return pa.table({"lang": pa.array([lang] * len(size), pa.string()), "phrase": phrase, "size": pa.array(size), "f": pa.array(total)})


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["lang", "slot", "rows", "total", "words", "codes"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _read(chunk: int, fan: int):
    def flush(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        words, codes = suffixes(b"\n".join(texts))
        codes, counts = merged(codes, None, len(words))
        return _table(list(blocks(lang, "", words, codes, counts, 1, fan)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["t"].to_pylist(), strict=True):
                for part in slices(text.encode("utf-8", "surrogatepass"), chunk):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= chunk:
                        for x in held.items():
                            yield flush(*x)
                        held, size = {}, 0
        for x in held.items():
            yield flush(*x)

    return run


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts of about `size` bytes that end where a piece ends."""
    while len(text) > size:
        cut = max(text.rfind(c, 0, size) for c in (b".", b",", b"\n", b";", b":", b"!", b"?"))
        if cut <= 0:
            ends = [x for x in (text.find(c, size) for c in (b".", b",", b"\n", b";", b":", b"!", b"?")) if x >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[: cut + 1]
        text = text[cut + 1 :]
    yield text


def _extend(depth: int, fan: int):
    """A part of a group over the budget, dealt by one more word: its blocks, and beside them the counts of its nodes of `depth` words."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, path = key[0].as_py(), key[1].as_py()
        words, codes, counts = unpacked(table)
        codes, counts = merged(codes, counts, len(words))
        made = pa.Table.from_batches([_table(list(blocks(lang, path, words, codes, counts, depth + 1, fan)))])
        told = _phrases(lang, words, codes, counts, 1, depth - 1, depth)
        none = lambda kind, n: pa.nulls(n, kind)
        made = made.append_column("phrase", none(pa.string(), len(made))).append_column("f", none(pa.int64(), len(made)))
        n = len(told)
        told = pa.table({"lang": told["lang"], "slot": none(pa.string(), n), "rows": none(pa.int64(), n), "total": none(pa.int64(), n), "words": none(pa.binary(), n), "codes": none(pa.binary(), n), "phrase": told["phrase"], "f": told["f"]})
        return pa.concat_tables([made, told])

    return run


def _tree(depth: int, least: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, codes, counts = unpacked(table)
        codes, counts = merged(codes, counts, len(words))
        return _phrases(key[0].as_py(), words, codes, counts, least, depth - 1)

    return run


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, fan: int = FAN, budget: int = BUDGET, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of up to DEPTH words with `least` occurrences, and (lang, n), the words of each language."""
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of().alias("t"))
    with small_batches(docs.sparkSession):
        now = written(read.mapInArrow(_read(chunk, fan), _BLOCK), "suffixes")
    spoken = now.groupBy("lang").agg(F.sum("total").alias("n"))
    found, above, counts = [], [], "lang string, phrase string, size int, f long"
    for depth in range(1, DEPTH + 1):
        sizes = now.groupBy("lang", "slot").agg(F.sum("rows").alias("__rows"))
        sizes = written(sizes.withColumn("__parts", F.ceil(F.col("__rows") / budget).cast("int")), "groups")
        over = sizes.filter("__parts > 1").select("lang", "slot", "__rows", "__parts")
        last = depth == DEPTH or over.isEmpty()
        fits = now if last else now.join(over, ["lang", "slot"], "left_anti")
        # at the last depth a suffix is one entry of each part before it, and the groups are FAN**DEPTH: none is large
        found.append(fits.groupBy("lang", "slot").applyInArrow(_tree(depth, least), counts))
        if last:
            break
        # blocks are dealt whole: a part's number comes from the block's own words, so it is the same when a task runs again
        many = now.join(over, ["lang", "slot"]).withColumn("part", F.pmod(F.xxhash64("words", "codes"), F.col("__parts")))
        dealt = many.select("lang", "slot", "part", "rows", "words", "codes").groupBy("lang", "slot", "part").applyInArrow(_extend(depth, fan), f"{_BLOCK}, phrase string, f long")
        dealt = written(dealt, f"cut{depth}")
        above.append(dealt.filter("phrase is not null").groupBy("lang", "phrase").agg(F.lit(depth).alias("size"), F.sum("f").alias("f")).filter(F.col("f") >= least))
        now = dealt.filter("slot is not null").drop("phrase", "f")
    return written(reduce(DataFrame.unionByName, [*found, *above]), "phrases"), spoken


def _words(phrase: str) -> Column:
    return F.split(phrase, " ", -1)


def _part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to DEPTH words."""
    counts, spoken = phrase_counts(docs, least, **sizes)
    words = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), _words("phrase").alias("w"))
    cuts = words.select("lang", "phrase", "a", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(_part(F.col("w"), F.lit(1), k).alias("head"), _part(F.col("w"), k + 1, F.col("size") - k).alias("tail")))).alias("k", "c"))
    cuts = written(cuts.select("lang", "phrase", "a", "k", "c.head", "c.tail"), "cuts")

    def looked(df: DataFrame, key: str, name: str) -> DataFrame:
        # a word may be an end of very many phrases: such keys are dealt in parts
        asked = df.groupBy("lang", key).agg(F.count("*").alias("asked"))
        known = counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name)).join(asked, ["lang", key])
        return joined_hot(df, written(known, name), ["lang", key], "asked", ["phrase", "k"]).drop("asked")

    both = looked(looked(cuts, "head", "l"), "tail", "r")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumn("hi", F.lit(2_000_000).cast("decimal(7,0)") * wide("a")).withColumn("lo", wide("l") + wide("r"))
    scored = both.withColumn("score", F.expr("hi div lo"))
    scored = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.score", "m.a", "m.l", "m.r")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: _part(F.col("w"), at, n))))
    holds = words.filter("size > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(holds, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("longer") < F.lit(80).cast("decimal(3,0)") * wide("a")))
    return _ranked(free, spoken, top)


def _ranked(free: DataFrame, spoken: DataFrame, top: int) -> DataFrame:
    from pyspark.sql import Window as W

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each part first, so that no task ranks a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = free.withColumn("part", part).withColumn("nth", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best))).filter(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(spoken, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(p) AS x FROM d)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
q AS (SELECT lang, unnest(list_concat(list_transform(w, lambda x: [x]), list_transform(range(1, len(w)), lambda i: w[i : i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2]), list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3]))) AS g FROM w),
f AS (SELECT lang, array_to_string(g, ' ') AS phrase, len(g) AS size, count(*) AS f FROM q GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
j AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS j FROM c)),
v AS (SELECT j.lang, j.phrase, a, j, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score FROM j JOIN f l ON l.lang = j.lang AND l.phrase = head JOIN f r ON r.lang = j.lang AND r.phrase = tail),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM v),
h AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(CASE WHEN size = 3 THEN [w[1:2], w[2:3]] WHEN size = 4 THEN [w[1:2], w[2:3], w[3:4], w[1:3], w[2:4]] END) AS g, array_to_string(g, ' ') AS phrase FROM c WHERE size > 2) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM u LEFT JOIN h USING (lang, phrase) JOIN t USING (lang)
WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 80 * a) QUALIFY rank <= 2000
"""
