"""A Merkle manifest of a table by butterfly exchange.

Rows are leaves. Each language's leaves, by doc_id, form a tree of fanout 8; the trees' roots, by
language, form another. A partition is BLOCK = 8**4 consecutive leaves of a tree. It hashes its own
subtree, and from then on partitions meet in rounds: in round r the aligned groups of 8**(r + 1)
partitions swap their subtree roots, each with those whose number differs from its own in the r-th
digit to the base of 8. Every partition then hashes the parent itself, the same in all of a group,
and keeps the seven others as its proof for that level. After log8(partitions) rounds each has the
root and its whole upper proof, and nothing has to travel down. Where the last subtree of a level
has fewer partitions than its siblings, they stand in for the missing ones in turn.

Leaves are numbered by a range partition, sorted inside, with the partitions' counts added up: no
task sees a whole language. Texts are hashed where they are read and are never shuffled.

Results for odd input: null values are hashed as `-`; null doc_ids come first and are no
candidates for tampering; rows with one doc_id are leaves of their own, by digest; a null language
is a tree of its own, before the others; long texts are hashed whole; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import written

FANOUT, HEIGHT = 8, 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _part(value: Column) -> Column:
    """A value as it is hashed: `-` if null, else its UTF-8 bytes after their count and a colon."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the language, null first), doc_id, leaf, tampered (null where nothing is tampered with)."""
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = lambda text: F.sha2(F.concat(*[_part(c) for c in head], _part(text)), 256)
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(lowered)).alias("tampered"))


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """rows with idx, the place from 0 inside each tree, by order: range partitions, sorted inside, and sums of their counts."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(tree), *order]
    put = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    put = written(put.withColumn("__part", F.shiftright("__at", 33).cast("int")), "sorted")
    counts = put.groupBy(tree, "__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = F.sum("n").over(W.partitionBy(tree).orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    counts = counts.withColumn("before", before).select(F.col(tree).alias("__tree"), F.col("__part").alias("__p"), "before", "first")
    # a range holds few trees and a tree's range few rows beyond a partition: no key is hot
    return put.join(counts, (F.col(tree) == F.col("__tree")) & (F.col("__part") == F.col("__p"))).withColumn("idx", F.col("before") + F.col("__at") - F.col("first")).drop("__tree", "__p", "before", "first", "__at", "__part")


def _join(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def subtree(digests: list[str], height: int, whole: bool) -> list[list[str]]:
    """The levels of a block, leaves first, up to `height` or, where the block is a whole tree, to its root."""
    levels = [digests]
    while len(levels) <= height and not (whole and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([_join(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def _block_roots(height: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        digests = [x for _, x in sorted(zip(table["idx"].to_pylist(), table["leaf"].to_pylist(), strict=True))]
        high, alone = (subtree(digests, height, whole)[-1][0] for whole in (False, True))
        return pa.table({"tree": [tree], "block": pa.array([block], pa.int64()), "high": [high], "alone": [alone]})

    return run


def _levels(most: int) -> int:
    rounds, n = 0, most
    while n > 1:
        rounds, n = rounds + 1, -(-n // FANOUT)
    return rounds


_PROOF = "array<struct<place:int,others:array<string>>>"


def butterfly(blocks: DataFrame) -> DataFrame:
    """(tree, block, n, digest) -> tree, block, digest (the root), proof: (place in the run, the run's other digests) by level.

    block numbers run from 0 to n - 1 in each tree. One shuffle of at most 8 narrow messages a block in each round.
    """
    state = written(blocks.withColumn("proof", F.array().cast(_PROOF)), "round0")
    most = state.agg(F.max("n")).first()[0] or 0
    for r in range(_levels(most)):
        step = FANOUT**r
        node, low = F.expr(f"block div {step}"), F.expr(f"block % {step}")
        df = state.withColumn("node", node).withColumn("low", low).withColumn("first", F.expr(f"node div {FANOUT} * {FANOUT}"))
        # the last subtree may have fewer blocks: each answers for every size-th place
        df = df.withColumn("size", F.least(F.lit(step), F.col("n") - F.col("node") * step)).withColumn("nodes", F.ceil(F.col("n") / step))
        last = F.least(F.col("first") + FANOUT, F.col("nodes")) - 1
        to = F.flatten(F.transform(F.sequence("first", last), lambda d: F.transform(F.sequence(F.col("low"), F.lit(step - 1).cast("long"), F.col("size")), lambda at: d * step + at)))
        sent = df.withColumn("to", F.explode(to)).filter("to < n").withColumn("own", F.col("to") == F.col("block"))
        met = sent.groupBy("tree", F.col("to").alias("block")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("run"), F.max("nodes").alias("nodes"),
            F.max(F.when(F.col("own"), F.col("node"))).alias("mine"), F.first(F.when(F.col("own"), F.col("proof")), ignorenulls=True).alias("proof"),
        )
        others = F.transform(F.filter("run", lambda x: x["node"] != F.col("mine")), lambda x: x["digest"])
        level = F.struct((F.col("mine") % FANOUT).cast("int").alias("place"), others.alias("others"))
        parent = F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256)
        up = F.col("nodes") > 1
        met = met.select("tree", "block", "n", F.when(up, parent).otherwise(F.get("run", 0)["digest"]).alias("digest"), F.when(up, F.concat("proof", F.array(level))).otherwise(F.col("proof")).alias("proof"))
        state = written(met, f"round{r + 1}")
    return state.select("tree", "block", "digest", "proof")


def _proofs(height: int):
    """Each leaf's whole proof and what it folds to: the block's own levels, then what the block has got from the others."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, upper: pa.Table) -> pa.Table:
        up = upper.to_pylist()[0]
        table = sorted(zip(rows["idx"].to_pylist(), rows["doc_id"].to_pylist(), rows["leaf"].to_pylist(), rows["tampered"].to_pylist(), strict=True), key=lambda x: x[0])
        levels = subtree([x[2] for x in table], height, up["n"] == 1)
        above = [(x["place"], x["others"]) for x in up["proof"]]
        out = []
        for at, (_, doc_id, leaf, tampered) in enumerate(table):
            steps = []
            for level in levels[:-1]:
                first = at // FANOUT * FANOUT
                steps.append((at - first, level[first:at] + level[at + 1 : first + FANOUT]))
                at //= FANOUT
            steps += above
            now = leaf if tampered is None else tampered
            for place, others in steps:
                now = _join([*others[:place], now, *others[place:]])
            out.append((doc_id, leaf, up["subroot"], up["root"], _join([x for _, others in steps for x in others]), now, now == up["root"]))
        columns = list(zip(*out, strict=True))
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per input row.

    A leaf is 8**height-th of a block; the folded root is made again from the tampered leaf, where there is one.
    """
    # written first: dealing by ranges reads its rows twice, and texts are to be hashed once
    rows = numbered(written(leaves(docs), "hashed"), "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    rows = written(rows.withColumn("block", F.expr(f"idx div {FANOUT**height}")), "leaves")
    roots = rows.select("tree", "block", "idx", "leaf").groupBy("tree", "block").applyInArrow(_block_roots(height), "tree string, block long, high string, alone string")
    roots = written(roots, "roots")
    blocks = roots.groupBy("tree").agg(F.count("*").alias("n"))
    digest = F.when(F.col("n") == 1, F.col("alone")).otherwise(F.col("high"))
    parts = written(butterfly(roots.join(blocks, "tree").select("tree", "block", "n", digest.alias("digest"))), "parts")

    trees = numbered(parts.filter("block = 0").select(F.lit("all").alias("all"), "tree", F.col("digest").alias("subroot")), "all", [F.col("tree")])
    trees = written(trees, "trees")
    top = butterfly(trees.select(F.col("all").alias("tree"), F.col("idx").alias("block"), F.lit(trees.count()).cast("long").alias("n"), F.col("subroot").alias("digest")))
    top = top.select(F.col("block").alias("idx"), F.col("digest").alias("root"), F.col("proof").alias("above"))
    top = written(trees.join(top, "idx").join(blocks, "tree").select("tree", "subroot", "root", "above", "n"), "top")
    upper = parts.join(top, "tree").select("tree", "block", "n", "subroot", "root", F.concat("proof", "above").alias("proof"))

    result = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    made = rows.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(_proofs(height), result)
    return written(made, "manifest")


_H = "list_transform(range(0, CAST(ceil(len({0}) / 8.0) AS BIGINT)), lambda g: sha256(array_to_string({0}[8 * g + 1 : 8 * g + 8], '')))"
_RUN = "x.nodes[8 * (p.place // 8) + 1 : 8 * (p.place // 8) + 8]"
_S = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END))"

#: Trees as lists of levels; the proofs level by level, those of a language's tree (0), then those of the languages' (1).
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_S.format("doc_id")} || {_S.format("source")} || {_S.format("lang")} || {_S.format("n_chars")} AS head, text, xor({_CRC}, 4294967295::BIGINT) % 3 = 0 AS hit FROM documents),
f AS (SELECT doc_id, lang, sha256(head || {_S.format("text")}) AS leaf, sha256(head || {_S.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low, hit FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) = 1 AS alone FROM f),
t AS (SELECT tree, 0 AS level, list(leaf ORDER BY place) AS nodes FROM i GROUP BY tree UNION ALL SELECT tree, level + 1, {_H.format("nodes")} FROM t WHERE len(nodes) > 1),
s AS (SELECT tree, nodes[1] AS subroot FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY tree) AS nodes FROM s UNION ALL SELECT level + 1, {_H.format("nodes")} FROM u WHERE len(nodes) > 1),
b AS (SELECT 0 AS part, tree, level, nodes FROM t WHERE len(nodes) > 1 UNION ALL SELECT 1, tree, level, nodes FROM u CROSS JOIN (SELECT DISTINCT tree FROM i) WHERE len(nodes) > 1),
x AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY part, level) AS step FROM b),
p AS (SELECT doc_id, leaf, tree, CASE WHEN alone THEN tree ELSE place END AS place, 0 AS step, CASE WHEN hit THEN low ELSE leaf END AS now, '' AS proof FROM i
  UNION ALL SELECT p.doc_id, p.leaf, p.tree, CASE WHEN y.part IS NULL OR y.part = x.part THEN p.place // 8 ELSE p.tree END, p.step + 1,
    sha256(array_to_string(list_transform({_RUN}, lambda h, k: CASE WHEN k = p.place % 8 + 1 THEN p.now ELSE h END), '')), p.proof || array_to_string(list_filter({_RUN}, lambda h, k: k <> p.place % 8 + 1), '')
  FROM p JOIN x ON x.tree = p.tree AND x.step = p.step + 1 LEFT JOIN x y ON y.tree = p.tree AND y.step = p.step + 2)
SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS verified
FROM p JOIN s USING (tree) LEFT JOIN (SELECT tree, max(step) AS last FROM x GROUP BY tree) USING (tree) WHERE step = coalesce(last, 0)
"""
