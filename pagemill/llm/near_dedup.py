"""MinHash near-dedup.

A document is the set of its distinct 5-word shingles. 336 universal hash minima make 56 bands
of 6 (a pair at Jaccard 0.75 shares no band with probability 2e-5, one at 0.2 shares a band with
0.4 %). Documents with the same set are one class from the start. Candidates are made without
listing the pairs of a bucket:

1. star: each member of a bucket is paired with the bucket's most connected class (the one whose
   buckets hold most others: an original among its copies, not one copy among others);
2. signatures, then full sets, confirm the pairs; components by alternating large-star and
   small-star. A centre's signature and set are sent once per SPREAD of its pairs, and the pairs
   stream past them;
3. rest: only buckets that still hold several components are looked at again. One of more than
   BLOCK rows or SHINGLES shingles is dealt into blocks: members of its largest component once, the
   others, which every new link has at one end, to each block. Where the others fill more than a
   block, the bucket is crowded: a second shared band splits it first, and only what is still so
   large is dealt in blocks of both kinds. Signatures first tell which members have a partner in
   another component at all; those get their full sets, and a pair leaves its task only as a
   confirmed link between two components (at the first bands that the two share). Then components
   run again;
4. crowded buckets that hold several components still: pairs without a second shared band. Their
   members are joined by shingles: ordered rarest first, two sets at 0.75 always share one among
   the first quarter of each. Groups by these shingles are looked at as in step 3, and those that
   are too large are dealt in blocks of both kinds, so every pair of them is covered.

No bucket, class or component is gathered in one task, no bucket or list of candidates is cut,
buckets of more than SPREAD rows meet their centre in parts, batches and blocks are bounded in bytes, and documents, links and components never pass through the driver.

Results for odd input: without words the set is empty, n_shingles is 0 and nothing links; a null
doc_id links with nothing, has a null component_id and stays; rows that share a doc_id are one
node of the graph, linked by each of their texts; repeated rows are each returned; a very long text
is one set in one row; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import joined_hot, remove, small_batches, text_of, written

SHINGLE, NUM, DEN = 5, 75, 100
ROWS, BANDS = 6, 56
CHECKED, BLOCK, SHINGLES, SPREAD = ROWS * BANDS, 512, 1 << 21, 256
#: Signatures (the low 8 bits of each minimum) of a pair at 0.75 agree in fewer than 212 of 336 places with probability 4e-7.
AGREE = 212


@cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    k = ROWS * BANDS
    return (rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 2**32, k, dtype=np.uint32)[:, None]


def shingle_set(text: str) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    if not k:
        return h
    n = len(words) - k + 1
    mix = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            mix = (mix ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
    return np.unique(mix)


def minima(s: np.ndarray) -> np.ndarray:
    a, b = _family()
    x, low = (s >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(x), 2048):
        m = (a * x[i : i + 2048] + b).min(axis=1)
        low = m if low is None else np.minimum(low, m)
    return low


_SKETCH = "doc_id long, n_shingles long, set_id binary, sig binary, bands array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    for batch in batches:
        out = []
        for text in batch["t"].to_pylist():
            s = shingle_set(text)
            if len(s):
                m = minima(s)
                bands = [xxh3_64_intdigest(r.tobytes(), i) - 2**63 for i, r in enumerate(m.reshape(BANDS, ROWS))]
                out.append((len(s), xxh3_128_digest(s.tobytes()), m.astype(np.uint8).tobytes(), bands))
            else:
                out.append((0, None, None, None))
        types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_shingles", "set_id", "sig", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([shingle_set(t).tobytes() for t in batch["t"].to_pylist()], pa.binary())], ["id", "data"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle of each text: set tells apart the texts of one id, n is the set's size."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        sets = [shingle_set(t) for t in batch["t"].to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        names = np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        columns = [np.repeat(batch["id"].to_numpy(zero_copy_only=False).astype(np.int64), sizes), np.repeat(names, sizes), np.repeat(sizes, sizes), np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "set", "n", "g"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def _alike_sets(x: bytes, y: bytes) -> bool:
    return similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))


def _alike_signatures(x: bytes, y: bytes) -> bool:
    """Data are a signature and the set's size."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n, m = int.from_bytes(x[CHECKED:], "big"), int.from_bytes(y[CHECKED:], "big")
    return DEN * min(n, m) >= NUM * max(n, m) and int((a[:CHECKED] == b[:CHECKED]).sum()) >= AGREE


def _passing(alike):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of (c, part); those without id hold the centre's data and come first."""
        at, centre = None, []
        for batch in batches:
            kept = ([], [])
            for c, part, i, data in zip(*(batch[k].to_pylist() for k in ("c", "part", "id", "data")), strict=True):
                if (c, part) != at:
                    at, centre = (c, part), []
                if i is None:
                    centre.append(data)
                elif any(alike(x, data) for x in centre):
                    kept[0].append(c), kept[1].append(i)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in kept], ["c", "id"])

    return run


def _against_centres(pairs: DataFrame, payload: DataFrame, alike, label: str) -> DataFrame:
    """The written pairs (c, id) whose payloads (id, data) are alike. Each centre's data go once to every SPREAD of its pairs."""
    counts = written(pairs.groupBy("c").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / SPREAD).cast("int")), "counts")
    dealt = joined_hot(pairs, counts, ["c"], "n", ["id"], SPREAD).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = dealt.select("c", "part", "id").join(payload, "id").select("c", "part", "id", "data")
    centres = counts.select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(payload.withColumnRenamed("id", "c"), "c")
    rows = members.union(centres.select("c", "part", F.lit(None).cast("long").alias("id"), "data"))
    with small_batches(pairs.sparkSession):
        ordered = rows.repartition("c", "part").sortWithinPartitions("c", "part", F.col("id").asc_nulls_first())
        return written(ordered.mapInArrow(_passing(alike), "c long, id long").distinct(), label)


def _linked(star: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (c, id) of classes whose full sets pass; sets are made again for these classes only."""
    signed = classes.select("id", F.concat("sig", F.unhex(F.lpad(F.hex("n"), 16, "0"))).alias("data"))
    near = _against_centres(star, signed, _alike_signatures, "near")
    sets = _full_sets(near.select(F.col("c").alias("id")).union(near.select("id")), docs)
    links = _against_centres(near, sets, _alike_sets, "links")
    remove(near, sets)
    return links.select(F.col("c").alias("a"), F.col("id").alias("b"))


def _full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, data): the sets of these ids, made from whole texts again. Rows that repeat an id give each of their sets."""
    need = written(ids.distinct(), "need")
    text = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("t")).join(need, "id", "left_semi")
    with small_batches(docs.sparkSession):
        return written(text.mapInArrow(_sets, "id long, data binary").filter("octet_length(data) > 0"), "full").dropDuplicates(["id", "data"])


def _partners(pdf: pd.DataFrame):
    """(row, rows) that join components and agree by signature, where these are the first bands that the two share."""
    path = [int(x) for x in pdf["path"].iat[0].split(",")]
    left, right = np.flatnonzero(pdf["left"]), np.flatnonzero(pdf["right"])
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, CHECKED)
    before = np.array(pdf["bands"].tolist())[:, : path[-1]]
    ids, comp, n, major = (pdf[c].to_numpy() for c in ("id", "comp", "n", "major"))
    for x in left:
        at = right[(comp[right] != comp[x]) & (DEN * np.minimum(n[right], n[x]) >= NUM * np.maximum(n[right], n[x]))]
        at = at if major[x] else at[ids[at] > ids[x]]
        at = at[(sig[at] == sig[x]).sum(axis=1) >= AGREE]
        at = at[(before[at] == before[x]).sum(axis=1) == len(path) - 1]
        if len(at):
            yield x, at


_PLACE = ["path", "key", "i", "j", "left", "right", "major", "id", "comp"]


def _with_partner(pdf: pd.DataFrame) -> pd.DataFrame:
    keep = np.zeros(len(pdf), bool)
    for x, at in _partners(pdf):
        keep[x] = keep[at] = True
    return pdf.loc[keep, _PLACE]


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, out = pdf["id"].to_numpy(), []
    for x, at in _partners(pdf):
        out += [(ids[x], ids[y]) for y in at if _alike_sets(pdf["data"].iat[x], pdf["data"].iat[y])]
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _sided(big: DataFrame) -> DataFrame:
    """Rows of groups that are too large for one task, with major (of the group's largest component) and the blocks for all and for the others."""
    per = big.groupBy("path", "key", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    most = per.groupBy("path", "key").agg(F.max(F.struct("size", "comp", "total")).alias("m"), F.sum("size").alias("rows"), F.sum("total").alias("all"))
    blocks = lambda rows, total: F.greatest(F.ceil(rows / BLOCK), F.ceil(total / SHINGLES), F.lit(1)).cast("int")
    most = most.select("path", "key", "rows", F.col("m.comp").alias("top"), blocks(F.col("rows"), F.col("all")).alias("lefts"), blocks(F.col("rows") - F.col("m.size"), F.col("all") - F.col("m.total")).alias("rights"))
    rows = joined_hot(big.select("path", "key", "id", "n", "comp"), written(most, "most"), ["path", "key"], "rows", ["id"], SPREAD)
    return written(rows.withColumn("major", F.col("comp") == F.col("top")), "sided")


def _dealt(sided: DataFrame) -> DataFrame:
    """_PLACE for rows of _sided, in blocks (i, j): every row is on the left of its block once for each block of the others, which alone are on the right."""
    own = lambda seed, of: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = sided.select("path", "key", own(1, "lefts").alias("i"), each("rights").alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"), "major", "id", "comp")
    right = sided.filter("not major").select("path", "key", each("lefts").alias("i"), own(2, "rights").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"), "major", "id", "comp")
    return left.union(right)


def _groups(now: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows (path, key, id, n, comp) -> groups of `least` rows and more that hold several components: _PLACE for those that fit a task, _sided rows for the others."""
    groups = now.groupBy("path", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"), F.sum("n").alias("total")).filter(f"c0 != c1 and size >= {least}")
    groups = written(groups.drop("c0", "c1"), "groups")
    mine = written(joined_hot(now, groups, ["path", "key"], "size", ["id"], SPREAD), "grouped")
    fits = (F.col("size") <= BLOCK) & (F.col("total") <= SHINGLES)
    whole = {"i": F.lit(0), "j": F.lit(0), "left": F.lit(True), "right": F.lit(True), "major": F.lit(False)}
    return mine.filter(fits).withColumns(whole).select(_PLACE), _sided(mine.filter(~fits))


def _blocks(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (band, key, id, n, comp) of buckets -> _PLACE: those that can still link components, in groups of bounded size; and the rows of crowded buckets, of which only pairs with a second shared band are among them."""
    # a bucket of two was compared by its star
    whole, sided = _groups(rows.select(F.col("band").cast("string").alias("path"), "key", "id", "n", "comp"), 3)
    out, crowded = [whole, _dealt(sided.filter("rights = 1"))], sided.filter("rights > 1")
    if not crowded.isEmpty():
        wide = crowded.join(classes.select("id", "bands"), "id").select("path", "key", "id", "n", "comp", F.posexplode("bands").alias("b", "k"))
        wide = wide.filter(F.col("b") > F.col("path").cast("int"))
        whole, sided = _groups(written(wide.select(F.concat_ws(",", "path", F.col("b").cast("string")).alias("path"), F.xxhash64("key", "k").alias("key"), "id", "n", "comp"), "split"), 2)
        out += [whole, _dealt(sided)]
    return reduce(DataFrame.union, out), crowded


def _apart(crowded: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, n, comp): the members of crowded buckets that hold several components still."""
    rows = crowded.select("path", "key", "id", "n").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    groups = rows.groupBy("path", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).filter("c0 != c1")
    groups = written(groups.select("path", "key", "size"), "apart")
    return written(joined_hot(rows, groups, ["path", "key"], "size", ["id"], SPREAD).select("id", "n", "comp").distinct(), "apart")


def _by_shingles(apart: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (id, n, comp) -> _PLACE: every pair of different components that reaches the threshold shares a group.

    Shingles are ordered by how many of these sets hold them, rarest first. Two sets that share 0.75 of their union share one of
    the first n - ceil(0.75 n) + 1 shingles of each, n being its size: the first that they share has all others behind it.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("t")).join(written(apart.select("id").distinct(), "need"), "id", "left_semi")
    with small_batches(docs.sparkSession):
        shingles = written(text.mapInArrow(_shingles, "id long, set long, n long, g long"), "shingles")
    # shingles of one set only come before all others and can't be shared
    shared = written(shingles.groupBy("g").agg(F.count("*").alias("times")).filter("times > 1"), "shared")
    of_set = W.partitionBy("id", "set")
    ranked = joined_hot(shingles, shared, ["g"], "times", ["id"]).withColumns({"r": F.row_number().over(of_set.orderBy("times", "g")), "k": F.count("*").over(of_set)})
    first = written(ranked.filter(F.col("r") <= F.col("k") - F.ceil(F.col("n") * NUM / DEN) + 1).select("id", "g").distinct(), "first")
    remove(shingles, shared)
    # the path of band 0: no band comes before it
    whole, sided = _groups(written(first.join(apart, "id").select(F.lit("0").alias("path"), F.col("g").alias("key"), "id", "n", "comp"), "split"), 2)
    return whole.union(_dealt(sided))


def _confirmed(rest: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The links (a, b) between components among rows _PLACE: signatures first, then full sets."""
    shape, block = classes.select("id", "n", "sig", "bands"), ["path", "key", "i", "j"]
    places = "path string, key long, i int, j int, left boolean, right boolean, major boolean, id long, comp long"
    rest = written(rest.join(shape, "id").groupBy(*block).applyInPandas(_with_partner, places), "rest")
    if rest.isEmpty():
        return rest.select(F.col("id").alias("a"), F.col("id").alias("b"))
    full = rest.join(shape, "id").join(_full_sets(rest.select("id"), docs), "id")
    return written(full.groupBy(*block).applyInPandas(_block_links, "a long, b long").distinct(), "found")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, comp): connected components by alternating large-star and small-star. The tables of a round are removed after the next."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        # large-star: every larger neighbour of u is linked to u's smallest neighbour
        both = now.union(now.select("v", "u"))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "low")
        large = joined_hot(both.filter("v > u"), low, ["u"], "n", ["v"], SPREAD).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        # small-star: u and its smaller neighbours are linked to the smallest of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v")
        after = written(small.distinct(), "edges")
        remove(now, low, large, least)
        now, state = after, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id")
        before = state


def find_near(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    with small_batches(docs.sparkSession):
        sketch = written(read.mapInArrow(_sketches, _SKETCH), "sketch")
    linkable = sketch.filter("set_id is not null and doc_id is not null")
    members = written(linkable.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")), "sets")
    # a class is its first document: with doc_id in the key a set that many share is no hot key
    first = members.select("set_id", F.col("id").alias("doc_id"), "n")
    classes = linkable.join(first, ["set_id", "doc_id"]).dropDuplicates(["set_id", "doc_id"])
    classes = written(classes.select(F.col("doc_id").alias("id"), "n", "sig", "bands"), "classes")

    rows = classes.select("id", "n", F.posexplode("bands").alias("band", "key")).distinct()
    buckets = written(rows.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    rows = written(joined_hot(rows, buckets, ["band", "key"], "size", ["id"], SPREAD), "members")
    weight = written(rows.groupBy("id").agg(F.sum(F.col("size") - 1).alias("weight")), "weight")
    centre = rows.join(weight, "id").groupBy("band", "key").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("c"), F.first("size").alias("size"))
    centre = written(centre.select("band", "key", "size", (-F.col("c.id")).alias("c")), "centres")
    # of two classes always the same one is the centre, so a pair comes once
    star = written(joined_hot(rows.drop("size"), centre, ["band", "key"], "size", ["id"], SPREAD).filter("id != c").select("c", "id").distinct(), "star")
    links = _linked(star, classes, docs)
    # a doc_id that has several texts links their classes
    several = written(linkable.groupBy("doc_id").agg(F.min("set_id").alias("s0"), F.max("set_id").alias("s1")).filter("s0 != s1").select("doc_id"), "several")
    links = links.union(linkable.join(several, "doc_id").join(members, "set_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")))
    links = written(links, "links")
    comps = written(components(links), "comps")

    rows = rows.join(comps, "id", "left").select("band", "key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    rest, crowded = _blocks(written(rows, "rows"), classes)
    found = _confirmed(rest, classes, docs)
    if not found.isEmpty():
        links = links.union(found)
        comps = written(components(links), "comps")
    if not crowded.isEmpty():
        apart = _apart(crowded, comps)
        found = _confirmed(_by_shingles(apart, docs), classes, docs)
        if not found.isEmpty():
            comps = written(components(links.union(found)), "comps")

    named = members.join(comps, "id", "left").select("set_id", "copies", F.coalesce("comp", "id").alias("component_id"))
    found = joined_hot(linkable.select("doc_id", "n_shingles", "set_id"), written(named, "named"), ["set_id"], "copies", ["doc_id"], SPREAD)
    alone = sketch.filter("set_id is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id").unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns."""
    gone = written(find_near(docs).filter("not kept").select(F.col("doc_id").alias("__pm_id")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__pm_id"), "left_anti").select(docs.columns)


#: All links from an inverted list of shingles, then the smallest doc_id reachable.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS reached FROM d UNION SELECT r.id, u.b FROM r JOIN u ON r.reached = u.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
