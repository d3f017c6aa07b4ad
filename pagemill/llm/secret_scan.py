"""Secret scans with a random forest that removes false positives.

Candidates are values of 6 or more characters, of any kind, that a secret name is assigned, and
anywhere published tokens and strings of 16 or more characters with a digit. A name may have digits,
dots, hyphens and a closing quote, at any length. A quoted value with a blank is no candidate by its
name, and an inner quote of the same kind ends a value. A candidate keeps up to NEAR characters of
text on either side. What stands for a password before the @ of a URL is a candidate too, named LOGIN_NAME.

Features: length, character transitions, shares of distinct characters, digits, vowels and capitals,
the share of the candidate that are dictionary words, hexadecimal, path, e-mail, placeholder, number,
code, product-number and published-token form, the assigned name (secret, digest or amount words),
quotes, and the three words before and after (secret, digest, example words). The dictionary is the
whole words of a public vocabulary file, read by the driver (some 25,000 words).

The forest, MLlib's, is trained from a table of labelled findings (text, candidate, label), given or
else made by `secret_findings` (LABELLED of them), and its score alone decides. Nothing is learned
from the corpus, so a finding's score depends on its own text alone. Everything runs in the JVM.

Results for odd input: null or empty text has no candidates; equal candidates in a document are
each returned; repeated rows are scanned each on its own; a null doc_id is kept; a very long text is
scanned whole, as one row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import joined_hot, text_of, written
from pagemill.llm.secret_findings import made_findings

LABELLED, TREES, DEPTH, THRESHOLD, NEAR = 4000, 24, 8, 0.5, 60
CHARS, NAME, QUOTE = r"A-Za-z0-9_+/.=-", r"A-Za-z0-9_.-", "[\"'`]"
_EDGE, _EDGE_AFTER = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))", r"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
#: Words of names that announce a secret, and published token formats.
_WORD = rf"{_EDGE}(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)(?i:s?){_EDGE_AFTER}"
TOKENS = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}+[.]eyJ[A-Za-z0-9_-]{8,}+[.][A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])"
NAMES = rf"^[{NAME}]*?{_WORD}"
_ASSIGN = rf"\\{{0,2}}{QUOTE}?\s{{0,3}}[=:]{{1,3}}>?\s{{0,3}}\\{{0,2}}"
#: A secret name with any value of 6 or more characters: quoted (3 to 5), or bare up to a blank, a quote, closing marks or the next assignment (6).
ASSIGNED = (
    rf"(?<![{NAME}])(?=[{NAME}]++{_ASSIGN})(?=[{NAME}]*?{_WORD})([{NAME}]++){_ASSIGN}(?:({QUOTE})"
    r"""(?:(?<=")([^\s"]{6,}?)\\{0,2}"|(?<=')([^\s']{6,}?)\\{0,2}'|(?<=`)([^\s`]{6,}?)\\{0,2}`)|"""
    rf"""([^\s"'`]{{6,}}?)(?=[.,;:)\]}}>]{{0,4}}(?:[\s"'`\\]|\z)|[&;,][{NAME}]+[=:]))"""
)
#: A URL with a password before its host.
LOGIN, LOGIN_NAME = r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s:/@"'`]*+:([^\s/@"'`]{6,}+)@""", "userinfo-password"
#: A published token, or 16 or more characters with a digit among them, whatever name is before them.
FOUND = rf"""(?<![{CHARS}@])(?:([A-Za-z_][{NAME}]*+){_ASSIGN}({QUOTE}?))?({TOKENS}|(?=[{CHARS}]*[0-9])[{CHARS}]{{16,}})({QUOTE}?)(@?)"""
_MAIL = "^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$"
VOCABULARY = "word_bpe_49k.json"
#: Forms of stand-ins, words for what only looks like a secret, and words of made-up texts.
PLACEHOLDER = r"(?i)change_?me|your[_-]|[_-]here|example|placeholder|replace|insert|dummy|sample|redacted|default|todo|^(?:null|none|true|false|undefined|required|optional|string|password|passwd|secret)$|x{4}|\*{3}|[.]{3}|^[$<{%(]|^(.)\1+$"
DIGEST = r"(?i)commit|sha-?[0-9]|md5|checksum|crc|hash|digest|etag|integrity|revision|(?<![a-z])rev(?![a-z])|uuid|guid|build|version|serial|fingerprint|file|path|url|uri|dir|name|type|field|policy|id[0-9]?$"
#: Words of names that hold amounts; forms of code (a call, a member, an index, a class or function name), of hashes with their kind, and of product numbers.
AMOUNT = r"(?i)(?:^|[^a-z])(?:max|min|num|total)(?![a-z])|count|limit|length|size|ttl|expir|timeout|seconds|minutes|days|tokens$"
CODE = r"[(\[]|->|::|^[A-Za-z_]\w*+(?:[.][A-Za-z_]\w*+){1,8}$|^[A-Z]*+[a-z]++[0-9]?+(?:[A-Z]++[a-z]++[0-9]?+){1,12}$"
HASHED, PRODUCT = r"^(?i:sha-?[0-9]+|md5)[-:=]", r"^(?=[^0-9]*[0-9])[A-Z0-9][A-Z0-9./-]*$"
MADE_UP = "(?i)example|sample|dummy|fake|test|placeholder|template|documentation"
_ANY_WORD = "(?i)(?<![a-z])(?:token|secret|password|passwd|pwd|api[ _-]?key|key|credential|auth|login)"
_SEGMENT = "[A-Z]?[a-z]{2,}|[A-Z]{3,}"
FEATURES = [
    "length", "transitions", "distinct", "coverage", "digits", "vowels", "capitals", "hex", "uuid", "path", "token", "placeholder", "mail", "named", "digest", "assigned", "quoted",
    "number", "code", "hashed", "product", "amount",
    "before_secret", "before_digest", "before_made_up", "after_digest", "after_made_up",
]


def _hits(texts: DataFrame, text: Column, pattern: str) -> DataFrame:
    """doc_id, hit, before, after: matches in order, with the text around them up to the next match."""
    df = texts.select("doc_id", text.alias("x")).select("doc_id", "x", F.regexp_extract_all("x", F.lit(pattern), F.lit(0)).alias("hits"))
    df = df.filter(F.size("hits") > 0).select("doc_id", "hits", F.split("x", pattern, -1).alias("gaps"))
    df = df.select("doc_id", "gaps", F.posexplode("hits").alias("i", "hit"))
    return df.select("doc_id", "hit", F.right(F.get("gaps", F.col("i")), F.lit(NEAR)).alias("before"), F.left(F.get("gaps", F.col("i") + 1), F.lit(NEAR)).alias("after"))


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, candidate, name, q1, q2, at, before, after: one row per candidate."""
    texts = docs.select("doc_id", text_of().alias("t"))
    part = lambda i: F.regexp_extract("hit", ASSIGNED, i)
    around = ["before", "after"]
    none = F.lit("")
    logins = _hits(texts.filter(F.contains("t", F.lit("://"))), F.col("t"), LOGIN).select("doc_id", F.lit(LOGIN_NAME).alias("name"), none.alias("q1"), F.regexp_extract("hit", LOGIN, 1).alias("candidate"), none.alias("q2"), none.alias("at"), *around)
    texts = texts.withColumn("t", F.when(F.contains("t", F.lit("://")), F.regexp_replace("t", LOGIN, "\n")).otherwise(F.col("t")))
    assigned = _hits(texts, F.col("t"), ASSIGNED).select("doc_id", part(1).alias("name"), part(2).alias("q1"), F.concat(*map(part, range(3, 7))).alias("candidate"), part(2).alias("q2"), F.lit("").alias("at"), *around)
    seen = lambda i: F.regexp_extract("hit", FOUND, i)
    rest = _hits(texts, F.regexp_replace("t", ASSIGNED, "\n"), FOUND)
    return logins.union(assigned).union(rest.select("doc_id", seen(1).alias("name"), seen(2).alias("q1"), seen(3).alias("candidate"), seen(4).alias("q2"), seen(5).alias("at"), *around))


def described(found: DataFrame) -> DataFrame:
    """Adds all features but the dictionary's to rows of found_in."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda chars: F.regexp_count(c, F.lit(f"[{chars}]")) / n
    before = F.regexp_extract("before", r"((?:\S+\s+){0,2}\S*)\s*$", 1)
    after = F.regexp_extract("after", r"^\S*\s*((?:\S+\s*){0,3})", 1)
    told = lambda text, pattern: text.rlike(pattern).cast("double")
    return found.withColumns({
        "length": n, "transitions": F.regexp_count(c, F.lit(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]")) / n, "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": share("0-9"), "vowels": share("aeiouyAEIOUY"), "capitals": share("A-Z"), "hex": told(c, "^[0-9a-fA-F]+$"), "uuid": told(c, "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"),
        "path": told(c, r"/.*/|^https?:|\.[a-z]{2,5}$|^\.{1,2}/|^/"), "token": told(c, f"^{TOKENS}"), "placeholder": told(c, PLACEHOLDER),
        "mail": ((F.col("at") != "") | c.rlike(_MAIL)).cast("double"), "named": told(F.col("name"), NAMES), "digest": told(F.col("name"), DIGEST), "assigned": (F.col("name") != "").cast("double"),
        "quoted": ((F.col("q1") != "") & (F.col("q1") == F.col("q2"))).cast("double"), "before_secret": told(before, _ANY_WORD), "before_digest": told(before, DIGEST), "before_made_up": told(before, MADE_UP),
        "number": told(c, r"^[0-9][0-9.,_]*$"), "code": told(c, CODE), "hashed": told(c, HASHED), "product": told(c, PRODUCT), "amount": told(F.col("name"), AMOUNT),
        "after_digest": told(after, DIGEST), "after_made_up": told(after, MADE_UP),
    })


def dictionary(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word): whole words of 3 or more letters of a public vocabulary file, which the driver reads."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        words = [w[:-4] for w in json.load(f)["model"]["vocab"] if w.endswith("</w>")]
    words = [w for w in words if len(w) >= 3 and w.isascii() and w.isalpha()]
    return spark.sql("SELECT explode(split(:words, ' ')) AS word", args={"words": " ".join(words)}).distinct()


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds coverage: the share of a candidate's characters in runs of letters that are dictionary words. `found` is a written table."""
    values = found.groupBy("candidate").agg(F.count("*").alias("__n"))
    runs = values.select("candidate", F.explode(F.regexp_extract_all("candidate", F.lit(_SEGMENT), F.lit(0))).alias("run"))
    known = runs.join(words, F.lower("run") == F.col("word")).groupBy("candidate").agg(F.sum(F.length("run")).alias("known"))
    share = values.join(known, "candidate", "left").select("candidate", "__n", (F.coalesce("known", F.lit(0)) / F.length("candidate")).alias("coverage"))
    return joined_hot(found, written(share, "coverage"), ["candidate"], "__n", ["doc_id", "name"]).drop("__n")


def candidates(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """doc_id, candidate, name and the features: one row per candidate."""
    found = written(found_in(docs), "candidates")
    return described(with_coverage(found, dictionary(docs.sparkSession) if words is None else words)).select("doc_id", "candidate", "name", *FEATURES)


def trained(findings: DataFrame):
    """The forest, and the assembler before it, fitted to labelled findings (text, candidate, label)."""
    rows = findings.select(F.col("id").alias("doc_id"), "text")
    labels = findings.select(F.col("id").alias("doc_id"), F.col("candidate").alias("value"), F.col("label").cast("double").alias("label"))
    same = (F.col("value") == F.col("candidate")) | (F.col("value") == F.rtrim("candidate", F.lit(".")))
    # a text that holds its candidate twice counts once
    marked = candidates(rows).join(labels, "doc_id").filter(same).dropDuplicates(["doc_id", "value"])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    marked = vectors.transform(written(marked, "labelled"))
    return vectors, RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7).fit(marked)


def scored(found: DataFrame, findings: DataFrame) -> DataFrame:
    """candidates() with score, the forest's share of votes for a secret."""
    vectors, forest = trained(findings)
    return forest.transform(vectors.transform(found)).withColumn("score", vector_to_array("probability")[1])


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, candidate_sha256, name, length, score, secret: one row per candidate; strings are not shown."""
    known = made_findings(docs.sparkSession, LABELLED) if findings is None else findings
    out = scored(candidates(docs), known)
    return out.select("doc_id", F.sha2("candidate", 256).alias("candidate_sha256"), "name", F.col("length").cast("long").alias("length"), "score", (F.col("score") >= THRESHOLD).alias("secret"))
