"""Labelled findings for secret scans: made texts in which one candidate is known to be a secret or not.

Values come from hashes of the row number and a seed, names and sentences from short lists, so the
same size and seed give the same table. Column expressions over spark.range make all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import written

#: Words around findings, names that announce a secret and names that don't.
WORDS = "red river mountain coffee winter garden silver harbor candle maple velvet planet forest window yellow orange little thunder summer bridge castle dragon guitar monkey paper rocket".split()
PROSE = ["we set", "deploy with", "then run", "please note", "in the config", "the server reads", "und dann", "le fichier", "", "see also", "thing the of", "as before"]
SECRET_NAMES = ["token", "secret", "password", "api_key", "apiKey", "client_secret", "db_password", "dbPassword", "AWS_SECRET_ACCESS_KEY", "auth_token", "private-key", "pwd", "x-api-key", "secret_key", "access_key", "api-key", "auth", "credential", "PASSWD"]
DIGEST_NAMES = ["commit", "sha256", "md5", "checksum", "etag", "digest", "integrity", "revision", "uuid", "request_id", "build", "fingerprint", "commit-id", "trace_id", "cache_hash", "object_id"]
WORD_NAMES = ["token_type", "secret_name", "password_field", "auth_url", "api_key_name", "token_file", "passwordPolicy", "credential_path", "auth_method", "pwd_dir"]
STAND_INS = ["changeme", "change_me", "your-token-here", "your_api_key", "<your-api-key>", "xxxxxxxxxxxx", "${DB_PASSWORD}", "{{secret}}", "example-password", "REPLACE_ME", "************", "insert-key-here", "placeholder", "dummy-secret", "sample_token", "redacted", "required", "undefined", "%(password)s", "$SECRET_KEY", "default-password", "AAAAAAAAAAAAAAAA"]
AMOUNT_NAMES = ["tokens", "max_tokens", "token_count", "password_min_length", "tokenLimit", "secret_ttl", "auth_timeout", "numTokens", "token_expires_in", "auth-max-age-seconds"]
VERBS, KINDS = ["get", "load", "read", "prompt", "fetch", "find", "make"], ["Token", "Provider", "Auth", "Store", "Scheme", "Helper", "Factory", "Password"]
GOODS, SCHEMES = ["sku", "part no.", "IBAN", "model", "invoice", "order", "serial", "batch", "plate"], ["postgres", "mysql", "https", "redis", "amqp", "mongodb+srv", "ftp", "smtp"]
PLACES = ["example.com", "mail3.example.org", "corp.net", "uni-x.edu"]


def _pick(items: list[str], salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(items))) + 1).cast("int"))


def _below(n: int, salt: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))


def _hex(n: int, salt: str) -> Column:
    return F.left(F.sha2(F.concat("id", F.lit(salt)), 256), F.lit(n))


def _base64(n: int, salt: str) -> Column:
    return F.left(F.base64(F.unhex(F.concat(_hex(64, salt), _hex(64, salt + "+")))), F.lit(n))


def _alnum(n: int, salt: str) -> Column:
    return F.left(F.regexp_replace(_base64(80, salt), "[^A-Za-z0-9]", ""), F.lit(n))


def _letters(n: int, salt: str) -> Column:
    return F.left(F.regexp_replace(_base64(80, salt), "[^A-Za-z]", ""), F.lit(n))


def _uuid(salt: str) -> Column:
    h = _hex(32, salt)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _number(n: int, salt: str) -> Column:
    return F.left(F.regexp_replace(F.concat(_hex(64, salt), _hex(64, salt + "+")), "[^0-9]", ""), F.lit(n))


def _cases(column: Column, values: list[Column]) -> Column:
    out = F.when(column == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(column == k, v)
    return out


def _value() -> Column:
    """A secret: random characters of several alphabets, made-up passwords, joined words."""
    word = lambda salt: _pick(WORDS, salt)
    mixed = F.concat(F.initcap(word("v1")), _number(3, "v2"), _pick(["!", "#", "$", "&", "!x", "@q"], "v3"), word("v4"), _number(2, "v5"))
    return _cases(_below(13, "value"), [
        _hex(40, "a"), _hex(32, "b"), _alnum(24, "c"), _alnum(32, "d"), _base64(44, "e"), mixed, _letters(24, "f"), F.concat(word("w1"), word("w2"), word("w3"), word("w4")), F.concat(word("w5"), _number(2, "g"), word("w6")),
        F.concat(_letters(4, "h"), _number(2, "i"), F.lit("-"), _letters(3, "j"), F.lit("!"), _number(2, "k")), _alnum(40, "l"), F.concat(F.left(word("w7"), F.lit(3)), F.lit("-"), _letters(3, "m"), F.lit("-"), _number(1, "n")), F.concat(word("w8"), F.lit("-"), word("w9"), F.lit("-"), _number(1, "n1"), F.lit("-"), word("w0")),
    ])


def _token() -> Column:
    upper = F.upper(_alnum(16, "t1"))
    part = lambda salt, n: F.concat(F.lit("eyJ"), F.translate(_base64(n, salt), "+/=", "-_"))
    web = F.concat_ws(".", part("t7", 33), part("t8", 60), F.translate(_base64(43, "t9"), "+/=", "-_"))
    return _cases(_below(7, "token"), [F.concat(F.lit("AKIA"), upper), F.concat(F.lit("ghp_"), _alnum(36, "t2")), F.concat(F.lit("sk_live_"), _alnum(24, "t3")), F.concat(F.lit("xoxb-"), _number(12, "t4"), F.lit("-"), _alnum(24, "t5")), F.concat(F.lit("AIza"), _alnum(35, "t6")), web, web])


def _assigned(name: Column, value: Column) -> Column:
    """The ways in which a value is written beside its name."""
    return _cases(_below(7, "form"), [
        F.concat(name, F.lit(' = "'), value, F.lit('"')), F.concat(name, F.lit(": "), value), F.concat(name, F.lit("="), value), F.concat(F.lit('{"'), name, F.lit('": "'), value, F.lit('"}')),
        F.concat(name, F.lit(" = '"), value, F.lit("'")), F.concat(F.lit("url?"), name, F.lit("="), value, F.lit("&page=2")), F.concat(name, F.lit(': "'), value, F.lit('",')),
    ])


def _plain() -> Column:
    """Strings that are found for their digits alone and are no secrets."""
    word = lambda salt: _pick(WORDS, salt)
    return _cases(_below(9, "plain"), [
        F.concat(word("p1"), F.lit("."), _number(2, "p2"), F.lit("."), word("p3"), F.lit("@"), _pick(PLACES, "p4")), F.concat(F.lit("docs/"), word("p5"), F.lit("/20"), _number(2, "p6"), F.lit("/"), word("p7"), F.lit("-v2.pdf")),
        F.concat(F.lit("image_20"), _number(2, "p8"), F.lit("_"), word("p9"), F.lit("_final.png")), _number(18, "q1"), F.concat(F.lit("2024-0"), _below(9, "q2") + 1, F.lit("-1"), _number(1, "q3"), F.lit("-10-30-00")),
        F.concat(word("q4"), F.lit("-cluster-"), word("q5"), F.lit("-"), _number(2, "q6")), F.concat(word("q7"), F.lit("_"), word("q8"), F.lit("_form_"), _number(1, "q9")), _hex(40, "r1"), _uuid("r2"),
    ])


def _code() -> Column:
    """What code assigns to a secret name: calls (up to their bracket), members, names of classes and functions."""
    word, big = lambda salt: _pick(WORDS, salt), lambda salt: F.initcap(_pick(WORDS, salt))
    verb, kind = _pick(VERBS, "c1"), _pick(KINDS, "c2")
    return _cases(_below(5, "code"), [
        F.concat(word("c3"), F.lit("."), verb, F.lit("(")), F.concat(verb, big("c4"), kind, F.lit("(")), F.concat(big("c5"), kind, big("c6")), F.concat(word("c7"), F.lit("."), word("c8"), F.lit("_"), F.lower(kind)), F.concat(verb, F.lit("_"), word("c9"), F.lit("(")),
    ])


def _product() -> Column:
    """Numbers of goods and papers, hashes with their kind before them, and long names of classes with a digit."""
    upper = lambda n, salt: F.upper(_alnum(n, salt))
    big = lambda salt: F.initcap(_pick(WORDS, salt))
    return _cases(_below(6, "product"), [
        F.concat(upper(16, "g1"), _number(3, "g2")), F.concat(upper(2, "g3"), _number(20, "g4")), F.concat(upper(3, "g5"), _number(2, "g6"), F.lit("-"), upper(5, "g7"), F.lit("-"), _number(4, "g8"), F.lit("-"), upper(4, "g9")),
        F.concat(_number(4, "h1"), upper(13, "h2")), F.concat(_pick(["sha256-", "sha512-", "sha384-", "md5-"], "h3"), _base64(44, "h4")), F.concat(big("h5"), big("h6"), _pick(KINDS, "h7"), _number(1, "h8"), _pick(KINDS, "h9"), big("h0")),
    ])


def _login(value: Column) -> Column:
    return F.concat(_pick(SCHEMES, "o1"), F.lit("://"), _pick(["", "admin", "svc", "root"], "o2"), F.lit(":"), value, F.lit("@"), _pick([*PLACES, "db:5432", "localhost"], "o3"), _pick(["", "/app", "/0", ":99/x?y=1"], "o4"))


def made_findings(spark: SparkSession, size: int, seed: int = 0) -> DataFrame:
    """id, text, candidate, label (1 secret, 0 not): half of each."""
    df = spark.range(size).select((F.col("id") + seed * 1_000_003).cast("string").alias("id"), "id").toDF("key", "row").select(F.col("key").alias("id"), "row")
    secret, digest = _pick(SECRET_NAMES, "name"), _pick(DIGEST_NAMES, "name")
    hashed = _cases(_below(4, "hashed"), [_hex(40, "s1"), _hex(64, "s2"), _uuid("s3"), _base64(44, "s4")])
    worded = _cases(_below(4, "worded"), [
        F.concat(_pick(WORDS, "u1"), F.lit("_"), _pick(WORDS, "u2")), F.concat(F.lit("/etc/"), _pick(WORDS, "u3"), F.lit("/"), _pick(WORDS, "u4"), F.lit(".txt")), F.concat(F.lit("https://"), _pick(PLACES, "u5"), F.lit("/"), _pick(WORDS, "u6")), F.concat(_pick(WORDS, "u7"), F.lit("@"), _pick(PLACES, "u8")),
    ])
    kind = F.col("row") % 16
    # 0 to 4 a named secret, 5 and 6 a published token, 7 a password in a URL; 8 and 9 a digest, 10 a stand-in, 11 words, 12 code, 13 an amount, 14 and 15 found for their digits alone
    plain = F.when(_below(2, "which") == 0, _plain()).otherwise(_product())
    value = F.when(kind < 5, _value()).when(kind < 7, _token()).when(kind == 7, F.translate(_value(), "/@", "")).when(kind < 10, hashed).when(kind == 10, _pick(STAND_INS, "stand")).when(kind == 11, worded)
    value = value.when(kind == 12, _code()).when(kind == 13, _number(9, "amount")).otherwise(plain)
    named = F.when((kind < 5) | (kind == 10) | (kind == 12), secret).when(kind < 10, digest).when(kind == 13, _pick(AMOUNT_NAMES, "name")).otherwise(_pick(WORD_NAMES, "name"))
    # the values are used many times below: written, they are made once
    df = written(df.select("id", kind.alias("kind"), value.alias("value"), named.alias("named"), digest.alias("digest")), "values")
    kind, v, named, digest = (F.col(c) for c in ("kind", "value", "named", "digest"))
    bare = _cases(_below(3, "bare"), [F.concat(F.lit("use "), v), F.concat(F.lit("see "), v, F.lit(", thanks")), F.concat(_pick(WORDS, "x1"), F.lit(" "), v, F.lit("."))])
    goods = F.concat(_pick(GOODS, "x2"), _pick([" ", ": ", " is "], "x3"), v)
    called = F.concat(named, _pick([" = ", "=", ": "], "x4"), v, F.when(F.endswith(v, F.lit("(")), _pick([")", "'db')", '"X-Y")'], "x5")).otherwise(_pick(["", ";", ","], "x6")))
    said = F.when((kind == 7) | ((kind == 10) & (_below(4, "login") == 0)), _login(v)).when(kind == 12, called)
    said = said.when((kind == 9) & (_below(2, "said") == 0), F.concat(digest, F.lit(" "), v)).when((kind >= 14) & (_below(2, "goods") == 0), goods)
    said = said.when((kind == 5) | (kind == 6) | (kind >= 14), bare).otherwise(_assigned(named, v))
    text = F.concat_ws(" ", _pick(PROSE, "y1"), _pick(WORDS, "y2"), said, _pick(PROSE, "y3"))
    # of an e-mail address only the part before the @ is found by its digits
    found = F.when((kind >= 14) & F.contains(v, F.lit("@")), F.substring_index(v, "@", 1)).otherwise(v)
    return df.select("id", text.alias("text"), found.alias("candidate"), (kind < 8).cast("int").alias("label"))
