"""Readers and writers. Paths go to Spark only, so any store it knows will do."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.urls import site_folder
from pagemill.operators.versions import format_versions, site_scope

MAX_SUBTITLE_BYTES = 10 * 1024 * 1024
RUN_SCHEMA = "id string, site string, createdAt string, rootUrl string, maxPages int, crawledPages int, articleFiles int, runDir string, resultFile string"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path).select("page_id", "url", "html")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """video_id, lang, fmt, raw from files named <video>.<lang>.srt or .vtt; larger files are left out, SRT goes first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= MAX_SUBTITLE_BYTES)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    df = files.select(F.regexp_extract(name, r"^(.*)\.([^.]+)\.(srt|vtt)$", 1).alias("video_id"), F.regexp_extract(name, r"^(.*)\.([^.]+)\.(srt|vtt)$", 2).alias("lang"), F.regexp_extract(name, r"\.(srt|vtt)$", 1).alias("fmt"), F.decode("content", "UTF-8").alias("raw"))
    first = F.row_number().over(W.partitionBy("video_id", "lang").orderBy("fmt"))
    return df.filter("fmt != ''").withColumn("nth", first).filter("nth = 1").drop("nth")


def read_runs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of runs, or with `lines` what write_runs writes; a missing site is filled from the root URL; anything else gives no rows."""
    df = spark.read.schema(RUN_SCHEMA).json(path, multiLine=not lines).filter("id is not null")
    return df.withColumn("site", F.coalesce(F.nullif("site", F.lit("")), site_folder(F.col("rootUrl"))))


def write_articles(df: DataFrame, path: str, fmt: str = "parquet", files: int = 16) -> None:
    """Partitioned by site; rows of a site are dealt by their other keys over `files` tasks, so a hot site is not one file."""
    by = [c for c in ("slug", "url", "ext") if c in df.columns] or [c for c in df.columns if c != "site"]
    df.repartition("site", F.pmod(F.xxhash64(*by), F.lit(files))).write.mode("overwrite").format(fmt).partitionBy("site").save(path)


def write_runs(df: DataFrame, path: str, per_site: bool = False) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy("site") if per_site else writer).json(path)


def export_page_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


STORED = "slug string, ext string, collected_at timestamp, content string, signature string, digest string, site string"
#: Of `latest`: which run's row of `history` holds the content.
CURRENT = "slug string, ext string, collected_at timestamp, signature string, digest string, run string, site string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@contextmanager
def short_shuffles(spark: SparkSession):
    """Shuffle files go at the end of each write while this holds, not when the driver next collects garbage: contents are most of the disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


class ArticleStore:
    """Article files as two tables, `latest` (one row per article and format) and `history` (one per version), partitioned by site.

    Contents stand in `history` only, compressed with an article's formats side by side; `latest` names the run whose version is
    the newest. A run reads of `latest` the rows of its own sites only, adds its versions to `history` in a partition of its own name,
    and replaces the partitions of `latest` that it changes. Run again after a loss it writes the same: its history partition is
    overwritten, and latest is the newest of what stood there and of the run's own versions.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*("site", "run")[: 1 + (name == "history")]).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def current(self) -> DataFrame:
        """The rows of latest without contents, and the run that wrote each."""
        return self._read("latest", CURRENT)

    def latest(self) -> DataFrame:
        keys = ("site", "slug", "ext", "run")
        held = self.history().select("content", *[F.col(c).alias(f"__{c}") for c in keys])
        return self.current().join(held, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), keys, F.lit(True))).select(_names(STORED))

    def history(self) -> DataFrame:
        return self._read("history", f"{STORED}, run string")

    def _replace(self, df: DataFrame, name: str) -> None:
        """The site partitions that df has rows of; others stay untouched."""
        by = ["site", "run"] if name == "history" else ["site"]
        # formats of an article are much alike: side by side they take little more than one
        rows = df.repartition(*by, F.pmod(F.xxhash64("slug"), F.lit(16))).sortWithinPartitions(*by, "slug", "ext")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{name}")

    def publish(self, articles: DataFrame, run: str) -> None:
        """articles: site, slug, collected_at, signature, md, txt, json; one row per article. run: a name that no other run has."""
        with short_shuffles(self.spark):
            self._publish(articles, run)

    def _publish(self, articles: DataFrame, run: str) -> None:
        had, mark = self.current().join(articles.select("site").distinct(), "site", "left_semi"), F.col("run") == run
        # what this very run has stored before it was lost is no earlier version, nor is the signature that it gave to formats that stay
        again = had.filter(mark).select("site", "slug", F.lit(True).alias("__again")).distinct()
        old = had.filter(~mark).join(again, ["site", "slug"], "left").withColumn("signature", F.when(F.col("__again").isNull(), F.col("signature")))
        new = format_versions(articles, old.select("site", "slug", "ext", "signature", "digest")).withColumn("digest", F.sha2("content", 256))
        self._replace(new.withColumn("run", F.lit(run)).select(*_names(STORED), "run"), "history")
        mine = self.history().filter(mark).select(_names(CURRENT))
        touched = mine.select("site").distinct()
        # an article has one signature: of its formats that stay as they are too
        signed = mine.groupBy("site", "slug").agg(F.max("signature").alias("__new"))
        stay = self.current().join(touched, "site", "left_semi").join(mine.select("site", "slug", "ext"), ["site", "slug", "ext"], "left_anti")
        stay = stay.join(signed, ["site", "slug"], "left").withColumn("signature", F.coalesce("__new", "signature")).drop("__new")
        whole = stay.unionByName(mine)
        # Spark can't overwrite what it reads: the new partitions are written aside first
        aside = f"{self.path}/_aside-{run}"
        whole.write.mode("overwrite").parquet(aside)
        self._replace(self.spark.read.schema(whole.schema).parquet(aside), "latest")
        self._drop(aside)

    def _drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def purge(self, scope: str) -> list[str]:
        """Deletes the folders of a site, or of all sites for `all`; a scope that names no site is an error. The folders that went."""
        kinds = ("latest", "history")
        if scope.strip().lower() == "all":
            gone = [f"{self.path}/{k}" for k in kinds]
        else:
            site = self.spark.range(1).select(site_scope(F.lit(scope))).first()[0]
            if not site:
                raise ValueError("the scope is neither all nor a site")
            gone = [f"{self.path}/{k}/site={site}" for k in kinds]
        for folder in gone:
            self._drop(folder)
        return gone
