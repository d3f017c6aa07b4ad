"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager
from functools import cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a class body for Java, RE2 and Python.
WS = r"\x20\x09-\x0D"
WORD = f"[^{WS}]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one serves a single machine; a cluster gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _temporary()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and its size is known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagemill-{label}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def joined_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, spread: list[str], hot: int = 1 << 16) -> DataFrame:
    """left joined with the one row that each key has in `right`, whose column `count` says how many rows of left have it.

    Keys with more than `hot` rows are dealt by a hash of `spread`, about `hot` rows a task, and their row of `right` is
    repeated for each part. `right` must be a written table: the list of hot keys has at most rows / hot rows, and Spark
    broadcasts it if its size allows.
    """
    parts = F.ceil(F.col(count) / hot).cast("int")
    many = right.filter(F.col(count) > hot).select(*keys, parts.alias("__parts"))
    if many.isEmpty():
        return left.join(right, keys)
    dealt = left.join(many, keys, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    copies = right.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [*keys, "__part"]).drop("__part")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20):
    """Python workers get batches of at most `rows` rows and about `size` bytes while this holds: whole texts are large rows."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {key: spark.conf.get(key, None) for key in new}
    for key, value in new.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def fitting_sample(df: DataFrame, rows: int, size: int, seed: int) -> DataFrame:
    """At most `size` of about `rows` rows, by hash of doc_id: what models are fitted on.

    A first cut by hash keeps what the tasks send for the ordering near `size` in all, however many they are.
    """
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    cut = df if rows <= 2 * size else df.filter(F.pmod(h, F.lit(2**30)) < int(2**30 * 1.5 * size / rows))
    return cut.orderBy(h, "doc_id").limit(size)


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
