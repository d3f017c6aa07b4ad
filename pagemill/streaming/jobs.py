"""Structured Streaming jobs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.functions.text import slugify
from pagemill.functions.urls import site_folder
from pagemill.operators.html_nodes import article_columns, parsed_pages
from pagemill.operators.requests import accept
from pagemill.operators.versions import page_signature


def stream_rate_limit(requests: DataFrame, window_s: float = 60, max_requests: int = 8, late: str = "10 minutes") -> DataFrame:
    """The rate limit on a stream; a user's state is the accepted times of the window, and a timer drops it after that.

    Rows later than the watermark are dropped; it begins at the epoch. Of a batch, a user's rows are judged in time order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        pdf, out = pd.concat(list(batches)).sort_values(["us", "event_id"]), []
        for us, event_id in zip(pdf["us"], pdf["event_id"], strict=True):
            ok, wait, taken = accept(us / 1e6, taken, window_s, max_requests)
            out.append((key[0], event_id, ok, wait))
        state.update((taken,))
        ends = int((max(taken, default=0) + window_s) * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "retry_after_s"])

    rows = requests.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, allowed boolean, retry_after_s long", "taken array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_ttl_cache(requests: DataFrame, ttl_s: float = 21600, late: str = "10 minutes") -> DataFrame:
    """The cache rule on a stream; a key's state is when its entry ends, and a timer drops it after that.

    Rows later than the watermark are dropped; it begins at the epoch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        pdf, out = pd.concat(list(batches)).sort_values(["us", "event_id"]), []
        for us, event_id in zip(pdf["us"], pdf["event_id"], strict=True):
            hit = until is not None and us < until
            until = until if hit else us + int(ttl_s * 1e6)
            out.append((key[0], event_id, hit))
        state.update((until,))
        state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "event_id", "hit"])

    rows = requests.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, event_id long, hit boolean", "until long", "append", GroupStateTimeout.EventTimeTimeout)


VERSION = "site string, slug string, collected_at timestamp, url string, article_title string, content string, description string, published_at string, signature string"


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def article_rows(pages: DataFrame, collected_at: Column) -> DataFrame:
    """Rows of captures; the signature also covers the ordered blocks with their links, tables and images. A column collected_at of `pages` goes before the one given."""
    at = F.coalesce(F.col("collected_at").cast("timestamp"), collected_at) if "collected_at" in pages.columns else collected_at
    # the time takes the place of page_id through the parser, so that nothing has to be joined or written for it
    df = article_columns(parsed_pages(pages.select(F.unix_micros(at.cast("timestamp")).alias("page_id"), "url", "html")), blocks=True)
    df = df.select(site_folder(F.col("url")).alias("site"), slugify(F.col("article_title")).alias("slug"), F.timestamp_micros("page_id").alias("collected_at"), "url", "article_title", F.col("article_body_text").alias("content"), "description", "published_at", "content_blocks")
    return df.withColumn("signature", page_signature("url", "article_title", "description", "content", "content_blocks", "published_at")).drop("content_blocks")


class LatestSignature(StatefulProcessor):
    """Of a URL's rows those that differ from the row before; the state is the signature of the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "signature string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((initialState["signature"].iat[0],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["collected_at", "signature"], kind="stable")
        before = pdf["signature"].shift()
        before.iloc[0] = self.last.get()[0] if self.last.exists() else None
        self.last.update((pdf["signature"].iat[-1],))
        yield pdf[pdf["signature"] != before].drop(columns="key")

    def close(self) -> None:
        pass


def incremental_extract(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Captures are extracted, and each that differs from the one before of its URL is a new version in target.

    An article is its URL: pages with equal titles stay apart, and `assign_article_dirs` names them when they are exported. Captures
    of one URL in one batch are compared in the order of collected_at. The signature last seen of each URL is keyed state (on disk,
    changes only are saved), so a batch touches the state of its own URLs, however much is stored; a new checkpoint takes the
    signatures once from what target holds. A batch writes a folder of its own, so run twice it writes the same.
    """
    spark, run, columns = stream.sparkSession, zlib.crc32(checkpoint.encode()), [c.split()[0] for c in VERSION.split(", ")]
    spark.createDataFrame([], f"{VERSION}, batch string").write.mode("ignore").partitionBy("batch").parquet(target)
    # a null URL is a key of its own
    key = F.coalesce("url", F.lit("")).alias("key")
    stored = spark.read.schema(VERSION).parquet(target).groupBy(key).agg(F.max_by("signature", F.struct("collected_at", "signature")).alias("signature"))
    rows = article_rows(stream, F.current_timestamp()).select(key, *columns)
    new = rows.groupBy("key").transformWithStateInPandas(LatestSignature(), VERSION, "Append", "None", stored.groupBy("key"))

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={run}-{epoch}")

    # the query takes these when it starts; the session has its own again after that
    own = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
