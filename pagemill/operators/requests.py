"""Rules over request logs. The greedy ones go through each key's requests in time order.

A key's requests are read by one task, as the rule needs what was accepted before; they stream
through in batches and the state is at most max_requests times, so a hot key costs time, not
memory. Keys are spread over tasks by one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accept(now: float, taken: list[float], window: float, most: int) -> tuple[bool, int, list[float]]:
    """(allowed, seconds to wait, accepted times of the window) for one request."""
    live = [t for t in taken if now - t < window]
    if len(live) < most:
        return True, 0, [*live, now]
    return False, max(1, math.ceil(live[0] + window - now)), live


def _in_order(requests: DataFrame, key: str) -> DataFrame:
    """key, event_id, us: every task has whole keys, one after the other, in time order."""
    rows = requests.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.repartition(key).sortWithinPartitions(key, "us", "event_id")


def _begins(keys: pd.Series, last) -> list[bool]:
    """Whether each row is the first of its key; `last` is the key before these rows."""
    known = [None if pd.isna(k) else k for k in keys]
    return [a != b for a, b in zip([last, *known], known)]


def rate_limit(requests: DataFrame, window_s: float = 60, max_requests: int = 8) -> DataFrame:
    """user_id, event_id, allowed, retry_after_s: a request is allowed if fewer than max were accepted in the window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: list[float] = []
        last = object()
        for pdf in batches:
            out = []
            for us, first in zip(pdf["us"], _begins(pdf["user_id"], last), strict=True):
                ok, wait, taken = accept(us / 1e6, [] if first else taken, window_s, max_requests)
                out.append((ok, wait))
            if len(pdf):
                last = None if pd.isna(pdf["user_id"].iat[-1]) else pdf["user_id"].iat[-1]
            yield pdf[["user_id", "event_id"]].assign(allowed=[x[0] for x in out], retry_after_s=[x[1] for x in out])

    return _in_order(requests, "user_id").mapInPandas(run, "user_id long, event_id long, allowed boolean, retry_after_s long")


def ttl_cache_hits(requests: DataFrame, ttl_s: float = 21600) -> DataFrame:
    """key, event_id, hit: a miss fills the key for ttl seconds; a hit doesn't extend it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        until, last = 0, object()
        for pdf in batches:
            out = []
            for us, first in zip(pdf["us"], _begins(pdf["key"], last), strict=True):
                out.append(hit := not first and us < until)
                until = until if hit else us + int(ttl_s * 1e6)
            if len(pdf):
                last = None if pd.isna(pdf["key"].iat[-1]) else pdf["key"].iat[-1]
            yield pdf[["key", "event_id"]].assign(hit=out)

    return _in_order(requests, "key").mapInPandas(run, "key string, event_id long, hit boolean")


def live_entries(entries: DataFrame, now, ttl_s: int, cap: int, session: bool = False) -> DataFrame:
    """key, created_at: not expired at `now`, the newest `cap`. A cache entry ends at its ttl, a session after it."""
    ends, at = F.unix_micros(F.col("created_at").cast("timestamp")) + ttl_s * 1_000_000, F.unix_micros(now)
    return entries.filter(ends >= at if session else ends > at).orderBy(F.col("created_at").desc(), "key").limit(cap)


def live_count(entries: DataFrame, now, ttl_s: int, session: bool = False) -> DataFrame:
    """live: how many entries are not expired at `now`."""
    ends, at = F.unix_micros(F.col("created_at").cast("timestamp")) + ttl_s * 1_000_000, F.unix_micros(now)
    return entries.agg(F.count_if(ends >= at if session else ends > at).alias("live"))
