"""The frontier as a stream: exact-within-watermark dedupe, politeness state and crawl telemetry."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def frontier_source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Frontier rows dropped as JSON files in a folder; the bound on files per trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def dedupe(urls: DataFrame, key: str = "full_url", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each URL once within the watermark; state older than ``delay`` is dropped."""
    return urls.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def paced(urls: DataFrame, domain: str = "domain", per_batch: int = 5, delay: float = 1.0, ts: str | None = None, idle: str = "1 hour") -> DataFrame:
    """(domain, full_url, turn, due): each domain's URLs numbered across batches, ``per_batch`` to a turn, so no domain takes more than its share of a turn.

    ``due`` is when a URL may be fetched, in seconds since the epoch: ``delay`` after the turn before it. With an event time ``ts`` a
    domain that is silent for ``idle`` is forgotten, and time is that of the events; without one its count stays, and time is the clock's.
    """
    number, unit = idle.split()
    forget = int(float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, free = state.get if state.exists else (0, 0.0)
        latest = 0.0
        for pdf in frames:
            pdf = pdf.sort_values("full_url")
            latest = max(latest, pdf[ts].max().timestamp()) if ts else time.time()
            turn, begun = (n + pd.RangeIndex(len(pdf)).to_numpy()) // per_batch, max(latest, free)
            yield pd.DataFrame({"domain": key[0], "full_url": pdf["full_url"].to_numpy(), "turn": turn, "due": begun + delay * (turn - n // per_batch)})
            free = begun + delay * ((n + len(pdf)) // per_batch - n // per_batch)
            n += len(pdf)
        state.update((n, free))
        if ts:
            state.setTimeoutTimestamp(max(int(latest * 1000), state.getCurrentWatermarkMs()) + forget)

    kept = urls.withWatermark(ts, idle) if ts else urls
    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return kept.groupBy(domain).applyInPandasWithState(run, "domain string, full_url string, turn bigint, due double", "n bigint, free double", "append", timeout)


def telemetry(events: DataFrame, width: str = "1 hour", slide: str | None = None, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Fetches, failures and bytes by window; the same call serves batch and stream."""
    if delay:
        events = events.withWatermark(ts, delay)
    w: Column = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.sum("value").alias("bytes")).select(F.col("w.start").alias("start_ts"), "n_events", "n_failed", "bytes")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Runs of activity that a pause of ``gap`` ends."""
    if delay:
        events = events.withWatermark(ts, delay)
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_events")


def quiet(events: DataFrame, limit: str = "30 minutes", key: str = "project", ts: str = "ts") -> DataFrame:
    """(key, ended): projects whose last operation lies more than ``limit`` before the newest of all; they have timed out."""
    last = events.groupBy(key).agg(F.max(ts).alias("last"))
    newest = events.agg(F.max(ts).alias("now"))
    return last.join(F.broadcast(newest)).where(F.expr(f"now - INTERVAL {limit} > last")).select(key, F.expr(f"last + INTERVAL {limit}").alias("ended"))
