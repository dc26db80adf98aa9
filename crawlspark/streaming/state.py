"""Frontier state with timers: recently seen URLs, the end of silent projects, and requests in flight.

Each operator takes a stream and keeps one small state per key in the state store, so keys are spread over the cluster and survive lost
executors with the checkpoint. Sessions that run them need the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that timers need, for the queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ms(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _at(ts: pd.Series) -> pd.Series:
    """Milliseconds since the epoch of timestamps of any unit."""
    return ts.astype("datetime64[ms]").astype("int64")


def _texts(values: list[str]) -> pd.Series:
    return pd.Series(values, dtype=object)


def _stamp(ms: list[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(ms, unit="ms"), dtype="datetime64[ns]")


class _Recent(StatefulProcessor):
    """The last time that a URL was seen."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t) for pdf in rows for t in _at(pdf["ts"]))
        last = self.last.get()[0] if self.last.exists() else None
        fresh = []
        for t in times:
            if last is None or t - last > self.ttl:
                fresh.append(t)
            last = t if last is None else max(last, t)
        self.last.update((last,))
        self.handle.registerTimer(last + self.ttl)
        yield pd.DataFrame({"full_url": _texts([key[0]] * len(fresh)), "ts": _stamp(fresh)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer of an earlier sight says nothing once the URL was seen again
        if self.last.exists() and self.last.get()[0] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame({"full_url": _texts([]), "ts": _stamp([])})

    def close(self) -> None:
        pass


def recent(urls: DataFrame, ttl: str = "1 hour", key: str = "full_url", ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """(full_url, ts) of each sight of a URL that comes more than ``ttl`` after the one before it; every sight refreshes.

    ``delay`` is how late a row may be; those later than the watermark are dropped. Rows whose URL or time is null are left out. Within a micro-batch
    rows count in the order of their time; one that is late, but not too late, is held against the newest sight.
    """
    kept = urls.select(F.col(key).alias("full_url"), F.col(ts).alias("ts")).where("full_url is not null and ts is not null").withWatermark("ts", delay)
    return kept.groupBy("full_url").transformWithStateInPandas(_Recent(_ms(ttl)), "full_url string, ts timestamp", "append", "eventTime")


class _Silence(StatefulProcessor):
    """The last operation of a project and how many there were."""

    def __init__(self, limit: int, by_clock: bool):
        self.limit, self.by_clock = limit, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.seen.get() if self.seen.exists() else (None, 0)
        now = timerValues.getCurrentProcessingTimeInMs()
        at, counts = [], []
        for t in sorted(now if self.by_clock else int(x) for pdf in rows for x in _at(pdf["ts"])):
            if last is not None and t - last > self.limit:  # the timer of this end hasn't come yet
                at.append(last + self.limit)
                counts.append(n)
                n = 0
            last, n = t if last is None else max(last, t), n + 1
        self.seen.update((last, n))
        self.handle.registerTimer(last + self.limit)
        yield self._ended(key, at, counts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended: tuple[list, list] = ([], [])
        if self.seen.exists():
            last, n = self.seen.get()
            if last + self.limit <= expiredTimerInfo.getExpiryTimeInMs():
                ended = ([last + self.limit], [n])
                self.seen.clear()
        yield self._ended(key, *ended)

    def _ended(self, key, at: list, n: list) -> pd.DataFrame:
        return pd.DataFrame({"project": _texts([key[0]] * len(at)), "ended": _stamp(at), "n_operations": pd.Series(n, dtype="int64")})

    def close(self) -> None:
        pass


def ended_projects(operations: DataFrame, limit: str = "5 minutes", key: str = "project", ts: str | None = "ts", delay: str = "0 seconds") -> DataFrame:
    """(project, ended, n_operations): a row when a project has had no operation for ``limit``; one that goes on afterwards begins anew.

    With an event time ``ts`` silence is measured by the watermark, so others' operations let time pass; without one by the clock. Rows of a
    micro-batch count in the order of their time.
    """
    if ts is None:
        kept = operations.select(F.col(key).alias("project"), F.lit(None).cast("timestamp").alias("ts")).where("project is not null")
    else:
        kept = operations.select(F.col(key).alias("project"), F.col(ts).alias("ts")).where("project is not null and ts is not null").withWatermark("ts", delay)
    return kept.groupBy("project").transformWithStateInPandas(_Silence(_ms(limit), ts is None), "project string, ended timestamp, n_operations bigint", "append", "processingTime" if ts is None else "eventTime")


def stop_when_silent(query: StreamingQuery, seconds: float, poll: float = 0.2) -> bool:
    """Waits until ``query`` has read no row for ``seconds`` and stops it; False where it ended by itself."""
    last, batch = time.monotonic(), -1
    while query.isActive:
        for p in query.recentProgress:
            if p["batchId"] > batch:
                batch = p["batchId"]
                last = time.monotonic() if p["numInputRows"] else last
        # a batch under way isn't silence
        if query.status["isTriggerActive"] and query.status["isDataAvailable"]:
            last = time.monotonic()
        if time.monotonic() - last >= seconds:
            query.stop()
            return True
        query.awaitTermination(poll)
    return False


class _InFlight(StatefulProcessor):
    """The open requests of a server, and those that wait, in the order in which they were asked for."""

    def __init__(self, requests: int):
        self.requests = requests

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "url string", "since bigint")
        self.count = handle.getValueState("count", "n bigint, first bigint, next bigint")
        self.waiting = handle.getMapState("waiting", "turn bigint", "url string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = sorted((int(t), e != "end", u) for pdf in rows for t, e, u in zip(_at(pdf["ts"]), pdf["event"], pdf["full_url"], strict=True))
        n, first, nxt = self.count.get() if self.count.exists() else (0, 0, 0)
        granted = []

        def grant(url: str, t: int) -> None:
            self.open.updateValue((url,), (t,))
            granted.append((url, t))

        for t, start, url in told:  # at one time ends come before starts
            if start:
                if n < self.requests:
                    n += 1
                    grant(url, t)
                else:
                    self.waiting.updateValue((nxt,), (url,))
                    nxt += 1
            elif self.open.containsKey((url,)):
                self.open.removeKey((url,))
                n -= 1
                if first < nxt:
                    n += 1
                    grant(self.waiting.getValue((first,))[0], t)
                    self.waiting.removeKey((first,))
                    first += 1
        self.count.update((n, first, nxt))
        yield pd.DataFrame({"server": _texts([key[0]] * len(granted)), "full_url": _texts([u for u, _ in granted]), "granted": _stamp([t for _, t in granted])})

    def close(self) -> None:
        pass


def in_flight(events: DataFrame, requests: int = 5, server: str = "server") -> DataFrame:
    """(server, full_url, granted): when each request may go out, so that no server ever has more than ``requests`` open.

    ``events``: server, full_url, event (``start``: wanted, ``end``: done), ts. Requests beyond the cap wait in the order of their time until
    one that is open ends; the end of a URL that isn't open changes nothing. A URL is asked for again only after its end. Rows with a null are left
    out. Open and waiting requests are single entries of the state, so a server with many costs no more per event than one with few.
    """
    kept = events.select(F.col(server).alias("server"), "full_url", "event", "ts").dropna()
    return kept.groupBy("server").transformWithStateInPandas(_InFlight(requests), "server string, full_url string, granted timestamp", "append", "none")
