"""Streams with state against exact models of one process."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crawlspark.streaming import state

START = datetime(2024, 1, 1)
STAMP = "%Y-%m-%dT%H:%M:%S"


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, name, batches, schema, op):
    """The rows that ``op`` emits for one file a batch, the batches in order, resumed from the checkpoint after half of them."""
    src = tmp_path / name
    src.mkdir()

    def run(some, first):
        for i, rows in enumerate(some):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src / f"{first + i:03d}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(f"{src}/*")
        out = op(stream).writeStream.format("parquet").option("path", str(tmp_path / f"{name}_out")).option("checkpointLocation", str(tmp_path / f"{name}_at"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)

    half = len(batches) // 2
    run(batches[:half], 0)
    run(batches[half:], half)
    return spark.read.parquet(str(tmp_path / f"{name}_out")).collect()


def test_recent_urls_are_refreshed_by_every_sight(spark, tmp_path):
    r = random.Random(5)
    batches = [[(f"u{r.randrange(6)}", at(b * 20 + m)) for m in range(0, 20, 4)] for b in range(6)]
    batches[1] += [(None, at(25)), ("x", None), batches[1][0]]
    got = streamed(spark, tmp_path, "recent", batches, "full_url string, ts timestamp", lambda s: state.recent(s, "30 minutes", delay="1 hour"))
    last, want = {}, []
    for batch in batches:
        for u, t in sorted(x for x in batch if None not in x):
            if u not in last or t - last[u] > timedelta(minutes=30):
                want.append((u, t))
            last[u] = max(t, last.get(u, t))
    assert sorted((x.full_url, x.ts) for x in got) == sorted(want) and len(want) > 6


def test_silent_projects_end_once_and_may_begin_anew(spark, tmp_path):
    batches = [[("a", at(0)), ("b", at(1)), (None, at(1))], [("a", at(4)), ("b", at(5))], [("b", at(8))], [("b", at(12))], [("a", at(20)), ("b", at(16))], [("c", at(60))], [("c", at(61))]]
    got = streamed(spark, tmp_path, "ended", batches, "project string, ts timestamp", lambda s: state.ended_projects(s, "5 minutes"))
    assert sorted((x.project, x.ended, x.n_operations) for x in got) == [("a", at(9), 2), ("a", at(25), 1), ("b", at(21), 5)]


def test_a_silent_stream_is_stopped(spark, tmp_path):
    src = tmp_path / "ops"
    spark.createDataFrame([("p",), ("p",), ("q",)], "project string").coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("project string").json(str(src))
    q = state.ended_projects(stream, "2 seconds", ts=None).writeStream.format("memory").queryName("silent").start()
    assert state.stop_when_silent(q, 15) and not q.isActive
    assert sorted((r.project, r.n_operations) for r in spark.table("silent").collect()) == [("p", 2), ("q", 1)]


def test_no_server_has_more_open_than_its_requests(spark, tmp_path):
    r, cap = random.Random(3), 2
    model = {"open": defaultdict(set), "wait": defaultdict(deque)}
    want, batches, n, clock = [], [], 0, 0

    def granted(s, u, t):
        model["open"][s].add(u)
        want.append((s, u, t))
        assert len(model["open"][s]) <= cap

    for _ in range(6):
        rows = []
        for _ in range(14):
            clock += 1
            s, t = r.choice("ssst"), at(clock)
            if model["open"][s] and r.random() < 0.45:
                u = r.choice(sorted(model["open"][s]))
                model["open"][s].remove(u)
                rows.append((s, u, "end", t))
                if model["wait"][s]:
                    granted(s, model["wait"][s].popleft(), t)
            else:
                n += 1
                rows.append((s, f"u{n}", "start", t))
                granted(s, f"u{n}", t) if len(model["open"][s]) < cap else model["wait"][s].append(f"u{n}")
        r.shuffle(rows)
        batches.append([*rows, ("s", "never", "end", at(clock)), (None, "x", "start", at(clock))])
    got = streamed(spark, tmp_path, "flight", batches, "server string, full_url string, event string, ts timestamp", lambda s: state.in_flight(s, cap))
    assert sorted((x.server, x.full_url, x.granted) for x in got) == sorted(want) and any(model["wait"].values())
