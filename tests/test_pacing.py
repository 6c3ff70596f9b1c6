"""Pacing decisions against plain loops over the same small log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.operators import health as h

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log():
    rng, t, rows = random.Random(7), START, []
    for i in range(400):
        t += timedelta(seconds=rng.choice([0, 0, 0.4, 1, 2, 5, 6, 40, 4000]))
        rows.append((i, rng.choice("aaab"), rng.choice("xy"), t, rng.random() < 0.6, rng.choice([0.5, 2.0, 9.0])))
    return rows


@pytest.fixture(scope="module")
def frame(spark, log):
    return spark.createDataFrame(log, "request_id bigint, source string, key string, ts timestamp, ok boolean, seconds double")


def test_gate(frame, log):
    last, want = {}, {}
    for i, source, key, ts, ok, _ in log:
        seen = last.get((source, key))
        want[i] = seen is None or ts - seen >= timedelta(seconds=5)
        if want[i] and ok:
            last[(source, key)] = ts
    assert {r.request_id: r.accepted for r in h.gate_requests(frame, ok="ok").collect()} == want


def test_spacing(frame, log):
    free, want = {}, {}
    for i, source, _, ts, *_ in log:
        begin = max(ts, free.get(source, ts))
        wait = begin - ts
        want[i] = (wait <= timedelta(seconds=3), 0 if wait > timedelta(seconds=3) else int(wait.total_seconds() * 1000))
        if want[i][0]:
            free[source] = begin + timedelta(seconds=1)
    assert {r.request_id: (r.accepted, r.wait_ms) for r in h.space_requests(frame, 1, 3).collect()} == want


def test_coalescing_delay_and_streaks(frame, log):
    attempts = frame.select(F.col("request_id").alias("attempt_id"), "source", "key", F.col("ts").alias("started"),
                            h.plus_seconds(F.col("ts"), F.col("seconds")).alias("ended"), "ok")
    flights, leaders, streak, streaks = {}, {}, {}, {}
    for i, source, key, ts, ok, seconds in log:
        flight = flights.get((source, key))
        if flight is None or ts >= flight[1]:
            flight = flights[(source, key)] = (i, ts + timedelta(seconds=seconds))
        leaders[i] = flight[0]
        streak[source] = 0 if ok else streak.get(source, 0) + 1
        streaks[i] = streak[source]
    assert {r.attempt_id: r.leader_id for r in h.coalesce_inflight(attempts).collect()} == leaders
    assert {r.attempt_id: r.streak for r in h.failure_streak(attempts).collect()} == streaks
    answered, want = {}, {}
    for i, source, _, ts, _, seconds in log:
        begun = max(ts, answered.get(source, ts - timedelta(days=1)) + timedelta(seconds=2))
        want[i] = answered[source] = begun + timedelta(seconds=seconds)
    out = h.delay_schedule(frame, F.lit(2_000_000), F.col("seconds") * 1_000_000)
    assert {r.request_id: r.answered for r in out.collect()} == want


def test_a_key_that_is_never_idle(spark):
    """One long chain over many cells, with flights of no length among it."""
    rows = [(i, "hot", "k", START + timedelta(milliseconds=700 * i), True, [0.0, 3.0, 1.4][i % 3]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "request_id bigint, source string, key string, ts timestamp, ok boolean, seconds double")
    last, want = None, {}
    for i, _, _, ts, *_ in rows:
        want[i] = last is None or ts - last >= timedelta(seconds=5)
        last = ts if want[i] else last
    assert {r.request_id: r.accepted for r in h.gate_requests(frame).collect()} == want
    attempts = frame.select(F.col("request_id").alias("attempt_id"), "source", "key", F.col("ts").alias("started"), h.plus_seconds(F.col("ts"), F.col("seconds")).alias("ended"), "ok")
    flight, leaders = None, {}
    for i, _, _, ts, _, seconds in rows:
        if flight is None or ts >= flight[1]:
            flight = (i, ts + timedelta(seconds=seconds))
        leaders[i] = flight[0]
    assert {r.attempt_id: r.leader_id for r in h.coalesce_inflight(attempts).collect()} == leaders


def test_stream_gate_keeps_many_keys_in_one_state(spark, tmp_path, monkeypatch):
    """Forty keys over three micro-batches: as many states as buckets, the decisions of a loop."""
    from gleanery.streaming import gate

    monkeypatch.setattr(gate, "BUCKETS", 4, raising=False)
    rows = [(i, f"s{i % 10}" if i % 10 else None, f"k{i % 4}", i * 4, i % 3 > 0) for i in range(240)]
    schema = "request_id bigint, source string, key string, second bigint, ok boolean"
    for n in range(3):
        spark.createDataFrame(rows[n * 80:(n + 1) * 80], schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    asked = arriving.withColumn("ts", F.timestamp_seconds("second"))
    decided = gate.gate_stream(asked, interval=100, idle_seconds=None).writeStream.format("parquet")
    run = decided.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == 3
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    last, want = {}, {}
    for i, source, key, now, ok in rows:
        want[i] = (source, key) not in last or now - last[source, key] >= 100
        if want[i] and ok:
            last[source, key] = now
    assert {r.request_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
