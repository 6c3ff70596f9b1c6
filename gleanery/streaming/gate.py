"""Request pacing as keyed streaming state, with the same decisions as the batch forms."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery.operators.health import MAX_BACKOFF, MAX_WAIT, REPEAT_INTERVAL, SPACING

#: Groups of keys that share one state. A call for a group costs as much as thousands of rows, so keys do not each get one.
#: Like the number of state partitions, it stays as it is for the life of a checkpoint.
BUCKETS = 4096


def _remembered(
    requests: DataFrame, by: Sequence[str], columns: Sequence[str], decide: Callable[..., tuple], schema: str, idle_seconds: int | None
) -> DataFrame:
    """(request_id, *by, what decide returns): every request in order of (ts, request_id), told what its key remembers.

    decide(value or None, microseconds, *columns) gives (new value or None, answers); a value is what JSON can hold. A bucket of
    keys is one state: a list of its live keys, when each was last asked for, and its value.
    """

    def run(_, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        clock, idle = (0, None) if idle_seconds is None else (state.getCurrentProcessingTimeMs(), int(idle_seconds * 1000))
        live = {tuple(k): (asked, value) for k, asked, value in (json.loads(state.get[0]) if state.exists else [])}
        rows = pd.concat(list(chunks)).sort_values(["ts", "request_id"], kind="stable")
        times = rows["ts"].to_numpy("datetime64[ns]").view("int64") // 1000
        out = []
        for key, now, *given in zip(zip(*[rows[c].tolist() for c in by]), times.tolist(), *[rows[c].tolist() for c in columns]):
            asked, value = live.get(key, (0, None))
            if idle is not None and clock - asked > idle:
                value = None
            value, answers = decide(value, now, *given)
            if value is not None:
                live[key] = (clock, value)
            out.append(answers)
        kept = [(k, asked, value) for k, (asked, value) in live.items() if idle is None or clock - asked <= idle]
        if kept:
            state.update((json.dumps(kept),))
            if idle is not None:
                state.setTimeoutDuration(idle)
        answered = dict(zip(names, zip(*out)))
        yield pd.DataFrame({"request_id": rows["request_id"].to_numpy(), **{c: rows[c].to_numpy() for c in by}, **answered})

    names = [field.split()[0] for field in schema.split(", ")]
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).alias("bucket")
    return requests.select(bucket, "request_id", *by, "ts", *columns).groupBy("bucket").applyInPandasWithState(
        run,
        f"request_id bigint, {', '.join(f'{c} string' for c in by)}, {schema}",
        "live string",
        "append",
        GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def gate_stream(requests: DataFrame, interval: float = REPEAT_INTERVAL, idle_seconds: int | None = 86_400) -> DataFrame:
    """accepted per request: a repeat of (source, key) within the interval of the last accepted
    success is answered from the store. requests: request_id, source, key, ts, ok.

    State is one timestamp per live key, dropped after idle_seconds. Pass None under an
    availableNow trigger: a processing-time timeout asks for another batch for ever, so such
    a run would never end. One micro-batch
    of one key is sorted in a task; the trigger bounds how much that is.
    """
    least = interval * 1_000_000

    def decide(last: int | None, now: int, ok: bool) -> tuple:
        go = last is None or now - last >= least
        return (now if go and ok else last), (go,)

    return _remembered(requests, ["source", "key"], ["ok"], decide, "accepted boolean", None if idle_seconds is None else max(interval, idle_seconds))


def pace_stream(
    requests: DataFrame, spacing: float = SPACING, max_wait: float = MAX_WAIT, idle_seconds: int | None = 86_400
) -> DataFrame:
    """decision and wait_ms per request of a source: backoff after failures, one slot per `spacing`,
    and no queue longer than max_wait. requests: request_id, source, ts, ok, seconds.

    A failure raises the backoff (5 s doubled per failure in a row, at most ten minutes); a
    success clears it. idle_seconds as in gate_stream.
    """

    def decide(value: list[int] | None, now: int, ok: bool, seconds: float) -> tuple:
        next_allowed, failures = value or (0, 0)
        start = max(now, next_allowed)
        if failures > 0 and now < next_allowed:
            return (next_allowed, failures), ("backoff", 0)
        if start - now > max_wait * 1_000_000:
            return (next_allowed, failures), ("busy", 0)
        next_allowed = start + int(spacing * 1_000_000)
        if ok:
            failures = 0
        else:
            failures += 1
            wait = min(REPEAT_INTERVAL * 2 ** min(failures, 8), MAX_BACKOFF)
            next_allowed = max(next_allowed, start + int((seconds + wait) * 1_000_000))
        return (next_allowed, failures), ("run", (start - now) // 1000)

    return _remembered(requests, ["source"], ["ok", "seconds"], decide, "decision string, wait_ms bigint", idle_seconds)
