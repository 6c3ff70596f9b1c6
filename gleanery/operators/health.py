"""Source health folded from the attempt log, and request pacing over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.operators.scan import CELL, cells_before, chain, deal, in_cell, islands, running, scan_islands
from gleanery.session import cut_lineage

# Fixed value: what clients are told of a source that failed; its cause stays in the log.
SEARCH_FAILED = "the tracker could not be searched"

# Pacing limits, in seconds.
REPEAT_INTERVAL = 5
SPACING = 1
MAX_WAIT = 15
MAX_BACKOFF = 600
MAX_REQUEST_GAP = 60


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds.cast("double") * 1_000_000).cast("bigint"))


def failure_streak(attempts: DataFrame, order: tuple[str, ...] = ("started", "attempt_id")) -> DataFrame:
    """streak: failures since the source's last success, after each attempt.

    Attempts that only waited in a queue count as neither; the caller leaves them out. Both parts, failures
    so far and failures at the last success, are carried from cell to cell in one pass.
    """
    keys = ["source"]
    here = in_cell(keys, order)
    rows = deal(attempts, keys, order).withColumn("__failed", F.when(F.col("ok"), 0).otherwise(1))
    rows = rows.withColumn("__fails", F.sum("__failed").over(here))
    rows = cut_lineage(rows.withColumn("__reset", F.max(F.when(F.col("ok"), F.col("__fails"))).over(here)))
    cells = rows.groupBy(CELL, *keys).agg(F.sum("__failed").alias("f"), F.max("__reset").alias("r"))
    earlier = cells_before(keys)
    cells = cells.withColumn("__base", F.coalesce(F.sum("f").over(earlier), F.lit(0)))
    cells = cells.withColumn("__last", F.max(F.col("r") + F.col("__base")).over(earlier)).drop("f", "r")
    reset = F.coalesce(F.greatest(F.col("__reset") + F.col("__base"), F.col("__last")), F.lit(0))
    streak = (F.col("__fails") + F.col("__base") - reset).cast("int")
    return rows.join(cells, [CELL, *keys]).select(*attempts.columns, streak.alias("streak"))


def backoff_seconds(streak: Column) -> Column:
    return F.least(F.lit(REPEAT_INTERVAL) * F.pow(F.lit(2), F.least(streak, F.lit(8))), F.lit(MAX_BACKOFF)).cast("int")


def backoff(streaks: DataFrame, order: tuple[str, ...] = ("started", "attempt_id")) -> DataFrame:
    """next_allowed: the deadline after each attempt, never earlier than one already set."""
    own = F.when(~F.col("ok"), plus_seconds(F.col("ended"), backoff_seconds(F.col("streak"))))
    return running(streaks, ["source"], order, {"next_allowed": ("max", own)})


def source_health(attempts: DataFrame, order: tuple[str, ...] = ("started", "attempt_id")) -> DataFrame:
    """(source, failures, next_allowed, scraped) after the whole log, by aggregation alone."""
    at = F.struct(*order)
    streaks = backoff(failure_streak(attempts, order), order)
    return (
        streaks.groupBy("source")
        .agg(
            F.max(F.struct(at.alias("at"), F.col("streak"), F.col("next_allowed"))).alias("last"),
        )
        .select("source", F.col("last.streak").alias("failures"), F.col("last.next_allowed").alias("next_allowed"), F.lit(True).alias("scraped"))
    )


def state_label(now: Column) -> Column:
    """backoff, idle, failing or ok, from failures, next_allowed and scraped."""
    failing = F.coalesce(F.col("failures"), F.lit(0)) > 0
    return (
        F.when(failing & (now < F.col("next_allowed")), F.lit("backoff"))
        .when(~F.coalesce(F.col("scraped"), F.lit(False)), F.lit("idle"))
        .when(failing, F.lit("failing"))
        .otherwise(F.lit("ok"))
    )


def source_directory(sources: DataFrame, stats: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Every configured source with its listing count and state, by name; unscraped ones show zeros."""
    return (
        sources.join(stats.withColumnRenamed("tracker", "id"), "id", "left")
        .join(health.withColumnRenamed("source", "id"), "id", "left")
        .select(
            "id",
            "name",
            F.coalesce("torrents", F.lit(0)).alias("torrents"),
            "newest",
            F.coalesce("failures", F.lit(0)).alias("failures"),
            state_label(now).alias("state"),
        )
        .orderBy("name", "id")
    )


def outcome_report(attempts: DataFrame, page: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Each attempted source of a request: elapsed ms, rows on the returned page, status 1 error / 2 ok.

    attempts: request_id, source, started, ended, ok. page: request_id, tracker.
    """
    counts = page.groupBy("request_id", F.col("tracker").alias("source")).agg(F.count("*").alias("results"))
    report = attempts.join(counts, ["request_id", "source"], "left").select(
        "request_id",
        "source",
        F.floor((F.unix_micros("ended") - F.unix_micros("started")) / 1000).cast("bigint").alias("elapsed_ms"),
        F.coalesce("results", F.lit(0)).cast("bigint").alias("results"),
        F.when(F.col("ok"), F.lit("")).otherwise(F.lit(SEARCH_FAILED)).alias("error"),
        F.when(F.col("ok"), F.lit(2)).otherwise(F.lit(1)).alias("status"),
    )
    if names is None:
        return report.withColumn("name", F.col("source"))
    return report.join(names.select(F.col("id").alias("source"), "name"), "source", "left").withColumn(
        "name", F.coalesce("name", "source")
    )


def all_failed(attempts: DataFrame) -> DataFrame:
    """(request_id, failed): a search over a set fails only when every source failed."""
    return attempts.groupBy("request_id").agg(F.bool_and(~F.col("ok")).alias("failed"))


def choose_mirror(attempts: DataFrame) -> DataFrame:
    """(request_id, source) -> the first reachable mirror in order, NULL when none was.

    attempts: request_id, source, ordinal, mirror, paths, answered, skipped. A mirror whose
    every path was skipped was never asked, so it counts as reachable.
    """
    reachable = (F.col("answered") > 0) | (F.col("skipped") == F.col("paths"))
    return attempts.groupBy("request_id", "source").agg(
        F.min_by("mirror", F.when(reachable, F.col("ordinal"))).alias("mirror"),
        F.bool_or(reachable).alias("reachable"),
    )


# --- pacing, as batch decisions over a request log -------------------------------------


def gate_requests(
    requests: DataFrame,
    interval: int = REPEAT_INTERVAL,
    ts: str = "ts",
    tie: str = "request_id",
    keys: tuple[str, ...] = ("source", "key"),
    ok: str | None = None,
) -> DataFrame:
    """accepted: whether a request reaches the source, or repeats a search answered within the interval.

    The window runs from the last accepted success, so a skipped repeat does not extend it: the
    successes accepted are a chain, each the first one at or after the end of the window before. `tie` is unique.
    """
    reach = plus_seconds(F.col(ts), F.lit(interval))
    answered = requests if ok is None else requests.where(ok)
    taken = chain(answered, keys, (ts, tie), reach, tie).withColumn("__taken", F.lit(True))
    marked = requests.join(taken, tie, "left").withColumn("__until", F.when(F.col("__taken"), reach))
    known = running(marked, keys, (ts, tie), {"__blocked": ("max", F.col("__until"))}, before=True)
    accepted = F.col("__blocked").isNull() | (F.col(ts) >= F.col("__blocked"))
    return known.withColumn("accepted", accepted).select(*requests.columns, "accepted")


def space_requests(
    requests: DataFrame, spacing: int = SPACING, max_wait: int = MAX_WAIT, ts: str = "ts", tie: str = "request_id"
) -> DataFrame:
    """accepted and wait_ms: each source takes one request per `spacing`; a longer queue than max_wait is skipped."""
    reach = plus_seconds(F.col(ts), F.lit(max_wait + spacing))
    split = islands(requests, ("source",), (ts, tie), reach)
    gap, most = spacing * 1_000_000, max_wait * 1_000_000

    def step(next_allowed, row):
        now = getattr(row, ts).value // 1000
        start = max(now, next_allowed)
        wait = start - now
        if wait > most:
            return next_allowed, (False, 0)
        return start + gap, (True, wait // 1000)

    return scan_islands(split, ("source",), (ts, tie), step, lambda: 0, "accepted boolean, wait_ms bigint").drop("island")


def coalesce_inflight(
    attempts: DataFrame,
    keys: tuple[str, ...] = ("source", "key"),
    order: tuple[str, ...] = ("started", "attempt_id"),
) -> DataFrame:
    """leader_id: a request whose key is still in flight follows that flight's leader.

    Only leaders run, so a flight ends with its leader; what a follower would have taken
    on its own plays no part.
    """
    start, ident = order[0], order[-1]
    leaders = chain(attempts, keys, order, F.col("ended"), ident).withColumn("__leads", F.lit(True))
    marked = attempts.join(leaders, ident, "left")
    lead = F.when(F.col("__leads"), F.struct(F.col(start).alias("at"), F.col(ident).cast("bigint").alias("id")))
    flown = running(marked, keys, order, {"__flight": ("max", lead)})
    return flown.select(*attempts.columns, F.col("__flight.id").alias("leader_id"))


def request_gap(delay: Column) -> Column:
    """Seconds between a source's requests: none if unset or not positive, at most a minute."""
    return F.when(delay > 0, F.least(delay, F.lit(float(MAX_REQUEST_GAP)))).otherwise(F.lit(0.0))


def delay_schedule(
    requests: DataFrame, gap_micros: Column, duration_micros: Column, ts: str = "ts", tie: str = "request_id"
) -> DataFrame:
    """begun and answered: per source one request at a time, each a gap after the previous answer.

    answered = max(arrival, previous answered + gap) + duration unrolls to a running sum
    and a running maximum, both of which cut into cells. Without a gap nothing is paced.
    """
    arrive = F.unix_micros(F.col(ts))
    cost = gap_micros.cast("bigint") + duration_micros.cast("bigint")
    order = (ts, tie)
    prepared = requests.withColumn("__cost", cost).withColumn("__end0", arrive + duration_micros.cast("bigint"))
    summed = running(prepared, ["source"], order, {"__sum": ("sum", F.col("__cost"))})
    topped = running(summed, ["source"], order, {"__top": ("max", F.col("__end0") - F.col("__sum"))})
    queued = F.col("__top") + F.col("__sum")
    answered = F.when(gap_micros > 0, queued).otherwise(F.col("__end0"))
    return (
        topped.withColumn("answered", F.timestamp_micros(answered))
        .withColumn("begun", F.timestamp_micros(answered - duration_micros.cast("bigint")))
        .drop("__cost", "__end0", "__sum", "__top")
    )
