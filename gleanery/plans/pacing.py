"""Source health, request pacing and search outcomes, from the event log as attempts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gleanery import fixtures as fx
from gleanery.operators import health as h, listings as ops
from gleanery.plans import sql
from gleanery.plans.asking import source_table
from gleanery.plans.registry import flag, query, stamp

NOW = datetime(2024, 1, 30, 23, 0, 0)
NOW_SQL = "TIMESTAMP '2024-01-30 23:00:00'"
STREAKS = f"""{sql.ATTEMPTS},
  grouped AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY source ORDER BY started, attempt_id) AS grp FROM attempts),
  streaks AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY source, grp ORDER BY started, attempt_id)::INT AS streak FROM grouped),
  deadlines AS (SELECT *, max(CASE WHEN NOT ok THEN ended + to_seconds(least(5 * (1 << least(streak, 8)), 600)) END)
    OVER (PARTITION BY source ORDER BY started, attempt_id) AS next_allowed FROM streaks)"""


@query("failure_streaks", f"WITH {STREAKS} SELECT source, attempt_id, ok::INT AS ok, streak FROM streaks")
def failure_streaks(spark, sf):
    return h.failure_streak(fx.attempts(spark, sf)).select("source", "attempt_id", flag("ok").alias("ok"), "streak")


@query(
    "backoff_deadline",
    f"WITH {STREAKS} SELECT source, attempt_id, {sql.folded('next_allowed')} AS next_allowed FROM deadlines",
)
def backoff_deadline(spark, sf):
    streaks = h.failure_streak(fx.attempts(spark, sf))
    return h.backoff(streaks).select("source", "attempt_id", stamp("next_allowed").alias("next_allowed"))


@query(
    "source_states",
    f"""WITH {STREAKS}, last AS (SELECT source, arg_max(streak, row(started, attempt_id)) AS failures, max(next_allowed) AS next_allowed FROM deadlines GROUP BY source),
      s AS (SELECT s_name AS id, 'Shop ' || s_suppkey AS name, s_suppkey::VARCHAR AS k FROM supplier),
      t AS (SELECT l_suppkey, count(*) AS torrents FROM lineitem GROUP BY ALL)
      SELECT id, name, coalesce(torrents, 0) AS torrents, coalesce(failures, 0) AS failures,
        CASE WHEN failures > 0 AND {NOW_SQL} < next_allowed THEN 'backoff' WHEN l.source IS NULL THEN 'idle' WHEN failures > 0 THEN 'failing' ELSE 'ok' END AS state
      FROM s LEFT JOIN last l ON l.source = k LEFT JOIN t ON l_suppkey::VARCHAR = k""",
)
def source_states(spark, sf):
    """The panel's directory: every source, scraped or not, with its count and state."""
    name = F.concat(F.lit("Supplier#"), F.lpad("source", 9, "0"))
    state = h.source_health(fx.attempts(spark, sf)).withColumn("source", name)
    stored = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("tracker"),
        F.col("l_shipdate").cast("timestamp").alias("published"),
    )
    return h.source_directory(source_table(spark, sf), ops.stats(stored), state, F.lit(NOW)).drop("newest")


SEARCH_ATTEMPTS = """
tried AS (SELECT event_id // 4 AS request_id, event_id % 4 || '/' || user_id AS source, ts AS started, event_type != 'error' AS ok,
    ts + to_microseconds(round(value * 1000000)::BIGINT) AS ended FROM events),
rows AS (SELECT request_id, source AS tracker FROM tried, unnest(range((hash(source) % 1 + request_id % 3)::BIGINT)) WHERE ok)"""


def _tried(spark, sf):
    """Four sources per search."""
    a = fx.attempts(spark, sf)
    return a.select(
        F.floor(F.col("attempt_id") / 4).alias("request_id"),
        F.concat((F.col("attempt_id") % 4).cast("string"), F.lit("/"), F.col("source")).alias("source"),
        "started", "ended", "ok",
    )


@query(
    "outcome_report",
    f"""WITH {SEARCH_ATTEMPTS}, c AS (SELECT request_id, tracker, count(*) AS n FROM rows GROUP BY ALL)
      SELECT t.request_id, source, source AS name, (epoch_us(ended) - epoch_us(started)) // 1000 AS elapsed_ms, coalesce(n, 0) AS results,
        CASE WHEN ok THEN '' ELSE 'the tracker could not be searched' END AS error, CASE WHEN ok THEN 2 ELSE 1 END AS status
      FROM tried t LEFT JOIN c ON c.request_id = t.request_id AND tracker = source""",
)
def outcome_report(spark, sf):
    tried = _tried(spark, sf)
    page = tried.filter("ok").select(
        "request_id", F.col("source").alias("tracker"), F.explode(F.sequence(F.lit(0), F.col("request_id") % 3)).alias("i")
    ).filter("i > 0")
    return h.outcome_report(tried, page)


@query(
    "failed_searches",
    f"WITH {SEARCH_ATTEMPTS} SELECT request_id, bool_and(NOT ok)::INT AS failed FROM tried GROUP BY request_id",
)
def failed_searches(spark, sf):
    return h.all_failed(_tried(spark, sf)).select("request_id", flag("failed").alias("failed"))


@query(
    "chosen_mirrors",
    """WITH m AS (SELECT event_id // 5 AS request_id, 's' || (event_id // 5 % 7) AS source, event_id % 5 AS ordinal, 'm' || user_id AS mirror,
        event_type = 'view' OR (event_type = 'click' AND value > 100) AS reachable FROM events)
      SELECT request_id, source, coalesce(arg_min(mirror, ordinal) FILTER (reachable), '') AS mirror, bool_or(reachable)::INT AS reachable FROM m GROUP BY ALL""",
)
def chosen_mirrors(spark, sf):
    e = fx.table(spark, sf, "events")
    request = F.floor(F.col("event_id") / 5)
    slow = (F.col("event_type") == "click") & (F.col("value") > 100)
    tries = e.select(
        request.alias("request_id"), F.concat(F.lit("s"), (request % 7).cast("string")).alias("source"), (F.col("event_id") % 5).alias("ordinal"),
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("mirror"), F.lit(3).alias("paths"),
        F.when(F.col("event_type") == "view", 2).otherwise(0).alias("answered"), F.when(slow, 3).otherwise(1).alias("skipped"),
    )
    out = h.choose_mirror(tries)
    return out.select("request_id", "source", F.coalesce("mirror", F.lit("")).alias("mirror"), flag("reachable").alias("reachable"))


@query(
    "inflight_groups",
    f"""WITH RECURSIVE {sql.ATTEMPTS}, a AS (SELECT source, key, attempt_id, started, started + (ended - started) * 600 AS ended FROM attempts),
      lead AS (SELECT source, key, attempt_id, started, ended FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY started, attempt_id) AS n FROM a) WHERE n = 1
        UNION ALL SELECT source, key, attempt_id, started, ended FROM (SELECT a.*, row_number() OVER (PARTITION BY a.source, a.key ORDER BY a.started, a.attempt_id) AS n
          FROM lead l JOIN a ON a.source = l.source AND a.key = l.key AND a.started >= l.ended) WHERE n = 1)
      SELECT a.attempt_id, arg_max(l.attempt_id, row(l.started, l.attempt_id)) AS leader_id FROM a JOIN lead l ON l.source = a.source AND l.key = a.key
        AND row(l.started, l.attempt_id) <= row(a.started, a.attempt_id) GROUP BY a.attempt_id""",
)
def inflight_groups(spark, sf):
    """Attempts taken as ten hours per minute, so that searches of one key overlap."""
    a = fx.attempts(spark, sf)
    stretched = F.timestamp_micros(F.unix_micros("started") + (F.unix_micros("ended") - F.unix_micros("started")) * 600)
    return h.coalesce_inflight(a.withColumn("ended", stretched)).select("attempt_id", "leader_id")


GATE_HOURS = 6


@query(
    "request_gate",
    f"""WITH RECURSIVE r AS (SELECT event_id AS request_id, user_id AS source, event_type AS key, ts FROM events),
      taken AS (SELECT source, key, request_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY ts, request_id) AS n FROM r) WHERE n = 1
        UNION ALL SELECT source, key, request_id, ts FROM (SELECT r.*, row_number() OVER (PARTITION BY r.source, r.key ORDER BY r.ts, r.request_id) AS n
          FROM taken t JOIN r ON r.source = t.source AND r.key = t.key AND r.ts >= t.ts + INTERVAL {GATE_HOURS} HOUR) WHERE n = 1)
      SELECT r.request_id, (t.request_id IS NOT NULL)::INT AS accepted FROM r LEFT JOIN taken t USING (request_id)""",
)
def request_gate(spark, sf):
    gated = h.gate_requests(_gate_requests(spark, sf), GATE_HOURS * 3600)
    return gated.select("request_id", flag("accepted").alias("accepted"))


def _gate_requests(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


@query("request_spacing")
def request_spacing(spark, sf):
    """Slots of an hour per source, at most five hours of queue; checked against a loop in the tests."""
    spaced = h.space_requests(_gate_requests(spark, sf), 3600, 5 * 3600)
    return spaced.select("request_id", flag("accepted").alias("accepted"), "wait_ms")


@query(
    "delay_schedule",
    """WITH RECURSIVE r AS (SELECT event_id AS id, user_id AS source, epoch_us(ts) AS a, round(value * 60000000)::BIGINT AS d,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      run AS (SELECT id, source, n, a AS b, a + d AS e FROM r WHERE n = 1
        UNION ALL SELECT r.id, r.source, r.n, greatest(r.a, e + 60000000), greatest(r.a, e + 60000000) + r.d FROM run JOIN r ON r.source = run.source AND r.n = run.n + 1)
      SELECT id AS request_id, b AS begun_us, e AS answered_us FROM run""",
)
def delay_schedule(spark, sf):
    """One request at a time per source, a minute after the previous answer; answers take minutes."""
    e = fx.table(spark, sf, "events")
    requests = e.select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 60_000_000).cast("bigint").alias("took"),
    )
    gap = F.round(h.request_gap(F.lit(75.0)) * 1_000_000).cast("bigint")
    out = h.delay_schedule(requests, gap, F.col("took"))
    return out.select("request_id", F.unix_micros("begun").alias("begun_us"), F.unix_micros("answered").alias("answered_us"))
