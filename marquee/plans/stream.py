"""Streaming jobs and their batch twins, with the SQL that states their results."""

from __future__ import annotations

from ..sources.tables import fail_events
from ..streaming import jobs, state
from .ctes import FAILS, sql

FAILURES = sql(
    """SELECT ann_id, count(*) FILTER (wins = last AND op = 'fail') AS count, max(CASE WHEN op = 'fail' THEN n ELSE 0 END) >= 2 OR bool_or(op = 'fail' AND failure_type = 'no_content') AS needs_manual FROM (
    SELECT *, max(wins) OVER (PARTITION BY ann_id) AS last, count(*) FILTER (op = 'fail') OVER (PARTITION BY ann_id, wins) AS n FROM (
        SELECT *, sum((op = 'success')::INT) OVER (PARTITION BY ann_id ORDER BY ts, event_id) AS wins FROM (
            SELECT *, sum((op = 'clear')::INT) OVER (PARTITION BY ann_id ORDER BY ts, event_id) AS clears, sum((op = 'clear')::INT) OVER (PARTITION BY ann_id) AS all_clears FROM fails) WHERE clears = all_clears AND op <> 'clear'))
    GROUP BY ann_id HAVING bool_or(op = 'fail')""",
    FAILS,
)

QUERIES = {
    "st_04_failure_fold": lambda spark, sf_dir: jobs.failure_state(fail_events(spark, sf_dir)),
    "st_04_failure_stream": jobs.failure_stream,
    "st_02_seen_stream": jobs.seen_keys,
    "st_09_window_stream": jobs.event_windows,
    "snk_02_buffered_writer": jobs.buffered_totals,
    "st_03_ttl_cache_stream": state.cached_reads,
    "st_05_run_state_stream": state.run_states,
    "st_06_budget_stream": state.budgeted_requests,
}
SQL = {
    "st_04_failure_fold": FAILURES,
    # (late events arrive last)
    "st_04_failure_stream": FAILURES.replace("ORDER BY ts, event_id", "ORDER BY event_id % 97 = 0, ts, event_id"),
    "st_02_seen_stream": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "st_09_window_stream": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events WHERE event_id % 97 <> 0 OR time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR > (SELECT max(ts) - INTERVAL 1 DAY FROM (SELECT epoch(ts) AS e, ts, min(epoch(ts)) OVER () AS a, max(epoch(ts)) OVER () AS b FROM events WHERE event_id % 97 <> 0) WHERE e - a < 9 * greatest(1, b - a) / 10) GROUP BY ALL",
    "snk_02_buffered_writer": "SELECT CASE WHEN user_id % 2 = 0 THEN 'summer_camp' ELSE 'pre_admission' END AS board, count(*)::HUGEINT::BIGINT AS items FROM events GROUP BY 1",
    # the last entry of the same kind before a read, if its life is not over
    "st_03_ttl_cache_stream": """WITH e AS (SELECT event_id, ts, user_id % 5 AS query, event_id % 2 AS kind, event_type IN ('purchase', 'signup') AS put FROM events WHERE event_id % 97 <> 0),
        w AS (SELECT *, max(CASE WHEN put THEN {'ts': ts, 'event_id': event_id} END) OVER (PARTITION BY query, kind ORDER BY ts, event_id) AS last FROM e)
        SELECT event_id, CASE WHEN ts <= last.ts + CASE kind WHEN 0 THEN INTERVAL 7200 SECOND ELSE INTERVAL 86400 SECOND END THEN last.event_id END AS found FROM w WHERE NOT put""",
    "st_05_run_state_stream": """WITH e AS (SELECT event_id, ts, user_id % 20 AS job, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'progress' END AS op FROM events WHERE event_id % 97 <> 0),
        w AS (SELECT *, last_value(CASE WHEN op <> 'progress' THEN op END IGNORE NULLS) OVER (PARTITION BY job ORDER BY ts, event_id) AS phase FROM e),
        l AS (SELECT job, arg_max(event_id, (ts, event_id)) FILTER (op = 'start') AS started, max((ts, event_id)) FILTER (op = 'start') AS begun, arg_max(event_id, (ts, event_id)) FILTER (op IN ('finish', 'fail')) AS last_end, max((ts, event_id)) FILTER (op IN ('finish', 'fail')) AS end_at,
            arg_max(op || ' ' || event_id, (ts, event_id)) FILTER (op <> 'progress' OR phase = 'start') AS message, coalesce(arg_max(phase, (ts, event_id)) = 'start', false) AS running FROM w GROUP BY job)
        SELECT job, coalesce(running, false) AS running, started, CASE WHEN begun IS NULL OR end_at > begun THEN last_end END AS ended, message FROM l""",
    "st_06_budget_stream": "SELECT event_id FROM events WHERE event_id % 97 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 15 AND epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)) <= 86400 * 20",
}
