"""Queries on the access log that events stand for: errors are failures, signups successes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.operators import access as A
from noticeloom.plans.catalog import Tables, query


def attempts(t: Tables) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failure").otherwise("success")
    return t.events.where(F.col("event_type").isin("error", "signup")).select(F.col("user_id").alias("key"), "event_id", "ts", outcome.alias("outcome"))


@query("lockout_detect", """WITH RECURSIVE a AS (SELECT user_id AS key, event_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'signup')),
w AS (SELECT key, event_id, ts, i, CASE WHEN bad THEN 1 ELSE 0 END AS failures, CAST(NULL AS TIMESTAMP) AS locked_until, 'allowed' AS decision FROM a WHERE i = 1
UNION ALL SELECT a.key, a.event_id, a.ts, a.i,
CASE WHEN w.locked_until IS NOT NULL AND a.ts < w.locked_until THEN w.failures WHEN a.bad AND w.failures + 1 >= 5 THEN 0 WHEN a.bad THEN w.failures + 1 ELSE 0 END,
CASE WHEN w.locked_until IS NOT NULL AND a.ts < w.locked_until THEN w.locked_until WHEN a.bad AND w.failures + 1 >= 5 THEN a.ts + INTERVAL 24 HOUR END,
CASE WHEN w.locked_until IS NOT NULL AND a.ts < w.locked_until THEN 'rejected' WHEN a.bad AND w.failures + 1 >= 5 THEN 'locked' ELSE 'allowed' END
FROM w JOIN a ON a.key = w.key AND a.i = w.i + 1)
SELECT key, event_id, decision, CAST(failures AS BIGINT) AS failures, locked_until, CASE WHEN decision <> 'allowed' THEN CAST(ceil(date_sub('second', ts, locked_until) / 60) AS BIGINT) END AS minutes_left FROM w""")
def lockout_detect(t: Tables) -> DataFrame:
    """With a lock of a day, as within ten minutes no attempt of these data falls."""
    return A.lockouts(attempts(t), lock_minutes=24 * 60).select("key", "event_id", "decision", "failures", "locked_until", "minutes_left")


@query("session_valid", """WITH l AS (SELECT user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('view', 'click'))
SELECT r.event_id, r.user_id, r.ts, l.ts AS last_login, coalesce(r.ts < l.ts + INTERVAL 24 HOUR, false) AS valid FROM r ASOF LEFT JOIN l ON r.user_id = l.user_id AND r.ts >= l.ts""")
def session_valid(t: Tables) -> DataFrame:
    logins = t.events.where("event_type = 'signup'").select("user_id", "ts")
    requests = t.events.where("event_type in ('view', 'click')").select("event_id", "user_id", "ts")
    return A.session_valid(requests, logins, "user_id", "ts")
