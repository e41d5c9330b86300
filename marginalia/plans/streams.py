"""Queries of rate limits and debounce, over the table of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.session import table
from marginalia.streaming import limits

HOUR = 3_600_000_000


def z1_cooldown(spark, d):
    return limits.limited(table(spark, d, "events"), "user_id", "ts", "event_id", limits.cooldown_step(6 * HOUR))


def z2_sliding_window(spark, d):
    return limits.limited(table(spark, d, "events"), "user_id", "ts", "event_id", limits.window_step(3, 24 * HOUR))


def z3_debounce(spark, d):
    out = limits.debounced(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return out.select("user_id", F.unix_micros("first_at").alias("first_us"), "events")


def z4_file_events(spark, d):
    return limits.file_events(table(spark, d, "vault_files"), ["Memory/Index", "Memory/Config"]).select("path", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "event")


QUERIES = {f.__name__: f for f in (z1_cooldown, z2_sliding_window, z3_debounce, z4_file_events)}

SQL = {
    "z4_file_events": """WITH k AS (SELECT DISTINCT path, mtime, listed_at, removed_at IS NOT NULL AS gone FROM vault_files WHERE path IS NOT NULL AND NOT regexp_matches(path, '^Memory/(Index|Config)/')),
        p AS (SELECT *, lag(gone) OVER o AS pg, lag(mtime) OVER o AS pm FROM k WINDOW o AS (PARTITION BY path ORDER BY listed_at NULLS FIRST, gone, mtime NULLS FIRST)),
        e AS (SELECT path, epoch_us(listed_at) AS at_us, CASE WHEN gone AND pg = false THEN 'delete' WHEN NOT gone AND coalesce(pg, true) THEN 'create' WHEN NOT gone AND mtime IS DISTINCT FROM pm THEN 'modify' END AS event FROM p) SELECT * FROM e WHERE event IS NOT NULL""",
    "z1_cooldown": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT user_id, event_id, n, t AS last, true AS accepted FROM e WHERE n = 1 UNION ALL
              SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - r.last >= 21600000000 THEN e.t ELSE r.last END, e.t - r.last >= 21600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT user_id, event_id, accepted FROM r""",
    "z2_sliding_window": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT user_id, event_id, n, [t] AS kept, true AS accepted FROM e WHERE n = 1 UNION ALL
              SELECT user_id, event_id, n, CASE WHEN len(k) < 3 THEN list_append(k, t) ELSE k END, len(k) < 3 FROM (SELECT e.user_id, e.event_id, e.n, e.t, list_filter(r.kept, lambda x: x > e.t - 86400000000) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
        SELECT user_id, event_id, accepted FROM r""",
    "z3_debounce": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 21600000000, true) AS new FROM events),
        g AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(t) AS first_us, count(*) AS events FROM g GROUP BY user_id, g""",
}
