"""The life of jobs over the benchmark tables: events stand in for what workers report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.plans.base import Registry, Tables
from loomstead.sources.shared import fresh_folder
from loomstead.streaming import lifecycle

query = Registry()
HOUR, MICROS = 3600, 1_000_000
LEASE, RETRIES, BACKOFF, DELAY = 60 * HOUR, 3, 12 * HOUR, 24 * HOUR
KINDS = {"signup": "submitted", "view": "claimed", "click": "progress", "purchase": "finished", "error": "failed"}
_ID, _ATTEMPT, _WORKER, _PROGRESS = "concat(user_id, '-', event_id % 8)", "1 + event_id % 16 // 12", "concat('w', event_id % 40 // 32)", "CAST(floor(value) AS INT) % 120"


@query(f"""WITH RECURSIVE e AS (SELECT {_ID} AS id, epoch_us(ts) AS t, event_id AS seq, event_type AS kind, {_ATTEMPT} AS attempt, {_WORKER} AS worker, {_PROGRESS} AS pct
 FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_id IS NOT NULL),
now AS (SELECT max(t) // 1000 * 1000 - {DELAY * MICROS} AS now FROM e), past AS (SELECT e.* FROM e, now WHERE t <= now),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, seq) AS i FROM past
 UNION ALL SELECT id, any_value(now), NULL, 'tick', NULL, NULL, NULL, count(*) + 1 FROM past, now GROUP BY id),
w AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS p, CAST(NULL AS VARCHAR) AS w, CAST(NULL AS BIGINT) AS due, CAST(0 AS BIGINT) AS changes, CAST(0 AS BIGINT) AS refusals FROM past
 UNION ALL SELECT id, i,
  CASE act WHEN 'submit' THEN 'queued' WHEN 'claim' THEN 'running' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN CASE WHEN n >= {RETRIES} THEN 'failed' ELSE 'queued' END ELSE s END,
  CASE WHEN act = 'submit' THEN 1 WHEN act = 'error' AND n < {RETRIES} THEN n + 1 ELSE n END,
  CASE WHEN act IN ('submit', 'claim') OR act = 'error' AND n < {RETRIES} THEN 0 WHEN act = 'click' THEN greatest(p, least(99, coalesce(pct, 0))) WHEN act = 'purchase' THEN 100 ELSE p END,
  CASE act WHEN 'claim' THEN worker WHEN 'error' THEN NULL ELSE w END,
  CASE WHEN act = 'submit' THEN t WHEN act IN ('claim', 'click') THEN t + {LEASE * MICROS} WHEN act = 'error' THEN t + (CAST({BACKOFF * MICROS} AS BIGINT) << CAST(n - 1 AS INT)) ELSE due END,
  changes + CASE WHEN act IN ('no', 'tick') THEN 0 ELSE 1 END, refusals + CASE WHEN act = 'no' THEN 1 ELSE 0 END
 FROM (SELECT *, CASE WHEN kind = 'tick' THEN 'tick' WHEN kind = 'signup' THEN CASE WHEN s IS NULL THEN 'submit' ELSE 'no' END WHEN s IS NULL THEN 'no'
   WHEN kind = 'view' THEN CASE WHEN s = 'queued' AND attempt = n AND t >= due THEN 'claim' ELSE 'no' END
   WHEN s = 'running' AND attempt = n AND worker = w THEN kind ELSE 'no' END AS act
  FROM (SELECT id, i, t, kind, attempt, worker, pct, refusals, changes + CASE WHEN x THEN 1 ELSE 0 END AS changes, CASE WHEN NOT x THEN s WHEN n >= {RETRIES} THEN 'failed' ELSE 'queued' END AS s,
    CASE WHEN x AND n < {RETRIES} THEN n + 1 ELSE n END AS n, CASE WHEN x AND n < {RETRIES} THEN 0 ELSE p END AS p, CASE WHEN x THEN NULL ELSE w END AS w,
    CASE WHEN x THEN due + (CAST({BACKOFF * MICROS} AS BIGINT) << CAST(n - 1 AS INT)) ELSE due END AS due
   FROM (SELECT r.*, s, n, p, w, due, changes, refusals, coalesce(s = 'running' AND due <= t, false) AS x FROM w JOIN r ON r.id = w.id AND r.i = w.i + 1))))
SELECT id, s AS status, n AS attempts, p AS progress_pct, changes, refusals FROM w JOIN r USING (id, i) WHERE kind = 'tick'""")
def job_lifecycle(t: Tables) -> DataFrame:
    """Where the stream of all events leaves the jobs at its last watermark; the table is one batch, whatever its files' order."""
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in KINDS.items()])
    spark_sql = lambda text: text.replace("event_id % 16 // 12", "event_id % 16 div 12").replace("event_id % 40 // 32", "event_id % 40 div 32")
    fields = {"id": _ID, "at": "CAST(ts AS TIMESTAMP)", "seq": "event_id", "attempt": f"CAST({spark_sql(_ATTEMPT)} AS INT)", "worker": spark_sql(_WORKER), "progress": _PROGRESS, "error": "CAST(NULL AS STRING)"}
    reports = t.stream("events").select(*[F.expr(x).alias(c) for c, x in fields.items()], kind.alias("kind"))
    folder = fresh_folder(t.spark)
    lifecycle.follow(t.spark, reports, f"{folder}/answers", f"{folder}/checkpoint", LEASE, RETRIES, BACKOFF, DELAY, slot=240 * HOUR, buckets=lifecycle.buckets_for(t.events.count()))
    return lifecycle.current(lifecycle.answers(t.spark, f"{folder}/answers")).select("id", "status", "attempts", "progress_pct", "changes", "refusals")
