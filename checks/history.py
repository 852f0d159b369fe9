"""Audit tail, retention, freshness, latest version, state fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import table, view, with_views
from pkgrisk.operators import history


@query("audit_tail", with_views("audit") + "SELECT event_id, package, status FROM audit ORDER BY ts DESC, event_id DESC LIMIT 5000")
def _(spark, sf):
    return history.audit_tail(view(spark, sf, "audit"), 5000).select("event_id", "package", "status")


OBJ = with_views("audit") + """, obj AS (SELECT event_id, concat('c/', event_id, '.tgz') AS path, bytes AS size, date_trunc('hour', ts) AS mtime, CAST(event_id % 3 AS STRING) AS tenant FROM audit),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY tenant ORDER BY mtime, CAST('0x' || substring(sha256(path), 1, 15) AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(size) OVER (PARTITION BY tenant) AS total FROM obj),
p AS (SELECT *, total > 2000000 AND total - before > 1600000 AS evict FROM o)
"""


def objects(spark, sf):
    return view(spark, sf, "audit").selectExpr(
        "event_id", "concat('c/', event_id, '.tgz') AS path", "bytes AS size", "date_trunc('hour', ts) AS mtime",
        "cast(event_id % 3 AS string) AS tenant",
    )


@query("plan_eviction", OBJ + "SELECT event_id, tenant, evict FROM p")
def _(spark, sf):
    return history.plan_eviction(objects(spark, sf), 2_000_000).select("event_id", "tenant", "evict")


@query(
    "eviction_stats",
    OBJ + """SELECT tenant, count(*) FILTER (evict) AS evicted_files, CAST(coalesce(sum(size) FILTER (evict), 0) AS BIGINT) AS evicted_bytes,
      count(*) FILTER (NOT evict) AS file_count, CAST(coalesce(sum(size) FILTER (NOT evict), 0) AS BIGINT) AS total_bytes FROM p GROUP BY tenant""",
)
def _(spark, sf):
    return history.eviction_stats(history.plan_eviction(objects(spark, sf), 2_000_000))


@query(
    "fresh_metadata",
    """SELECT package, CAST(fetched_at AS STRING) AS fetched_at, payload FROM (SELECT concat('pkg', user_id) AS package, ts AS fetched_at, props AS payload,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, props DESC) AS rn, max(ts) OVER () AS newest FROM events)
      WHERE rn = 1 AND epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(fetched_at) < 864000 * 1000000::BIGINT""",
)
def _(spark, sf):
    snaps = table(spark, sf, "events").selectExpr("concat('pkg', user_id) AS package", "ts AS fetched_at", "props AS payload")
    out = history.fresh_metadata(snaps, "timestamp'2024-01-20 00:00:00'", 864000)
    return out.selectExpr("package", "cast(fetched_at AS string) AS fetched_at", "payload")


@query(
    "latest_version",
    with_views("releases")
    + """SELECT r.package, coalesce(max(t.latest), max(version)) AS version FROM releases r
      LEFT JOIN (SELECT concat('pkg', c_custkey) AS package, 'tagged' AS latest FROM customer WHERE c_nationkey < 5) t ON t.package = r.package GROUP BY r.package""",
)
def _(spark, sf):
    tags = table(spark, sf, "customer").filter("c_nationkey < 5").selectExpr("concat('pkg', c_custkey) AS package", "'tagged' AS latest")
    return history.latest_version(view(spark, sf, "releases"), tags)


EVENTS = """SELECT concat('pkg', user_id % 300, '@1') AS key, ts, event_id AS seq,
  CASE WHEN event_type IN ('click', 'error') THEN 'promote' ELSE 'add' END AS action,
  CASE WHEN event_type = 'view' THEN 'quarantined' WHEN event_type = 'signup' THEN 'blocked' WHEN event_id % 10 = 0 THEN 'other'
       WHEN event_id % 3 = 0 THEN 'allowlist' ELSE 'quarantined' END AS state,
  CASE WHEN event_id % 7 = 0 THEN 'short' ELSE concat('reviewed by hand number ', event_id, chr(10), 'second line') END AS rationale
FROM events"""
FOLD = f"""WITH e AS ({EVENTS}), b AS (SELECT *, CASE WHEN action = 'add' AND state = 'other' THEN 'unknown_state'
    WHEN action = 'add' AND rationale = 'short' THEN 'short_rationale' END AS bad FROM e),
  m AS (SELECT key, seq, action, lag(action) OVER w AS pa, lag(rationale) OVER w AS pr FROM b WHERE action = 'promote' OR (state = 'quarantined' AND bad IS NULL) WINDOW w AS (PARTITION BY key ORDER BY ts, seq)),
  c AS (SELECT b.*, CASE WHEN b.action = 'promote' AND coalesce(m.pa, '') <> 'add' THEN 'not_quarantined' ELSE bad END AS problem,
     split_part(CASE WHEN b.action = 'promote' THEN m.pr ELSE b.rationale END, chr(10), 1) AS reason FROM b LEFT JOIN m ON m.key = b.key AND m.seq = b.seq),
  ok AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS rn FROM c WHERE problem IS NULL),
  l AS (SELECT key, max(CASE WHEN action = 'add' AND state = 'blocked' THEN rn END) AS rb, max(CASE WHEN action = 'add' AND state = 'quarantined' THEN rn END) AS rq,
     max(CASE WHEN action = 'promote' OR (action = 'add' AND state = 'allowlist') THEN rn END) AS ra, max(CASE WHEN action = 'promote' THEN rn END) AS rp FROM ok GROUP BY key)
"""


def state_events(spark, sf):
    from checks.views import tables

    tables(spark, sf, EVENTS)
    return spark.sql(EVENTS)


@query("checked_events", FOLD + "SELECT problem, action, count(*) AS n FROM c GROUP BY ALL")
def _(spark, sf):
    return history.checked_events(state_events(spark, sf)).groupBy("problem", "action").agg(F.expr("count(*) AS n"))


@query(
    "fold_state",
    FOLD
    + """SELECT l.key, 'blocked' AS state, ok.reason FROM l JOIN ok ON ok.key = l.key AND ok.rn = rb
      UNION ALL SELECT l.key, 'quarantined', ok.reason FROM l JOIN ok ON ok.key = l.key AND ok.rn = rq WHERE rp IS NULL OR rq > rp
      UNION ALL SELECT l.key, 'allowlist', ok.reason FROM l JOIN ok ON ok.key = l.key AND ok.rn = ra""",
)
def _(spark, sf):
    return history.fold_state(history.checked_events(state_events(spark, sf))).select("key", "state", "reason")
