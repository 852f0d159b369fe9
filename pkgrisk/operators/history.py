"""Audit tails, retention, metadata freshness, latest versions and the state fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.operators.ordering import segmented_lag, value_prefix

# Retention target, metadata lifetime, note length.
TARGET_RATIO, METADATA_TTL, MIN_RATIONALE = 0.8, 3600, 16


def audit_tail(audit: DataFrame, n: int, tiebreak: str = "event_id") -> DataFrame:
    """The newest ``n`` audit rows; as many as are asked for."""
    return audit.orderBy(F.col("ts").desc(), F.col(tiebreak).desc()).limit(max(0, n))


def _cut(df: DataFrame, key: str, group: Sequence[str], budget: str) -> DataFrame:
    """Per group, the last key whose running size before it is still below ``budget``, an expression over the total.

    Only the stretch of keys in which the budget runs out is sorted.
    """
    def wanted(before: str, size: str, total: str) -> str:
        need = budget.format(total=total)
        return f"{before} < {need} AND {need} <= {before} + {size}"

    prefix = value_prefix(df, key, ["size"], group, wanted=wanted)
    return prefix.filter(f"before_size < {budget.format(total='total_size')}").groupBy(*group).agg(
        F.expr(f"max_by(struct({key}, before_size, size, total_size), {key}) AS c")
    )


def plan_eviction(
    objects: DataFrame, max_bytes: int, ratio: float = TARGET_RATIO, group: Sequence[str] = ("tenant",)
) -> DataFrame:
    """Mark objects to evict: oldest first until the total is at most ``ratio * max_bytes``.

    Groups within ``max_bytes`` keep everything. ``objects(path, size, mtime)`` plus the
    group columns; equal times are ordered by a hash of the path. Only cut points are
    computed (one row per group), then each object is compared with its group's cut.
    """
    group = list(group)
    target = int(max_bytes * ratio)
    keyed = objects.selectExpr("*", "unix_micros(cast(mtime AS timestamp)) AS _t")
    own_hash = "cast(conv(left(sha2(path, 256), 15), 16, 10) AS bigint)"
    need = f"IF({{total}} > {max_bytes}, {{total}} - {target}, 0)"
    by_time = _cut(keyed.selectExpr(*group, "_t", "cast(size AS bigint) AS size"), "_t", group, need).selectExpr(
        *group, "c._t AS cut_t", f"c.total_size - {target} - c.before_size AS left_over"
    )
    # Paths are hashed at the cut time only, here and below: the comparison of times comes first.
    tied = keyed.select(*group, "_t", "path", "size").join(by_time, group).filter("_t = cut_t").selectExpr(
        *group, "cut_t", "left_over", f"{own_hash} AS _h", "cast(size AS bigint) AS size"
    )
    by_hash = value_prefix(tied, "_h", ["size"], [*group, "cut_t", "left_over"])  # one cut time for each group
    cuts = by_hash.filter("before_size < left_over").groupBy(*group, "cut_t").agg(F.expr("max(_h) AS cut_h"))
    joined = keyed.join(cuts, group, "left")
    evict = F.expr(f"coalesce(_t < cut_t OR (_t = cut_t AND {own_hash} <= cut_h), false)")
    return joined.withColumn("evict", evict).drop("_t", "cut_t", "cut_h")


def eviction_stats(plan: DataFrame, group: Sequence[str] = ("tenant",)) -> DataFrame:
    return plan.groupBy(*group).agg(
        F.expr("count_if(evict) AS evicted_files"), F.expr("coalesce(sum(IF(evict, size, 0)), 0) AS evicted_bytes"),
        F.expr("count_if(NOT evict) AS file_count"), F.expr("coalesce(sum(IF(evict, 0, size)), 0) AS total_bytes"),
    )


def fresh_metadata(snapshots: DataFrame, as_of: str, ttl: int = METADATA_TTL, value: str = "payload") -> DataFrame:
    """Newest snapshot per package if it is younger than ``ttl`` seconds at ``as_of``."""
    newest = snapshots.groupBy("package").agg(
        F.expr(f"max_by(struct(fetched_at, {value}), struct(fetched_at, {value})) AS s")
    )
    return newest.selectExpr("package", "s.*").filter(
        f"unix_micros(cast({as_of} AS timestamp)) - unix_micros(cast(fetched_at AS timestamp)) < {ttl} * 1000000L"
    )


def latest_version(releases: DataFrame, tags: DataFrame) -> DataFrame:
    """``latest`` tag per package, else the version that sorts last as text."""
    last = releases.groupBy("package").agg(F.expr("max(version) AS last_version"))
    return last.join(tags.selectExpr("package", "latest"), "package", "left").selectExpr(
        "package", "coalesce(latest, last_version) AS version"
    )


def checked_events(events: DataFrame, segment: str = "date_trunc('HOUR', ts)") -> DataFrame:
    """Add ``problem`` to state events: NULL when valid.

    ``events(key, ts, seq, action, state, rationale)`` with action add or promote. An add
    needs a known state and a rationale of at least 16 characters; a promote needs the key
    to be quarantined at that moment, that is, the add or promote before it was a valid add.
    Rows flagged in an optional ``trusted`` column (state carried over from an earlier run)
    skip the rationale check.
    """
    untrusted = "NOT trusted" if "trusted" in events.columns else "true"
    df = events.withColumn("problem", F.expr(
        "CASE WHEN action = 'add' AND coalesce(state, '') NOT IN ('blocked', 'quarantined', 'allowlist') THEN 'unknown_state' "
        f"WHEN action = 'add' AND {untrusted} AND length(trim(coalesce(rationale, ''))) < {MIN_RATIONALE} THEN 'short_rationale' "
        "WHEN coalesce(action, '') NOT IN ('add', 'promote') THEN 'unknown_action' END"
    )).withColumn("reason", F.expr("split(trim(rationale), '\\n')[0]"))
    moves = "coalesce(action = 'promote' OR (state = 'quarantined' AND problem IS NULL), false)"
    chain = segmented_lag(
        df.filter(moves), ["key"], segment, "ts, seq", "struct(action, reason)", "_before"
    )
    chain = chain.withColumns({
        "problem": F.expr(
            "IF(action = 'promote' AND coalesce(_before.action, '') <> 'add', 'not_quarantined', problem)"
        ),
        "reason": F.expr("IF(action = 'promote', _before.reason, reason)"),
    }).drop("_before")
    return chain.unionByName(df.filter(f"NOT ({moves})"))


def fold_state(checked: DataFrame) -> DataFrame:
    """Current policy state ``(key, state, reason, added)`` from checked events.

    A key is quarantined while its last quarantine add is later than its last promotion;
    it is allow-listed by an add or a promotion, whichever came last.
    """
    ok = checked.filter("problem IS NULL").withColumn("_at", F.expr("struct(ts, seq)"))

    def last(cond: str) -> str:
        return f"max_by(IF({cond}, struct(_at, reason), NULL), IF({cond}, _at, NULL))"

    allowed = "action = 'promote' OR (action = 'add' AND state = 'allowlist')"
    per_key = ok.groupBy("key").agg(
        F.expr(last("action = 'add' AND state = 'blocked'") + " AS b"),
        F.expr(last("action = 'add' AND state = 'quarantined'") + " AS q"),
        F.expr(last(allowed) + " AS a"),
        F.expr("max(IF(action = 'promote', _at, NULL)) AS p"),
    )
    return per_key.selectExpr(
        "key",
        "inline(filter(array(IF(b IS NOT NULL, struct('blocked' AS state, b.reason AS reason, b._at.ts AS added), NULL), "
        "IF(q IS NOT NULL AND (p IS NULL OR q._at > p), struct('quarantined' AS state, q.reason AS reason, q._at.ts AS added), NULL), "
        "IF(a IS NOT NULL, struct('allowlist' AS state, a.reason AS reason, a._at.ts AS added), NULL)), x -> x IS NOT NULL))",
    )


def state_as_events(state: DataFrame) -> DataFrame:
    """A folded state as events, so that folding can go on from it."""
    return state.selectExpr(
        "key", "added AS ts", "-1L AS seq", "'add' AS action", "state", "reason AS rationale", "true AS trusted"
    )


def advance_state(state: DataFrame, events: DataFrame) -> DataFrame:
    """Fold new events onto an existing state; only keys with events are recomputed."""
    touched = events.select("key").distinct()
    carried = state_as_events(state.join(touched, "key", "left_semi"))
    fresh = events.selectExpr("key", "cast(ts AS timestamp) AS ts", "seq", "action", "state", "rationale", "false AS trusted")
    moved = fold_state(checked_events(carried.unionByName(fresh)))
    return state.join(touched, "key", "left_anti").unionByName(moved)
