"""Rule outcomes → verdict per release and environment.

Outcomes stay on the release row, so a decision needs no shuffle at all: one projection
per release, fanned out over the handful of configured environments.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions import integrity
from pkgrisk.functions.sql import texts
from pkgrisk.operators import environments, rules


def evaluate(
    releases: DataFrame,
    envs: Iterable[environments.Environment],
    as_of: str,
    state: DataFrame | None = None,
    min_age_days: int | None = None,
    ready: dict[str, str] | None = None,
) -> DataFrame:
    """Run every rule for every environment: adds ``env`` and one ``r_<rule>`` outcome each.

    Optional inputs (``scripts``, ``integrity``, ``content``, ``repository``, ``git_head``,
    ``compared``/``matched``/``suspicious``) count as missing where the column is absent.
    ``as_of`` is a SQL timestamp expression; ``ready`` replaces a rule by the outcome
    expression given. All that does not depend on the environment is computed once per
    release, before the fan-out.
    """
    rows = rules.quarantine_lookup(releases, state) if state is not None else releases
    have = set(rows.columns)

    def col(name: str, dtype: str) -> str:
        return name if name in have else f"cast(NULL AS {dtype})"

    content, declared = col("content", "binary"), col("integrity", "string")
    rows = integrity.add_verification(rows, declared, content, "_check")
    once = {
        "known_quarantine": rules.known_quarantine(
            col("blocked_reason", "string"), col("quarantined_reason", "string"), state is not None
        ),
        "install_scripts": rules.install_scripts(
            col("scripts", "map<string,string>"), col("ecosystem", "string"),
            "scripts_is_object" if "scripts_is_object" in have else "true",
        ),
        "checksum": rules.checksum(declared, content, "_check"),
        "source_match": rules.source_match(
            col("repository", "string"), col("git_head", "string"), f"{content} IS NOT NULL",
            col("compared", "bigint"), col("matched", "bigint"), col("suspicious", "bigint"),
        ),
        **(ready or {}),
    }
    rows = rows.withColumns({f"r_{name}": F.expr(e) for name, e in once.items()}).drop("_check")
    fan_out = f"explode(array({', '.join(environments.as_sql(e) for e in envs)}))"
    rows = rows.withColumn("_env", F.expr(fan_out))
    min_age = str(min_age_days) if min_age_days is not None else "_env.min_release_age_days"
    age = rules.release_age("published", "version", min_age, as_of)
    return rows.withColumns({"env": F.col("_env.name"), "r_release_age": F.expr(age)})


def outcome_rows(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per release, environment and rule."""
    packed = ", ".join(
        f"named_struct('ord', {i}, 'rule', '{n}', 'outcome', CASE WHEN r_{n}.ok THEN 'pass' "
        f"WHEN NOT r_{n}.ok THEN 'fail' ELSE 'skip' END, 'reason', r_{n}.reason)"
        for i, n in enumerate(rules.ORDER)
    )
    return evaluated.selectExpr(*keys, f"inline(array({packed}))")


def verdicts(evaluated: DataFrame, strict_requirements: bool = False) -> DataFrame:
    """Fold outcomes into ``verdict, failed_rules, passed_rules, skipped_rules, evidence``.

    A skipped checksum or source match always holds the release; with
    ``strict_requirements`` only where the environment requires that rule.
    """
    ok = {n: f"r_{n}.ok" for n in rules.ORDER}
    mode = "_env.install_scripts"
    failed = {n: f"NOT {c}" for n, c in ok.items()}
    failed["install_scripts"] += f" AND {mode} = 'deny'"
    skipped = {n: f"{c} IS NULL" for n, c in ok.items()}

    def names(flags: dict[str, str], *extra: str) -> str:
        items = [f"IF({c}, '{n}', NULL)" for n, c in flags.items()] + list(extra)
        return f"array_compact(array({', '.join(items)}))"

    def moved(to: str) -> str:
        return f"IF(NOT {ok['install_scripts']} AND {mode} = '{to}', 'install_scripts', NULL)"

    holds = dict(skipped)
    if strict_requirements:
        holds["checksum"] += " AND _env.require_checksum"
        holds["source_match"] += " AND _env.require_source_match"
    any_block = " OR ".join(f"coalesce({failed[n]}, false)" for n in rules.BLOCKING)
    any_hold = " OR ".join(
        f"coalesce({failed[n]}, false) OR ({holds[n]})" for n in ("checksum", "source_match")
    )
    lines = ", ".join(
        f"concat('{n}: ', coalesce(r_{n}.reason, 'skipped (no verdict)'))" for n in rules.ORDER
    )
    softened = "_env.log_only AND _raw <> 'allow'"
    note = "concat('env=', env, ': log_only=true, downgraded ', _raw, ' -> allow')"
    df = evaluated.withColumn(
        "_raw", F.expr(f"CASE WHEN {any_block} THEN 'block' WHEN {any_hold} THEN 'quarantine' ELSE 'allow' END")
    )
    return df.withColumns({
        "verdict": F.expr(f"IF({softened}, 'allow', _raw)"),
        "failed_rules": F.expr(names(failed)),
        "passed_rules": F.expr(names(ok, moved("allow"))),
        "skipped_rules": F.expr(names(skipped, moved("warn"))),
        "evidence": F.expr(f"array_compact(array({lines}, IF({softened}, {note}, NULL)))"),
    }).drop("_raw", "_env", *[f"r_{n}" for n in rules.ORDER])


def decide(
    releases: DataFrame,
    as_of: str = "current_timestamp()",
    envs: Iterable[environments.Environment] | None = None,
    state: DataFrame | None = None,
    strict_requirements: bool = False,
    **kwargs,
) -> DataFrame:
    chosen = list(envs) if envs is not None else list(environments.DEFAULTS.values())
    return verdicts(evaluate(releases, chosen, as_of, state, **kwargs), strict_requirements)


def apply_allowlist(decisions: DataFrame) -> DataFrame:
    """Held releases on the allowlist are let through, with a marker rule and an evidence line."""
    line = "concat('allowlist_override: ', package, '@', version, ' is on the curated allowlist')"
    none = "cast(array() AS array<string>)"
    return decisions.withColumn("_hit", F.expr("allowlisted AND verdict = 'quarantine'")).withColumns({
        "verdict": F.expr("IF(_hit, 'allow', verdict)"),
        "failed_rules": F.expr(f"IF(_hit, {none}, failed_rules)"),
        "passed_rules": F.expr("IF(_hit, array_append(passed_rules, 'allowlist_override'), passed_rules)"),
        "evidence": F.expr(f"IF(_hit, array_append(evidence, {line}), evidence)"),
    }).drop("_hit")


def decide_long(rule_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys, ord, rule, outcome, reason) → arrays; at most one row per rule and release."""
    packed = rule_rows.groupBy(*keys).agg(
        F.expr("array_sort(collect_list(named_struct('ord', ord, 'rule', rule, 'outcome', outcome, 'reason', reason))) AS r")
    )

    def pick(state: str) -> str:
        return f"transform(filter(r, x -> x.outcome = '{state}'), x -> x.rule)"

    arrays = packed.selectExpr(
        *keys, f"{pick('fail')} AS failed_rules", f"{pick('pass')} AS passed_rules",
        f"{pick('skip')} AS skipped_rules",
        "transform(r, x -> concat(x.rule, ': ', coalesce(x.reason, 'skipped (no verdict)'))) AS evidence",
    )
    return arrays.withColumn("verdict", F.expr(
        f"CASE WHEN arrays_overlap(failed_rules, array({texts(rules.BLOCKING)})) THEN 'block' "
        "WHEN size(failed_rules) > 0 OR arrays_overlap(skipped_rules, array('checksum', 'source_match')) "
        "THEN 'quarantine' ELSE 'allow' END"
    ))
