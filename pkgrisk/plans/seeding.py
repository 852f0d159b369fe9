"""Corpus pre-audit: latest version per package, size cap, rules, optional auditor, decision table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.operators import decide, environments, history


def pre_audit(
    releases: DataFrame,
    tags: DataFrame,
    as_of: str,
    state: DataFrame | None = None,
    envs: Iterable[environments.Environment] | None = None,
    min_age_days: int = 14,
    max_bytes: int | None = None,
    audits: DataFrame | None = None,
) -> DataFrame:
    """One decision per package. With ``max_bytes``, ``verdict`` is skipped for larger archives.

    Only the latest release of each package is kept (a join on package and version), then
    decided like any release; ``audits(package, version, verdict)`` adds ``audit_verdict``.
    """
    latest = history.latest_version(releases, tags)
    chosen = releases.join(latest, ["package", "version"], "left_semi")
    sized = chosen.withColumn("bytes", F.expr("coalesce(octet_length(content), 0)"))
    picked = list(envs) if envs is not None else [environments.DEFAULTS[environments.FALLBACK]]
    decided = decide.decide(
        sized if max_bytes is None else sized.filter(f"bytes <= {max_bytes}"), as_of, picked, state, min_age_days=min_age_days
    ).select("package", "version", "bytes", "verdict", "failed_rules")
    out = decided
    if max_bytes is not None:
        out = decided.unionByName(sized.filter(f"bytes > {max_bytes}").selectExpr(
            "package", "version", "bytes", "'skipped' AS verdict", "array('too large') AS failed_rules"
        ))
    if audits is None:
        return out.withColumn("audit_verdict", F.lit(None).cast("string"))
    return out.join(audits.selectExpr("package", "version", "verdict AS audit_verdict"), ["package", "version"], "left")


def verdict_totals(audited: DataFrame) -> DataFrame:
    """Packages by verdict."""
    return audited.groupBy("verdict").agg(F.expr("count(*) AS n"))
