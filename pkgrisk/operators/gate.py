"""Inventory gate: scan feed against decisions, status codes, reasons, memos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Decision per response status.
STATUS = {200: "allow", 202: "quarantine", 451: "block", 404: "not-found"}
# Strictest first.
STRICTNESS = ("block", "quarantine", "allow")


def inventory_rows(feed: DataFrame, ecosystem: str = "npm") -> DataFrame:
    """Package records of one ecosystem with a usable name and version; empty text counts as missing."""
    return feed.filter(f"record_type = 'package' AND ecosystem = '{ecosystem}'").withColumns({
        "package": F.expr("coalesce(nullif(normalized_name, ''), nullif(package_name, ''))"),
        "source_file": F.expr("coalesce(source_file, '')"),
        "confidence": F.expr("coalesce(confidence, '')"),
    }).filter("package IS NOT NULL AND coalesce(version, '') <> ''").drop("record_type", "normalized_name", "package_name")


def decode_status(audit: DataFrame, status: str = "status") -> DataFrame:
    """Add ``decision`` and the short ``reason`` shown for it."""
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in STATUS.items())
    have = set(audit.columns)

    def col(name: str, dtype: str = "string") -> str:
        return name if name in have else f"cast(NULL AS {dtype})"

    rules = f"array_join({col('failed_rules', 'array<string>')}, ',')"
    reason = (
        f"CASE WHEN {status} = 451 THEN coalesce(nullif({rules}, ''), {col('error')}, '') "
        f"WHEN {status} = 202 THEN coalesce(concat('quarantine: ', nullif({rules}, '')), {col('note')}, '') "
        f"WHEN {status} = 404 THEN 'not-found' "
        f"WHEN {status} >= 400 THEN coalesce(nullif({col('detail')}, ''), {col('error')}, '') ELSE '' END"
    )
    return audit.withColumns({
        "decision": F.expr(f"CASE {status} {whens} ELSE 'error' END"),
        "reason": F.expr(reason),
    })


def gate_inventory(scan: DataFrame, decisions: DataFrame, environment: str | None = None) -> DataFrame:
    """Verdict per scanned package; unknown packages are ``not-found``, unknown versions ``error``.

    ``decisions(package, version, verdict, failed_rules)``, with ``ecosystem`` if the scan has it too. Of several rows
    for a release, in several environments for instance, the strictest counts; ``environment`` keeps those of one.
    """
    if environment is not None:
        decisions = decisions.filter(F.col("env") == environment)
    key = ["ecosystem", "package"] if {"ecosystem"} <= set(scan.columns) & set(decisions.columns) else ["package"]
    known = decisions.select(*key).distinct().withColumn("_known", F.lit(True))
    place = "coalesce(nullif(array_position(array({}), verdict), 0), 9)".format(", ".join(f"'{v}'" for v in STRICTNESS))
    verdicts = decisions.groupBy(*key, "version").agg(
        F.expr(f"min_by(struct(verdict, failed_rules), struct({place}, verdict, failed_rules)) AS _d")
    ).select(*key, "version", "_d.verdict", "_d.failed_rules")
    joined = scan.join(verdicts, [*key, "version"], "left").join(known, key, "left")
    return joined.selectExpr(
        *scan.columns,
        "coalesce(verdict, IF(_known, 'error', 'not-found')) AS decision",
        "CASE WHEN verdict = 'block' THEN array_join(failed_rules, ',') WHEN verdict = 'quarantine' AND size(failed_rules) > 0 "
        "THEN concat('quarantine: ', array_join(failed_rules, ',')) WHEN verdict IS NULL AND _known IS NULL THEN 'not-found' ELSE '' END AS reason",
    )


def gate_summary(gated: DataFrame) -> DataFrame:
    """Counts by decision and the flag that fails a build."""
    return gated.agg(
        F.expr("count(*) AS n"), *[F.expr(f"count_if(decision = '{d}') AS n_{d.replace('-', '_')}") for d in ("allow", "quarantine", "block", "not-found", "error")],
        F.expr("coalesce(bool_or(decision = 'block'), false) AS any_block"),
    )


# Wording per decision and per threat class.
DECISION_TEXT = {
    "allow": "Meets all intake controls; approved for installation.",
    "quarantine": "Fails a non-blocking control; held for manual review.",
    "block": "Fails a blocking control; refused.",
}
THREAT_TEXT = {
    "A": "Compromised-Maintainer Version Bump",
    "B": "Typosquatting / Dependency Confusion",
    "C": "Novel Vulnerability",
}


def render_memos(decisions: DataFrame, timestamp: str, threat_class: str = "A", policy_version: str = "1.0") -> DataFrame:
    """Evidence memo per decision: each evidence line split at its first colon into rule and detail.

    Adds ``memo`` and ``n_pass``; hash columns ``tarball_sha512`` and ``metadata_sha256`` are quoted when present.
    """
    have = set(decisions.columns)
    rules = (
        "transform(evidence, e -> named_struct('name', trim(substring_index(e, ':', 1)), "
        "'detail', trim(substring(e, instr(e, ':') + 1))))"
    )
    staged = decisions.withColumn("_r", F.expr(
        f"transform({rules}, r -> named_struct('name', r.name, 'detail', r.detail, 'passed', array_contains(passed_rules, r.name)))"
    ))
    described = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DECISION_TEXT.items()) + " ELSE 'Decision recorded; no description available.' END"
    loss = "IF(verdict = 'block', 'supply-chain dependency compromise', 'no loss path: cleared by policy controls')"
    hashes = ", ".join(
        f"concat('{label}: ', coalesce({c}, '(not computed)'))" if c in have else f"'{label}: (not computed)'"
        for label, c in (("Tarball SHA-512", "tarball_sha512"), ("Metadata SHA-256", "metadata_sha256"))
    )
    memo = (
        "concat_ws('\\n', '# Control Evidence Memo', concat('Control: ', package, '-', version), "
        "concat('Package: ', package, '@', version), concat('Decision: ', upper(verdict)), "
        f"'Threat class: {threat_class} - {THREAT_TEXT[threat_class]}', concat('Evaluated: ', {timestamp}), 'Policy version: {policy_version}', "
        f"{described}, array_join(transform(_r, r -> concat('- ', r.name, ': ', IF(r.passed, 'PASS', 'FAIL'), ' - ', r.detail)), '\\n'), "
        f"concat('Loss path: ', {loss}), {hashes})"
    )
    return staged.withColumns({
        "memo": F.expr(memo), "n_pass": F.expr("size(filter(_r, r -> r.passed))"),
    }).drop("_r")
