"""Advisories and malware listings → one case schema, and advisory summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.sql import text, text_array

CASE_SCHEMA_VERSION = "scraped_case.v1"
# Weakness ids and words that set the severity of an advisory.
CRITICAL_CWES = ("CWE-506", "CWE-94", "CWE-78", "CWE-829", "CWE-915")
HIGH_CWES = ("CWE-77", "CWE-79", "CWE-352", "CWE-918")
CRITICAL_WORDS = "backdoor|credential|exfil|ransomware|wiper|malicious code|malware|trojan"
# Severity by intent label.
INTENT_SEVERITY = {
    "malicious_intent_all_versions": "critical",
    "malicious_intent": "critical",
    "compromised_lib_listed": "critical",
    "compromised_lib": "high",
}


def infer_severity(cwes: str, summary: str) -> str:
    upper = f"transform({cwes}, c -> upper(c))"
    return (
        f"CASE WHEN arrays_overlap({upper}, {text_array(CRITICAL_CWES)}) THEN 'critical' "
        f"WHEN arrays_overlap({upper}, {text_array(HIGH_CWES)}) THEN 'high' "
        f"WHEN lower(coalesce({summary}, '')) RLIKE '{CRITICAL_WORDS}' THEN 'critical' ELSE 'high' END"
    )


def _cwes(affected: str = "affected") -> str:
    ids = f"flatten(transform({affected}, a -> coalesce(transform(a.database_specific.cwes, c -> c.cweId), array())))"
    return f"array_sort(array_distinct(filter({ids}, c -> coalesce(c, '') <> '')))"


def _ranges() -> str:
    """Rendered ranges: the last event of each kind wins; fixed before last_affected."""
    def last(field: str) -> str:
        return f"try_element_at(filter(r.events.{field}, x -> x IS NOT NULL), -1)"

    ranges = "flatten(transform(affected, a -> coalesce(a.ranges, array())))"
    ends = (
        f"transform({ranges}, r -> named_struct('type', coalesce(r.type, '?'), 'bounds', concat_ws(' ', "
        f"concat('>=', {last('introduced')}), coalesce(concat('<', {last('fixed')}), concat('<=', {last('last_affected')})))))"
    )
    chunks = f"transform(filter({ends}, e -> e.bounds <> ''), e -> concat('[', e.type, '] ', e.bounds))"
    return f"nullif(array_join({chunks}, '; '), '')"


def osv_to_cases(osv: DataFrame, as_of: str = "current_timestamp()") -> DataFrame:
    """npm advisories with an id and an affected package as cases; others are left out."""
    first = "get(affected, 0).package"
    kept = osv.filter(
        f"coalesce(id, '') <> '' AND size(affected) > 0 AND coalesce({first}.name, '') <> '' AND {first}.ecosystem = 'npm'"
    )
    fixed = "flatten(transform(flatten(transform(affected, a -> coalesce(a.ranges, array()))), r -> transform(r.events, e -> e.fixed)))"
    alias = "filter(coalesce(aliases, array()), a -> startswith(a, '{}'))".format
    versions = "flatten(transform(affected, a -> coalesce(a.versions, array())))"
    staged = kept.withColumn("cwes", F.expr(_cwes()))
    return staged.selectExpr(
        f"'{CASE_SCHEMA_VERSION}' AS schema_version",
        f"concat('osv_', id, '_', {first}.name) AS case_id", "'osv' AS source", "'incident_replay' AS case_type",
        f"{first}.name AS package",
        f"concat(array(id), {alias('GHSA-')}, {alias('CVE-')}) AS advisory_ids",
        f"{infer_severity('cwes', 'summary')} AS severity", "summary", "cwes",
        f"{_ranges()} AS affected_range",
        f"get(filter({fixed}, x -> coalesce(x, '') <> ''), 0) AS first_patched_version",
        f"transform({versions}, v -> named_struct('role', 'likely_affected', 'version', v, 'published_at', cast(NULL AS string))) AS candidate_versions",
        "cast(array() AS array<string>) AS benign_neighbor_versions",
        "filter(transform(coalesce(references, array()), r -> r.url), u -> coalesce(u, '') <> '') AS references",
        "cast(NULL AS string) AS source_code_location",
        "named_struct('origins', array_sort(array_distinct(filter(transform(coalesce("
        "database_specific.`malicious-packages-origins`, array()), o -> o.source), s -> coalesce(s, '') <> ''))), "
        "'published', published, 'modified', modified) AS npm",
        f"concat(array(id), {alias('GHSA-')}) AS osv_ids", "'candidate' AS triage_status",
        f"cast({as_of} AS string) AS scraped_at",
    )


def summarize_osv(osv: DataFrame) -> DataFrame:
    """One manifest row per advisory: package, version count, sorted weakness and GHSA ids."""
    versions = "flatten(transform(coalesce(affected, array()), a -> coalesce(a.versions, array())))"
    names = "filter(transform(coalesce(affected, array()), a -> a.package.name), x -> x IS NOT NULL)"
    return osv.selectExpr(
        "id AS advisory_id", f"get({names}, 0) AS package", "get(affected, 0).package.ecosystem AS ecosystem",
        "coalesce(aliases, array()) AS aliases",
        "filter(coalesce(aliases, array()), a -> startswith(a, 'GHSA-')) AS ghsa_ids",
        "summary", "published", "modified", f"size({versions}) AS version_count",
        f"{_cwes('coalesce(affected, array())')} AS cwe_ids",
    )


def intent_label(archives: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``intent_label`` from the intent folder and the package manifest.

    ``manifest(package, versions)``: versions NULL means every version is malicious.
    """
    known = manifest.selectExpr("package", "versions AS _versions", "true AS _known")
    joined = archives.join(known, "package", "left")
    return joined.withColumn("intent_label", F.expr(
        "CASE WHEN intent_class = 'compromised_lib' THEN 'compromised_lib' "
        "WHEN _known AND _versions IS NULL THEN 'malicious_intent_all_versions' "
        "WHEN array_contains(_versions, version) THEN 'compromised_lib_listed' ELSE 'malicious_intent' END"
    )).drop("_versions", "_known")


def malware_to_cases(listing: DataFrame, as_of: str = "current_timestamp()") -> DataFrame:
    """Malware listing rows (``package, version, intent_class, intent_label, captured_date``) as cases."""
    rows = listing.filter("coalesce(package, '') <> '' AND coalesce(version, '') <> ''").selectExpr(
        "package", "version", "coalesce(nullif(intent_label, ''), 'malicious_intent') AS intent_label",
        "coalesce(nullif(intent_class, ''), 'malicious_intent') AS intent_class",
        "coalesce(nullif(captured_date, ''), 'unknown') AS captured",
    )
    severity = "CASE intent_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INTENT_SEVERITY.items()) + " ELSE 'high' END"
    kind = (
        "IF(startswith(intent_label, 'malicious_intent'), 'published with malicious intent', "
        "'compromised release of a legitimate library')"
    )
    return rows.selectExpr(
        f"'{CASE_SCHEMA_VERSION}' AS schema_version",
        "concat('malware_', intent_class, '_', package, '@', version) AS case_id", "'malware_corpus' AS source",
        "'incident_replay' AS case_type", "package",
        "array(concat('MALWARE-', upper(intent_class), '-', package, '-', version)) AS advisory_ids",
        f"{severity} AS severity",
        f"concat({text('Malware corpus entry for npm package `')}, package, '` (version ', version, '), captured ', captured, ': ', {kind}, '.') AS summary",
        "array('CWE-506') AS cwes", "concat('==', version) AS affected_range", "cast(NULL AS string) AS first_patched_version",
        "array(named_struct('role', 'likely_affected', 'version', version, 'published_at', nullif(captured, 'unknown'))) AS candidate_versions",
        "intent_class", "intent_label", f"cast({as_of} AS string) AS scraped_at",
    )
