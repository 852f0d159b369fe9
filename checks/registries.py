"""Registry projections, advisories, malware listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import table, view, with_views
from pkgrisk.functions import names
from pkgrisk.operators import cases, projections
from pkgrisk.sources import advisories

NPM = with_views("npm_docs") + """, npm AS (
  SELECT concat('pkg', o_custkey) AS package, concat('1.0.', k) AS version, concat(substring(CAST(o_orderdate AS STRING), 1, 10), 'T00:00:00Z') AS published,
    'install=node-gyp rebuild' AS scripts, CASE k % 3 WHEN 0 THEN 'sha256-AAA= sha384-BBB=' WHEN 1 THEN 'sha1-x' ELSE 'sha512-CCC' END AS integrity_hash,
    CASE k % 3 WHEN 0 THEN 'sha384' ELSE 'sha512' END AS integrity_algo, CASE k % 3 WHEN 0 THEN 'git+https://github.com/o/r' WHEN 1 THEN concat('https://gitlab.com/o/r', k) END AS repository,
    'abc' AS git_head, concat('https://r/', k, '.tgz') AS tarball FROM npm_docs
  UNION ALL SELECT concat('pkg', o_custkey), concat('2.0.', k), NULL, '', NULL, 'sha512', NULL, NULL, '' FROM npm_docs)
"""
PYPI = with_views("pypi_docs") + """, pypi AS (
  SELECT concat('pkg-', o_custkey, '-x') AS package, concat('1.', o_orderkey) AS version,
   CASE o_orderkey % 4 WHEN 1 THEN '2001-01-01T00:00:00' WHEN 2 THEN '2002-01-01T00:00:00Z' ELSE '1990-01-01T00:00:00' END AS published,
   concat_ws(';', CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0 THEN 'custom_install_cmd' END, CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 4 <> 0 THEN 'install_requires_url' END,
     CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 4 <> 0 THEN 'post_install_hook' END, CASE WHEN o_orderkey % 4 IN (1, 3) THEN 'setup_py' END) AS scripts,
   CASE o_orderkey % 4 WHEN 1 THEN 'abcd' WHEN 2 THEN 'ef01' END AS integrity_hash,
   CASE o_orderkey % 3 WHEN 0 THEN concat('https://home/', o_orderkey) WHEN 1 THEN 'https://code' ELSE 'https://src' END AS repository,
   CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://s' WHEN 2 THEN 'https://w' ELSE 'https://e' END AS tarball FROM orders)
"""
COMPOSER = """composer AS (
  SELECT concat('vendor/pkg', o_orderkey) AS package, concat('v1.', o_orderkey) AS version, concat('1.', o_orderkey, '.0') AS version_normalized,
   '2000-01-01T00:00:00+00:00' AS published, 'post-install-cmd=a && b;post-update-cmd=c' AS scripts,
   CASE WHEN o_orderkey % 2 = 0 THEN 'abcdef01' ELSE 'abcdef' END AS integrity_hash,
   CASE o_orderkey % 3 WHEN 0 THEN 'https://github.com/v/p' WHEN 1 THEN 'https://hp' END AS repository, concat('https://d/', o_orderkey) AS tarball FROM orders)
"""
PAIRS = "array_join(array_sort(transform(map_entries(scripts), e -> concat(e.key, '=', e.value))), ';') AS scripts"


def docs(spark, sf, name):
    return view(spark, sf, name).selectExpr("try_parse_json(line) AS doc")


@query("project_npm", NPM + "SELECT * FROM npm")
def _(spark, sf):
    out = projections.project_npm(docs(spark, sf, "npm_docs"))
    return out.selectExpr("package", "version", "published", PAIRS, "integrity_hash", "integrity_algo", "repository", "git_head", "tarball")


@query("project_pypi", PYPI + "SELECT * FROM pypi")
def _(spark, sf):
    out = projections.project_pypi(docs(spark, sf, "pypi_docs"))
    return out.selectExpr("package", "version", "published", "array_join(array_sort(map_keys(scripts)), ';') AS scripts", "integrity_hash", "repository", "tarball")


@query("project_composer", f"WITH {COMPOSER} SELECT * FROM composer")
def _(spark, sf):
    out = projections.project_composer(docs(spark, sf, "composer_docs"))
    return out.selectExpr("package", "version", "version_normalized", "published", PAIRS, "integrity_hash", "repository", "tarball")


@query(
    "unify_releases",
    NPM + PYPI[PYPI.index(", pypi AS"):] + "," + COMPOSER
    + """SELECT package, version, 'npm' AS ecosystem, integrity_hash AS integrity FROM npm
      UNION ALL SELECT package, version, 'pypi', CASE WHEN integrity_hash IS NOT NULL THEN concat('sha256-', to_base64(unhex(integrity_hash))) END FROM pypi
      UNION ALL SELECT package, version, 'composer', concat('sha1-hex:', integrity_hash) FROM composer""",
)
def _(spark, sf):
    out = projections.unify_releases(
        projections.project_npm(docs(spark, sf, "npm_docs")), projections.project_pypi(docs(spark, sf, "pypi_docs")),
        projections.project_composer(docs(spark, sf, "composer_docs")),
    )
    return out.select("package", "version", "ecosystem", "integrity")


KEPT = "o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0 AND o_orderkey % 5 <> 0"
CASES = f"""WITH c AS (SELECT o_orderkey AS k, concat('osv_MAL-', o_orderkey, '_pkg', o_custkey) AS case_id, concat('pkg', o_custkey) AS package,
  concat('MAL-', o_orderkey, ',GHSA-', o_orderkey, ',CVE-', o_orderkey) AS advisory_ids,
  CASE WHEN o_orderkey % 4 = 0 THEN 'critical' WHEN o_orderkey % 4 = 1 THEN 'high' WHEN o_orderkey % 6 IN (0, 1) THEN 'critical' ELSE 'high' END AS severity,
  CASE o_orderkey % 4 WHEN 0 THEN 'CWE-506,CWE-79' WHEN 1 THEN 'CWE-79' WHEN 2 THEN 'CWE-1' ELSE '' END AS cwes,
  concat('[SEMVER] >=0 <2.0.', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '; [SEMVER] >=3.0 <=3.5' ELSE '' END) AS affected_range,
  concat('2.0.', o_orderkey) AS first_patched_version, concat('1.0.', o_orderkey, ',1.1.', o_orderkey) AS versions,
  'a,b' AS origins, concat('https://x/', o_orderkey) AS refs, concat('MAL-', o_orderkey, ',GHSA-', o_orderkey) AS osv_ids FROM orders WHERE {KEPT})
"""


def osv(spark, sf):
    return advisories.parse_osv(view(spark, sf, "advisory_text"), "line")


def osv_cases(spark, sf):
    return cases.osv_to_cases(osv(spark, sf), "timestamp'2001-01-01'")


@query("osv_to_cases", CASES + "SELECT * EXCLUDE (k) FROM c")
def _(spark, sf):
    return osv_cases(spark, sf).selectExpr(
        "case_id", "package", "array_join(advisory_ids, ',') AS advisory_ids", "severity", "array_join(cwes, ',') AS cwes",
        "affected_range", "first_patched_version", "array_join(transform(candidate_versions, c -> c.version), ',') AS versions",
        "array_join(npm.origins, ',') AS origins", "array_join(references, ',') AS refs", "array_join(osv_ids, ',') AS osv_ids",
    )


@query(
    "read_osv",
    """SELECT o_orderkey AS aid, CASE WHEN o_orderkey % 23 <> 0 THEN concat('MAL-', o_orderkey) END AS id,
      CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 1 END AS n_affected FROM orders""",
)
def _(spark, sf):
    return osv(spark, sf).selectExpr("aid", "id", "cast(size(affected) AS int) AS n_affected")


@query(
    "summarize_osv",
    """SELECT CASE WHEN o_orderkey % 23 <> 0 THEN concat('MAL-', o_orderkey) END AS advisory_id, CASE WHEN o_orderkey % 29 <> 0 THEN concat('pkg', o_custkey) END AS package,
      concat('GHSA-', o_orderkey) AS ghsa, CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 2 END AS version_count,
      CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'CWE-506,CWE-79' WHEN 1 THEN 'CWE-79' WHEN 2 THEN 'CWE-1' ELSE '' END END AS cwes FROM orders""",
)
def _(spark, sf):
    return cases.summarize_osv(osv(spark, sf)).selectExpr(
        "advisory_id", "package", "array_join(ghsa_ids, ',') AS ghsa", "version_count", "array_join(cwe_ids, ',') AS cwes"
    )


ARCHIVES = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'compromised_lib' ELSE 'malicious_intent' END AS intent_class,
  concat('2020-01-0', p_partkey % 9 + 1, '-', CASE WHEN p_partkey % 3 = 0 THEN '@s@' ELSE '' END, 'pkg', p_size, '-v1.', p_partkey % 5, CASE WHEN p_partkey % 50 = 7 THEN '.tar' ELSE '.zip' END) AS name FROM part"""
LISTED = f"""WITH a AS ({ARCHIVES}), l AS (SELECT a.p_partkey, intent_class, CASE WHEN name LIKE '%.zip' THEN regexp_replace(regexp_extract(name, '^[0-9-]{{10}}-(.+)-v', 1), '^@s@', '@s/') END AS package,
  CASE WHEN name LIKE '%.zip' THEN concat('1.', p_partkey % 5) END AS version, CASE WHEN name LIKE '%.zip' THEN substring(name, 1, 10) END AS captured_date FROM a),
  m AS (SELECT DISTINCT concat('pkg', p_size) AS package, p_size % 2 = 0 AS every FROM part WHERE p_size % 3 <> 2),
  f AS (SELECT l.*, CASE WHEN intent_class = 'compromised_lib' THEN 'compromised_lib' WHEN every THEN 'malicious_intent_all_versions'
     WHEN NOT every AND version IN ('1.1', '1.2') THEN 'compromised_lib_listed' ELSE 'malicious_intent' END AS intent_label FROM l LEFT JOIN m ON m.package = l.package)
"""


def listing(spark, sf):
    from checks.views import tables

    tables(spark, sf, ARCHIVES)
    a = spark.sql(ARCHIVES).withColumn("k", F.expr(names.dated_archive("name")))
    a = a.selectExpr("p_partkey", "intent_class", "k.package", "k.version", "k.captured_date")
    manifest = table(spark, sf, "part").filter("p_size % 3 <> 2").selectExpr(
        "concat('pkg', p_size) AS package", "IF(p_size % 2 = 0, NULL, array('1.1', '1.2')) AS versions"
    ).distinct()
    return cases.intent_label(a, manifest)


@query("intent_label", LISTED + "SELECT p_partkey, package, version, captured_date, intent_label FROM f")
def _(spark, sf):
    return listing(spark, sf).select("p_partkey", "package", "version", "captured_date", "intent_label")


@query(
    "malware_to_cases",
    LISTED
    + """SELECT concat('malware_', intent_class, '_', package, '@', version) AS case_id, CASE WHEN intent_label = 'compromised_lib' THEN 'high' ELSE 'critical' END AS severity,
      concat('MALWARE-', upper(intent_class), '-', package, '-', version) AS advisory_id, concat('==', version) AS affected_range, captured_date AS published_at FROM f WHERE package IS NOT NULL""",
)
def _(spark, sf):
    return cases.malware_to_cases(listing(spark, sf), "timestamp'2001-01-01'").selectExpr(
        "case_id", "severity", "advisory_ids[0] AS advisory_id", "affected_range", "candidate_versions[0].published_at AS published_at"
    )
