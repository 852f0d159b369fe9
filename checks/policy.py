"""Rules, verdicts, state lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import AS_OF, view, with_views
from pkgrisk.functions import integrity, names
from pkgrisk.operators import decide, environments, rules


def releases(spark, sf):
    """Releases with the script map and bytes the rules read."""
    df = view(spark, sf, "releases")
    return df.selectExpr(
        "*", "IF(command IS NOT NULL, map(hook, command), NULL) AS scripts",
        "cast(body AS binary) AS content", "compared - matched AS suspicious",
    )


def as_of():
    return f"timestamp'{AS_OF}'"


# SQL restatement of the rules over the releases view.
AGE = f"date_diff('day', CAST(substring(published,1,10) AS DATE), DATE '{AS_OF[:10]}')"
OUTCOMES = f"""
rel AS (
  SELECT r.*, s.blocked_reason, s.quarantined_reason, coalesce(s.allowlisted, false) AS allowlisted,
    CASE WHEN published IS NULL THEN concat('missing publish timestamp for ', version)
         WHEN published = 'soon' THEN 'unparseable publish timestamp: ''soon''' END AS age_problem,
    CASE WHEN published LIKE '%Z' THEN {AGE} END AS age,
    CASE WHEN command IS NULL THEN true
         WHEN ecosystem = 'pypi' THEN false
         WHEN command = 'echo done' THEN true ELSE false END AS scripts_ok,
    CASE WHEN o7 = 0 THEN 'dist.integrity missing from metadata'
         WHEN o7 = 2 THEN concat('checksum mismatch: expected ',
              substring(to_base64(unhex(sha256('other bytes'))),1,16), '... got ',
              substring(to_base64(unhex(sha256(body))),1,16), '...')
         WHEN o7 = 3 THEN 'integrity parse error: no supported algorithm in integrity string: ''md5-abc'''
         WHEN o7 = 1 THEN 'sha1 verified' ELSE 'sha256 verified' END AS sum_reason,
    o7 NOT IN (0, 2, 3) AS sum_ok,
    (rid % 5 IN (1, 2)) AND git_head IS NOT NULL AND compared > 0 AS sm_usable
  FROM (SELECT *, rid % 7 AS o7 FROM releases) r
  LEFT JOIN (SELECT key, max(CASE WHEN state='blocked' THEN coalesce(reason,'no reason') END) AS blocked_reason,
                    max(CASE WHEN state='quarantined' THEN coalesce(reason,'no reason') END) AS quarantined_reason,
                    bool_or(state='allowlist') AS allowlisted
             FROM state GROUP BY key) s ON s.key = concat(r.package,'@',r.version)),
env(env, min_age, mode, log_only) AS (VALUES ('dev',0,'warn',true),('preprod',7,'deny',false),('prod',14,'deny',false)),
out AS (
  SELECT rel.*, env.env, env.mode, env.log_only,
    (blocked_reason IS NULL AND quarantined_reason IS NULL) AS kq_ok,
    CASE WHEN blocked_reason IS NOT NULL THEN concat('explicitly blocked: ', blocked_reason)
         WHEN quarantined_reason IS NOT NULL THEN concat('explicitly quarantined: ', quarantined_reason)
         ELSE 'not in quarantine db' END AS kq_reason,
    (age_problem IS NULL AND age >= min_age) AS age_ok,
    CASE WHEN age_problem IS NOT NULL THEN age_problem
         WHEN age < min_age THEN concat('released ', age, '.0d ago, minimum is ', min_age, 'd')
         ELSE concat('released ', age, '.0d ago') END AS age_reason,
    CASE WHEN scripts_ok THEN 'lifecycle scripts trivial or absent'
         ELSE concat('non-trivial lifecycle scripts: ', hook, '=''', command, '''') END AS sc_reason,
    CASE WHEN sm_usable THEN matched >= 0.95 * compared END AS sm_ok,
    CASE WHEN sm_usable AND matched >= 0.95 * compared THEN concat('source-match: ',
           CAST(floor(CAST(matched AS DOUBLE)/compared*100) AS BIGINT), '% of files match upstream repo at sha=',
           substring(git_head,1,7), ' (', matched, '/', compared, ')')
         WHEN sm_usable THEN concat('source-match: only ', CAST(floor(CAST(matched AS DOUBLE)/compared*100) AS BIGINT),
           '% of files match (sha=', substring(git_head,1,7), '); ', compared - matched, ' suspicious file(s) differ') END AS sm_reason
  FROM rel, env),
dec AS (
  SELECT *, (mode <> 'warn' AND NOT scripts_ok) AS sc_failed,
    CASE WHEN NOT kq_ok OR NOT age_ok OR (mode <> 'warn' AND NOT scripts_ok) THEN 'block'
         WHEN NOT sum_ok OR sm_ok IS NULL OR NOT sm_ok THEN 'quarantine' ELSE 'allow' END AS raw
  FROM out),
fin AS (
  SELECT *, CASE WHEN log_only THEN 'allow' ELSE raw END AS verdict,
    concat_ws(',', CASE WHEN NOT kq_ok THEN 'known_quarantine' END, CASE WHEN NOT age_ok THEN 'release_age' END,
      CASE WHEN sc_failed THEN 'install_scripts' END, CASE WHEN NOT sum_ok THEN 'checksum' END,
      CASE WHEN NOT sm_ok THEN 'source_match' END) AS failed,
    concat_ws(',', CASE WHEN kq_ok THEN 'known_quarantine' END, CASE WHEN age_ok THEN 'release_age' END,
      CASE WHEN scripts_ok THEN 'install_scripts' END, CASE WHEN sum_ok THEN 'checksum' END,
      CASE WHEN sm_ok THEN 'source_match' END) AS passed,
    concat_ws(' | ', concat('known_quarantine: ', kq_reason), concat('release_age: ', age_reason),
      concat('install_scripts: ', sc_reason), concat('checksum: ', sum_reason),
      concat('source_match: ', coalesce(sm_reason, 'skipped (no verdict)')),
      CASE WHEN log_only AND raw <> 'allow' THEN concat('env=', env, ': log_only=true, downgraded ', raw, ' -> allow') END) AS evidence
  FROM dec)
"""
POLICY = with_views("releases", "state") + "," + OUTCOMES


def decided(spark, sf, **kw):
    return decide.decide(releases(spark, sf), as_of(), state=view(spark, sf, "state"), **kw)


def flat(df):
    return df.selectExpr(
        "package", "version", "env", "verdict",
        "array_join(failed_rules, ',') AS failed",
        "array_join(passed_rules, ',') AS passed",
        "array_join(evidence, ' | ') AS evidence",
    )


@query(
    "decide_releases",
    POLICY + "SELECT package, version, env, verdict, failed, passed, evidence FROM fin",
)
def _(spark, sf):
    return flat(decided(spark, sf))


@query(
    "verdict_counts",
    POLICY + "SELECT env, verdict, count(*) AS n FROM fin GROUP BY ALL",
)
def verdict_counts(spark, sf):
    return decided(spark, sf).groupBy("env", "verdict").agg(F.count("*").alias("n"))


@query(
    "rule_release_age",
    POLICY + "SELECT package, version, env, age_ok AS ok, age_reason AS reason FROM out",
)
def _(spark, sf):
    ev = decide.evaluate(releases(spark, sf), environments.DEFAULTS.values(), as_of())
    return ev.select("package", "version", "env", "r_release_age.ok", "r_release_age.reason")


@query(
    "rule_install_scripts",
    POLICY + "SELECT package, version, scripts_ok AS ok, sc_reason AS reason FROM out WHERE env = 'prod'",
)
def _(spark, sf):
    r = rules.install_scripts("scripts", "ecosystem")
    return releases(spark, sf).withColumn("r", F.expr(r)).select("package", "version", "r.ok", "r.reason")


@query(
    "rule_checksum",
    POLICY + "SELECT package, version, sum_ok AS ok, sum_reason AS reason FROM out WHERE env = 'prod'",
)
def _(spark, sf):
    df = integrity.add_verification(releases(spark, sf), "integrity", "content")
    r = rules.checksum("integrity", "content", "check")
    return df.withColumn("r", F.expr(r)).select("package", "version", "r.ok", "r.reason")


@query(
    "rule_quarantine",
    POLICY + "SELECT package, version, kq_ok AS ok, kq_reason AS reason FROM out WHERE env = 'prod'",
)
def _(spark, sf):
    joined = rules.quarantine_lookup(releases(spark, sf), view(spark, sf, "state"))
    r = rules.known_quarantine("blocked_reason", "quarantined_reason")
    return joined.withColumn("r", F.expr(r)).select("package", "version", "r.ok", "r.reason")


@query(
    "rule_source_match",
    POLICY + "SELECT package, version, sm_ok AS ok, sm_reason AS reason FROM out WHERE env = 'prod'",
)
def _(spark, sf):
    r = rules.source_match(
        "repository", "git_head", "content IS NOT NULL", "compared", "matched", "suspicious",
    )
    return releases(spark, sf).withColumn("r", F.expr(r)).select("package", "version", "r.ok", "r.reason")


@query(
    "apply_allowlist",
    POLICY
    + """SELECT package, version, CASE WHEN hit THEN 'allow' ELSE verdict END AS verdict,
      CASE WHEN hit THEN '' ELSE failed END AS failed,
      CASE WHEN hit THEN concat_ws(',', nullif(passed,''), 'allowlist_override') ELSE passed END AS passed
    FROM (SELECT *, allowlisted AND verdict = 'quarantine' AS hit FROM fin WHERE env = 'preprod')""",
)
def _(spark, sf):
    env = environments.pick(environments.resolve(), "no-such-environment")  # falls back to preprod
    return flat(decide.apply_allowlist(decided(spark, sf, envs=[env]))).drop("env", "evidence")


@query(
    "decide_strict",
    POLICY
    + """SELECT env, verdict, count(*) AS n FROM (SELECT env, CASE WHEN log_only THEN 'allow'
      WHEN NOT kq_ok OR NOT age_ok OR NOT scripts_ok THEN 'block'
      WHEN NOT sum_ok OR NOT coalesce(sm_ok, env <> 'prod') THEN 'quarantine' ELSE 'allow' END AS verdict
      FROM dec WHERE env <> 'dev') GROUP BY ALL""",
)
def _(spark, sf):
    envs = environments.resolve({"environments": {"preprod": {"require_source_match": "no"}}})
    out = decided(spark, sf, envs=[envs["preprod"], envs["prod"]], strict_requirements=True)
    return out.groupBy("env", "verdict").agg(F.count("*").alias("n"))


@query(
    "decide_long",
    POLICY
    + """SELECT package, version, failed, CASE WHEN sm_ok IS NULL THEN 'source_match' ELSE '' END AS skipped,
         raw AS verdict FROM fin WHERE env = 'prod'""",
)
def _(spark, sf):
    ev = decide.evaluate(
        releases(spark, sf), [environments.DEFAULTS["prod"]], as_of(), view(spark, sf, "state")
    )
    long = decide.outcome_rows(ev, ["package", "version"])
    out = decide.decide_long(long, ["package", "version"])
    return out.selectExpr(
        "package", "version", "array_join(failed_rules, ',') AS failed",
        "array_join(skipped_rules, ',') AS skipped", "verdict",
    )


@query(
    "verify_integrity",
    with_views("releases")
    + """SELECT package, version, CASE WHEN o = 1 THEN 'sha1' WHEN o IN (0, 3) THEN 'sha512' ELSE 'sha256' END AS algo,
      CASE WHEN o = 1 THEN sha1(body) WHEN o IN (0, 3) THEN '' ELSE to_base64(unhex(sha256(body))) END AS actual,
      o NOT IN (0, 2, 3) AS matches, o IN (0, 3) AS broken FROM (SELECT *, rid % 7 AS o FROM releases)""",
)
def _(spark, sf):
    df = integrity.add_verification(releases(spark, sf), "integrity", "content", "v")
    return df.select(
        "package", "version", "v.algo", "v.actual", "v.matches", F.col("v.error").isNotNull().alias("broken")
    )


@query(
    "parse_repo",
    with_views("releases")
    + """SELECT rid, CASE WHEN o IN (1, 3) THEN 'github' WHEN o = 2 THEN 'gitlab' END AS host,
      CASE WHEN o IN (1, 2, 3) THEN replace(package, 'pkg', 'own') END AS owner,
      CASE WHEN o IN (1, 2, 3) THEN 'rep' END AS repo,
      CASE WHEN o IN (1, 3) THEN concat('https://github.com/', replace(package, 'pkg', 'own'), '/rep/archive/{sha}.tar.gz')
           WHEN o = 2 THEN concat('https://gitlab.com/', replace(package, 'pkg', 'own'), '/rep/-/archive/{sha}/rep-{sha}.tar.gz') END AS archive_url
    FROM (SELECT *, rid % 5 AS o FROM releases)""",
)
def _(spark, sf):
    return view(spark, sf, "releases").withColumn("r", F.expr(names.repository("repository"))).selectExpr(
        "rid", "r.host", "r.owner", "r.repo", f"{names.archive_url('r')} AS archive_url"
    )
