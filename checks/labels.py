"""Ground truth, label lookup, corpora, state validation, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import table, tables, view, with_views
from pkgrisk.functions import names
from pkgrisk.operators import labels, predicates


TRUTH = with_views("truth_sources", "labelled_pkgs") + r""",
sets AS (SELECT key FROM truth_sources WHERE source = 'tool_benign' EXCEPT SELECT key FROM truth_sources WHERE source = 'tool_fn'),
ben AS (SELECT key FROM sets UNION SELECT key FROM truth_sources WHERE source = 'tool_fp'),
mal AS (SELECT key FROM (SELECT key FROM truth_sources WHERE source = 'tool_malicious' EXCEPT SELECT key FROM truth_sources WHERE source = 'tool_fp')
        UNION SELECT key FROM truth_sources WHERE source = 'tool_fn'),
cand AS (SELECT key, 3 AS rank, 0 AS label FROM truth_sources WHERE source = 'benign_list'
   UNION ALL SELECT key, 2, 0 FROM ben UNION ALL SELECT key, 4, 1 FROM mal
   UNION ALL SELECT key, 1, 1 FROM truth_sources WHERE source = 'summary'),
truth AS (SELECT regexp_extract(key, '^(.*)/([^/]*)$', 1) AS name, regexp_extract(key, '^(.*)/([^/]*)$', 2) AS version,
   arg_max(label, rank) AS label FROM cand WHERE key LIKE '%/%' GROUP BY 1, 2)
"""


@query("build_ground_truth", TRUTH + "SELECT name, version, label FROM truth")
def truth(spark, sf):
    return labels.build_ground_truth(view(spark, sf, "truth_sources"))


@query(
    "report_set_difference",
    TRUTH + "SELECT key, true AS is_benign, key IN (SELECT key FROM mal) AS is_malicious FROM ben "
    "UNION ALL SELECT key, false, true FROM mal WHERE key NOT IN (SELECT key FROM ben)",
)
def _(spark, sf):
    src = view(spark, sf, "truth_sources").filter("source LIKE 'tool%'").selectExpr(
        "key", "replace(replace(replace(replace(source, 'tool_fp', 'fp'), 'tool_fn', 'fn'), 'tool_benign', 'benign'), "
        "'tool_malicious', 'malicious') AS source",
    )
    return labels.tool_truth(src).filter("is_benign OR is_malicious")


@query(
    "attach_labels",
    TRUTH
    + """SELECT doc_id, coalesce(t.label, n.label, 0) AS label, coalesce(t.label, n.label) IS NOT NULL AS is_labelled,
      CASE coalesce(t.label, n.label) WHEN 1 THEN 'malicious' WHEN 0 THEN 'clean' ELSE 'suspicious' END AS label_word
      FROM labelled_pkgs p LEFT JOIN truth t ON t.name = p.name AND t.version = p.version
      LEFT JOIN (SELECT name, min(label) AS label FROM truth GROUP BY name HAVING count(DISTINCT label) = 1) n ON n.name = p.name""",
)
def attached(spark, sf):
    out = labels.attach_labels(view(spark, sf, "labelled_pkgs"), labels.build_ground_truth(view(spark, sf, "truth_sources")))
    return out.select("doc_id", "label", "is_labelled", "label_word")


@query(
    "map_labels",
    TRUTH
    + """SELECT word, verdict, flat, count(*) AS n FROM (SELECT CASE WHEN l.toxic = 1 THEN 'malicious' WHEN l.quality = 1 THEN 'clean' ELSE 'suspicious' END AS word,
      CASE WHEN l.toxic = 1 THEN 'block' WHEN l.quality = 1 THEN 'allow' ELSE 'quarantine' END AS verdict,
      CASE WHEN l.toxic = 1 THEN '1' ELSE '0' END AS flat FROM labels l) GROUP BY ALL""",
)
def _(spark, sf):
    df = table(spark, sf, "labels").selectExpr(
        "CASE WHEN toxic = 1 THEN 'malicious' WHEN quality = 1 THEN 'clean' ELSE 'suspicious' END AS word"
    )
    df = labels.map_labels(labels.map_labels(df, "word", "word", "verdict", "verdict"), "verdict", "verdict", "binary", "flat")
    return df.groupBy("word", "verdict", "flat").agg(F.count("*").alias("n"))


def corpora(spark, sf):
    docs = table(spark, sf, "documents")
    path = "concat('pkgs/', doc_id) AS path"
    benign = docs.filter("n_chars <= 5000").selectExpr(path, "0 AS label")
    synth = docs.selectExpr(path, "IF(doc_id % 3 = 0, 1, 0) AS label", "concat('pat', doc_id % 5) AS pattern_id")
    real = docs.filter("n_chars > 5000").selectExpr(path, "1 AS label")
    return benign, synth, real


@query(
    "merge_corpora",
    """WITH b AS (SELECT concat('pkgs/', doc_id) AS path, 0 AS label FROM documents WHERE n_chars <= 5000),
    s AS (SELECT concat('pkgs/', doc_id) AS path, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS label, concat('pat', doc_id % 5) AS pattern_id FROM documents)
    SELECT path, label, 'benign' AS source, NULL AS pattern_id FROM b
    UNION ALL SELECT path, label, 'synthetic', pattern_id FROM s WHERE NOT (label = 0 AND path IN (SELECT path FROM b))
    UNION ALL SELECT concat('pkgs/', doc_id), 1, 'real_mal', NULL FROM documents WHERE n_chars > 5000""",
)
def _(spark, sf):
    return labels.merge_corpora(*corpora(spark, sf)).select("path", "label", "source", "pattern_id")


@query(
    "concat_corpora",
    """SELECT origin, count(*) AS n, count(pattern_id) AS n_pattern FROM (
      SELECT 'advisory' AS origin, NULL AS pattern_id FROM orders UNION ALL SELECT 'documents', lang FROM documents) GROUP BY ALL""",
)
def _(spark, sf):
    a = table(spark, sf, "orders").selectExpr("'advisory' AS origin", "o_orderkey AS id")
    b = table(spark, sf, "documents").selectExpr("'documents' AS origin", "lang AS pattern_id")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.count("pattern_id").alias("n_pattern"))


STATE_SQL = with_views("state") + r""",
st AS (SELECT state, CASE WHEN hash_n % 9 = 0 THEN replace(key, '@', '#') ELSE key END AS key FROM (SELECT *, length(key) + ascii(right(key, 1)) AS hash_n FROM state)),
notes AS (SELECT concat(replace(key, '/', '__'), '.md') AS name FROM st WHERE key LIKE '%7' OR key LIKE '%1'
  UNION ALL SELECT 'README.md' UNION ALL SELECT concat('orphan', n_nationkey, '@1.md') FROM nation),
expected AS (SELECT DISTINCT concat(key, '.md') AS item FROM st WHERE key LIKE '%@%'),
problems AS (SELECT 'invalid_key' AS problem, concat(state, ':', key) AS item FROM st WHERE key NOT LIKE '%@%'
  UNION ALL SELECT 'missing_note', item FROM expected WHERE item NOT IN (SELECT name FROM notes)
  UNION ALL SELECT DISTINCT 'orphan_note', name FROM notes WHERE name <> 'README.md' AND name NOT IN (SELECT item FROM expected))
"""


def state_problems(spark, sf):
    st = view(spark, sf, "state").selectExpr(
        "state", "IF((length(key) + ascii(right(key, 1))) % 9 = 0, replace(key, '@', '#'), key) AS key"
    )
    notes = st.filter("key LIKE '%7' OR key LIKE '%1'").selectExpr("concat(replace(key, '/', '__'), '.md') AS name")
    extra = table(spark, sf, "nation").selectExpr("inline(array(struct(concat('orphan', n_nationkey, '@1.md') AS name), struct('README.md' AS name)))")
    return labels.validate_state(st, notes.unionByName(extra))


@query("validate_state", STATE_SQL + "SELECT problem, item FROM problems")
def _(spark, sf):
    return state_problems(spark, sf)


@query(
    "validation_report",
    STATE_SQL
    + """SELECT count(*) FILTER (problem = 'invalid_key') AS n_invalid_key, count(*) FILTER (problem = 'missing_note') AS n_missing_note,
      count(*) FILTER (problem = 'orphan_note') AS n_orphan_note, count(*) = 0 AS ok FROM problems""",
)
def _(spark, sf):
    return labels.validation_report(state_problems(spark, sf))


@query(
    "resolve_records",
    """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN concat('custom/', doc_id, '.json') END AS record_path,
      CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN concat('c', n_chars) WHEN doc_id % 5 <> 0 THEN concat('r', n_chars) END AS payload,
      (doc_id % 3 = 0 AND doc_id % 4 <> 0) OR doc_id % 5 <> 0 AS resolved FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    manifest = docs.selectExpr("doc_id AS id", "IF(doc_id % 3 = 0, concat('custom/', doc_id, '.json'), NULL) AS record_path")
    records = docs.filter("doc_id % 4 <> 0").selectExpr("concat('custom/', doc_id, '.json') AS path", "concat('c', n_chars) AS payload").unionByName(
        docs.filter("doc_id % 5 <> 0").selectExpr("concat('records/', doc_id, '.json') AS path", "concat('r', n_chars) AS payload")
    )
    return labels.resolve_records(manifest, records)


@query(
    "seed_allowlist",
    """WITH r AS (SELECT concat('p', c_custkey) AS package, '1' AS version, c_custkey AS pos FROM customer),
    s AS (SELECT concat('p', o_custkey) AS package, CAST(o_orderkey % 2 AS STRING) AS version, o_orderkey AS pos FROM orders)"""
    + """ SELECT package, version, CASE WHEN min(tier) = 0 THEN 'required' ELSE 'seed' END AS origin, arg_min(pos, tier * 1000000000000 + pos) AS pos FROM (
      SELECT package, version, 0 AS tier, pos FROM r UNION ALL
      SELECT package, version, 1, pos FROM s WHERE (package, version) NOT IN (SELECT concat('p', s_suppkey), '0' FROM supplier)) GROUP BY ALL""",
)
def _(spark, sf):
    cust, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    req = cust.selectExpr("concat('p', c_custkey) AS package", "'1' AS version", "c_custkey AS pos")
    seeds = orders.selectExpr("concat('p', o_custkey) AS package", "cast(o_orderkey % 2 AS string) AS version", "o_orderkey AS pos")
    bad = table(spark, sf, "supplier").selectExpr("concat('p', s_suppkey) AS package", "'0' AS version")
    return labels.seed_allowlist(req, seeds, bad)


@query(
    "incremental_run",
    """SELECT d.doc_id, l.doc_id IS NOT NULL AS cached, CASE WHEN l.doc_id IS NOT NULL THEN 'stored' ELSE 'fresh' END AS how
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    cases = docs.select("doc_id")
    done = table(spark, sf, "labels").selectExpr("doc_id", "'stored' AS how")
    fresh = labels.incremental(cases, done, ["doc_id"]).withColumn("how", F.lit("fresh"))
    return labels.with_cached(fresh, done, cases, ["doc_id"])


MEMBERS_SQL = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('/etc/', p_name) WHEN 1 THEN concat('a/../', p_name)
  WHEN 2 THEN concat('a/..b/', p_name) ELSE concat('package/', p_name) END AS member, p_size % 7 = 0 AS is_link FROM part"""


@query(
    "safe_members",
    f"""SELECT p_partkey, CASE WHEN member LIKE '/%' THEN 'absolute_path' WHEN list_contains(string_split(member, '/'), '..') THEN 'parent_segment'
      WHEN is_link THEN 'link' END AS reject_reason FROM ({MEMBERS_SQL})""",
)
def _(spark, sf):
    tables(spark, sf, MEMBERS_SQL)
    return spark.sql(MEMBERS_SQL).selectExpr("p_partkey", f"{predicates.reject_reason('member', 'is_link')} AS reject_reason")


FILE_SQL = r"""regexp_extract(path, '[^/](\.[^./]+)$', 1)"""


@query(
    "file_kinds",
    with_views("pkg_files", "src_pkg")
    + rf"""SELECT path, n IN ('.js','.mjs','.ts','.json','.md') OR path = 'LICENSE' AS textual,
      regexp_extract(path, '([^/]*)$', 1) <> 'package.json' AND n IN ('.js','.mjs','.ts','.json','.md') AS comparable,
      path LIKE 'lib/%' OR path LIKE 'dist/%' AS build FROM (SELECT path, lower({FILE_SQL}) AS n FROM
      (SELECT path FROM pkg_files UNION ALL SELECT path FROM src_pkg))""",
)
def _(spark, sf):
    files = view(spark, sf, "pkg_files").select("path").unionByName(view(spark, sf, "src_pkg").select("path"))
    return files.selectExpr(
        "path", f"{predicates.is_textual('path')} AS textual", f"{predicates.is_comparable('path')} AS comparable",
        f"{predicates.is_build_output('path')} AS build",
    )


@query(
    "discover_packages",
    with_views("pkg_files")
    + "SELECT DISTINCT concat('root/', package) AS package_dir FROM pkg_files WHERE path = 'package.json'",
)
def _(spark, sf):
    files = view(spark, sf, "pkg_files").selectExpr("concat('root/', package, '/', path) AS path")
    nested = files.selectExpr("concat('root/node_modules/x/', path) AS path")
    return predicates.discover_packages(files.unionByName(nested))


@query(
    "since_filter",
    with_views("advisory_text")
    + """SELECT skip, count(*) AS n FROM (SELECT CASE WHEN dt IS NULL THEN 'no_date' WHEN dt < '1998-01-01' THEN 'too_old' END AS skip FROM (
      SELECT CASE WHEN o_orderkey % 9 <> 0 OR o_orderkey % 4 <> 0 THEN o_orderdate END AS dt FROM orders)) GROUP BY ALL""",
)
def _(spark, sf):
    from pkgrisk.sources import advisories

    osv = advisories.parse_osv(view(spark, sf, "advisory_text"), "line")
    return predicates.since(osv, "1998-01-01").groupBy("skip").agg(F.count("*").alias("n"))


@query(
    "newest_advisories",
    """SELECT o_orderkey AS aid FROM orders ORDER BY CASE WHEN o_orderkey % 9 <> 0 OR o_orderkey % 4 <> 0 THEN
      o_orderdate + CASE WHEN o_orderkey % 9 <> 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 12 HOUR END END DESC NULLS LAST, o_orderkey LIMIT 500""",
)
def _(spark, sf):
    from pkgrisk.sources import advisories

    osv = advisories.parse_osv(view(spark, sf, "advisory_text"), "line")
    return predicates.newest(osv, 500, "aid").select("aid")


@query(
    "cap_sizes",
    "SELECT doc_id, n_chars > 4000 AS oversize, CASE WHEN n_chars > 4000 THEN 0 ELSE length(text) END AS kept FROM documents",
)
def _(spark, sf):
    files = table(spark, sf, "documents").selectExpr("doc_id", "n_chars AS size", "text AS content")
    return predicates.cap_sizes(files, 4000).selectExpr("doc_id", "oversize", "cast(length(content) AS bigint) AS kept")


@query(
    "allowed_urls",
    r"""SELECT page_id, coalesce(regexp_matches(url, '^https?://') AND lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) IN ('m.ththth.example.net', 'ththre.example.com', 'www.example.org'), false) AS url_ok FROM pages""",
)
def _(spark, sf):
    out = predicates.allowed_urls(table(spark, sf, "pages"), ["m.ththth.example.net", "ththre.example.com", "www.example.org"])
    return out.select("page_id", "url_ok")


@query(
    "parse_keys",
    """SELECT o_orderkey, concat(CASE WHEN o_orderkey % 2 = 0 THEN '@s/' ELSE '' END, 'pkg', o_custkey) AS package, concat('1.0.', o_orderkey) AS version,
      concat(CASE WHEN o_orderkey % 2 = 0 THEN '@s__' ELSE '' END, 'pkg', o_custkey, '@1.0.', o_orderkey, '.md') AS note,
      concat('pkg', o_custkey, '-1.0.', o_orderkey, '.tgz') AS tarball, concat('1.0.', o_orderkey) AS tar_version,
      concat('pkg', o_custkey, '-x') AS pypi, substring(CAST(o_orderdate AS STRING), 1, 10) AS captured,
      concat(CASE WHEN o_orderkey % 2 = 0 THEN '@s_' ELSE '' END, 'pkg', o_custkey, '_v') AS token FROM orders""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderdate",
        "concat(IF(o_orderkey % 2 = 0, '@s/', ''), 'pkg', o_custkey, '@1.0.', o_orderkey) AS key",
    )
    df = df.selectExpr(
        "*", f"{names.package_key('key')} AS k", f"{names.seed_line("concat('  ', key)")} AS s",
        f"{names.dated_archive(dated())} AS d",
    )
    return df.selectExpr(
        "o_orderkey", "k.package", "s.version", f"{names.note_file_name('k.package', 'k.version')} AS note",
        f"{names.tarball_name('k.package', 'k.version')} AS tarball",
        f"{names.tarball_version('k.package', names.tarball_name('k.package', 'k.version'))} AS tar_version",
        f"{names.canonical(pypi(), repr('pypi'))} AS pypi", "d.captured_date AS captured",
        f"{names.safe_path_token(token())} AS token",
    )


def dated() -> str:
    return "concat(left(cast(o_orderdate AS string), 10), '-@s@pkg', o_custkey, '-v1.zip')"


def pypi() -> str:
    return "concat(' Pkg', o_custkey, '_.-X ')"


def token() -> str:
    return "concat('/', k.package, '/ v/')"
