"""Views that give the test tables their role (releases, files, state, feeds…).

The SQL is the common subset of Spark SQL and DuckDB, so both engines see the same input.
A few helper functions with DuckDB's names are declared as inlined SQL functions in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

AS_OF = "2001-01-10 00:00:00"

VIEWS: dict[str, str] = {}

VIEWS["releases"] = """
SELECT o_orderkey AS rid,
       concat('pkg', o_custkey) AS package,
       concat('1.0.', o_orderkey) AS version,
       CASE o_orderkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'composer' END AS ecosystem,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'soon'
            ELSE concat(substring(CAST(o_orderdate AS STRING), 1, 10), 'T00:00:00Z') END AS published,
       o_orderdate AS published_at,
       CASE o_orderkey % 3 WHEN 0 THEN 'postinstall' WHEN 1 THEN 'setup_py' ELSE 'post-autoload-dump' END AS hook,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'echo done'
            WHEN o_orderpriority = '2-HIGH' THEN 'node x.js && node y.js'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'echo a b c'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
            ELSE 'echo "open' END AS command,
       concat('bytes of ', o_orderkey) AS body,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL
            WHEN o_orderkey % 7 = 1 THEN concat('sha1-hex:', upper(sha1(concat('bytes of ', o_orderkey))))
            WHEN o_orderkey % 7 = 2 THEN concat('sha256-', to_base64(unhex(sha256('other bytes'))))
            WHEN o_orderkey % 7 = 3 THEN 'md5-abc'
            ELSE concat('sha1-hex:00 sha256-', to_base64(unhex(sha256(concat('bytes of ', o_orderkey))))) END AS integrity,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL
            WHEN o_orderkey % 5 = 1 THEN concat('git+https://github.com/own', o_custkey, '/rep.git#main')
            WHEN o_orderkey % 5 = 2 THEN concat('https://gitlab.com/own', o_custkey, '/rep/')
            WHEN o_orderkey % 5 = 3 THEN concat('git@github.com:own', o_custkey, '/rep.git')
            ELSE 'https://example.com/foo/bar' END AS repository,
       CASE WHEN o_orderkey % 2 = 0 THEN sha1(CAST(o_orderkey AS STRING)) END AS git_head,
       CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 50 + 1 END AS compared,
       CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN o_orderkey % 50 + 1
            ELSE CAST(floor((o_orderkey % 50 + 1) / 2) AS BIGINT) END AS matched
FROM orders
"""

VIEWS["state"] = """
SELECT CASE WHEN o_orderkey % 41 = 0 THEN 'blocked' WHEN o_orderkey % 43 = 0 THEN 'quarantined'
            ELSE 'allowlist' END AS state,
       concat('pkg', o_custkey, '@1.0.', o_orderkey) AS key,
       CASE WHEN o_orderkey % 2 = 0 THEN 'manual review' END AS reason
FROM orders WHERE o_orderkey % 41 = 0 OR o_orderkey % 43 = 0 OR o_orderkey % 5 = 0
"""

# Ten files per package, one of them package.json, one hook file, one below node_modules.
VIEWS["pkg_files"] = r"""
SELECT doc_id,
       concat('pkg', CAST(floor(doc_id / 10) AS BIGINT)) AS package,
       CASE doc_id % 10 WHEN 0 THEN 'package.json' WHEN 1 THEN 'postinstall.js'
            WHEN 2 THEN concat('lib/', doc_id, '.ts') WHEN 3 THEN concat('node_modules/', doc_id, '.js')
            WHEN 4 THEN concat('docs/', doc_id, '.MD') WHEN 5 THEN concat('src/', doc_id, '.mjs')
            ELSE concat('lib/', doc_id, '.js') END AS path,
       CASE WHEN doc_id % 10 = 0 THEN
            concat('{"name":"pkg', CAST(floor(doc_id / 10) AS BIGINT), '","version":"1.0.', doc_id,
                   '","main":"lib/', doc_id + 6, '.js","scripts":{"postinstall":"node lib/', doc_id + 7,
                   '.js --x","test":"node src/', doc_id + 5, '.mjs"},"dependencies":{"a":"1","b":"2"}}')
            ELSE text END AS content
FROM documents
"""

# Trees before and after: %3=0 removed, %3=2 added, %6=1 modified, %6=4 unchanged.
VIEWS["tree_before"] = """
SELECT concat('case', CAST(floor(doc_id / 100) AS BIGINT)) AS case_id, concat('lib/', doc_id, '.js') AS path,
       text AS content, doc_id
FROM documents WHERE doc_id % 3 <> 2
"""
VIEWS["tree_after"] = r"""
SELECT concat('case', CAST(floor(doc_id / 100) AS BIGINT)) AS case_id, concat('lib/', doc_id, '.js') AS path,
       CASE WHEN doc_id % 6 = 1 THEN concat(text, chr(10), 'added line ', doc_id) ELSE text END AS content, doc_id
FROM documents WHERE doc_id % 3 <> 0
"""
VIEWS["src_pkg"] = """
SELECT concat('case', CAST(floor(doc_id / 100) AS BIGINT)) AS package,
       CASE WHEN doc_id % 7 = 0 THEN concat('dist/', doc_id, '.js') WHEN doc_id % 11 = 0 THEN concat('img/', doc_id, '.png')
            ELSE concat('src/', doc_id, '.js') END AS path,
       text AS content, doc_id
FROM documents WHERE doc_id % 3 <> 2
"""
VIEWS["src_repo"] = """
SELECT concat('case', CAST(floor(doc_id / 100) AS BIGINT)) AS package,
       CASE WHEN doc_id % 5 = 0 THEN concat('src/', doc_id, '.ts') ELSE concat('src/', doc_id, '.js') END AS path,
       CASE WHEN doc_id % 4 = 1 THEN concat(text, '!') ELSE text END AS content
FROM documents WHERE doc_id % 13 <> 0
"""

# Labelled records; unlabelled rows exercise fallbacks. Scores carry many ties.
VIEWS["scored"] = """
SELECT d.doc_id AS id, d.lang AS stratum, d.source AS pattern_id, l.quality AS label,
       CAST(((d.doc_id * 7919) % 101 + l.quality * 20) AS DOUBLE) / 128.0 AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

VIEWS["audit"] = """
SELECT event_id, ts, concat('pkg', user_id) AS package, concat('1.', event_id % 7) AS version,
       CASE event_type WHEN 'purchase' THEN 200 WHEN 'view' THEN 200 WHEN 'click' THEN 202
            WHEN 'error' THEN 451 ELSE 404 END AS status,
       CAST(floor(value * 100) AS BIGINT) AS bytes, props
FROM events
"""

VIEWS["scan"] = """
SELECT event_id,
       CASE WHEN event_id % 11 = 0 THEN 'summary' ELSE 'package' END AS record_type,
       CASE WHEN event_id % 5 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('pkg', user_id) END AS normalized_name,
       CASE WHEN event_id % 21 = 0 THEN '' ELSE concat('Pkg', user_id) END AS package_name,
       CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('1.', event_id % 7) END AS version,
       concat('src', user_id % 4) AS source_file, event_type AS confidence
FROM events
"""

# One advisory per order: nested text, some fields missing, other ecosystems, duplicates of CWE ids.
VIEWS["advisory_text"] = """
SELECT o_orderkey AS aid,
       concat('{',
         CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE concat('"id":"MAL-', o_orderkey, '",') END,
         '"summary":"', CASE o_orderkey % 6 WHEN 0 THEN 'a backdoor found' WHEN 1 THEN 'Malware inside' ELSE 'odd code' END, '",',
         CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('"published":"', substring(CAST(o_orderdate AS STRING), 1, 10), 'T00:00:00Z",') END,
         CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('"modified":"', substring(CAST(o_orderdate AS STRING), 1, 10), 'T12:00:00Z",') END,
         '"aliases":["GHSA-', o_orderkey, '","CVE-', o_orderkey, '","X-1"],',
         '"affected":[', CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE concat(
            '{"package":{"name":"pkg', o_custkey, '","ecosystem":"', CASE WHEN o_orderkey % 5 = 0 THEN 'PyPI' ELSE 'npm' END, '"},',
            '"versions":["1.0.', o_orderkey, '","1.1.', o_orderkey, '"],',
            '"ranges":[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"2.0.', o_orderkey, '"}]}',
            CASE WHEN o_orderkey % 3 = 0 THEN ',{"type":"SEMVER","events":[{"introduced":"3.0"},{"last_affected":"3.5"}]}' ELSE '' END, '],',
            '"database_specific":{"cwes":[', CASE o_orderkey % 4 WHEN 0 THEN '{"cweId":"CWE-79"},{"cweId":"CWE-506"},{"cweId":"CWE-79"}'
                 WHEN 1 THEN '{"cweId":"CWE-79"}' WHEN 2 THEN '{"cweId":"CWE-1"}' ELSE '' END, ']}}') END, '],',
         '"references":[{"url":"https://x/', o_orderkey, '"}],',
         '"database_specific":{"malicious-packages-origins":[{"source":"b"},{"source":"a"},{"source":"b"}]}}') AS line
FROM orders
"""

# Package records: manifest, separator, prose plus code-like snippets.
VIEWS["records"] = r"""
SELECT doc_id, concat('pkg', doc_id) AS package_name, concat('1.0.', doc_id) AS version, source, lang,
  concat(
    CASE WHEN doc_id % 11 = 0 THEN 'not json'
         WHEN doc_id % 13 = 0 THEN '{"scripts":"none","files":"x.node","bin":"run.exe"}'
         ELSE concat('{"name":"pkg', doc_id, '","scripts":{"postinstall":"node -e ', left(sha1(CAST(doc_id AS STRING)), 24), '","publish":"p"',
              CASE WHEN doc_id % 2 = 0 THEN ',"preinstall":"sh a.sh"' ELSE '' END, '},"dependencies":{"a":"1"',
              CASE WHEN doc_id % 3 = 0 THEN ',"b":"2"' ELSE '' END, '},"devDependencies":["x"],"files":["a.js"',
              CASE WHEN doc_id % 5 = 0 THEN ',"B.NODE"' ELSE ',7' END, '],"_age_days":', doc_id % 400, '.5}') END,
    '<sep>', text,
    CASE WHEN doc_id % 2 = 0 THEN ' eval (x); new  Function("a"); ' ELSE '' END,
    CASE WHEN doc_id % 3 = 0 THEN ' require("child_process").exec("ls"); require( name ); ' ELSE '' END,
    CASE WHEN doc_id % 4 = 0 THEN '<sep> fs.writeFileSync("/home/u/.ssh/id"); ' ELSE '' END,
    CASE WHEN doc_id % 5 = 0 THEN ' fetch("http://x"); import a from "axios"; require("https") ' ELSE '' END,
    CASE WHEN doc_id % 6 = 0 THEN concat(' ', repeat('QUJD', 16), '== ', repeat('QUJD', 16), ' ', repeat('Zz09', 20), ' ') ELSE '' END,
    CASE WHEN doc_id % 7 = 0 THEN ' _0x1f2a _0x2b _0x3c _0x4d a$$$b _0x55 ' ELSE '' END) AS text
FROM documents
"""

# Report keys per source; every precedence pair occurs.
VIEWS["truth_sources"] = """
SELECT CASE WHEN quality = 1 THEN 'benign_list' ELSE 'summary' END AS source,
       concat('@s##n', CAST(floor(doc_id / 4) AS BIGINT), '/1.', doc_id % 4) AS key FROM labels WHERE doc_id % 2 = 0
UNION ALL
SELECT CASE WHEN toxic = 1 THEN 'tool_malicious' ELSE 'tool_benign' END,
       concat('@s##n', CAST(floor(doc_id / 4) AS BIGINT), '/1.', doc_id % 4) FROM labels WHERE doc_id % 3 <> 0
UNION ALL
SELECT CASE WHEN doc_id % 5 = 0 THEN 'tool_fp' ELSE 'tool_fn' END,
       concat('@s##n', CAST(floor(doc_id / 4) AS BIGINT), '/1.', doc_id % 4) FROM labels WHERE doc_id % 5 < 2
UNION ALL
SELECT 'summary', CASE WHEN doc_id % 7 = 0 THEN concat('noslash', doc_id)
       ELSE concat('@s##n', CAST(floor(doc_id / 4) AS BIGINT), '/1.', doc_id % 4) END FROM labels
"""

VIEWS["labelled_pkgs"] = """
SELECT doc_id, concat('@s##n', CAST(floor(doc_id / 4) AS BIGINT)) AS name, concat('1.', doc_id % 4) AS version FROM documents
"""

VIEWS["chat"] = """
SELECT conv_id, turn, role, text FROM conversations
"""

VIEWS["records_plain"] = "SELECT doc_id, text FROM documents"

# npm packuments: two versions and one entry of the wrong type; repository as text or object.
VIEWS["npm_docs"] = """
SELECT o_orderkey AS k, o_custkey, o_orderdate, concat('{"name":"pkg', o_custkey, '","time":{"1.0.', o_orderkey, '":"', substring(CAST(o_orderdate AS STRING), 1, 10), 'T00:00:00Z"},',
  '"versions":{"1.0.', o_orderkey, '":{"scripts":{"install":"node-gyp rebuild","n":', o_orderkey, '},"dist":{"integrity":"',
  CASE o_orderkey % 3 WHEN 0 THEN 'sha256-AAA= sha384-BBB=' WHEN 1 THEN 'sha1-x' ELSE 'sha512-CCC' END, '","tarball":"https://r/', o_orderkey, '.tgz"},"gitHead":"abc",',
  '"repository":', CASE o_orderkey % 3 WHEN 0 THEN '"git+https://github.com/o/r"' WHEN 1 THEN concat('{"type":"git","url":"https://gitlab.com/o/r', o_orderkey, '"}') ELSE '7' END, '},',
  '"2.0.', o_orderkey, '":{"scripts":"none","dist":[]},"bad":7}}') AS line
FROM orders
"""

VIEWS["pypi_docs"] = """
SELECT o_orderkey AS k, concat('{"info":{"name":"Pkg_', o_custkey, '.x","version":"1.', o_orderkey, '","upload_time":"1990-01-01T00:00:00",',
  '"description":"', CASE o_orderkey % 5 WHEN 0 THEN 'uses cmdclass = {' WHEN 1 THEN 'install_requires a from https://x and a Post-Install step' ELSE 'plain' END, '",',
  '"home_page":" https://home/', o_orderkey, ' ","project_urls":', CASE o_orderkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '{"Code":"https://code","Source":" "}' ELSE '{"Homepage":"https://hp","Source":"https://src"}' END, '},',
  '"urls":[', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '{"packagetype":"sdist","url":"https://s","filename":"a.tar.gz","digests":{"sha256":"ABCD"},"upload_time":"2001-01-01T00:00:00"}'
     WHEN 2 THEN '{"packagetype":"sdist","url":"https://s","filename":"a.tar.gz"},{"packagetype":"bdist_wheel","url":"https://w","filename":"a.whl","digests":{"sha256":"EF01"},"upload_time_iso_8601":"2002-01-01T00:00:00Z"},{"packagetype":"bdist_wheel","url":"https://w2"}'
     ELSE '3,{"packagetype":"bdist_egg","url":"https://e","filename":"a.zip"}' END, ']}') AS line
FROM orders
"""

VIEWS["composer_docs"] = """
SELECT o_orderkey AS k, concat('{"packages":{"Vendor/Pkg', o_orderkey, '":[{"version":"v1.', o_orderkey, '","version_normalized":"1.', o_orderkey, '.0","time":"2000-01-01T00:00:00+00:00",',
  '"dist":{"url":"https://d/', o_orderkey, '","shasum":"ABCDEF', CASE WHEN o_orderkey % 2 = 0 THEN '01' ELSE '' END, '"},',
  CASE o_orderkey % 3 WHEN 0 THEN '"source":{"url":"https://github.com/v/p"},' WHEN 1 THEN '"homepage":"https://hp",' ELSE '"source":"none",' END,
  '"scripts":{"post-install-cmd":["a","b",3],"post-update-cmd":"c","x":[],"y":{}}},4]}}') AS line
FROM orders
"""



def with_views(*names: str) -> str:
    """``WITH`` clause declaring the views (for the SQL side)."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n"


_HELPERS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION sha256(x STRING) RETURNS STRING RETURN sha2(x, 256)",
    "CREATE OR REPLACE TEMPORARY FUNCTION to_base64(x BINARY) RETURNS STRING "
    "RETURN regexp_replace(base64(x), '[\\r\\n]', '')",
)


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that is read in fewer parts than there are cores, or lies in fewer files.

    A file is cut by bytes, but all rows of a row group go to one part, so parts of few files may be empty. A large
    table of many files stays as it is.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    few = min(cores, 64)
    return df.repartition(max(cores, parts), df.columns[0]) if parts < few or len(df.inputFiles()) < few else df


def tables(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views over the Parquet tables the SQL reads."""
    for t in TABLES:
        if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    for helper in _HELPERS:
        spark.sql(helper)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # No WITH clause here: a plan that holds one is not recognised when it is cached.
    tables(spark, sf_dir, VIEWS[name])
    return spark.sql(VIEWS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
