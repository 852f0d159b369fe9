"""File selection, text assembly, budget packing."""

from __future__ import annotations

from checks.registry import query
from checks.views import table, view, with_views
from pkgrisk.operators import selection

SEL = with_views("pkg_files") + r""",
pf AS (SELECT *, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS suf, length(content) - length(replace(content, chr(10), '')) AS nl,
  strlen(content) AS octets, path LIKE 'node_modules/%' AS nm FROM pkg_files),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY nl DESC, path) AS rank FROM pf WHERE suf = '.js' AND NOT nm) WHERE rank <= 3),
ref AS (SELECT package, concat('lib/', doc_id + 7, '.js') AS path FROM pkg_files WHERE path = 'package.json'),
tier AS (SELECT pf.*, CASE WHEN pf.path = 'package.json' THEN 0 WHEN pf.path = 'postinstall.js' THEN 1 WHEN ref.path IS NOT NULL THEN 2
  WHEN suf = '.js' AND NOT nm THEN 3 END AS tier FROM pf LEFT JOIN ref ON ref.package = pf.package AND ref.path = pf.path),
sig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY tier, CASE WHEN tier = 3 THEN -nl ELSE 0 END, path) AS rank,
   row_number() OVER (PARTITION BY package, tier ORDER BY CASE WHEN tier = 3 THEN -nl ELSE 0 END, path) AS in_tier FROM tier WHERE tier IS NOT NULL)
   WHERE rank <= 6 AND (tier < 3 OR in_tier <= 3)),
pri AS (SELECT * FROM (SELECT *, CASE WHEN path = 'package.json' THEN 0 ELSE row_number() OVER (PARTITION BY package, path = 'package.json' ORDER BY length(content), path) END AS rank
   FROM pf WHERE suf IN ('.js','.cjs','.mjs','.ts','.json')) WHERE rank <= 5)
"""


@query("top_files", SEL + "SELECT package, path, rank, nl AS n_lines FROM top")
def _(spark, sf):
    return selection.top_files(view(spark, sf, "pkg_files"), 3, None).select("package", "path", "rank", "n_lines")


@query("select_files_signal", SEL + "SELECT package, path, tier, rank FROM sig")
def _(spark, sf):
    return selection.select_signal_files(view(spark, sf, "pkg_files")).select("package", "path", "tier", "rank")


@query("select_files_priority", SEL + "SELECT package, path, rank FROM pri")
def _(spark, sf):
    return selection.select_priority_files(view(spark, sf, "pkg_files")).select("package", "path", "rank")


@query(
    "assemble_text_signal",
    SEL
    + """SELECT package, count(*) AS n_parts, sha256(string_agg(concat('// === ', path, ' ===', chr(10), content), concat(chr(10), chr(10)) ORDER BY rank)) AS digest
      FROM sig GROUP BY package""",
)
def _(spark, sf):
    out = selection.assemble_text(view(spark, sf, "pkg_files"), "signal")
    return out.selectExpr("package", "cast(n_parts AS bigint) AS n_parts", "sha2(text, 256) AS digest")


@query(
    "assemble_text_record",
    SEL
    + """, parts AS (SELECT package, 0 AS rank, content FROM pf WHERE path = 'package.json'
      UNION ALL SELECT pf.package, 1, content FROM pf JOIN ref ON ref.package = pf.package AND ref.path = pf.path
      UNION ALL SELECT package, 10 + rank, content FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY nl DESC, path) AS rank FROM pf WHERE suf = '.js' AND NOT nm) WHERE rank <= 3)
    SELECT package, count(*) AS n_parts, sha256(string_agg(content, '<sep>' ORDER BY rank)) AS digest
    FROM parts GROUP BY package""",
)
def _(spark, sf):
    out = selection.assemble_text(view(spark, sf, "pkg_files"), "record")
    return out.selectExpr("package", "cast(n_parts AS bigint) AS n_parts", "sha2(text, 256) AS digest")


@query(
    "pack_budget",
    SEL
    + """SELECT package, path, sum_before, sha256(left(content, 8000 - CAST(sum_before AS BIGINT))) AS digest FROM (
      SELECT *, CAST(coalesce(sum(least(length(content), 8000)) OVER (PARTITION BY package ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sum_before FROM pri)
      WHERE 8000 - sum_before > 200""",
)
def _(spark, sf):
    chosen = selection.select_priority_files(view(spark, sf, "pkg_files"))
    out = selection.pack_budget(chosen, 8000)
    return out.selectExpr("package", "path", "sum_before", "sha2(body, 256) AS digest")


@query(
    "pack_budget_full",
    """SELECT source AS package, doc_id, sum_before FROM (
      SELECT *, CAST(coalesce(sum(least(length(text), 20000)) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sum_before
      FROM documents WHERE length(text) > 0) WHERE sum_before < 20000""",
)
def _(spark, sf):
    files = table(spark, sf, "documents").selectExpr("source AS package", "doc_id AS path", "doc_id", "n_chars AS rank", "text AS content")
    return selection.pack_budget(files, 20000, stop="full").select("package", "doc_id", "sum_before")


@query(
    "prompt_order",
    SEL
    + """, named AS (SELECT package, concat('lib/', doc_id + 7, '.js') AS path, 0 AS tier, 0 AS o FROM pkg_files WHERE path = 'package.json'
       UNION ALL SELECT package, concat('src/', doc_id + 5, '.mjs'), 0, 100000 FROM pkg_files WHERE path = 'package.json'
       UNION ALL SELECT package, concat('lib/', doc_id + 6, '.js'), 1, 0 FROM pkg_files WHERE path = 'package.json')
     SELECT pf.package, pf.path, coalesce(named.tier, 2) AS tier,
       coalesce(named.o, CASE WHEN pf.path LIKE 'src/%' THEN 0 WHEN pf.path LIKE 'lib/%' THEN 1 ELSE 2 END) AS ord
     FROM pf LEFT JOIN named ON named.package = pf.package AND named.path = pf.path
     WHERE pf.path <> 'package.json' AND (named.path IS NOT NULL OR (suf IN ('.js','.ts','.mjs') AND NOT nm))""",
)
def _(spark, sf):
    return selection.prompt_order(view(spark, sf, "pkg_files")).select("package", "path", "tier", "ord")
