"""Version picking, tree diffs, source match, evidence, packed diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registries import CASES, osv_cases
from checks.registry import query
from checks.views import table, view, with_views
from pkgrisk.operators import parts, treediff

DIFF = with_views("tree_before", "tree_after") + """, d AS (
  SELECT coalesce(b.case_id, a.case_id) AS case_id, coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS change_kind,
    coalesce(strlen(b.content), 0) AS size_before, coalesce(strlen(a.content), 0) AS size_after,
    coalesce(a.doc_id, b.doc_id) AS doc_id, b.content AS cb, a.content AS ca
  FROM tree_before b FULL OUTER JOIN tree_after a ON a.case_id = b.case_id AND a.path = b.path WHERE b.content IS DISTINCT FROM a.content)
"""


def diff(spark, sf, with_text=False):
    return treediff.diff_trees(view(spark, sf, "tree_before"), view(spark, sf, "tree_after"), with_text)


@query("diff_trees", DIFF + "SELECT case_id, path, change_kind, size_before, size_after FROM d")
def _(spark, sf):
    return diff(spark, sf).drop("oversize")


LINES = DIFF + """, lines AS (
  SELECT case_id, path, w, unnest(string_split(regexp_replace(t, '\\n$', ''), chr(10))) AS line FROM (
    SELECT case_id, path, 1 AS w, ca AS t FROM d WHERE ca <> '' UNION ALL SELECT case_id, path, -1, cb FROM d WHERE cb <> '')),
  net AS (SELECT case_id, path, line, sum(w) AS x FROM lines GROUP BY ALL)
"""


@query(
    "line_counts",
    LINES + "SELECT case_id, path, CAST(sum(greatest(x, 0)) AS BIGINT) AS added_lines, CAST(sum(greatest(-x, 0)) AS BIGINT) AS removed_lines FROM net GROUP BY ALL",
)
def _(spark, sf):
    return treediff.line_counts(diff(spark, sf, True))


# Whole-file additions and removals, and one appended line, align the same way in any diff.
@query(
    "line_diff",
    LINES
    + """, n AS (SELECT case_id, path, sum(greatest(x, 0)) AS a, sum(greatest(-x, 0)) AS r FROM net GROUP BY ALL)
      SELECT n.case_id, n.path, CAST(a AS BIGINT) + CASE WHEN change_kind = 'modified' THEN 1 ELSE 0 END AS added_lines, CAST(r AS BIGINT) + CASE WHEN change_kind = 'modified' THEN 1 ELSE 0 END AS removed_lines
      FROM n JOIN d ON d.case_id = n.case_id AND d.path = n.path""",
)
def _(spark, sf):
    # The line before an appended one gains its newline, so an aligned diff reports it on both sides.
    out = treediff.line_diff(diff(spark, sf, True))
    return out.select("case_id", "path", "added_lines", "removed_lines")


# Texts of very different authors and of shared passages: the next document's text as the one after.
NEXT = "SELECT a.doc_id, a.text AS before, b.text AS after FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"


def next_texts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    after = docs.selectExpr("doc_id - 1 AS doc_id", "text AS text_after")
    return docs.withColumnRenamed("text", "text_before").join(after, "doc_id").withColumn("path", F.lit("x"))


@query("line_edits", f"SELECT doc_id, sha256(after) AS digest, true AS fewer FROM ({NEXT})")
def _(spark, sf):
    """The edits rebuild the text after, and keep no more lines than the two texts have in common."""
    files = next_texts(spark, sf)
    kept = "aggregate(edits, 0, (n, e) -> n + IF(e.lines IS NULL, e.upto - e.from, 0))"
    common = "size(array_intersect(split(text_before, '\\n'), split(text_after, '\\n')))"
    return (
        treediff.line_edits(files).join(files.select("doc_id", "text_before", "text_after"), "doc_id")
        .selectExpr("doc_id", f"sha2({treediff.apply_edits('text_before')}, 256) AS digest", f"{kept} <= size(split(text_before, '\\n')) AND ({kept} = 0 OR {common} > 0) AS fewer")
    )


@query(
    "line_diff_bounds",
    f"""WITH n AS ({NEXT}), l AS (
      SELECT doc_id, w, unnest(string_split(regexp_replace(t, '\\n$', ''), chr(10))) AS line FROM (SELECT doc_id, 1 AS w, after AS t FROM n WHERE after <> '' UNION ALL SELECT doc_id, -1, before FROM n WHERE before <> '')),
      net AS (SELECT doc_id, line, sum(w) AS x FROM l GROUP BY ALL), c AS (SELECT doc_id, sum(greatest(x, 0)) AS a, sum(greatest(-x, 0)) AS r, sum(x) AS s FROM net GROUP BY doc_id)
      SELECT doc_id, CAST(s AS BIGINT) AS balance, true AS bounded FROM c""",
)
def _(spark, sf):
    """An aligned diff changes at least the lines that the multisets differ in, and as many more on one side."""
    files = next_texts(spark, sf).withColumn("case_id", F.col("doc_id"))
    plain = files.selectExpr("case_id", "doc_id", "path", "regexp_replace(text_before, '\\n$', '') AS text_before", "regexp_replace(text_after, '\\n$', '') AS text_after")
    counts = treediff.line_counts(plain).selectExpr("case_id", "added_lines AS a", "removed_lines AS r")
    ended = plain.selectExpr("case_id", "doc_id", "path", *[f"IF({t} = '', '', concat({t}, '\\n')) AS {t}" for t in ("text_before", "text_after")])
    out = treediff.line_diff(ended).join(counts, "case_id")
    return out.selectExpr("doc_id", "added_lines - removed_lines AS balance", "added_lines >= a AND removed_lines >= r AS bounded")


def pairs(spark, sf):
    return view(spark, sf, "tree_before").select("case_id").distinct().withColumn("status", F.lit("tarball_diff"))


@query(
    "pair_manifest",
    DIFF + "SELECT case_id, 'tarball_diff' AS status, count(*) AS n_files_changed, " + ", ".join(f"count(*) FILTER (change_kind = '{k}') AS n_{k}" for k in ("added", "removed", "modified")) + " FROM d GROUP BY case_id",
)
def _(spark, sf):
    return treediff.pair_manifest(pairs(spark, sf), diff(spark, sf))


@query(
    "manifest_summary",
    DIFF + "SELECT 'tarball_diff' AS status, count(*) AS n_total, count(*) AS n_with_changes, CAST(sum(n) AS BIGINT) AS total_changes FROM (SELECT count(*) AS n FROM d GROUP BY case_id)",
)
def _(spark, sf):
    return treediff.manifest_summary(treediff.pair_manifest(pairs(spark, sf), diff(spark, sf)))


SRC = with_views("src_pkg", "src_repo") + r""", p AS (SELECT *, lower(regexp_extract(path, '([^/]*)\.[^.]+$', 1)) AS stem, path LIKE 'dist/%' AS build FROM src_pkg WHERE path NOT LIKE '%.png'),
s AS (SELECT *, lower(regexp_extract(path, '([^/]*)\.[^.]+$', 1)) AS stem FROM src_repo),
v AS (SELECT p.package, p.path, CASE WHEN e.path IS NOT NULL THEN CASE WHEN e.content = p.content THEN 'matched' ELSE 'suspicious' END
   WHEN EXISTS (SELECT 1 FROM s WHERE s.package = p.package AND s.stem = p.stem AND s.content = p.content) THEN 'matched' WHEN build THEN NULL ELSE 'suspicious' END AS verdict,
   e.path IS NULL AND EXISTS (SELECT 1 FROM s WHERE s.package = p.package AND s.stem = p.stem) AS by_stem
   FROM p LEFT JOIN s e ON e.package = p.package AND e.path = p.path)
"""


@query("source_match_files", SRC + "SELECT package, path, verdict, by_stem FROM v")
def _(spark, sf):
    return treediff.source_match_files(view(spark, sf, "src_pkg"), view(spark, sf, "src_repo"))


@query(
    "source_match",
    SRC
    + """, c AS (SELECT package, count(verdict) AS compared, count(*) FILTER (verdict = 'matched') AS matched FROM v GROUP BY package)
      SELECT package, compared, matched, compared - matched AS suspicious, matched / compared AS ratio, matched / compared >= 0.95 AS passes FROM c
      UNION ALL SELECT 'empty', 0, 0, 0, 1.0, NULL FROM region WHERE r_regionkey = 0""",
)
def _(spark, sf):
    files = view(spark, sf, "src_pkg")
    packages = files.select("package").distinct().unionByName(table(spark, sf, "region").filter("r_regionkey = 0").selectExpr("'empty' AS package"))
    return treediff.source_match(packages, files, view(spark, sf, "src_repo"))


@query(
    "evidence_files",
    DIFF + """SELECT case_id, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE change_kind WHEN 'modified' THEN 0 WHEN 'added' THEN 1 ELSE 2 END, path) AS rank FROM d) WHERE rank <= 4""",
)
def _(spark, sf):
    return treediff.evidence_files(diff(spark, sf)).select("case_id", "path", "rank")


@query(
    "pack_blocks",
    DIFF
    + """, b AS (SELECT case_id, path, concat('--- a/', path, chr(10), '+++ b/', path, chr(10), '# change_kind=', change_kind, chr(10), 'sizes ', size_before, ' ', size_after, chr(10)) AS block FROM d),
      r AS (SELECT *, sum(length(block)) OVER (PARTITION BY case_id ORDER BY path) AS upto, sum(length(block)) OVER (PARTITION BY case_id) AS total FROM b)
      SELECT case_id, concat(coalesce(string_agg(block, '' ORDER BY path) FILTER (upto <= 2000), ''), CASE WHEN max(total) > 2000 THEN '... [truncated at 2000 chars] ...' || chr(10) ELSE '' END) AS diff_text, max(total) > 2000 AS truncated FROM r GROUP BY case_id""",
)
def _(spark, sf):
    changes = diff(spark, sf).withColumn("unified_diff", F.expr("concat('sizes ', size_before, ' ', size_after)"))
    return treediff.pack_blocks(changes, 2000)


@query(
    "diff_parts",
    DIFF
    + """, b AS (SELECT case_id, path, concat('--- a/', path, chr(10), '+++ b/', path, chr(10), '# change_kind=', change_kind, chr(10), 'sizes ', size_before, ' ', size_after, chr(10)) AS block FROM d)
      SELECT case_id, count(*) AS n_blocks, CAST(sum(length(block)) AS BIGINT) AS n_chars, true AS fits FROM b GROUP BY case_id""",
)
def _(spark, sf):
    changes = diff(spark, sf).withColumn("unified_diff", F.expr("concat('sizes ', size_before, ' ', size_after)"))
    return parts.diff_parts(changes, 400).groupBy("case_id").agg(
        F.expr("sum(n_blocks) AS n_blocks"), F.expr("sum(length(text)) AS n_chars"), F.expr("bool_and(n_blocks = 1 OR length(text) <= 400) AS fits")
    )


# Sources as groups: one holds a third of all texts. Place and digest show the order and the content of all parts.
@query(
    "text_parts",
    "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, sha256(concat(doc_id, ' ', text)) AS digest, true AS fits FROM documents",
)
def _(spark, sf):
    limit = 1 << 17
    joined = parts.text_parts(table(spark, sf, "documents"), ["source"], ["doc_id"], "concat(doc_id, ' ', text)", limit, "\x1e").select(
        "source", "part", "n_blocks", F.expr(f"n_blocks = 1 OR length(text) <= {limit}").alias("fits"), F.explode(F.transform(
            F.split("text", "\x1e"), lambda x, k: F.struct(k.alias("k"), F.sha2(x, 256).alias("digest"))
        )).alias("b"),
    )
    # part and place in it → place in the source, by running sums over the parts alone
    upto = joined.groupBy("source", "part").agg(F.max("n_blocks").alias("n")).selectExpr(
        "source", "part", "sum(n) OVER (PARTITION BY source ORDER BY part) - n AS earlier"
    )
    return joined.join(upto, ["source", "part"]).selectExpr("source", "earlier + b.k + 1 AS place", "b.digest AS digest", "fits")


PICK = CASES + """, v AS (SELECT c.*, concat('1.0.', k) AS unpatched_version, CASE WHEN k % 7 = 0 THEN concat('1.0.', k) WHEN k % 11 = 0 THEN NULL ELSE concat('2.0.', k) END AS patched_version FROM c),
s AS (SELECT *, CASE WHEN patched_version IS NULL THEN 'skipped_missing_versions' WHEN patched_version = unpatched_version THEN 'skipped_same_version' END AS status FROM v)
"""


def picked(spark, sf):
    k = "cast(substring(osv_ids[0], 5) AS bigint)"
    df = osv_cases(spark, sf).withColumn("first_patched_version", F.expr(
        f"CASE WHEN {k} % 7 = 0 THEN concat('1.0.', {k}) WHEN {k} % 11 = 0 THEN '' ELSE first_patched_version END"
    ))
    return treediff.pick_versions(df)


@query("pick_versions", PICK + "SELECT case_id, unpatched_version, patched_version, status FROM s")
def _(spark, sf):
    return picked(spark, sf).select("case_id", "unpatched_version", "patched_version", "status")


@query(
    "resolve_pairs",
    PICK
    + """SELECT case_id, CASE WHEN status IS NOT NULL THEN status WHEN package NOT IN (SELECT concat('pkg', o_custkey) FROM orders WHERE o_orderkey % 3 <> 0) THEN 'skipped_no_packument'
      WHEN k % 3 = 0 OR k % 5 = 1 THEN 'skipped_no_tarball' ELSE 'tarball_diff' END AS status FROM s""",
)
def _(spark, sf):
    rel = table(spark, sf, "orders").filter("o_orderkey % 3 <> 0").selectExpr(
        "concat('pkg', o_custkey) AS package", "inline(array(struct(concat('1.0.', o_orderkey) AS version, 'u' AS tarball), "
        "struct(concat('2.0.', o_orderkey) AS version, IF(o_orderkey % 5 = 1, '', 'p') AS tarball)))",
    )
    return treediff.resolve_pairs(picked(spark, sf), rel).select("case_id", "status")


@query(
    "manifest_slice",
    with_views("npm_docs")
    + """SELECT k, concat('install=x', k) AS scripts, 2 AS n_deps, CASE k % 3 WHEN 0 THEN 'git+https://github.com/o/r' WHEN 1 THEN concat('https://gitlab.com/o/r', k) END AS repository, concat('1.', k) AS version,
      CASE WHEN k % 2 = 0 THEN 'install: before=''x' || k || ''' after=''y''' ELSE '' END AS delta FROM npm_docs""",
)
def _(spark, sf):
    files = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS k", "'package.json' AS path",
        """concat('{"version":"1.', o_orderkey, '","scripts":{"install":"x', o_orderkey, '","test":"t"},"dependencies":{"a":"1","b":"2"},"repository":', CASE o_orderkey % 3 WHEN 0 THEN '"git+https://github.com/o/r"' WHEN 1 THEN concat('{"url":"https://gitlab.com/o/r', o_orderkey, '"}') ELSE '7' END, '}') AS content""",
    )
    s = treediff.manifest_slice(files, ["k"]).withColumn("after", F.expr("IF(k % 2 = 0, map('install', 'y'), scripts)"))
    return s.selectExpr(
        "k", "array_join(transform(map_entries(scripts), e -> concat(e.key, '=', e.value)), ';') AS scripts", "size(dependencies) AS n_deps", "repository", "version",
        f"array_join(transform({treediff.install_script_delta('scripts', 'after')}, d -> concat(d.hook, ': ', d.line)), '; ') AS delta",
    )
