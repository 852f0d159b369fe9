"""Chat rows, classification rows, trajectories, prompts, truth rows, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registries import CASES, osv_cases
from checks.registry import query
from checks.selection import SEL
from checks.trees import DIFF, diff
from checks.views import table, tables, view, with_views
from pkgrisk.operators import augment, builders, gate, responses, selection



def packages(spark, sf):
    return view(spark, sf, "pkg_files").filter("path = 'package.json'").selectExpr(
        "package", "concat('1.0.', doc_id) AS version", "CASE doc_id DIV 10 % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'clean' ELSE 'suspicious' END AS label", "'docs' AS source"
    )


@query(
    "to_sft",
    SEL
    + """, b AS (SELECT *, coalesce(sum(least(length(content), 8000)) OVER (PARTITION BY package ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pri),
      u AS (SELECT package, count(*) AS n_files, concat(string_agg(concat('- ', path), chr(10) ORDER BY rank), chr(10), chr(10), string_agg(concat('// FILE: ', path, chr(10), left(content, CAST(8000 - before AS BIGINT))), chr(10) || chr(10) ORDER BY rank)) AS files FROM b WHERE 8000 - before > 200 GROUP BY package),
      p AS (SELECT package, doc_id, doc_id // 10 % 3 AS k FROM pkg_files WHERE path = 'package.json')
      SELECT p.package, CASE k WHEN 0 THEN 'postinstall lifecycle hook present' WHEN 1 THEN 'matches benign baseline pattern' ELSE 'requires manual review' END AS findings, n_files,
        sha256(concat('Package: ', p.package, '@1.0.', doc_id, chr(10), 'Source: docs', chr(10), chr(10), 'Files included:', chr(10), files)) AS user_digest,
        CASE k WHEN 0 THEN 0.97 WHEN 1 THEN 0.92 ELSE 0.65 END::DOUBLE AS confidence FROM p JOIN u ON u.package = p.package""",
)
def _(spark, sf):
    out = builders.to_sft(packages(spark, sf), view(spark, sf, "pkg_files"), 2000)
    return out.selectExpr(
        "package", "array_join(findings, ';') AS findings", "cast(n_files AS bigint) AS n_files", "sha2(messages[1].content, 256) AS user_digest",
        "cast(get_json_object(messages[2].content, '$.confidence') AS double) AS confidence",
    )


@query(
    "cases_to_sft",
    CASES
    + """SELECT case_id, 'block' AS verdict, 0.97::DOUBLE AS confidence, concat_ws(';', concat('GHSA advisory: MAL-', k), concat('Severity tier: ', severity),
        CASE WHEN cwes <> '' THEN concat('CWE classification: ', replace(cwes, ',', ', ')) END, concat('Affected version range: ', affected_range), concat('Safe predecessor / first patched: ', first_patched_version)) AS findings FROM c""",
)
def _(spark, sf):
    return builders.cases_to_sft(osv_cases(spark, sf)).selectExpr("case_id", "verdict", "confidence", "array_join(findings, ';') AS findings")


LINES = """SELECT event_id AS ord, CASE event_id % 6 WHEN 0 THEN concat('{"prompt":"p', event_id, '","completion":"c"}') WHEN 1 THEN concat('{"prompt":"p', event_id, '","completion":"', event_type, '"}')
  WHEN 2 THEN concat('{"messages":[{"role":"user","content":"u', event_id, '"},{"role":1,"content":"x"},{"role":"assistant","content":"a"}]}')
  WHEN 3 THEN concat('{"question":"q', event_id, '","input":5,"answer":"a"}') WHEN 4 THEN '{"foo":"bar"}' ELSE 'broken' END AS line FROM events"""


def lines(spark, sf):
    tables(spark, sf, LINES)
    return spark.sql(LINES)


@query(
    "detect_shape",
    "SELECT arg_min(shape, struct_pack(n := -n, r := r)) AS shape FROM (SELECT shape, r, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'B' WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 3 THEN 'C' ELSE 'unknown' END AS shape, "
    "CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 4 END AS r FROM events WHERE event_id % 6 <> 5) GROUP BY ALL)",
)
def _(spark, sf):
    return builders.detect_shape(lines(spark, sf))


@query(
    "record_shapes",
    "SELECT shape, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'B' WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 3 THEN 'C' ELSE 'unknown' END AS shape FROM events WHERE event_id % 6 <> 5) GROUP BY ALL",
)
def _(spark, sf):
    df = lines(spark, sf).selectExpr("try_parse_json(line) AS v").filter("v IS NOT NULL")
    return df.selectExpr(f"{builders.record_shape('v')} AS shape").groupBy("shape").agg(F.expr("count(*) AS n"))


@query(
    "normalize_chat",
    """SELECT 'A' AS shape, event_id AS ord, CASE WHEN event_id % 6 = 2 THEN concat('user:u', event_id, '|assistant:a') END AS m FROM events WHERE event_id % 6 <> 5
      UNION ALL SELECT 'B', event_id, CASE event_id % 6 WHEN 0 THEN concat('user:p', event_id, '|assistant:c') WHEN 1 THEN concat('user:p', event_id, '|assistant:', event_type) END FROM events WHERE event_id % 6 <> 5
      UNION ALL SELECT 'C', event_id, CASE event_id % 6 WHEN 3 THEN concat('user:q', event_id, '|assistant:a') END FROM events WHERE event_id % 6 <> 5""",
)
def _(spark, sf):
    src, out = lines(spark, sf), None
    for shape in ("A", "B", "C"):
        one = builders.normalize_chat(src, shape).selectExpr(
            f"'{shape}' AS shape", "ord", "array_join(transform(filter(messages, m -> m.role <> 'system'), m -> concat(m.role, ':', m.content)), '|') AS m"
        )
        out = one if out is None else out.unionByName(one)
    return out


def pairs(spark, sf):
    return view(spark, sf, "tree_before").groupBy("case_id").agg(F.expr("min(doc_id) AS d")).selectExpr(
        "case_id", "concat('p-', case_id) AS package", "'1.0' AS unpatched_version", "'1.1' AS patched_version",
        "element_at(array('critical', 'high', 'medium', 'low'), cast(d DIV 100 % 4 AS int) + 1) AS severity", "array(concat('GHSA-', case_id)) AS advisory_ids",
        "concat('{\"d\":', d, '}') AS slice_before", "'{}' AS slice_after", "map('install', 'a') AS scripts_before",
        "IF(d DIV 100 % 2 = 0, map('install', 'a', 'postinstall', 'b'), map('install', 'a')) AS scripts_after",
    )


def changes(spark, sf):
    return diff(spark, sf).selectExpr(
        "*", "size_after AS added_lines", "size_before AS removed_lines", "concat('sizes ', size_before, ' ', size_after) AS unified_diff"
    )


PAIRS = DIFF + """, pr AS (SELECT case_id, min(doc_id) AS d, concat('p-', case_id) AS package, ['critical', 'high', 'medium', 'low'][min(doc_id) // 100 % 4 + 1] AS severity FROM tree_before GROUP BY case_id),
b AS (SELECT case_id, path, concat('--- a/', path, chr(10), '+++ b/', path, chr(10), '# change_kind=', change_kind, chr(10), 'sizes ', size_before, ' ', size_after, chr(10)) AS block,
  concat('[', change_kind, '] ', path, ' (+', size_after, '/-', size_before, ')') AS line FROM d),
t AS (SELECT case_id, count(*) AS n, string_agg(block, '' ORDER BY path) AS diff_text, string_agg(line, chr(10) ORDER BY path) AS paths FROM b GROUP BY case_id)
"""


@query(
    "pairs_to_classification",
    PAIRS
    + """, l AS (SELECT unnest([1, 0]) AS label)
      SELECT pr.case_id, label, CASE WHEN label = 1 THEN '1.0' ELSE '1.1' END AS version, n AS n_files_changed, sha256(concat_ws(chr(10), concat('PACKAGE: ', package), concat('VERSION: ', CASE WHEN label = 1 THEN '1.0' ELSE '1.1' END),
        concat('ROLE: ', CASE WHEN label = 1 THEN 'unpatched' ELSE 'patched' END), concat('SEVERITY: ', severity), concat('ADVISORIES: GHSA-', pr.case_id), '', '== MANIFEST ==',
        CASE WHEN label = 1 THEN concat('{"d":', d, '}') ELSE '{}' END, '', '== CHANGED FILES ==', paths, '', '== DIFF ==', diff_text)) AS digest
      FROM pr JOIN t ON t.case_id = pr.case_id, l""",
)
def _(spark, sf):
    out = builders.pairs_to_classification(pairs(spark, sf), changes(spark, sf))
    return out.selectExpr("case_id", "label", "version", "n_files_changed", "sha2(text, 256) AS digest")


@query(
    "pairs_to_trajectories",
    PAIRS
    + """SELECT pr.case_id, 3 + CASE WHEN d // 100 % 2 = 0 THEN 1 ELSE 0 END + least(4, n) AS n_tool_calls, 8 + 1 + 2 * CASE WHEN d // 100 % 2 = 0 THEN 1 ELSE 0 END + 2 * least(4, n) AS n_messages,
        CASE severity WHEN 'critical' THEN CASE WHEN d // 100 % 2 = 0 THEN 0.98 ELSE 0.95 END WHEN 'high' THEN CASE WHEN d // 100 % 2 = 0 THEN 0.93 ELSE 0.88 END WHEN 'medium' THEN 0.75 ELSE 0.6 END::DOUBLE AS confidence,
        concat('File changes between 1.0 and 1.1: ', n) AS changed FROM pr JOIN t ON t.case_id = pr.case_id""",
)
def _(spark, sf):
    out = builders.pairs_to_trajectories(pairs(spark, sf), changes(spark, sf))
    return out.selectExpr("case_id", "cast(n_tool_calls AS bigint) AS n_tool_calls", "cast(size(messages) AS bigint) AS n_messages", "confidence", "findings[2] AS changed")


@query(
    "truth_rows",
    PAIRS
    + """SELECT pr.case_id, n AS n_files_changed, d // 100 % 2 = 0 AS has_install_script_delta, '1.0=1,1.1=0' AS truth, e.paths AS paths FROM pr JOIN t ON t.case_id = pr.case_id
      JOIN (SELECT case_id, string_agg(path, ',' ORDER BY path) AS paths FROM d GROUP BY case_id) e ON e.case_id = pr.case_id""",
)
def _(spark, sf):
    out = builders.truth_rows(pairs(spark, sf), changes(spark, sf))
    return out.selectExpr(
        "case_id", "n_files_changed", "has_install_script_delta", "array_join(transform(array_sort(map_entries(ground_truth)), e -> concat(e.key, '=', e.value)), ',') AS truth",
        "array_join(evidence_paths, ',') AS paths",
    )


RUBRIC = "Look for install hooks that reach the network. " * 20


@query(
    "build_prompts",
    SEL
    + f""", named AS (SELECT package, concat('lib/', doc_id + 7, '.js') AS path, 0 AS tier, 0 AS o FROM pkg_files WHERE path = 'package.json'
       UNION ALL SELECT package, concat('src/', doc_id + 5, '.mjs'), 0, 100000 FROM pkg_files WHERE path = 'package.json'
       UNION ALL SELECT package, concat('lib/', doc_id + 6, '.js'), 1, 0 FROM pkg_files WHERE path = 'package.json'),
     o AS (SELECT pf.package, pf.path, content, coalesce(named.tier, 2) AS tier, coalesce(named.o, CASE WHEN pf.path LIKE 'src/%' THEN 0 WHEN pf.path LIKE 'lib/%' THEN 1 ELSE 2 END) AS ord
       FROM pf LEFT JOIN named ON named.package = pf.package AND named.path = pf.path
       WHERE pf.path <> 'package.json' AND length(content) > 0 AND (named.path IS NOT NULL OR (suf IN ('.js','.ts','.mjs') AND NOT nm))),
     m AS (SELECT package, length(content) AS m, {selection.code_budget(4000, len(RUBRIC))} AS budget FROM pf WHERE path = 'package.json'),
     r AS (SELECT o.*, m, budget, m + coalesce(sum(least(length(content), budget)) OVER (PARTITION BY o.package ORDER BY tier, ord, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM o JOIN m ON m.package = o.package)
     SELECT package, concat('package.json,', string_agg(path, ',' ORDER BY tier, ord, path)) AS files, CAST(max(m) + sum(least(length(content), budget - used)) AS BIGINT) AS code_chars FROM r WHERE used < budget GROUP BY package""",
)
def _(spark, sf):
    files = view(spark, sf, "pkg_files")
    out = builders.build_prompts(files.select("package").distinct(), files, RUBRIC, 4000)
    return out.selectExpr("package", "array_join(files_included, ',') AS files", "code_chars")


@query(
    "to_eval_records",
    """SELECT conv_id, concat(max(CASE WHEN r = 1 THEN text END), chr(10), chr(10), max(CASE WHEN r = 2 THEN text END)) AS prompt, max(CASE WHEN r = 3 THEN text END) AS expected
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3 GROUP BY conv_id HAVING count(*) = 3""",
)
def _(spark, sf):
    return builders.to_eval_records(table(spark, sf, "conversations"))


ANSWERS = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN concat('```json\n{"verdict":" Malicious ","confidence":', value, ',"findings":["a",', event_id, ']}\n```')
  WHEN 3 THEN concat('Sure: {"verdict":"clean","confidence":"0.25","findings":"one","reasoning":" r "} done') WHEN 4 THEN 'text {bad json}' WHEN 5 THEN '{"verdict":"odd","confidence":"x"}'
  WHEN 6 THEN 'I cannot assist with that.' ELSE '{"verdict":"suspicious","confidence":-1,"findings":[]}' END AS raw FROM events"""


@query(
    "parse_responses",
    """SELECT event_id, CASE event_id % 8 WHEN 2 THEN 'malicious' WHEN 3 THEN 'clean' ELSE 'suspicious' END AS verdict,
      CASE event_id % 8 WHEN 2 THEN greatest(0, least(1, value)) WHEN 3 THEN 0.25 WHEN 5 THEN 0.5 ELSE 0 END::DOUBLE AS confidence,
      CASE event_id % 8 WHEN 2 THEN concat('a,', event_id) WHEN 3 THEN 'one' ELSE '' END AS findings,
      CASE event_id % 8 WHEN 0 THEN 'empty response' WHEN 1 THEN 'empty response' WHEN 4 THEN 'broken JSON' WHEN 6 THEN 'no JSON object' END AS problem, event_id % 8 = 6 AS refusal FROM events""",
)
def _(spark, sf):
    tables(spark, sf, ANSWERS)
    out = responses.parse_responses(spark.sql(ANSWERS.replace("\n`", "\\n`").replace("json\n", "json\\n")))
    return out.selectExpr("event_id", "verdict", "confidence", "array_join(findings, ',') AS findings", "problem", "refusal")


def stub_reviewer(batch):
    """Answers by document length; a stand-in for a user's reviewer."""
    return [f'{{"verdict":"{"malicious" if n > 3000 else "clean"}","confidence":0.75}}' for n in batch["n_chars"]]


@query("audit", "SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'malicious' ELSE 'clean' END AS verdict, 0.75::DOUBLE AS confidence FROM documents")
def _(spark, sf):
    out = responses.audit(table(spark, sf, "documents").select("doc_id", "n_chars"), stub_reviewer, ["doc_id"])
    return out.select("doc_id", "verdict", "confidence")


GATE = with_views("scan") + """, s AS (SELECT event_id, CASE WHEN normalized_name <> '' THEN normalized_name ELSE package_name END AS package, version, source_file FROM scan
   WHERE record_type = 'package' AND ecosystem = 'npm' AND version <> '' AND (normalized_name <> '' OR package_name <> '')),
dec AS (SELECT DISTINCT concat('pkg', user_id) AS package, concat('1.', event_id % 7) AS version, CASE WHEN user_id % 9 = 0 THEN 'block' WHEN user_id % 4 = 0 THEN 'quarantine' ELSE 'allow' END AS verdict FROM events WHERE event_id % 7 < 5),
g AS (SELECT s.*, coalesce(verdict, CASE WHEN s.package IN (SELECT package FROM dec) THEN 'error' ELSE 'not-found' END) AS decision FROM s LEFT JOIN dec ON dec.package = s.package AND dec.version = s.version)
"""


def decisions(spark, sf):
    return table(spark, sf, "events").filter("event_id % 7 < 5").selectExpr(
        "concat('pkg', user_id) AS package", "concat('1.', event_id % 7) AS version",
        "CASE WHEN user_id % 9 = 0 THEN 'block' WHEN user_id % 4 = 0 THEN 'quarantine' ELSE 'allow' END AS verdict",
    ).distinct().withColumn("failed_rules", F.expr("IF(verdict = 'allow', cast(array() AS array<string>), array('release_age', 'checksum'))"))


@query(
    "gate_inventory",
    GATE + """SELECT event_id, package, decision, CASE decision WHEN 'block' THEN 'release_age,checksum' WHEN 'quarantine' THEN 'quarantine: release_age,checksum' WHEN 'not-found' THEN 'not-found' ELSE '' END AS reason FROM g""",
)
def gated(spark, sf):
    rows = gate.inventory_rows(view(spark, sf, "scan"))
    return gate.gate_inventory(rows, decisions(spark, sf)).select("event_id", "package", "decision", "reason")


@query(
    "gate_summary",
    GATE + "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (decision = '{d}') AS n_{d.replace('-', '_')}" for d in ("allow", "quarantine", "block", "not-found", "error")) + ", bool_or(decision = 'block') AS any_block FROM g",
)
def _(spark, sf):
    return gate.gate_summary(gated(spark, sf))


@query("read_inventory_scan", GATE + "SELECT event_id, package, version, source_file FROM s")
def _(spark, sf):
    return gate.inventory_rows(view(spark, sf, "scan")).select("event_id", "package", "version", "source_file")


@query(
    "decode_status",
    with_views("audit") + """SELECT event_id, CASE status WHEN 200 THEN 'allow' WHEN 202 THEN 'quarantine' WHEN 451 THEN 'block' ELSE 'not-found' END AS decision,
      CASE status WHEN 451 THEN CASE WHEN event_id % 2 = 0 THEN concat('rule_', event_id, ',', repeat('x', 90)) ELSE 'err' END WHEN 202 THEN CASE WHEN event_id % 2 = 0 THEN concat('quarantine: rule_', event_id, ',', repeat('x', 90)) ELSE 'held' END
        WHEN 404 THEN 'not-found' ELSE '' END AS reason FROM audit""",
)
def _(spark, sf):
    df = view(spark, sf, "audit").selectExpr(
        "*", "IF(event_id % 2 = 0, array(concat('rule_', event_id), repeat('x', 90)), array()) AS failed_rules", "'err' AS error", "'held' AS note"
    )
    return gate.decode_status(df).select("event_id", "decision", "reason")


@query(
    "augment_plan",
    """WITH d AS (SELECT doc_id, v, CAST('0x' || substring(sha256(concat('5|pkg', doc_id, '|', v)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * 17 AS u FROM documents, (SELECT unnest(range(2)) AS v)),
      i AS (SELECT *, CASE WHEN u < 2 THEN 'marker-doc' WHEN u < 12 THEN 'marker-install' ELSE 'marker-lib' END AS item FROM d)
      SELECT concat(item, '/pkg', doc_id, '__v', v) AS variant_package, item AS pattern_id, substring(sha256(concat('5|pkg', doc_id, '|', v, '|', item)), 1, 8) AS token FROM i""",
)
def _(spark, sf):
    pk = table(spark, sf, "documents").selectExpr("concat('pkg', doc_id) AS package")
    return augment.plan_variants(pk, augment.SAMPLE_CATALOG, 2, 5).select("variant_package", "pattern_id", "token")


@query(
    "augment",
    with_views("pkg_files")
    + """, d AS (SELECT DISTINCT package, v, CAST('0x' || substring(sha256(concat('5|', package, '|', v)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * 17 AS u FROM pkg_files, (SELECT unnest(range(2)) AS v)),
      i AS (SELECT *, CASE WHEN u < 2 THEN 'marker-doc' WHEN u < 12 THEN 'marker-install' ELSE 'marker-lib' END AS item FROM d),
      h AS (SELECT *, sha256(concat('5|', package, '|', v, '|', item)) AS h FROM i),
      p AS (SELECT concat(item, '/', package, '__v', v) AS variant_package, item AS pattern_id, package AS source_benign, substring(h, 1, 8) AS token,
        ['north', 'south', 'east'][CAST('0x' || substring(h, 9, 4) AS BIGINT) % 3 + 1] AS place FROM h),
      f AS (SELECT variant_package, path, pattern_id, source_benign, CASE WHEN path = 'package.json' AND pattern_id = 'marker-lib' THEN
          concat('echo ', token, ' fixed|', json_extract_string(content, '$.scripts.test'), '|true|', json_extract_string(content, '$.name'))
          WHEN path = 'package.json' AND pattern_id = 'marker-doc' THEN sha256(replace(content, 'install', concat('marker ', token))) ELSE sha256(content) END AS digest
        FROM p JOIN pkg_files ON package = source_benign WHERE NOT (pattern_id = 'marker-install' AND path = 'postinstall.js')
        UNION ALL SELECT variant_package, CASE pattern_id WHEN 'marker-install' THEN 'postinstall.js' WHEN 'marker-lib' THEN 'lib/extra.js' ELSE 'NOTES.md' END, pattern_id, source_benign,
          sha256(CASE pattern_id WHEN 'marker-install' THEN concat('// placeholder ', token, chr(10), 'var _v_', token, '_note = 1;', chr(10)) WHEN 'marker-lib' THEN concat('// placeholder ', token, ' ', place, chr(10)) ELSE concat('placeholder ', token, chr(10)) END) FROM p
        UNION ALL SELECT variant_package, 'README.md', pattern_id, source_benign, sha256(concat('see ', place, chr(10))) FROM p WHERE pattern_id = 'marker-doc'
        UNION ALL SELECT variant_package, 'package.json', pattern_id, source_benign, concat('echo ', token, ' fixed||true|') FROM p WHERE pattern_id = 'marker-lib' AND source_benign NOT IN (SELECT package FROM pkg_files WHERE path = 'package.json'))
      SELECT variant_package, path, pattern_id, source_benign, 1 AS label, digest FROM f""",
)
def _(spark, sf):
    files = view(spark, sf, "pkg_files").select("package", "path", "content")
    out = augment.augment(files.select("package").distinct(), files, augment.SAMPLE_CATALOG, 2, 5)
    probe = ", '|', ".join(f"coalesce(get_json_object(content, '$.{k}'), '')" for k in ("scripts.note", "scripts.test", "marked", "name"))
    return out.selectExpr(
        "variant_package", "path", "pattern_id", "source_benign", "label",
        f"IF(path = 'package.json' AND pattern_id = 'marker-lib', concat({probe}), sha2(content, 256)) AS digest",
    )
