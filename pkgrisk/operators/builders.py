"""Chat triples, classification rows, tool trajectories, prompts and truth rows from packages and pairs.

Instruction texts are parameters: what the operators fix is which evidence goes in, in
which order and under which budget. JSON in messages is compact and keeps NULL fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.sql import text
from pkgrisk.functions.variant import array_at, parse, string_at
from pkgrisk.operators import selection, treediff

AUDITOR = "You review software packages for supply-chain risk and answer with one JSON object."
# Needles looked for in malicious packages, first hit per file.
NEEDLES = ("child_process", "execSync", "spawn", "fs.readFile", "process.env", "fetch(", "https.request")
MANIFEST_HOOKS = ("postinstall", "preinstall", "prepare")
# Confidence per label, and verdict with confidence per severity.
CONFIDENCE = "CASE {label} WHEN 'malicious' THEN 0.97D WHEN 'suspicious' THEN 0.65D ELSE 0.92D END"
SEVERITY_VERDICT = "IF({s} IN ('critical', 'high'), 'block', 'quarantine')"
SEVERITY_CONFIDENCE = "CASE {s} WHEN 'critical' THEN 0.95D WHEN 'high' THEN 0.88D WHEN 'medium' THEN 0.75D ELSE 0.6D END"


def _message(role: str, content: str) -> str:
    return f"named_struct('role', '{role}', 'content', {content})"


def _json(struct: str) -> str:
    return f"to_json({struct}, map('ignoreNullFields', 'false'))"


def to_sft(packages: DataFrame, files: DataFrame, max_tokens: int = 8192, system: str = AUDITOR) -> DataFrame:
    """Package → system, user, assistant messages. ``packages(package, version, label, source)``.

    Files are chosen by priority (six at most) before anything is collected; findings look
    at the whole chosen files, the user text at the packed ones.
    """
    budget = max_tokens * selection.CHARS_PER_TOKEN
    chosen = selection.select_priority_files(files)
    needle = "CASE " + " ".join(f"WHEN contains(content, {text(n)}) THEN {text('reference to ' + n)}" for n in NEEDLES) + " END"
    hooks = ", ".join(
        f"IF(path = 'package.json' AND contains(content, '\"{h}\"'), '{h} lifecycle hook present', NULL)" for h in MANIFEST_HOOKS
    )
    found = chosen.selectExpr("package", "rank", "path", f"array_compact(array({hooks}, {needle})) AS f").groupBy("package").agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(rank, path, f))), x -> x.f)) AS found")
    )
    packed = selection.pack_budget(chosen, budget).groupBy("package").agg(
        F.expr("array_sort(collect_list(struct(rank, path, body))) AS p")
    )
    joined = packages.join(packed, "package", "left").join(found, "package", "left")
    findings = (
        "CASE label WHEN 'malicious' THEN IF(size(coalesce(found, array())) > 0, found, array('classified malicious by source corpus')) "
        "WHEN 'suspicious' THEN array('requires manual review') ELSE array('matches benign baseline pattern') END"
    )
    reasoning = (
        "CASE label WHEN 'malicious' THEN 'The findings match known malicious behaviour.' "
        "WHEN 'suspicious' THEN 'The signals are ambiguous; hold for review.' ELSE 'Nothing departs from a routine release.' END"
    )
    user = (
        "concat('Package: ', package, '@', version, '\\nSource: ', source, '\\n\\nFiles included:\\n', "
        "array_join(transform(p, x -> concat('- ', x.path)), '\\n'), '\\n\\n', "
        "array_join(transform(p, x -> concat('// FILE: ', x.path, '\\n', x.body)), '\\n\\n'))"
    )
    staged = joined.withColumn("findings", F.expr(findings))
    answer = _json(
        f"named_struct('verdict', label, 'confidence', {CONFIDENCE.format(label='label')}, 'reasoning', {reasoning}, 'findings', findings)"
    )
    return staged.selectExpr(
        "package", "version", "label", "source", "findings", "size(p) AS n_files",
        f"array({_message('system', text(system))}, {_message('user', user)}, {_message('assistant', answer)}) AS messages",
    )


def cases_to_sft(cases: DataFrame, split: str = "'train'", system: str = AUDITOR) -> DataFrame:
    """Case → messages with the verdict its severity implies; confirmed incidents weigh most."""
    sev = "lower(coalesce(severity, ''))"
    first = "coalesce(get(advisory_ids, 0), 'unknown')"
    incident = f"case_type = 'incident_replay' AND {sev} IN ('high', 'critical')"
    staged = cases.withColumns({
        "verdict": F.expr(SEVERITY_VERDICT.format(s=sev)),
        "confidence": F.expr(f"IF({incident}, 0.97D, {SEVERITY_CONFIDENCE.format(s=sev)})"),
        "findings": F.expr(
            f"array_compact(array(concat('GHSA advisory: ', {first}), concat('Severity tier: ', coalesce(nullif({sev}, ''), 'unspecified')), "
            "IF(size(cwes) > 0, concat('CWE classification: ', array_join(cwes, ', ')), NULL), "
            "concat('Affected version range: ', nullif(affected_range, '')), "
            "concat('Safe predecessor / first patched: ', nullif(first_patched_version, ''))))"
        ),
    })
    lines = (
        "concat_ws('\\n', concat('Package: ', package), concat('Affected range: ', coalesce(affected_range, 'unknown')), "
        f"concat('First patched version: ', coalesce(first_patched_version, 'unknown')), concat('Advisory: ', {first}), "
        "concat('CWE(s): ', coalesce(nullif(array_join(cwes, ', '), ''), 'none')), "
        "concat('Severity: ', coalesce(severity, 'unknown')), concat('Advisory summary: ', coalesce(summary, '(no summary)')))"
    )
    answer = _json(
        "named_struct('verdict', verdict, 'threat_class', 'A', 'confidence', confidence, 'reasoning', "
        f"concat(package, ' carries a confirmed advisory (', {first}, ').'), 'findings', findings)"
    )
    return staged.selectExpr(
        "case_id", "case_type", "package", "severity", "advisory_ids", "verdict", "confidence", "findings", f"{split} AS split",
        f"array({_message('system', text(system))}, {_message('user', lines)}, {_message('assistant', answer)}) AS messages",
    )


# Keys that may hold the two sides of an input/output record, in order.
INPUT_KEYS, OUTPUT_KEYS = ("input", "question", "instruction"), ("output", "answer", "response")
SHAPES = ("A", "B", "C", "unknown")


def record_shape(v: str) -> str:
    """SQL: A messages, B prompt and completion, C input/output aliases, else unknown."""
    def any_key(keys: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"try_variant_get({v}, '$.{k}', 'variant') IS NOT NULL" for k in keys) + ")"

    return (
        f"CASE WHEN try_variant_get({v}, '$.messages[0].role', 'variant') IS NOT NULL THEN 'A' "
        f"WHEN {any_key(('prompt',))} AND {any_key(('completion',))} THEN 'B' "
        f"WHEN {any_key(INPUT_KEYS)} AND {any_key(OUTPUT_KEYS)} THEN 'C' ELSE 'unknown' END"
    )


def detect_shape(lines: DataFrame, line: str = "line") -> DataFrame:
    """Majority shape of all records; ties go to the earlier letter."""
    parsed = lines.selectExpr(f"{parse(line)} AS v").filter("v IS NOT NULL")
    votes = parsed.selectExpr(f"{record_shape('v')} AS shape").groupBy("shape").agg(F.expr("count(*) AS n"))
    at = "array_position(array('A', 'B', 'C', 'unknown'), shape)"
    return votes.agg(F.expr(f"coalesce(min_by(shape, struct(-n, {at})), 'unknown') AS shape"))


def normalize_chat(lines: DataFrame, shape: str, line: str = "line", system: str = AUDITOR) -> DataFrame:
    """Records of one shape → ``messages``; NULL messages mark skipped records."""
    if shape not in ("A", "B", "C"):
        raise ValueError(f"cannot normalise records of shape {shape!r}")
    if shape == "A":
        pairs = (
            f"transform({array_at('v', '$.messages')}, m -> named_struct('role', {string_at('m', '$.role')}, 'content', {string_at('m', '$.content')}))"
        )
        kept = f"filter({pairs}, m -> m.role IS NOT NULL AND m.content IS NOT NULL)"
        out = f"IF(size({kept}) > 0, {kept}, NULL)"
    else:
        keys = (("prompt",), ("completion",)) if shape == "B" else (INPUT_KEYS, OUTPUT_KEYS)
        user, reply = ("coalesce(" + ", ".join(string_at("v", f"$.{k}") for k in ks) + ")" for ks in keys)
        triple = f"array({_message('system', text(system))}, {_message('user', user)}, {_message('assistant', reply)})"
        out = f"IF({user} IS NOT NULL AND {reply} IS NOT NULL, {triple}, NULL)"
    others = [c for c in lines.columns if c != line]
    return lines.selectExpr(*others, f"{parse(line)} AS v").filter("v IS NOT NULL").selectExpr(*others, f"{out} AS messages")


def pairs_to_classification(pairs: DataFrame, changes: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Two rows per pair: the unpatched release (label 1) and the patched one (label 0).

    ``pairs(case_id, package, unpatched_version, patched_version, severity, advisory_ids,
    slice_before, slice_after)``; ``changes`` carry line counts and diffs. Texts are whole; with
    ``max_chars`` they are cut there, their diff part at half of that, in whole blocks.
    """
    packed = treediff.pack_blocks(changes, None if max_chars is None else max_chars // 2)
    n_changes = changes.groupBy("case_id").agg(F.expr("count(*) AS n_files_changed"))
    listed = treediff.salted_prefix_prune(
        changes.selectExpr(
            "case_id", "path", "concat('[', change_kind, '] ', path, ' (+', added_lines, '/-', removed_lines, ')') AS line"
        ).selectExpr("*", "cast(length(line) + 1 AS bigint) AS _n"),
        ["case_id"], "path", "_n", None if max_chars is None else f"sum_before < {max_chars}", "path",
    ).groupBy("case_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(path, line))), x -> x.line), '\\n') AS paths")
    )
    rows = (
        pairs.join(packed, "case_id", "left").join(listed, "case_id", "left").join(n_changes, "case_id", "left")
        .selectExpr("*", "explode(array(1, 0)) AS label")
        .selectExpr("*", "IF(label = 1, 'unpatched', 'patched') AS role", "IF(label = 1, unpatched_version, patched_version) AS version")
    )
    body = (
        "concat_ws('\\n', concat('PACKAGE: ', package), concat('VERSION: ', version), concat('ROLE: ', role), concat('SEVERITY: ', severity), "
        "concat('ADVISORIES: ', coalesce(nullif(array_join(advisory_ids, ', '), ''), 'none')), '', '== MANIFEST ==', "
        "coalesce(IF(label = 1, slice_before, slice_after), '{}'), '', '== CHANGED FILES ==', coalesce(paths, ''), '', '== DIFF ==', coalesce(diff_text, ''))"
    )
    cut = "t" if max_chars is None else f"IF(length(t) > {max_chars}, concat(left(t, {max_chars - 64}), '\\n... [text truncated]\\n'), t)"
    return rows.selectExpr("*", f"{body} AS t").selectExpr(
        "case_id", f"{cut} AS text", "label", "package", "version", "coalesce(get(advisory_ids, 0), '') AS advisory_id",
        "role", "severity", "coalesce(n_files_changed, 0L) AS n_files_changed",
    )


def pairs_to_trajectories(pairs: DataFrame, changes: DataFrame, system: str = AUDITOR, answer_chars: int | None = None) -> DataFrame:
    """Pair → fixed tool sequence: manifest, listing, new install script, four evidence files, scan, verdict.

    ``pairs`` as above plus ``scripts_before, scripts_after`` (maps). Adds ``n_tool_calls``. Tool answers are whole
    unless ``answer_chars`` is given.
    """
    counts = changes.groupBy("case_id").agg(F.expr("count(*) AS n_changed"))
    # Distinct top-level names, with a limit as many as fit one tool answer.
    names = changes.selectExpr("case_id", "split(path, '/')[0] AS top").distinct().selectExpr(
        "*", "cast(length(top) + 3 AS bigint) AS _n"
    )
    tops = treediff.salted_prefix_prune(
        names, ["case_id"], "top", "_n", None if answer_chars is None else f"sum_before < {answer_chars}", "top"
    ).groupBy("case_id").agg(F.expr("collect_set(top) AS tops"))
    top4 = treediff.evidence_files(changes).groupBy("case_id").agg(
        F.expr(f"array_sort(collect_list(struct(rank, path, change_kind, added_lines, removed_lines, {'unified_diff' if answer_chars is None else f'left(unified_diff, {answer_chars + 1})'} AS d))) AS ev")
    )
    joined = pairs.join(counts, "case_id", "left").join(tops, "case_id", "left").join(top4, "case_id", "left")
    staged = joined.withColumn("delta", F.expr(treediff.install_script_delta("scripts_before", "scripts_after")))
    staged = staged.withColumns({
        "new_hook": F.expr("get(filter(delta, d -> d.is_new), 0).hook"),
        "sev": F.expr("lower(coalesce(severity, 'unknown'))"),
        "n": F.expr("coalesce(n_changed, 0L)"),
    })

    def call(say: str, tool: str) -> str:
        return _message("assistant", f"concat({say}, '\\n<tool_call>', {tool}, '</tool_call>')")

    def answer(body: str) -> str:
        if answer_chars is None:
            return _message("tool", body)
        return _message("tool", f"IF(length({body}) > {answer_chars}, concat(left({body}, {answer_chars - 32}), '\\n... [truncated]\\n'), {body})")

    listing = "to_json(array_sort(array_distinct(concat(array('package.json', 'README.md', 'LICENSE'), coalesce(tops, array('src', 'lib'))))))"
    hook_file = "concat(new_hook, '.js')"
    verdict = _json(
        f"named_struct('verdict', {SEVERITY_VERDICT.format(s='sev')}, 'threat_class', 'A', 'confidence', confidence, 'findings', findings)"
    )
    staged = staged.withColumns({
        "confidence": F.expr(
            f"IF(size(delta) > 0 AND sev IN ('high', 'critical'), least(0.98D, {SEVERITY_CONFIDENCE.format(s='sev')} + 0.05D), {SEVERITY_CONFIDENCE.format(s='sev')})"
        ),
        "findings": F.expr(
            "array(concat('GHSA advisory: ', coalesce(get(advisory_ids, 0), 'unknown')), concat('Severity tier: ', sev), "
            "concat('File changes between ', unpatched_version, ' and ', patched_version, ': ', n), "
            "IF(size(delta) > 0, concat('Install-script delta: ', array_join(transform(delta, d -> concat(d.hook, ': ', d.line)), '; ')), "
            "'No lifecycle script delta between versions.'))"
        ),
    })
    user = (
        "concat('Package: ', package, '\\nVersion: ', unpatched_version, '\\nLast known safe version: ', patched_version, "
        "'\\nAdvisory: ', coalesce(get(advisory_ids, 0), 'unknown'), '\\nSeverity: ', severity)"
    )
    head = ", ".join([
        _message("system", text(system)), _message("user", user),
        call("'Reading the manifest.'", "'read_file(package.json)'"), answer("coalesce(slice_before, '{}')"),
        call("'Listing the package root.'", "'list_dir(.)'"), answer(listing),
    ])
    hook = ", ".join([
        call("concat('New install hook ', new_hook, '.')", f"concat('read_file(', {hook_file}, ')')"),
        answer(f"concat('// ', {hook_file}, ': presence confirmed by the manifest delta')"),
    ])
    looks = ", ".join([
        call("concat('Inspecting ', e.path, ' (', e.change_kind, ', +', e.added_lines, '/-', e.removed_lines, ').')", "concat('read_file(', e.path, ')')"),
        answer("coalesce(nullif(e.d, ''), '(no unified diff)')"),
    ])
    tail = ", ".join([
        call("'Running the static analysis.'", "'run_static_analysis(.)'"),
        answer("concat(n, ' files differ from ', patched_version, '; ', IF(size(delta) > 0, 'install_script_delta', 'no_install_delta'))"),
        _message("assistant", verdict),
    ])
    none = "cast(array() AS array<struct<role:string,content:string>>)"
    messages = (
        f"concat(array({head}), IF(new_hook IS NOT NULL, array({hook}), {none}), "
        f"coalesce(flatten(transform(ev, e -> array({looks}))), {none}), array({tail}))"
    )
    return staged.withColumn("messages", F.expr(messages)).selectExpr(
        "case_id", "package", "unpatched_version", "patched_version", "coalesce(get(advisory_ids, 0), 'unknown') AS advisory_id", "severity",
        "confidence", "findings", "messages",
        "size(filter(messages, m -> m.role = 'assistant' AND contains(m.content, '<tool_call>'))) AS n_tool_calls",
    )


def build_prompts(packages: DataFrame, files: DataFrame, rubric: str, max_tokens: int = 8192) -> DataFrame:
    """Review prompt per package: rubric plus code under the remaining budget, manifest always whole."""
    budget = selection.code_budget(max_tokens, len(rubric))
    manifest = files.filter("path = 'package.json'").selectExpr("package", "content AS manifest", "cast(length(content) AS bigint) AS m")
    clipped = selection.prompt_order(files).selectExpr("package", "path", "tier", "ord", f"left(content, {budget}) AS body").selectExpr(
        "*", "cast(length(body) AS bigint) AS _n"
    ).filter("_n > 0")
    with_m = clipped.join(manifest.select("package", "m"), "package")
    kept = treediff.salted_prefix_prune(with_m, ["package"], "tier, ord, path", "_n", f"m + sum_before < {budget}", "path")
    blocks = kept.selectExpr(
        "package", "tier", "ord", "path", f"left(body, cast({budget} - m - sum_before AS int)) AS body"
    ).groupBy("package").agg(F.expr("array_sort(collect_list(struct(tier, ord, path, body))) AS b"))
    joined = packages.join(manifest, "package").join(blocks, "package", "left")
    code = (
        "concat('// FILE: package.json\\n', manifest, '\\n\\n', coalesce(array_join(transform(b, x -> concat('// FILE: ', x.path, '\\n', x.body)), '\\n\\n'), ''))"
    )
    return joined.selectExpr(
        *packages.columns, f"{text(rubric)} AS criteria", f"{code} AS code",
        "concat(array('package.json'), coalesce(transform(b, x -> x.path), array())) AS files_included",
        "m + coalesce(aggregate(b, 0L, (a, x) -> a + length(x.body)), 0L) AS code_chars", f"{budget}L AS code_budget_chars",
    )


def to_eval_records(chats: DataFrame) -> DataFrame:
    """First three messages of each conversation → ``prompt, expected``; shorter ones are left out.

    ``chats(conv_id, turn, role, text)``. Only the three first turns are ever collected.
    """
    first = chats.selectExpr("*", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r").filter("r <= 3")
    at = [f"max(IF(r = {i}, text, NULL)) AS m{i}" for i in (1, 2, 3)]
    rows = first.groupBy("conv_id").agg(F.expr("count(*) AS n"), *[F.expr(a) for a in at])
    return rows.filter("n = 3").selectExpr("conv_id", "concat(m1, '\\n\\n', m2) AS prompt", "m3 AS expected")


def truth_rows(pairs: DataFrame, changes: DataFrame, max_paths: int | None = None) -> DataFrame:
    """Held-out truth per pair: version → 1/0, changed files, their paths (the first ``max_paths`` if given), install-script change."""
    counts = changes.groupBy("case_id").agg(F.expr("count(*) AS n"))
    listed = changes.select("case_id", "path")
    if max_paths is not None:
        listed = changes.selectExpr("case_id", "path", "row_number() OVER (PARTITION BY case_id ORDER BY path) AS r").filter(f"r <= {max_paths}")
    paths = listed.groupBy("case_id").agg(F.expr("array_sort(collect_list(path)) AS evidence_paths"))
    joined = pairs.join(counts, "case_id", "left").join(paths, "case_id", "left")
    return joined.selectExpr(
        "case_id", "package", "coalesce(get(advisory_ids, 0), '') AS advisory_id", "severity", "unpatched_version", "patched_version",
        "map(unpatched_version, 1, patched_version, 0) AS ground_truth", "coalesce(n, 0L) AS n_files_changed",
        f"size({treediff.install_script_delta('scripts_before', 'scripts_after')}) > 0 AS has_install_script_delta",
        "coalesce(evidence_paths, cast(array() AS array<string>)) AS evidence_paths",
    )
