"""Version pairs: choosing versions, resolving releases, comparing file trees, packing diffs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from pkgrisk.functions import patience
from pkgrisk.functions.sql import text_array, texts
from pkgrisk.functions.text import base_name, quoted, stem
from pkgrisk.functions.variant import kind, node, object_at, parse, string_at
from pkgrisk.operators.keyfilter import prefilter
from pkgrisk.operators.ordering import salted_prefix_prune
from pkgrisk.operators.predicates import is_build_output, is_comparable
from pkgrisk.session import small_batches

# Evidence file names, manifest hooks kept, evidence count.
HOOK_FILES = ("postinstall.js", "install.js", "preinstall.js")
SLICE_HOOKS = ("preinstall", "install", "postinstall", "preuninstall", "postuninstall")
DELTA_HOOKS = ("preinstall", "install", "postinstall")
EVIDENCE_FILES = 4
#: bytes of texts that Python holds as lines at a time
PIECE_BYTES = 1 << 20


def pick_versions(cases: DataFrame) -> DataFrame:
    """Add ``unpatched_version, patched_version, status``; status NULL when the pair can be diffed.

    First likely-affected candidate against the first patched one, else the case's own field.
    """
    def first(role: str) -> str:
        return f"get(filter(candidate_versions, c -> c.role = '{role}' AND coalesce(c.version, '') <> ''), 0).version"

    df = cases.withColumns({
        "unpatched_version": F.expr(first("likely_affected")),
        "patched_version": F.expr(f"coalesce({first('first_patched')}, nullif(first_patched_version, ''))"),
    })
    return df.withColumn("status", F.expr(
        "CASE WHEN unpatched_version IS NULL OR patched_version IS NULL THEN 'skipped_missing_versions' "
        "WHEN unpatched_version = patched_version THEN 'skipped_same_version' END"
    ))


def resolve_pairs(cases: DataFrame, releases: DataFrame) -> DataFrame:
    """Set ``status`` and archive URLs from the release table; unresolvable cases keep their row.

    ``releases(package, version, tarball)``, and ``ecosystem`` where both tables have it. Releases are reduced to one
    row for each key first, so a case is never multiplied. A package without any release has no packument.
    """
    key = ["ecosystem", "package"] if {"ecosystem"} <= set(cases.columns) & set(releases.columns) else ["package"]
    urls = releases.groupBy(*key, "version").agg(F.expr("max(nullif(tarball, '')) AS tarball"))
    known = releases.select(*key).distinct().withColumn("_known", F.lit(True))
    joined = (
        cases.join(known, key, "left")
        .join(urls.selectExpr(*key, "version AS unpatched_version", "tarball AS unpatched_url"), [*key, "unpatched_version"], "left")
        .join(urls.selectExpr(*key, "version AS patched_version", "tarball AS patched_url"), [*key, "patched_version"], "left")
    )
    return joined.withColumn("status", F.expr(
        "CASE WHEN status IS NOT NULL THEN status WHEN _known IS NULL THEN 'skipped_no_packument' "
        "WHEN unpatched_url IS NULL OR patched_url IS NULL THEN 'skipped_no_tarball' ELSE 'tarball_diff' END"
    )).drop("_known")


def diff_trees(before: DataFrame, after: DataFrame, with_text: bool = False, max_text_bytes: int | None = None) -> DataFrame:
    """Changed files per case: ``case_id, path, change_kind, size_before, size_after, oversize``.

    The join runs on digests; contents are joined back only for changed files, when
    ``with_text`` asks for them: a Bloom filter of the changed keys is applied where the trees are read, so other files'
    contents are not shuffled. Every text is whole, unless ``max_text_bytes`` is given: then larger files
    are ``oversize``, compare by digest and read as empty.
    """
    limit = "false" if max_text_bytes is None else f"{{}} > {max_text_bytes}"
    def slim(df: DataFrame, side: str) -> DataFrame:
        # One column, so that the filter and the changes read the same exchange.
        return df.selectExpr("case_id", "path", f"concat(sha2(content, 256), octet_length(content)) AS mark_{side}")

    joined = slim(before, "before").join(slim(after, "after"), ["case_id", "path"], "full_outer")
    differing = joined.filter("NOT (mark_before <=> mark_after)")
    changed = differing.selectExpr(
        "*", *[f"coalesce(cast(substring(mark_{side}, 65) AS bigint), 0L) AS size_{side}" for side in ("before", "after")]
    ).selectExpr(
        "case_id", "path",
        "CASE WHEN mark_before IS NULL THEN 'added' WHEN mark_after IS NULL THEN 'removed' ELSE 'modified' END AS change_kind",
        "size_before", "size_after",
        limit.format("greatest(size_before, size_after)") + " AS oversize",
    )
    if not with_text:
        return changed
    keys = ["case_id", "path"]

    def text(df: DataFrame, side: str) -> DataFrame:
        whole = df.selectExpr("case_id", "path", f"IF({limit.format('octet_length(content)')}, '', content) AS text_{side}")
        return prefilter(whole, differing, keys)

    return changed.join(text(before, "before"), keys, "left").join(text(after, "after"), keys, "left").selectExpr(
        *changed.columns, "coalesce(text_before, '') AS text_before", "coalesce(text_after, '') AS text_after"
    )


CONTEXT_LINES = 3


# Where str.splitlines ends a line, as a pattern that splits behind it.
LINE_END = r"(?<=[\\n\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]|\\r(?!\\n))"


def _hunk(runs: list[tuple], old: list[str], new: list[str]) -> list[str]:
    """One group of edit runs as text, with the places it covers on both sides."""
    def extent(begin: int, end: int) -> str:
        return f"{begin + 1 if end > begin else begin},{end - begin}"

    out = [f"@@ -{extent(runs[0][1], runs[-1][2])} +{extent(runs[0][3], runs[-1][4])} @@"]
    for equal, a, b, c, d in runs:
        if equal:
            out += [" " + x.rstrip("\n") for x in old[a:b]]
        else:
            out += ["-" + x.rstrip("\n") for x in old[a:b]] + ["+" + x.rstrip("\n") for x in new[c:d]]
    return out


def aligned_runs(before: str, after: str) -> tuple[list[tuple], list[str], list[str]]:
    """Edit runs of one file and the lines of both sides."""
    old, new = before.splitlines(keepends=True), after.splitlines(keepends=True)
    return patience.edits(patience.align(*patience.number_lines(old, new)), len(new)), old, new


def aligned_changes(path: str, before: str, after: str) -> tuple[str, int, int]:
    """Whole diff text of one file, and its added and removed lines."""
    runs, old, new = aligned_runs(before, after)
    changed = [r for r in runs if not r[0]]
    text = [f"--- a/{path}", f"+++ b/{path}"] if changed else []
    for group in patience.hunks(runs, CONTEXT_LINES):
        text += _hunk(group, old, new)
    return "\n".join(text), sum(d - c for _, _, _, c, d in changed), sum(b - a for _, a, b, _, _ in changed)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with texts of about PIECE_BYTES, one row at least, so that memory follows single texts."""
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64) for c in ("text_before", "text_after"))
    upto, low = np.cumsum(sizes), 0
    while low < len(upto):
        before = int(upto[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(upto, before + PIECE_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def _per_file(changes: DataFrame, work: Callable[[str, str, str], tuple], added: pa.Schema) -> DataFrame:
    """``changes`` without its texts, with the columns that ``work`` gives for path, text before and after."""
    kept = [c for c in changes.columns if c not in ("text_before", "text_after")]
    schema = StructType([*(changes.schema[c] for c in kept), *from_arrow_schema(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _pieces(whole)):
            sides = (batch.column(c).to_pylist() for c in ("path", "text_before", "text_after"))
            found = list(zip(*(work(p, a or "", b or "") for p, a, b in zip(*sides)))) or [()] * len(added)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(v, f.type) for v, f in zip(found, added))], names=schema.names
            )

    small_batches(changes.sparkSession)
    return changes.mapInArrow(run, schema)


def line_diff(changes: DataFrame) -> DataFrame:
    """Add ``unified_diff, added_lines, removed_lines`` to changed files with their texts.

    Lines are aligned by patience (``functions.patience``), whole and without a cut, in near linear time. Where only
    the numbers are asked for, ``line_counts`` gives them in SQL, moved lines apart. A null text is an empty one.
    """
    added = pa.schema([("unified_diff", pa.string()), ("added_lines", pa.int64()), ("removed_lines", pa.int64())])
    return _per_file(changes, aligned_changes, added)


def line_edits(changes: DataFrame) -> DataFrame:
    """Add ``edits``: the runs of lines that turn the text before into the one after.

    A run keeps the lines ``[from, upto)`` of the text before (``lines`` null) or puts ``lines`` in their place.
    """
    def work(path: str, before: str, after: str) -> tuple:
        runs, _, new = aligned_runs(before, after)
        return ([{"from": a, "upto": b, "lines": None if equal else new[c:d]} for equal, a, b, c, d in runs],)

    run = pa.struct([("from", pa.int32()), ("upto", pa.int32()), ("lines", pa.list_(pa.string()))])
    return _per_file(changes, work, pa.schema([("edits", pa.list_(run))]))


def apply_edits(text: str, edits: str = "edits") -> str:
    """SQL: the text that ``edits`` make of ``text``."""
    lines = f"filter(split(coalesce({text}, ''), '{LINE_END}'), x -> x <> '')"
    runs = f"transform({edits}, e -> IF(e.lines IS NULL, slice(l, e.from + 1, e.upto - e.from), e.lines))"
    return f"array_join(flatten(get(transform(array({lines}), l -> {runs}), 0)), '')"


def line_counts(changes: DataFrame) -> DataFrame:
    """Added and removed lines as a multiset difference, without Python.

    Lines are counted by 128-bit digest per file, so repeated lines and huge files only add
    partial counts. Moved lines cancel out, unlike in an aligned diff.
    """
    sides = changes.selectExpr(
        "case_id", "path", "inline(array(struct(1 AS w, text_after AS t), struct(-1 AS w, text_before AS t)))"
    ).filter("t <> ''")
    lines = sides.selectExpr("case_id", "path", "w", "explode(split(regexp_replace(t, '\\n$', ''), '\\n')) AS line")
    net = lines.groupBy("case_id", "path", F.md5(F.encode("line", "utf-8")).alias("h")).agg(
        F.expr("sum(w) AS d")
    )
    return net.groupBy("case_id", "path").agg(
        F.expr("sum(greatest(d, 0)) AS added_lines"), F.expr("sum(greatest(-d, 0)) AS removed_lines")
    )


def pair_manifest(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Per pair: changed, added, removed and modified files; pairs without changes count 0."""
    counts = changes.groupBy("case_id").agg(
        F.expr("count(*) AS c"), *[F.expr(f"count_if(change_kind = '{k}') AS c_{k}") for k in ("added", "removed", "modified")]
    )
    return pairs.join(counts, "case_id", "left").selectExpr(
        *pairs.columns, "coalesce(c, 0L) AS n_files_changed",
        *[f"coalesce(c_{k}, 0L) AS n_{k}" for k in ("added", "removed", "modified")],
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(
        F.expr("count(*) AS n_total"), F.expr("count_if(n_files_changed > 0) AS n_with_changes"),
        F.expr("sum(n_files_changed) AS total_changes"),
    )


def source_match_files(package_files: DataFrame, source_files: DataFrame) -> DataFrame:
    """Verdict per comparable package file: matched, suspicious, or NULL when not counted.

    Exact path first, by digest. On a miss, any source file with the same stem and digest
    counts; the key table holds one row per path, (stem, digest) and stem, so no group of
    same-named files is collected. Build output that has no equal is left out of the count.
    """
    pkg = package_files.filter(is_comparable("path")).selectExpr(
        "package", "path", "sha2(content, 256) AS sha", f"lower({stem('path')}) AS stem", f"{is_build_output('path')} AS is_build"
    )
    src = source_files.selectExpr("package", "path", "sha2(content, 256) AS sha", f"lower({stem('path')}) AS stem")

    def keyed(path: str) -> str:
        entries = (("path", path), ("same", "concat(stem, '\\u0000', sha)"), ("stem", "stem"))
        return "array(" + ", ".join(f"struct('{what}' AS what, {key} AS key)" for what, key in entries) + ")"

    # The sources are read and hashed once: every source row answers for its path, its (stem, digest) and its stem.
    keys = src.selectExpr(
        "package", f"inline({keyed('path')}) AS (what, key)", "sha"
    ).groupBy("package", "what", "key").agg(F.expr("max(sha) AS src_sha"))
    asked = pkg.selectExpr("*", f"inline({keyed('path')}) AS (what, key)")
    joined = asked.join(keys, ["package", "what", "key"], "left").groupBy("package", "path", "sha", "is_build").agg(
        F.expr("max(IF(what = 'path', src_sha, NULL)) AS src_sha"), F.expr("bool_or(what = 'same' AND src_sha IS NOT NULL) AS _same"),
        F.expr("max(IF(what = 'stem' AND src_sha IS NOT NULL, true, NULL)) AS _stem"),
    )
    return joined.selectExpr(
        "package", "path",
        "CASE WHEN src_sha IS NOT NULL THEN IF(src_sha = sha, 'matched', 'suspicious') "
        "WHEN _same THEN 'matched' WHEN is_build THEN NULL ELSE 'suspicious' END AS verdict",
        "src_sha IS NULL AND _stem IS NOT NULL AS by_stem",
    )


def source_match(packages: DataFrame, package_files: DataFrame, source_files: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Per package: ``compared, matched, suspicious, ratio`` and ``passes`` (NULL when nothing compared)."""
    counts = source_match_files(package_files, source_files).groupBy("package").agg(
        F.expr("count(verdict) AS c"), F.expr("count_if(verdict = 'matched') AS m")
    )
    return packages.join(counts, "package", "left").selectExpr(
        *packages.columns, "coalesce(c, 0L) AS compared", "coalesce(m, 0L) AS matched",
        "coalesce(c - m, 0L) AS suspicious", "IF(coalesce(c, 0) = 0, 1D, m / c) AS ratio",
        f"IF(coalesce(c, 0) = 0, NULL, m / c >= {threshold!r}D) AS passes",
    )


def manifest_slice(files: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of a manifest that matter for hijacks: five hooks, dependency maps, repository, version."""
    meta = files.filter("path = 'package.json'").selectExpr(*keys, f"{parse('content')} AS _m")

    def deps(name: str) -> str:
        return f"transform_values({object_at('_m', '$.' + name)}, (k, v) -> try_variant_get(v, '$', 'string')) AS {name}"

    repository = (
        f"coalesce({string_at('_m', '$.repository.url')}, {string_at('_m', '$.repository')}) AS repository"
    )
    return meta.selectExpr(
        *keys,
        f"transform_values(map_filter({object_at('_m', '$.scripts')}, (k, v) -> k IN ({texts(SLICE_HOOKS)})), "
        "(k, v) -> try_variant_get(v, '$', 'string')) AS scripts",
        deps("dependencies"), deps("devDependencies"), deps("optionalDependencies"), repository,
        f"{string_at('_m', '$.version')} AS version",
        f"{kind(node('_m', '$.scripts'))} AS scripts_kind",
    )


def install_script_delta(before: str, after: str) -> str:
    """SQL: array of struct<hook, line> for hooks whose command differs between two script maps."""
    b, a = f"try_element_at({before}, h)", f"try_element_at({after}, h)"
    return (
        f"transform(filter({text_array(DELTA_HOOKS)}, h -> NOT ({b} <=> {a})), h -> named_struct('hook', h, "
        f"'line', concat('before=', {quoted(b)}, ' after=', {quoted(a)}), 'is_new', {b} IS NULL))"
    )


def block_text() -> str:
    """SQL: a change as a headed diff block."""
    return "concat('--- a/', path, '\\n+++ b/', path, '\\n# change_kind=', change_kind, '\\n', unified_diff, '\\n')"


def pack_blocks(changes: DataFrame, cap: int | None = None) -> DataFrame:
    """Diff blocks per case in path order, all of them or until the next one would exceed ``cap`` characters.

    Returns ``case_id, diff_text, truncated``: whole blocks only, then a marker line.
    """
    blocks = changes.selectExpr("case_id", "path", f"{block_text()} AS block").selectExpr("*", "cast(length(block) AS bigint) AS _n")
    total = blocks.groupBy("case_id").agg(F.expr("sum(_n) AS _total"))
    over = "false" if cap is None else f"_total > {cap}"
    # A block above the cap only ends the text, so its body need not be shuffled.
    slim = blocks if cap is None else blocks.withColumn("block", F.expr(f"IF(_n > {cap}, NULL, block)"))
    kept = salted_prefix_prune(slim, ["case_id"], "path", "_n", None if cap is None else f"sum_before + _n <= {cap}", "path")
    packed = kept.groupBy("case_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(path, block))), x -> x.block), '') AS body")
    )
    return total.join(packed, "case_id", "left").selectExpr(
        "case_id", f"concat(coalesce(body, ''), IF({over}, '... [truncated at {cap} chars] ...\\n', '')) AS diff_text", f"{over} AS truncated",
    )


def evidence_files(changes: DataFrame, k: int = EVIDENCE_FILES) -> DataFrame:
    """The ``k`` most telling changes per case: hook files, then modified, added, removed, then path."""
    order = (
        f"IF(lower({base_name('path')}) IN ({texts(HOOK_FILES)}), 0, 1), "
        "CASE change_kind WHEN 'modified' THEN 0 WHEN 'added' THEN 1 ELSE 2 END, path"
    )
    return changes.selectExpr("*", f"row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS rank").filter(f"rank <= {k}")
