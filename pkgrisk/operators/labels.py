"""Ground truth, label lookup, vocabularies, corpus merging and state validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions import names
from pkgrisk.operators.keyfilter import prefilter

# Which report set a key comes from and how far it outranks the others.
MALICIOUS_TOOL, BENIGN_LIST, BENIGN_TOOL, SUMMARY = 4, 3, 2, 1


def split_key(df: DataFrame, key: str = "key") -> DataFrame:
    """``name/version`` at the last slash; keys without a slash are dropped."""
    return df.filter(f"contains({key}, '/')").selectExpr(
        "*", f"regexp_extract({key}, '^(.*)/([^/]*)$', 1) AS name",
        f"regexp_extract({key}, '^(.*)/([^/]*)$', 2) AS version",
    )


def tool_truth(sources: DataFrame) -> DataFrame:
    """Corrected report sets in one pass: benign = (ben − fn) ∪ fp, malicious = (mal − fp) ∪ fn.

    ``sources(source, key)`` with source in benign, malicious, fp, fn. Membership flags per
    key replace set differences, so each key is shuffled once.
    """
    flags = sources.groupBy("key").agg(*[
        F.expr(f"bool_or(source = '{s}') AS in_{s}") for s in ("benign", "malicious", "fp", "fn")
    ])
    return flags.selectExpr(
        "key", "(in_benign AND NOT in_fn) OR in_fp AS is_benign", "(in_malicious AND NOT in_fp) OR in_fn AS is_malicious"
    )


def build_ground_truth(sources: DataFrame) -> DataFrame:
    """``(source, key)`` rows → one label per (name, version), the higher-ranked source winning.

    Sources: benign_list, tool_benign, tool_malicious, tool_fp, tool_fn, summary.
    """
    tool = tool_truth(
        sources.filter("source LIKE 'tool%'").selectExpr(
            "key",
            "CASE source WHEN 'tool_benign' THEN 'benign' WHEN 'tool_malicious' THEN 'malicious' "
            "WHEN 'tool_fp' THEN 'fp' ELSE 'fn' END AS source",
        )
    )
    ranked = tool.selectExpr(
        "key",
        f"inline(filter(array(IF(is_benign, struct({BENIGN_TOOL} AS rank, 0 AS label), NULL), "
        f"IF(is_malicious, struct({MALICIOUS_TOOL} AS rank, 1 AS label), NULL)), x -> x IS NOT NULL))",
    )
    direct = sources.filter("source IN ('benign_list', 'summary')").selectExpr(
        "key", f"IF(source = 'summary', {SUMMARY}, {BENIGN_LIST}) AS rank", "IF(source = 'summary', 1, 0) AS label"
    )
    keyed = split_key(ranked.unionByName(direct))
    return keyed.groupBy("name", "version").agg(F.expr("max_by(label, rank) AS label"))


def attach_labels(packages: DataFrame, truth: DataFrame, default: int = 0) -> DataFrame:
    """Exact (name, version) label, else the name's label when all its versions agree, else ``default``.

    Adds ``label``, ``is_labelled`` and the three-valued ``label_word`` (unlabelled = suspicious).
    """
    exact = truth.selectExpr("name", "version", "label AS _exact")
    agreed = (
        truth.groupBy("name")
        .agg(F.expr("min(label) AS _lo"), F.expr("max(label) AS _hi"))
        .filter("_lo = _hi")
        .selectExpr("name", "_lo AS _agreed")
    )
    joined = packages.join(exact, ["name", "version"], "left").join(agreed, "name", "left")
    return joined.selectExpr(
        *packages.columns,
        f"coalesce(_exact, _agreed, {default}) AS label",
        "coalesce(_exact, _agreed) IS NOT NULL AS is_labelled",
        "CASE coalesce(_exact, _agreed) WHEN 1 THEN 'malicious' WHEN 0 THEN 'clean' ELSE 'suspicious' END AS label_word",
    )


# Label vocabularies, aligned by position.
VOCABULARIES = {
    "int": ("0", None, "1"),
    "word": ("clean", "suspicious", "malicious"),
    "verdict": ("allow", "quarantine", "block"),
}


def map_labels(df: DataFrame, column: str, source: str, target: str, out: str = "mapped") -> DataFrame:
    """Translate a label column; ``binary`` as target collapses to malicious or not."""
    whens = []
    for i, value in enumerate(VOCABULARIES[source]):
        if value is None:
            continue
        new = ("0", "0", "1")[i] if target == "binary" else VOCABULARIES[target][i]
        whens.append(f"WHEN '{value}' THEN " + ("NULL" if new is None else f"'{new}'"))
    return df.withColumn(out, F.expr(f"CASE cast({column} AS string) {' '.join(whens)} END"))


def merge_corpora(benign: DataFrame, synthetic: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """Concatenate corpora with source tags; benign copies in the synthetic set are dropped.

    A synthetic row with label 0 goes when its path is already in the benign set.
    """
    tagged = synthetic.filter("label <> 0").unionByName(
        synthetic.filter("label = 0").join(benign.select("path").distinct(), "path", "left_anti"),
        allowMissingColumns=True,
    )
    out = benign.withColumn("source", F.lit("benign")).unionByName(
        tagged.withColumn("source", F.lit("synthetic")), allowMissingColumns=True
    )
    if real is not None:
        out = out.unionByName(real.withColumn("source", F.lit("real_mal")), allowMissingColumns=True)
    return out


def validate_state(state: DataFrame, notes: DataFrame) -> DataFrame:
    """Problems in the policy state: ``(problem, item)`` with invalid_key, missing_note, orphan_note."""
    parsed = state.withColumn("_k", F.expr(names.package_key("key")))
    invalid = parsed.filter("_k.package IS NULL").selectExpr("'invalid_key' AS problem", "concat(state, ':', key) AS item")
    expected = parsed.filter("_k.package IS NOT NULL").selectExpr(
        f"{names.note_file_name('_k.package', '_k.version')} AS item"
    ).distinct()
    actual = notes.filter("name LIKE '%.md' AND name <> 'README.md'").selectExpr("name AS item").distinct()
    missing = expected.join(actual, "item", "left_anti").selectExpr("'missing_note' AS problem", "item")
    orphan = actual.join(expected, "item", "left_anti").selectExpr("'orphan_note' AS problem", "item")
    return invalid.unionByName(missing).unionByName(orphan)


def validation_report(problems: DataFrame) -> DataFrame:
    return problems.agg(
        *[F.expr(f"count_if(problem = '{p}') AS n_{p}") for p in ("invalid_key", "missing_note", "orphan_note")],
        F.expr("count(*) = 0 AS ok"),
    )


def resolve_records(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Manifest row → record by explicit path, else by ``records/<id>.json``; ``resolved`` false if neither."""
    by_path = records.selectExpr("path AS record_path", "payload AS _by_path")
    by_id = records.selectExpr("path AS _id_path", "payload AS _by_id")
    keyed = manifest.withColumn("_id_path", F.expr("concat('records/', id, '.json')"))
    joined = keyed.join(by_path, "record_path", "left").join(by_id, "_id_path", "left")
    return joined.selectExpr(
        *manifest.columns, "coalesce(_by_path, _by_id) AS payload",
        "coalesce(_by_path, _by_id) IS NOT NULL AS resolved",
    )


def seed_allowlist(required: DataFrame, seeds: DataFrame, malicious: DataFrame) -> DataFrame:
    """Required ∪ seed list − known malicious; a key listed twice keeps its first position.

    Inputs carry ``package, version, pos``. Only seeds are checked against the malicious list.
    """
    clean = seeds.join(malicious.select("package", "version").distinct(), ["package", "version"], "left_anti")
    ranked = required.selectExpr("package", "version", "struct(0 AS tier, pos) AS rank").unionByName(
        clean.selectExpr("package", "version", "struct(1 AS tier, pos) AS rank")
    )
    return ranked.groupBy("package", "version").agg(F.expr("min(rank) AS rank")).selectExpr(
        "package", "version", "IF(rank.tier = 0, 'required', 'seed') AS origin", "rank.pos AS pos"
    )


def incremental(cases: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cases still to run: those whose key has no stored row.

    Of the store only keys that may be asked for are shuffled, by a filter of the cases' keys.
    """
    return cases.join(prefilter(done.select(*keys), cases, keys).distinct(), keys, "left_anti")


def with_cached(fresh: DataFrame, done: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows plus the stored rows of the cases asked for, flagged ``cached``; other stored rows are not shuffled."""
    reused = prefilter(done, cases, keys).join(cases.select(*keys).distinct(), keys, "left_semi")
    return fresh.withColumn("cached", F.lit(False)).unionByName(
        reused.withColumn("cached", F.lit(True)), allowMissingColumns=True
    )
