"""Label sources, malware listings, registry documents, policy state, splits and feature tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.functions.names import dated_archive
from pkgrisk.functions.sql import regex
from pkgrisk.functions.variant import array_at, is_object, object_at, parse, string_at
from pkgrisk.sources import commits
from pkgrisk.sources.lines import WHOLE

STATES = ("blocked", "quarantined", "allowlist")
SPLIT_NAMES = ("train", "validation", "val", "dev", "test")


def benign_keys(lines: DataFrame, line: str = "value") -> DataFrame:
    """``name/version`` lines as ``source, key``."""
    return lines.selectExpr("'benign_list' AS source", f"trim({line}) AS key").filter("contains(key, '/')")


def report_keys(docs: DataFrame, source: str, text: str = "value") -> DataFrame:
    """Top-level keys of JSON objects; unreadable documents give none."""
    return docs.selectExpr(f"'{source}' AS source", f"explode(map_keys({object_at(parse(text), '$')})) AS key")


def summary_keys(docs: DataFrame, text: str = "value") -> DataFrame:
    """``package_name``/``version`` pairs found in a possibly truncated JSON text."""
    pattern = r'"package_name":\s*"([^"]+)"\s*,\s*"version":\s*"([^"]+)"'
    hits = docs.selectExpr(f"explode(regexp_extract_all({text}, {regex('(' + pattern + ')')}, 1)) AS hit")
    return hits.selectExpr(
        "'summary' AS source",
        f"concat(regexp_extract(hit, {regex(pattern)}, 1), '/', regexp_extract(hit, {regex(pattern)}, 2)) AS key",
    ).distinct()


def read_ground_truth(spark: SparkSession, root: str) -> DataFrame:
    """All label sources below ``root`` as ``source, key`` rows for ``labels.build_ground_truth``.

    Expects ``benign.txt``, ``tool/{benign,malicious,false_positives,false_negatives}.json`` and ``summary.json``.
    """
    root = root.rstrip("/")
    out = benign_keys(spark.read.text(f"{root}/benign.txt"))
    for source, name in (
        ("tool_benign", "benign"), ("tool_malicious", "malicious"), ("tool_fp", "false_positives"), ("tool_fn", "false_negatives"),
    ):
        out = out.unionByName(report_keys(spark.read.text(f"{root}/tool/{name}.json", **WHOLE), source))
    return out.unionByName(summary_keys(spark.read.text(f"{root}/summary.json", **WHOLE)))


def malware_manifest(docs: DataFrame, text: str = "value") -> DataFrame:
    """``{package: null | [versions]}`` → ``package, versions`` (NULL = every version)."""
    entries = docs.selectExpr(f"explode({object_at(parse(text), '$')}) AS (package, v)")
    return entries.selectExpr("package", "try_variant_get(v, '$', 'array<string>') AS versions")


def read_malware_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Archive listing (contents never read) and manifest of a malware corpus."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
        .selectExpr("path", "length")
    )
    intent = "regexp_extract(path, '/(malicious_intent|compromised_lib)/', 1)"
    listing = files.selectExpr("path", "length", f"{intent} AS intent_class", f"{dated_archive('regexp_extract(path, ' + repr('([^/]*)$') + ', 1)')} AS k")
    listing = listing.filter("intent_class <> ''").selectExpr("path", "length", "intent_class", "k.package", "k.version", "k.captured_date")
    manifest = malware_manifest(spark.read.text(f"{root.rstrip('/')}/manifest.json", **WHOLE))
    return listing, manifest


def read_packuments(spark: SparkSession, path: str) -> DataFrame:
    """Saved registry documents, one JSON document per line, as VARIANT ``doc``; broken ones skipped."""
    return spark.read.text(path).selectExpr(f"{parse('value')} AS doc").filter("doc IS NOT NULL")


def parse_policy_state(docs: DataFrame, text: str = "value") -> DataFrame:
    """Policy document → ``state, key, reason, added, note``; unknown states keep ``known = false``.

    A document or a state that is not an object stops the job, as a half-read policy must not pass.
    """
    whole = docs.selectExpr(f"{parse(text)} AS v").selectExpr(
        "coalesce(try_variant_get(v, '$', 'map<string,variant>'), raise_error('policy is not a JSON object')) AS m"
    )
    states = whole.selectExpr("explode(m) AS (state, block)").withColumn(
        "known", F.expr("state IN ('blocked', 'quarantined', 'allowlist')")
    )
    checked = states.selectExpr(
        "state", "known",
        f"CASE WHEN {is_object('block')} THEN try_variant_get(block, '$', 'map<string,variant>') "
        "WHEN known AND to_json(block) NOT IN ('null', 'false', '0', '\"\"', '[]') THEN raise_error(concat('state ', state, ' is not an object')) END AS entries",
    )
    return checked.selectExpr("state", "known", "explode(entries) AS (key, e)").selectExpr(
        "state", "key", f"{string_at('e', '$.reason')} AS reason", f"{string_at('e', '$.added')} AS added",
        f"{string_at('e', '$.note')} AS note", "known",
    )


def read_policy_state(spark: SparkSession, path: str) -> DataFrame:
    return parse_policy_state(spark.read.text(path, **WHOLE))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature table from Parquet, or its JSON-lines twin next to it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        twin = path.rstrip("/").removesuffix(".parquet") + ".jsonl"
        return spark.read.json(twin)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Version pairs of committed runs that were diffed; the filter reaches the Parquet scan."""
    df = commits.read_runs(spark, path, "pairs").filter("status = 'tarball_diff'")
    return usable_pairs(df)


def usable_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("status = 'tarball_diff'").withColumns({
        "severity": F.expr("coalesce(nullif(severity, ''), 'unknown')"),
        "advisory_ids": F.expr("coalesce(advisory_ids, cast(array() AS array<string>))"),
    })


def split_names(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Keep files named after a split; adds ``split``."""
    word = f"lower(regexp_extract({name}, {regex(r'([^/.]+)[.](?:jsonl?|ndjson|parquet)$')}, 1))"
    return files.withColumn("split", F.expr(word)).filter("split IN (" + ", ".join(f"'{s}'" for s in SPLIT_NAMES) + ")")


def read_splits(spark: SparkSession, directory: str) -> DataFrame:
    """Records of a directory of split files with their ``split``, as VARIANT ``rec``; needs at least two split names.

    ``.jsonl`` and ``.ndjson`` hold a record a line, ``.json`` an array of records or one record, ``.parquet`` rows.
    """
    file_name = "_metadata.file_name AS file_name"
    lines = spark.read.option("pathGlobFilter", "*.{jsonl,ndjson}").text(directory).selectExpr("value", file_name)
    whole = spark.read.option("pathGlobFilter", "*.json").text(directory, wholetext=True).selectExpr("value", file_name)
    arrays = split_names(whole).selectExpr("split", f"{parse('value')} AS v").selectExpr(
        "split", f"explode(coalesce({array_at('v', '$')}, array(v))) AS rec"
    )
    records = split_names(lines).selectExpr("split", f"{parse('value')} AS rec").unionAll(arrays)
    tables = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(directory).select("path")
    if not tables.isEmpty():
        rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(directory)
        rows = rows.selectExpr("to_variant_object(struct(*)) AS rec", file_name)
        records = records.unionAll(split_names(rows).select("split", "rec"))
    if records.select("split").distinct().limit(2).count() < 2:
        raise ValueError(f"{directory} does not hold two split files")
    return records.filter("rec IS NOT NULL")
