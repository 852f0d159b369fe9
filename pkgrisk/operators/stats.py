"""Corpus statistics, distributions, tree digests and file inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions.sql import regex, texts
from pkgrisk.functions.variant import object_at, parse
from pkgrisk.operators.ordering import value_prefix


def corpus_stats(df: DataFrame, split: str = "split", label: str = "label", source: str = "source") -> DataFrame:
    """Rows per split, per split and label, per split and source, in one pass."""
    typed = df.selectExpr(f"{split} AS split", f"cast({label} AS string) AS label", f"{source} AS source")
    cols = [F.col("split"), F.col("label"), F.col("source")]
    return typed.groupingSets([[cols[0]], cols[:2], [cols[0], cols[2]]], *cols).agg(F.expr("count(*) AS n"))


def length_stats(df: DataFrame, length: str, window: int, group: Sequence[str] = ()) -> DataFrame:
    """Mean, max, the elements at positions ``n // 2`` and ``int(0.95 n)``, and context use.

    Positions are exact: one pass reduces the rows to counts per length, and everything is
    read off the running counts over those.
    """
    sized = df.selectExpr(*group, f"cast({length} AS bigint) AS len", "1L AS c").filter("len IS NOT NULL")
    runs = value_prefix(sized, "len", ["c"], group)

    def at(position: str) -> str:
        return f"max(IF({position} >= before_c AND {position} < before_c + c, len, NULL))"

    return runs.groupBy(*group).agg(
        F.expr("max(total_c) AS n"), F.expr(f"{at('floor(total_c / 2)')} AS median"),
        F.expr(f"{at('floor(total_c * 0.95D)')} AS p95"), F.expr("sum(len * c) / max(total_c) AS mean"), F.expr("max(len) AS max"),
    ).withColumn("context_use", F.expr(f"mean / {window}"))


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every value of several columns: ``field, value, n``; NULL is a value."""
    pairs = ", ".join(f"struct('{c}' AS field, cast({c} AS string) AS value)" for c in columns)
    return df.selectExpr(f"inline(array({pairs}))").groupBy("field", "value").agg(F.expr("count(*) AS n"))


def year_prefix(value: str) -> str:
    return f"IF(length({value}) >= 4, left({value}, 4), NULL)"


def tree_fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """Order-free digest of a package's files, for packages of any size.

    Each file contributes SHA-256(path, NUL, SHA-256(content)); the four 60-bit parts are
    summed, so the tree is reduced map-side and never gathered.
    """
    lines = files.selectExpr("package", f"sha2(concat(path, '\\u0000', sha2({content}, 256)), 256) AS h")
    parts = [
        F.expr(f"sum(cast(conv(substring(h, {1 + 15 * i}, 15), 16, 10) AS decimal(38, 0))) AS s{i}") for i in range(4)
    ]
    return lines.groupBy("package").agg(*parts, F.expr("count(*) AS n_files")).selectExpr(
        "package", "n_files",
        "sha2(concat_ws(':', cast(s0 AS string), cast(s1 AS string), cast(s2 AS string), cast(s3 AS string), "
        "cast(n_files AS string)), 256) AS fingerprint",
    )


# Hex digits of a path's hash that name its leaf and the node above it: 65,536 leaves, 256 nodes.
LEAF_DIGITS, NODE_DIGITS = 4, 2


def tree_digest(files: DataFrame) -> DataFrame:
    """Merkle digest of a package's files, next to the fingerprint.

    A file is the line ``path NUL SHA-256(content)``. Files are dealt to leaves by the hash of their path; a leaf's
    digest is the SHA-256 of its lines in path order, a node's that of the lines ``leaf:digest`` below it, the
    package's that of its nodes. So equal trees have equal digests, and no group holds more than 1/65,536 of a package
    or 256 digests.
    """
    lines = files.selectExpr("package", f"left(sha2(path, 256), {LEAF_DIGITS}) AS name", "path", "concat(path, '\u0000', sha2(content, 256)) AS line")

    def digest(rows: DataFrame, order: str, line: str) -> DataFrame:
        joined = f"array_join(transform(array_sort(collect_list(struct({order} AS o, {line} AS l))), x -> x.l), '\n')"
        return rows.groupBy("package", "name").agg(F.expr(f"sha2({joined}, 256) AS digest"))

    above = digest(lines, "path", "line")
    for digits in (NODE_DIGITS, 0):
        above = digest(above.selectExpr("package", f"left(name, {digits}) AS name", "name AS below", "digest AS d"), "below", "concat(below, ':', d)")
    return tree_fingerprint(files).join(above.select("package", "digest"), "package", "left")


# Kinds by suffix (later archive match wins) and the keys that mark training data.
KINDS = (".jsonl", ".ndjson", ".json", ".csv", ".parquet", ".txt", ".md")
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2")
TRAINING_KEYS = (
    "messages", "prompt", "completion", "input", "output", "question", "answer", "instruction", "response",
)


def build_inventory(files: DataFrame) -> DataFrame:
    """Per file: kind, size, SHA-256 and the training keys found in its lines."""
    kind = "CASE " + " ".join(f"WHEN endswith(_name, '{a}') THEN 'archive'" for a in ARCHIVES)
    kind += " " + " ".join(f"WHEN endswith(_name, '{k}') THEN '{k[1:]}'" for k in KINDS) + " ELSE 'unknown' END"
    # Only a line that holds a key in quotes, or an escape that may hide one, is parsed.
    may_hold = f"l RLIKE {regex('\"(?:' + '|'.join(TRAINING_KEYS) + ')\"|' + chr(92) * 2)}"
    keys = (
        f"array_sort(array_intersect(flatten(transform(filter(split(content, '\\n'), l -> {may_hold}), "
        f"l -> coalesce(map_keys({object_at(parse('l'), '$')}), cast(array() AS array<string>)))), array({texts(TRAINING_KEYS)})))"
    )
    named = files.selectExpr("path", "content", "lower(substring_index(path, '/', -1)) AS _name")
    return named.filter("_name <> 'manifest.json'").selectExpr(
        "path", f"{kind} AS kind", "octet_length(content) AS size_bytes", "sha2(content, 256) AS sha256", "content"
    ).selectExpr(
        "path", "kind", "size_bytes", "sha256",
        f"IF(kind IN ('jsonl', 'ndjson'), {keys}, cast(array() AS array<string>)) AS training_keys",
    )


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.expr("count(*) AS file_count"), F.expr("sum(size_bytes) AS total_bytes"),
        F.expr("count_if(size(training_keys) > 0) AS candidate_count"),
    )
