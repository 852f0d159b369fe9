"""Filters over archive members, files, advisories and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.functions import dates
from pkgrisk.functions.sql import texts
from pkgrisk.functions.text import base_name, suffix

# Which files are text, comparable, skipped or build output.
TEXT_SUFFIXES = (
    ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".json", ".yaml", ".yml", ".md", ".txt", ".html",
    ".css", ".sh", ".py", ".coffee", ".vue",
)
TEXT_NAMES = ("LICENSE", "README", "Makefile", "CHANGELOG")
COMPARABLE_SUFFIXES = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".json", ".md")
NEVER_COMPARED = ("package.json", "LICENSE", "README.md", "CHANGELOG.md", ".npmignore")
BUILD_PREFIXES = ("dist/", "build/", "lib/", "out/", "es/", "esm/", "umd/")


def reject_reason(member: str, is_link: str = "false") -> str:
    """Why an archive member must not be unpacked; NULL when it is safe."""
    return (
        f"CASE WHEN startswith({member}, '/') THEN 'absolute_path' "
        f"WHEN array_contains(split({member}, '/'), '..') THEN 'parent_segment' "
        f"WHEN {is_link} THEN 'link' END"
    )


def is_textual(path: str) -> str:
    return f"({suffix(path)} IN ({texts(TEXT_SUFFIXES)}) OR {base_name(path)} IN ({texts(TEXT_NAMES)}))"


def is_comparable(path: str) -> str:
    return (
        f"({base_name(path)} NOT IN ({texts(NEVER_COMPARED)}) AND {suffix(path)} IN ({texts(COMPARABLE_SUFFIXES)}))"
    )


def is_build_output(path: str) -> str:
    return "(" + " OR ".join(f"startswith({path}, '{p}')" for p in BUILD_PREFIXES) + ")"


def in_node_modules(path: str) -> str:
    return f"array_contains(split({path}, '/'), 'node_modules')"


def discover_packages(files: DataFrame, path: str = "path") -> DataFrame:
    """Directories holding a ``package.json``, nested dependencies excluded."""
    hit = files.filter(f"{base_name(path)} = 'package.json' AND NOT {in_node_modules(path)}")
    return hit.selectExpr(f"regexp_replace({path}, '/?package[.]json$', '') AS package_dir").distinct()


def record_date(published: str = "published", modified: str = "modified") -> str:
    return f"coalesce({dates.iso_timestamp(published)}, {dates.iso_timestamp(modified)})"


def since(advisories: DataFrame, start: str) -> DataFrame:
    """Add ``when_at`` and ``skip``: NULL for kept rows, else no_date or too_old."""
    df = advisories.withColumn("when_at", F.expr(record_date()))
    return df.withColumn("skip", F.expr(
        f"CASE WHEN when_at IS NULL THEN 'no_date' WHEN when_at < timestamp'{start}' THEN 'too_old' END"
    ))


def newest(advisories: DataFrame, n: int, tiebreak: str = "id") -> DataFrame:
    """The ``n`` newest advisories, undated last (top-n without a full sort)."""
    df = advisories.withColumn("when_at", F.expr(record_date()))
    return df.orderBy(F.col("when_at").desc_nulls_last(), tiebreak).limit(n)


def cap_sizes(files: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """With a limit, oversize files read as empty text and are flagged; their size is kept."""
    if max_file_bytes is None:
        return files.withColumn("oversize", F.lit(False))
    return files.withColumns({
        "oversize": F.expr(f"size > {max_file_bytes}"),
        "content": F.expr(f"IF(size > {max_file_bytes}, '', content)"),
    })


def allowed_urls(df: DataFrame, hosts: list[str], url: str = "url", schemes: tuple[str, ...] = ("http", "https")) -> DataFrame:
    """Add ``url_ok``: scheme and host both on their lists."""
    return df.withColumn("url_ok", F.expr(
        f"coalesce(lower(try_parse_url({url}, 'PROTOCOL')) IN ({texts(schemes)}) "
        f"AND lower(try_parse_url({url}, 'HOST')) IN ({texts(hosts)}), false)"
    ))
