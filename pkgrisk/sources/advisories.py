"""OSV advisories: one JSON document per advisory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pkgrisk.functions.variant import parse

OSV_SCHEMA = """
id string, summary string, published string, modified string, aliases array<string>,
affected array<struct<
  package: struct<name: string, ecosystem: string>,
  versions: array<string>,
  ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string>>>>,
  database_specific: struct<cwes: array<struct<cweId: string>>>>>,
references array<struct<url: string>>,
database_specific struct<`malicious-packages-origins`: array<struct<source: string>>>
"""


def parse_osv(docs: DataFrame, text: str) -> DataFrame:
    """Advisory columns next to the given ones; unreadable documents are skipped."""
    flat = " ".join(OSV_SCHEMA.split())
    # One-element array and inline: each document is parsed once for all columns. Whether it
    # is readable is asked of the strict parser, as one field of a wrong type is no reason to skip it.
    records = f"inline(filter(array(from_json({text}, '{flat}')), r -> {parse(text)} IS NOT NULL))"
    kept = [c for c in docs.columns if c != text]
    return docs.selectExpr(*kept, records)


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.json`` below ``path``, one advisory per file, with its ``source_path``."""
    files = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
        .selectExpr("value", "_metadata.file_path AS source_path")
    )
    return parse_osv(files, "value")
