"""JSON lines, JSON documents and plain lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.functions.names import seed_line
from pkgrisk.functions.variant import is_object, parse

WHOLE = {"wholetext": True, "recursiveFileLookup": True}


def parse_jsonl(lines: DataFrame, schema: str | None = None, mode: str = "skip", line: str = "value") -> DataFrame:
    """Records from JSON lines: blank lines dropped, bad lines skipped, or fatal with ``mode='strict'``.

    Without a schema the record is one VARIANT column ``rec``; with one, its columns.
    """
    if mode not in ("skip", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    others = [c for c in lines.columns if c != line]
    text = lines.selectExpr(*others, f"trim({line}) AS _line").filter("_line <> ''")
    if mode == "strict":
        bad = "raise_error(concat('bad JSON line: ', left(_line, 200)))"
        rec = text.selectExpr(*others, "_line", f"coalesce({parse('_line')}, {bad}) AS rec")
    else:
        rec = text.selectExpr(*others, "_line", f"{parse('_line')} AS rec").filter("rec IS NOT NULL")
    if schema is None:
        return rec.drop("_line")
    flat = " ".join(schema.split())
    return rec.filter(is_object("rec")).selectExpr(*others, f"from_json(_line, '{flat}') AS _r").select(*others, "_r.*")


def line_counts(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row: lines in all, blank, bad and good ones."""
    return lines.agg(
        F.expr("count(*) AS n_lines"), F.expr(f"count_if(trim({line}) = '') AS n_blank"),
        F.expr(f"count_if(trim({line}) <> '' AND {parse(f'trim({line})')} IS NULL) AS n_bad"),
        F.expr(f"count_if({parse(f'trim({line})')} IS NOT NULL) AS n_records"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, mode: str = "skip") -> DataFrame:
    return parse_jsonl(spark.read.text(path), schema, mode)


def parse_json_documents(docs: DataFrame, text: str = "value") -> DataFrame:
    """Documents holding an array or one object → one VARIANT ``rec`` per object; other values dropped."""
    others = [c for c in docs.columns if c != text]
    parsed = docs.selectExpr(*others, f"{parse(text)} AS v").filter("v IS NOT NULL")
    items = "coalesce(try_variant_get(v, '$', 'array<variant>'), array(v))"
    return parsed.selectExpr(*others, f"explode({items}) AS rec").filter(is_object("rec"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_documents(spark.read.text(path, **WHOLE))


def parse_seed_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """``pkg@version`` lines → ``package, version``; comments and blanks dropped, malformed lines flagged."""
    kept = lines.selectExpr("*", f"trim({line}) AS _l").filter("_l <> '' AND NOT startswith(_l, '#')")
    split = kept.withColumn("_k", F.expr(seed_line("_l")))
    return split.selectExpr("* EXCEPT (_l, _k)", "_k.package", "_k.version", "_k.package IS NULL AS malformed")


def read_seed_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_seed_list(spark.read.text(path)).drop("value")


def write_jsonl(df: DataFrame, path: str, drop: list[str] = (), mode: str = "errorifexists") -> None:
    """JSON lines without the wide or nested columns named in ``drop``."""
    df.drop(*drop).write.mode(mode).json(path, ignoreNullFields=False)
