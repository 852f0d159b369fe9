"""Splits, folds, samples, interleaving."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import table, view, with_views
from pkgrisk.operators import splits


def split_sql(rounding: str, train: float, val: float, by: str) -> str:
    f = (lambda x: f"floor({x})") if rounding == "floor" else (lambda x: f"round_even({x}, 0)")
    return f"""SELECT doc_id, CASE WHEN rn <= {f(f'n * {train}::DOUBLE')} THEN 'train'
      WHEN rn <= {f(f'n * {train}::DOUBLE')} + {f(f'n * {val}::DOUBLE')} THEN 'val' ELSE 'test' END AS split FROM (
      SELECT doc_id, count(*) OVER (PARTITION BY {by}) AS n,
        row_number() OVER (PARTITION BY {by} ORDER BY sha256('42|' || doc_id)) AS rn FROM documents)"""


@query("stratified_split", split_sql("floor", 0.8, 0.1, "lang"))
def stratified(spark, sf):
    return splits.stratified_split(table(spark, sf, "documents"), ["lang"], "doc_id", 0.8, 0.1).select("doc_id", "split")


@query("stratified_split_half_even", split_sql("half_even", 0.7, 0.15, "lang, source"))
def _(spark, sf):
    return splits.stratified_split(
        table(spark, sf, "documents"), ["lang", "source"], "doc_id", 0.7, 0.15, 0.15, rounding="half_even"
    ).select("doc_id", "split")


@query(
    "holdout_split",
    """SELECT doc_id, row_number() OVER (ORDER BY sha256('7|' || doc_id)) <= greatest(1, floor(count(*) OVER () * 0.05)) AS is_test FROM documents""",
)
def _(spark, sf):
    return splits.holdout_split(table(spark, sf, "documents"), "doc_id", 0.05, 7).select("doc_id", "is_test")


@query(
    "holdout_split_per_source",
    """SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7|' || doc_id)) <= greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.01)) AS is_test FROM documents""",
)
def _(spark, sf):
    return splits.holdout_split(table(spark, sf, "documents"), "doc_id", 0.01, 7, ["source"]).select("doc_id", "is_test")


@query(
    "kfold",
    with_views("scored")
    + """SELECT label, fold, count(*) AS n FROM (SELECT label, (row_number() OVER (ORDER BY label) - 1) % 5 AS fold FROM scored) GROUP BY ALL""",
)
def _(spark, sf):
    return splits.kfold(view(spark, sf, "scored"), "label", "id").groupBy("label", "fold").agg(F.expr("count(*) AS n"))


# Severity weights as in a catalog: words become weights.
ITEMS = {"beacon": 3, "dropper": 9, "stealer": 5, "typo": 0}


@query(
    "weighted_draws",
    """SELECT doc_id, draw, CASE WHEN u * 18 < 3 THEN 'beacon' WHEN u * 18 < 12 THEN 'dropper' WHEN u * 18 < 17 THEN 'stealer' ELSE 'typo' END AS item
      FROM (SELECT doc_id, draw, CAST('0x' || substring(sha256(concat('42|', doc_id, '|', draw)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
      FROM documents, (SELECT unnest(range(3)) AS draw))""",
)
def _(spark, sf):
    out = splits.weighted_draws(table(spark, sf, "documents"), ITEMS, 3, 42, "doc_id")
    return out.select("doc_id", "draw", "item")


@query(
    "quota_sample",
    """WITH r AS (SELECT doc_id, lang, sha256('42|' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id)) AS rn,
      (SELECT count(DISTINCT lang) FROM documents) AS k FROM documents)
      SELECT doc_id, lang FROM r WHERE rn <= greatest(1, 101 // k) ORDER BY h LIMIT 101""",
)
def _(spark, sf):
    return splits.quota_sample(table(spark, sf, "documents"), "lang", "doc_id", 101).select("doc_id", "lang")


@query(
    "interleave",
    """SELECT doc_id, corpus, substring(h, 1, 16) AS h FROM (
      SELECT doc_id, 'a' AS corpus, sha256('9|a|' || doc_id) AS h FROM documents WHERE lang = 'en'
      UNION ALL SELECT doc_id, 'b', sha256('9|b|' || doc_id) FROM documents WHERE lang <> 'en')""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    out = splits.interleave(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"), "doc_id", 9)
    return out.selectExpr("doc_id", "corpus", "substring(order_hash, 1, 16) AS h")
