"""Statistics, distributions, digests, inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.splits import split_sql
from checks.views import table, view, with_views
from pkgrisk.operators import ordering, splits, stats


@query(
    "corpus_stats",
    f"""WITH s AS ({split_sql('floor', 0.8, 0.1, 'lang')}), j AS (SELECT split, CAST(quality AS STRING) AS label, source FROM documents d JOIN s USING (doc_id) LEFT JOIN labels l USING (doc_id))
      SELECT split, label, source, count(*) AS n FROM j GROUP BY GROUPING SETS ((split), (split, label), (split, source))""",
)
def _(spark, sf):
    df = splits.stratified_split(table(spark, sf, "documents"), ["lang"], "doc_id", 0.8, 0.1)
    df = df.join(table(spark, sf, "labels"), "doc_id", "left")
    return stats.corpus_stats(df, "split", "quality", "source")


@query(
    "length_stats",
    """WITH r AS (SELECT lang, length(text) // 4 AS len, row_number() OVER (PARTITION BY lang ORDER BY length(text) // 4) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
      SELECT lang, max(n) AS n, max(CASE WHEN i = n // 2 THEN len END) AS median, max(CASE WHEN i = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) THEN len END) AS p95,
        round(avg(len), 6) AS mean, max(len) AS max, round(avg(len) / 8192, 6) AS context_use FROM r GROUP BY lang""",
)
def _(spark, sf):
    out = stats.length_stats(table(spark, sf, "documents"), "floor(length(text) / 4)", 8192, ["lang"])
    return out.selectExpr("lang", "n", "median", "p95", "round(mean, 6) AS mean", "max", "round(context_use, 6) AS context_use")


@query(
    "length_stats_global",
    """WITH r AS (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM documents)
      SELECT max(n) AS n, max(CASE WHEN i = n // 2 THEN len END) AS median, max(CASE WHEN i = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) THEN len END) AS p95, max(len) AS max FROM r""",
)
def _(spark, sf):
    return stats.length_stats(table(spark, sf, "documents"), "length(text)", 8192).select("n", "median", "p95", "max")


@query(
    "distribution",
    """SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY ALL
      UNION ALL SELECT 'year', substring(CAST(ts AS STRING), 1, 4), count(*) FROM events GROUP BY ALL
      UNION ALL SELECT 'user_id', CAST(user_id AS STRING), count(*) FROM events GROUP BY ALL""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").withColumn("year", F.expr(stats.year_prefix("cast(ts AS string)")))
    return stats.distribution(ev, ["event_type", "year", "user_id"])


@query(
    "tree_fingerprint",
    """WITH l AS (SELECT source AS package, sha256(concat('lib/', doc_id, '.js', chr(0), sha256(text))) AS h FROM documents)
      SELECT package, count(*) AS n_files, sha256(concat_ws(':', """
    + ", ".join(f"CAST(sum(CAST('0x' || substring(h, {1 + 15 * i}, 15) AS BIGINT)) AS STRING)" for i in range(4))
    + ", CAST(count(*) AS STRING))) AS fingerprint FROM l GROUP BY package",
)
def _(spark, sf):
    return stats.tree_fingerprint(docs_as_files(spark, sf))


def docs_as_files(spark, sf):
    return table(spark, sf, "documents").selectExpr("source AS package", "concat('lib/', doc_id, '.js') AS path", "text AS content")


@query(
    "tree_digest",
    """WITH f AS (SELECT source AS package, concat('lib/', doc_id, '.js') AS path, sha256(text) AS sha FROM documents),
      leaf AS (SELECT package, left(sha256(path), 4) AS name, sha256(string_agg(concat(path, chr(0), sha), chr(10) ORDER BY path)) AS d FROM f GROUP BY ALL),
      node AS (SELECT package, left(name, 2) AS name, sha256(string_agg(concat(name, ':', d), chr(10) ORDER BY name)) AS d FROM leaf GROUP BY package, left(name, 2))
      SELECT package, sha256(string_agg(concat(name, ':', d), chr(10) ORDER BY name)) AS digest FROM node GROUP BY package""",
)
def _(spark, sf):
    return stats.tree_digest(docs_as_files(spark, sf)).select("package", "digest")


INVENTORY = r"""WITH f AS (SELECT concat('d/', event_id, CASE event_id % 6 WHEN 0 THEN '.jsonl' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.JSON' WHEN 3 THEN '.bin'
    WHEN 4 THEN '.ndjson' ELSE '.md' END) AS path,
  concat('{"prompt":1,"', event_type, '":2}', chr(10), 'bad', chr(10), props, CASE WHEN event_id % 5 = 0 THEN concat(repeat(chr(10), 60), '{"messages":1}') ELSE concat(chr(10), '{"answer":[]}') END) AS content, event_id FROM events)
"""


@query(
    "build_inventory",
    INVENTORY
    + """SELECT path, CASE event_id % 6 WHEN 0 THEN 'jsonl' WHEN 1 THEN 'archive' WHEN 2 THEN 'json' WHEN 3 THEN 'unknown' WHEN 4 THEN 'ndjson' ELSE 'md' END AS kind,
      strlen(content) AS size_bytes, sha256(content) AS sha256,
      CASE WHEN event_id % 6 NOT IN (0, 4) THEN '' WHEN event_id % 5 = 0 THEN 'messages,prompt' ELSE 'answer,prompt' END AS training_keys FROM f""",
)
def inventory(spark, sf):
    from checks.views import tables

    tables(spark, sf, INVENTORY)
    out = stats.build_inventory(spark.sql(INVENTORY + "SELECT path, content FROM f"))
    return out.selectExpr("path", "kind", "cast(size_bytes AS bigint) AS size_bytes", "sha256", "array_join(training_keys, ',') AS training_keys")


@query(
    "inventory_totals",
    INVENTORY
    + """SELECT count(*) AS file_count, CAST(sum(strlen(content)) AS BIGINT) AS total_bytes, count(*) FILTER (event_id % 6 IN (0, 4)) AS candidate_count FROM f""",
)
def _(spark, sf):
    from checks.views import tables

    tables(spark, sf, INVENTORY)
    return stats.inventory_totals(stats.build_inventory(spark.sql(INVENTORY + "SELECT path, content FROM f")))


@query(
    "key_intersection",
    """SELECT event_type, count(*) AS n FROM events WHERE json_exists(props, '$.k') AND event_id % 2 = 0 GROUP BY ALL""",
)
def _(spark, sf):
    files = table(spark, sf, "events").selectExpr(
        "concat(event_type, '/', event_id, '.jsonl') AS path", "IF(event_id % 2 = 0, replace(props, '\"k\"', '\"prompt\"'), 'broken') AS content"
    )
    hit = stats.build_inventory(files).filter("array_contains(training_keys, 'prompt')")
    return hit.groupBy(F.expr("split(path, '/')[0] AS event_type")).agg(F.expr("count(*) AS n"))


@query(
    "running_sums_refined",
    """WITH g AS (SELECT l_returnflag AS flag, CAST(l_extendedprice AS DOUBLE) AS price, sum(CAST(l_quantity AS BIGINT))::BIGINT AS w FROM lineitem GROUP BY ALL)
      SELECT flag, price, w, (sum(w) OVER (PARTITION BY flag ORDER BY price) - w)::BIGINT AS before_w, (sum(w) OVER (PARTITION BY flag))::BIGINT AS total_w FROM g""",
)
def _(spark, sf):
    """Running sums with every stretch of more than 50 values divided further."""
    lines = table(spark, sf, "lineitem").selectExpr("l_returnflag AS flag", "cast(l_extendedprice AS double) AS price", "cast(l_quantity AS bigint) AS w")
    return ordering.value_prefix(lines, "price", ["w"], ["flag"], stretch=50)
