"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pkgrisk.llm import (
    decontaminate, importance, licenses, linededup, mixing, neardup, pagetext, pii, quality, secrets, sharding, toxicity,
    vectorcodes,
)
from pkgrisk.llm.shared import read, sha256

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", sha256(F.col("kept")).alias("kept_sha256")
    )


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read(spark, sf_dir, "documents"), 40)


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_report(read(spark, sf_dir, "documents"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(read(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(read(spark, sf_dir, "embeddings"))


@query
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(read(spark, sf_dir, "pages"))


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES["op1_decontamination"] = f"""
WITH items AS (
  SELECT DISTINCT id, width, array_to_string(w[k:k + width - 1], ' ') AS s
  FROM (SELECT *, least(len(w), 5) AS width FROM (
    SELECT item_id AS id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark)),
    unnest(range(1, len(w) - width + 2)) AS u(k) WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT id, width, array_to_string(w[k:k + width - 1], ' ') AS s
  FROM (SELECT doc_id AS id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    (SELECT DISTINCT width FROM items), unnest(range(1, len(w) - width + 2)) AS u(k) WHERE len(w) > 0
), sizes AS (SELECT id, count(*) AS n FROM items GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n) AS n_shingles, count(*) AS n_found, count(*) / any_value(n) AS containment
FROM items i JOIN sizes ON sizes.id = i.id JOIN shingles d ON d.s = i.s AND d.width = i.width
GROUP BY d.id, i.id HAVING count(*) * 100 >= 80 * any_value(n)
"""

ORACLES["op4_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, k, line, first_doc IS NOT NULL AND first_doc <> doc_id AS dropped FROM keyed LEFT JOIN firsts USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES["op6_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), filled AS (  -- in the order in which they reach twice their size
  SELECT *, 2.0 * source_size / weight AS full_at, sum(source_size) OVER () * 1.5 AS total,
    coalesce(sum(2.0 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM sources WINDOW o AS (ORDER BY 2.0 * source_size / weight, source)
), level AS (
  SELECT arg_min((total - full_before) / weight_left, full_at) AS fill FROM filled WHERE (total - full_before) / weight_left <= full_at
), goals AS (
  SELECT source, source_size, least(2.0 * source_size, fill * weight)::DOUBLE AS target FROM filled, level
), parts AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, s.place, g.source,
    CASE WHEN g.source_size = 0 THEN 0 ELSE floor(g.target / g.source_size)::BIGINT END AS whole
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), running AS (
  SELECT *, target - whole * source_size AS budget, sum(size) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY source, place) AS here FROM parts
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN budget > 0 AND (upto < budget OR upto - here < budget AND abs(upto - budget) < abs(upto - here - budget)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""

ORACLES["op8_near_dedup"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 1], ' ') AS s FROM words, unnest(range(1, greatest(len(w), 2))) AS u(k) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT l.v, r.seen FROM reach r JOIN links l ON l.u = r.node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
"""


def _rounds(rounds: int) -> str:
    """Assignment and mean steps of Lloyd's rounds as chained tables."""
    out = ""
    for k in range(rounds + 1):
        out += f""", near{k} AS (
  SELECT vec_id, row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.row, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN book{k} b ON b.part = p.part) GROUP BY vec_id, row, part
)"""
        if k < rounds:
            out += f""", mean{k} AS (
  SELECT part, entry, list(m ORDER BY j) AS v FROM (
    SELECT n.part, n.entry, j, floor(sum(p.v[j])::DOUBLE / count(*))::BIGINT AS m
    FROM near{k} n JOIN parts p ON p.row = n.row AND p.part = n.part, unnest(range(1, len(p.v) + 1)) AS u(j) GROUP BY n.part, n.entry, j
  ) GROUP BY part, entry
), book{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON m.part = b.part AND m.entry = b.entry
)"""
    return out


ORACLES["op11_vector_codes"] = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, row, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS v FROM kept, unnest(range(16)) AS u(part)
), book0 AS (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= 64){_rounds(2)}, coded AS (
  SELECT row, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY row
), sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN coded USING (row) GROUP BY label)
SELECT k.vec_id, lower(code) AS code, error, label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM kept k JOIN coded c ON c.row = k.row JOIN sums s ON s.label IS NOT DISTINCT FROM k.label
"""

# the pages of these tables mark their main text by an article element
ORACLES["op12_main_text"] = r"""
WITH blocks AS (
  SELECT page_id, url, list_transform(
    regexp_split_to_array(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<b>|</b>', '', 'g'), '</?(p|h1)>'),
    lambda b: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(b, '<br>', ' '), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
      '&amp;?', '&', 'g'), '[\x09-\x0D\x20\xA0]+', ' ', 'g'))) AS b
  FROM pages
)
SELECT page_id, url, text, length(text) AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM blocks)
"""

ORACLES["op13_importance"] = f"""
WITH steps AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) AS t(i)
), bytes AS (SELECT list(v ORDER BY i) AS crc FROM steps
), words AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')) FROM benchmark
), counted AS (SELECT kind, id, w, count(*) AS n FROM words GROUP BY kind, id, w),
hashed AS (
  SELECT w, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM counted), bytes
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::BIGINT AS t
  FROM counted JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((sum(s) OVER ())::DOUBLE + 10000)) / ((s + 1) * ((sum(t) OVER ())::DOUBLE + 10000))))::BIGINT AS gain FROM sums
), weighed AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (w) JOIN gains USING (bucket)
  WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed ON id = doc_id
), ranked AS (
  SELECT *, n_features >= 20 AS open, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k,
    floor(10 * count(*) FILTER (n_features >= 20) OVER () / 100) AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND k <= drawn THEN k END AS rank FROM ranked
"""
