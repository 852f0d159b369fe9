"""Model, scoring, evaluation report, pre-audit, memos."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.features import FEATURES
from checks.metrics import SC
from checks.policy import POLICY, as_of, decided, releases
from checks.registry import query
from checks.views import table, view
from pkgrisk.operators import features, gate, responses
from pkgrisk.plans import model, seeding
from pkgrisk.session import shared_folder, stored
from pkgrisk.sources import config


@query(
    "render_memos",
    POLICY
    + """SELECT package, version, env, len(string_split(passed, ',')) - CASE WHEN passed = '' THEN 1 ELSE 0 END AS n_pass,
      CASE verdict WHEN 'block' THEN 'Decision: BLOCK' WHEN 'allow' THEN 'Decision: ALLOW' ELSE 'Decision: QUARANTINE' END AS decision_line, concat('- release_age: ', CASE WHEN age_ok THEN 'PASS' ELSE 'FAIL' END, ' - ', age_reason) AS age_line FROM fin""",
)
def _(spark, sf):
    out = gate.render_memos(decided(spark, sf), "'2001-01-10'")
    return out.selectExpr(
        "package", "version", "env", "cast(n_pass AS bigint) AS n_pass", "split(memo, '\\n')[3] AS decision_line",
        "get(filter(split(memo, '\\n'), l -> startswith(l, '- release_age')), 0) AS age_line",
    )


@query(
    "pre_audit",
    POLICY
    + """, last AS (SELECT r.package, max(version) AS version FROM releases r GROUP BY 1),
      a AS (SELECT out.*, (age_problem IS NULL AND age >= 14) AS ok14 FROM out JOIN last ON last.package = out.package AND last.version = out.version WHERE env = 'preprod')
      SELECT package, version, CASE WHEN NOT kq_ok OR NOT ok14 OR NOT scripts_ok THEN 'block' WHEN NOT sum_ok OR sm_ok IS NULL OR NOT sm_ok THEN 'quarantine' ELSE 'allow' END AS verdict FROM a""",
)
def _(spark, sf):
    rel = releases(spark, sf)
    tags = rel.filter("false").selectExpr("package", "version AS latest")
    out = seeding.pre_audit(rel, tags, as_of(), view(spark, sf, "state"))
    return out.select("package", "version", "verdict")


@query(
    "pre_audit_counts",
    POLICY
    + """, last AS (SELECT r.package, max(version) AS version FROM releases r GROUP BY 1),
      a AS (SELECT out.*, (age_problem IS NULL AND age >= 14) AS ok14 FROM out JOIN last ON last.package = out.package AND last.version = out.version WHERE env = 'preprod')
      SELECT CASE WHEN NOT kq_ok OR NOT ok14 OR NOT scripts_ok THEN 'block' WHEN NOT sum_ok OR sm_ok IS NULL OR NOT sm_ok THEN 'quarantine' ELSE 'allow' END AS verdict, count(*) AS n FROM a GROUP BY 1""",
)
def _(spark, sf):
    rel = releases(spark, sf)
    tags = rel.filter("false").selectExpr("package", "version AS latest")
    return seeding.verdict_totals(seeding.pre_audit(rel, tags, as_of(), view(spark, sf, "state")))


@query(
    "configured_decisions",
    FEATURES + "SELECT package_name, CASE WHEN score < 0.1::DOUBLE THEN 'allow' WHEN score >= 0.2::DOUBLE THEN 'block' ELSE 'quarantine' END AS decision FROM sc",
)
def _(spark, sf):
    path = shared_folder(spark, "thresholds")
    spark.createDataFrame([('{"allow_below": 0.1, "block_at_or_above": 0.2}',)], "value string").coalesce(1).write.text(path)
    limits = config.load_thresholds(path)
    scored = features.heuristic_score(features.extract_features(view(spark, sf, "records")))
    return features.threshold_decide(scored, allow_below=limits["allow_below"], block_from=limits["block_from"]).select("package_name", "decision")


@query(
    "feature_medians",
    """SELECT 'l_quantity' AS name, median(l_quantity) AS value FROM lineitem UNION ALL SELECT 'l_discount', median(l_discount) FROM lineitem
      UNION ALL SELECT 'gap', median(CASE WHEN l_linenumber <> 3 THEN l_tax END) FROM lineitem""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_quantity", "l_discount", "IF(l_linenumber <> 3, l_tax, NULL) AS gap")
    return model.median_rows(df, ["l_quantity", "l_discount", "gap"])


@query(
    "evaluation_report",
    SC
    + """, c AS (SELECT count(*) AS n, count(*) FILTER (label = 1 AND score >= 0.3) AS tp, count(*) FILTER (label = 0 AND score >= 0.3) AS fp FROM scored),
      g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY score),
      k AS (SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM g WINDOW w AS (ORDER BY score DESC)),
      au AS (SELECT (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auroc FROM (
        SELECT label, avg(rn) OVER (PARTITION BY score) AS r FROM (SELECT label, score, row_number() OVER (ORDER BY score) AS rn FROM scored)))
      SELECT c.n, c.tp, c.fp, auroc, (SELECT sum(pos / p * (tp / (tp + fp))) FROM k) AS average_precision FROM c, au""",
)
def _(spark, sf):
    out = model.evaluation_report(view(spark, sf, "scored"), "id")
    return out.select("n", "tp", "fp", "auroc", "average_precision")


def flights(spark, sf):
    """Numeric rows with a label for the classifier."""
    return table(spark, sf, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS key", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_linestatus = 'O' AS is_open", "IF(l_linenumber = 3, NULL, l_suppkey) AS supp", "IF(l_returnflag = 'R', 1, 0) AS label",
    )


@query("cross_validate")
def _(spark, sf):
    df = flights(spark, sf)
    cols = model.feature_columns(df, ["label"])
    matrix = model.feature_matrix(df, cols, model.medians(df, cols)).select("key", "label", "features")
    return model.cross_validate(matrix, "key", k=3, rounds=3, depth=3)


@query(
    "batch_score_heuristic",
    FEATURES + "SELECT package_name, round(score, 6) AS score, CASE WHEN score < 0.05::DOUBLE THEN 'allow' WHEN score >= 0.3::DOUBLE THEN 'block' ELSE 'quarantine' END AS decision FROM sc",
)
def _(spark, sf):
    out = model.batch_score(view(spark, sf, "records"))
    return out.selectExpr("package_name", "round(score, 6) AS score", "decision")


@query(
    "cross_validate_folds",
    """WITH r AS (SELECT label, (row_number() OVER (ORDER BY label) - 1) % 3 AS fold FROM (SELECT doc_id % 2 AS label FROM documents))
      SELECT fold, count(*) AS n_val, count(*) FILTER (label = 1) AS n_pos, true AS in_range FROM r GROUP BY fold""",
)
def _(spark, sf):
    rec = features.extract_features(view(spark, sf, "records").withColumn("label", F.expr("cast(doc_id % 2 AS int)")))
    cols = ["total_size_bytes", "mean_identifier_length", "package_name_length"]
    matrix = model.feature_matrix(rec, cols, model.medians(rec, cols)).select("package_name", "label", "features")
    out = model.cross_validate(matrix, "package_name", k=3, rounds=2, depth=2)
    return out.selectExpr("fold", "n_val", "n_pos", "f1 BETWEEN 0 AND 1 AND auroc BETWEEN 0 AND 1 AND pr_auc BETWEEN 0 AND 1 AS in_range")


@query("saved_model_scores", "SELECT count(*) AS n, count(*) AS n_equal, count(*) AS n_in_range FROM documents")
def _(spark, sf):
    rec = view(spark, sf, "records").withColumn("label", F.expr("doc_id % 2"))
    fitted = model.fit(features.extract_features(rec), features.NUMERIC, "package_name", k=0, rounds=2, depth=2)
    path = shared_folder(spark, "model")
    fitted.save(path)
    old, new = (model.batch_score(rec, m).select("package_name", F.col("score").alias(c)) for m, c in ((fitted, "a"), (model.load(spark, path), "b")))
    return old.join(new, "package_name").agg(F.expr("count(*) AS n"), F.expr("count_if(a = b) AS n_equal"), F.expr("count_if(a BETWEEN 0 AND 1) AS n_in_range"))


@query("batch_score_model")
def _(spark, sf):
    rec = view(spark, sf, "records").withColumn("label", F.expr("doc_id % 2"))
    feats = stored(features.extract_features(rec), "features")
    cols = [c for c in features.NUMERIC]
    fill = model.medians(feats, cols)
    fitted = model.train(model.feature_matrix(feats, cols, fill), rounds=3, depth=3)
    return model.batch_score(rec, fitted, cols, fill).select("package_name", "version", "score", "decision", "model")


@query(
    "heuristic_audit",
    FEATURES + "SELECT package_name AS package, CASE WHEN score < 0.05::DOUBLE THEN 'clean' WHEN score >= 0.3::DOUBLE THEN 'malicious' ELSE 'suspicious' END AS verdict FROM sc",
)
def _(spark, sf):
    return responses.heuristic_audit(view(spark, sf, "records")).select("package", "verdict")


@query(
    "split_evaluation",
    SC + """SELECT pattern_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, avg(CASE WHEN (score >= 0.3) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(score) AS mean_score
      FROM scored WHERE id % 3 = 0 GROUP BY pattern_id""",
)
def _(spark, sf):
    scored = view(spark, sf, "scored").withColumn("split", F.expr("IF(id % 3 = 0, 'test', 'train')"))
    return model.split_evaluation(scored, "id")["by_pattern"]
