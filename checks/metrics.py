"""Evaluation metrics on the scored rows."""

from __future__ import annotations

from checks.registry import query
from checks.views import view, with_views
from pkgrisk.operators import metrics

SC = with_views("scored")


@query(
    "binary_metrics",
    SC
    + """, c AS (SELECT count(*) AS n, count(*) FILTER (label = 1 AND score >= 0.3) AS tp, count(*) FILTER (label = 0 AND score >= 0.3) AS fp,
      count(*) FILTER (label = 1 AND score < 0.3) AS fn, count(*) FILTER (label = 0 AND score < 0.3) AS tn FROM scored)
      SELECT n, tp, fp, fn, tn, (tp + tn) / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
      tp + fn AS n_pos, fp + tn AS n_neg FROM c""",
)
def _(spark, sf):
    return metrics.binary_metrics(view(spark, sf, "scored"), 0.3)


@query(
    "auroc",
    SC
    + """SELECT sum(label) AS n_pos, count(*) - sum(label) AS n_neg, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2)
      / (sum(label) * (count(*) - sum(label))) AS auroc FROM (
      SELECT label, avg(rn) OVER (PARTITION BY score) AS r FROM (SELECT label, score, row_number() OVER (ORDER BY score) AS rn FROM scored))""",
)
def _(spark, sf):
    return metrics.auroc(view(spark, sf, "scored"))


@query(
    "auroc_by_stratum",
    SC
    + """SELECT stratum, CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2)
      / (sum(label) * (count(*) - sum(label))) END AS auroc FROM (
      SELECT stratum, label, avg(rn) OVER (PARTITION BY stratum, score) AS r FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY score) AS rn FROM scored)) GROUP BY stratum""",
)
def _(spark, sf):
    return metrics.auroc(view(spark, sf, "scored"), group=["stratum"]).select("stratum", "auroc")


@query(
    "auroc_ordered",
    SC
    + """SELECT (sum(CASE WHEN label = 1 THEN rn END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auroc
      FROM (SELECT label, row_number() OVER (ORDER BY score, id) AS rn FROM scored)""",
)
def _(spark, sf):
    return metrics.auroc_ordered(view(spark, sf, "scored"), "id")


CUM = SC + """, g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY score),
c AS (SELECT score, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC))
"""


@query("average_precision", CUM + "SELECT sum(pos / p * (tp / (tp + fp))) AS average_precision FROM c")
def _(spark, sf):
    return metrics.average_precision(view(spark, sf, "scored"))


@query(
    "curve_points",
    CUM + "SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, fp / n AS fpr, tp / p AS recall, tp / (tp + fp) AS precision FROM c",
)
def _(spark, sf):
    return metrics.curve_points(view(spark, sf, "scored"))


@query(
    "calibration",
    SC
    + ", e AS (SELECT " + ", ".join(f"quantile_cont(score, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM scored) "
    + "SELECT CAST(" + " + ".join(f"(score > e{i})::INT" for i in range(1, 10)) + " AS BIGINT) AS bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS positive_rate FROM scored, e GROUP BY 1",
)
def _(spark, sf):
    return metrics.calibration(view(spark, sf, "scored")).selectExpr("cast(bin AS bigint) AS bin", "n", "mean_score", "positive_rate")


@query(
    "conformal_threshold",
    SC
    + """, half AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS n FROM scored) WHERE rn <= greatest(1, n // 2) AND label = 1),
      r AS (SELECT 1 - score AS s, row_number() OVER (ORDER BY 1 - score) AS rn, count(*) OVER () AS n FROM half)
      SELECT max(n) AS n_calibration, 1 - max(CASE WHEN rn = CAST(ceil((n - 1) * 0.9::DOUBLE) AS BIGINT) + 1 THEN s END) AS threshold FROM r""",
)
def _(spark, sf):
    return metrics.conformal_threshold(view(spark, sf, "scored"), "id")


@query(
    "group_breakdown",
    SC
    + """SELECT pattern_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy,
      avg(score) AS mean_score FROM scored GROUP BY pattern_id""",
)
def _(spark, sf):
    return metrics.group_breakdown(view(spark, sf, "scored"), "pattern_id", 0.5)


@query(
    "fold_summary",
    SC
    + """, f AS (SELECT pattern_id, CASE WHEN sum(label) > 40 THEN NULL ELSE avg(score) END AS auroc, avg(label) AS pr_auc, max(score) AS f1 FROM scored GROUP BY pattern_id)
      SELECT avg(auroc) AS mean_auroc, stddev_pop(auroc) AS std_auroc, avg(pr_auc) AS mean_pr_auc, stddev_pop(pr_auc) AS std_pr_auc, avg(f1) AS mean_f1 FROM f""",
)
def _(spark, sf):
    from pyspark.sql import functions as F

    folds = view(spark, sf, "scored").groupBy("pattern_id").agg(
        F.expr("IF(sum(label) > 40, double('NaN'), avg(score)) AS auroc"), F.expr("avg(label) AS pr_auc"), F.expr("max(score) AS f1")
    )
    return metrics.fold_summary(folds)


@query(
    "eval_matrix",
    """WITH t AS (SELECT concat('p', doc_id) AS package, v, CASE WHEN v = '1.0' THEN 1 ELSE 0 END AS actual FROM documents, (VALUES ('1.0'), ('1.1')) x(v)),
      r AS (SELECT concat('p', doc_id) AS package, v, arm, (doc_id * arm + length(v)) % 3 % 2 AS predicted, doc_id % 7 AS tool_calls, doc_id % 11 * 0.5 AS latency, n_chars AS cost
        FROM documents, (VALUES ('1.0'), ('1.1'), ('9.9')) x(v), (VALUES (1), (2), (3), (4)) a(arm))
      SELECT arm, count(*) AS n, avg((predicted = actual)::INT) AS verdict_accuracy, avg(CASE WHEN actual = 1 THEN predicted END) AS malicious_recall,
        avg(CASE WHEN actual = 0 THEN predicted END) AS patched_false_positive_rate, avg(tool_calls) AS average_tool_calls,
        avg(latency) AS average_latency_seconds, avg(cost) AS average_token_cost FROM r JOIN t USING (package, v) GROUP BY arm""",
)
def _(spark, sf):
    from checks.views import table

    docs = table(spark, sf, "documents")
    truth = docs.selectExpr("concat('p', doc_id) AS package", "map('1.0', 1, '1.1', 0) AS ground_truth")
    results = docs.selectExpr("*", "explode(array('1.0', '1.1', '9.9')) AS version").selectExpr("*", "explode(array(1, 2, 3, 4)) AS arm").selectExpr(
        "arm", "concat('p', doc_id) AS package", "version", "cast((doc_id * arm + length(version)) % 3 % 2 AS int) AS predicted",
        "doc_id % 7 AS tool_calls", "doc_id % 11 * 0.5D AS latency", "n_chars AS cost",
    )
    return metrics.eval_matrix(results, truth)
