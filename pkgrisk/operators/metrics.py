"""Exact evaluation metrics. Scores are first reduced to counts per distinct value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.operators.ordering import kth_values, value_prefix


def _ratio(num: str, den: str) -> str:
    return f"IF({den} = 0, 0D, {num} / {den})"


def binary_metrics(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Accuracy, precision, recall, F1, confusion counts and label counts in one aggregate; n may be 0."""
    hit = f"{score} >= {threshold!r}D"
    counts = df.agg(
        F.expr("count(*) AS n"),
        F.expr(f"count_if({label} = 1 AND {hit}) AS tp"), F.expr(f"count_if({label} = 0 AND {hit}) AS fp"),
        F.expr(f"count_if({label} = 1 AND NOT {hit}) AS fn"), F.expr(f"count_if({label} = 0 AND NOT {hit}) AS tn"),
    )
    return counts.selectExpr(
        "*", f"{_ratio('(tp + tn)', 'n')} AS accuracy", f"{_ratio('tp', '(tp + fp)')} AS precision",
        f"{_ratio('tp', '(tp + fn)')} AS recall", f"{_ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1",
        "tp + fn AS n_pos", "fp + tn AS n_neg",
    )


def _by_score(df: DataFrame, score: str, label: str, group: Sequence[str]) -> DataFrame:
    counts = df.selectExpr(*group, f"cast({score} AS double) AS s", f"cast({label} = 1 AS bigint) AS pos", f"cast({label} = 0 AS bigint) AS neg")
    return value_prefix(counts, "s", ["pos", "neg"], group)


def auroc(df: DataFrame, score: str = "score", label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUROC with ties averaged; NULL when only one class is present."""
    p = _by_score(df, score, label, group)
    agg = p.groupBy(*group).agg(
        F.expr("sum(pos * (before_neg + neg / 2D)) AS u"), F.expr("max(total_pos) AS n_pos"), F.expr("max(total_neg) AS n_neg")
    )
    return agg.selectExpr(*group, "n_pos", "n_neg", "IF(n_pos > 0 AND n_neg > 0, u / (cast(n_pos AS double) * n_neg), NULL) AS auroc")


def score_report(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Threshold metrics, AUROC and average precision from one pass over the rows."""
    p = _by_score(df, score, label, ())
    hit, seen = f"s >= {threshold!r}D", "(total_pos - before_pos + total_neg - before_neg)"
    sums = p.agg(
        F.expr("coalesce(sum(pos + neg), 0) AS n"),
        *[F.expr(f"coalesce(sum(IF({cond}, {side}, 0)), 0) AS {name}") for name, side, cond in (
            ("tp", "pos", hit), ("fp", "neg", hit), ("fn", "pos", f"NOT {hit}"), ("tn", "neg", f"NOT {hit}"))],
        F.expr("sum(pos * (before_neg + neg / 2D)) AS u"),
        F.expr(f"sum(pos * ((total_pos - before_pos) / cast({seen} AS double))) AS area"),
    )
    both = "tp + fn > 0 AND fp + tn > 0"
    return sums.selectExpr(
        "n", "tp", "fp", "fn", "tn", f"{_ratio('(tp + tn)', 'n')} AS accuracy", f"{_ratio('tp', '(tp + fp)')} AS precision",
        f"{_ratio('tp', '(tp + fn)')} AS recall", f"{_ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1",
        f"IF({both}, u / (cast(tp + fn AS double) * (fp + tn)), NULL) AS auroc", f"IF({both}, area / (tp + fn), NULL) AS average_precision",
    )


def auroc_ordered(df: DataFrame, order: str, score: str = "score", label: str = "label") -> DataFrame:
    """AUROC with tied scores ranked by ``order`` instead of averaged; 0.5 when one class is missing.

    Negatives below each positive = negatives of lower scores, plus those of the same score
    that come earlier. Both parts are summed on their own, so nothing is joined on a score.
    """
    lower = _by_score(df, score, label, ()).agg(
        F.expr("sum(pos * before_neg) AS below"), F.expr("max(total_pos) AS n_pos"), F.expr("max(total_neg) AS n_neg")
    )
    tied = df.selectExpr(
        f"cast({score} AS double) AS s", f"cast({order} AS bigint) AS o", f"cast({label} = 1 AS bigint) AS pos", f"cast({label} = 0 AS bigint) AS neg"
    )
    earlier = value_prefix(tied, "o", ["pos", "neg"], ["s"]).agg(F.expr("sum(pos * before_neg) AS earlier"))
    return lower.join(F.broadcast(earlier)).selectExpr(  # one row each
        "IF(n_pos > 0 AND n_neg > 0, (below + earlier) / (cast(n_pos AS double) * n_neg), 0.5D) AS auroc"
    )


def average_precision(df: DataFrame, score: str = "score", label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision: precision at each threshold weighted by the recall it adds."""
    p = _by_score(df, score, label, group)
    tp, seen = "(total_pos - before_pos)", "(total_pos - before_pos + total_neg - before_neg)"
    agg = p.groupBy(*group).agg(
        F.expr(f"sum(pos * ({tp} / cast({seen} AS double))) AS area"), F.expr("max(total_pos) AS n_pos"), F.expr("max(total_neg) AS n_neg")
    )
    return agg.selectExpr(*group, "IF(n_pos > 0 AND n_neg > 0, area / n_pos, NULL) AS average_precision")


def curve_points(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC and PR points, one per distinct threshold (predict positive at or above it)."""
    p = _by_score(df, score, label, ())
    return p.selectExpr(
        "s AS threshold", "total_pos - before_pos AS tp", "total_neg - before_neg AS fp",
        "(total_neg - before_neg) / cast(total_neg AS double) AS fpr",
        "(total_pos - before_pos) / cast(total_pos AS double) AS recall",
        "(total_pos - before_pos) / cast(total_pos - before_pos + total_neg - before_neg AS double) AS precision",
    )


def calibration(df: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """Quantile bins (interpolated edges): rows, mean score and positive rate; empty bins are absent."""
    ranks = {}
    for i in range(1, bins):
        at = f"((n - 1) * {i / bins!r}D)"
        ranks[f"lo{i}"] = f"floor({at}) + 1"
        ranks[f"hi{i}"] = f"least(n, floor({at}) + 2)"
    at_ranks = kth_values(df.selectExpr(f"cast({score} AS double) AS s"), "s", ranks)
    edge = [f"lo{i} + (hi{i} - lo{i}) * ((n - 1) * {i / bins!r}D - floor((n - 1) * {i / bins!r}D))" for i in range(1, bins)]
    edges = at_ranks.selectExpr(f"array({', '.join(edge)}) AS edges")
    binned = df.selectExpr(f"cast({score} AS double) AS s", f"cast({label} AS double) AS y").join(F.broadcast(edges))  # one row
    return binned.selectExpr("size(filter(edges, e -> e < s)) AS bin", "s", "y").groupBy("bin").agg(
        F.expr("count(*) AS n"), F.expr("avg(s) AS mean_score"), F.expr("avg(y) AS positive_rate")
    )


def conformal_threshold(df: DataFrame, order: str, alpha: float = 0.1, score: str = "score", label: str = "label") -> DataFrame:
    """Score threshold covering 1−alpha of the positives in the first half of the rows by ``order``.

    One row; ``threshold`` is NULL when the calibration half holds no positive.
    """
    half = kth_values(df.selectExpr(f"cast({order} AS bigint) AS o"), "o", {"cut": "greatest(1, floor(n / 2))"}).select("cut")
    held = df.join(F.broadcast(half)).filter(f"{order} <= cut AND {label} = 1")  # one row
    misfit = held.selectExpr(f"1 - cast({score} AS double) AS s")
    q = kth_values(misfit, "s", {"q": f"ceil((n - 1) * {1 - alpha!r}D) + 1"})
    return q.selectExpr("coalesce(n, 0) AS n_calibration", "1 - q AS threshold")


def group_breakdown(df: DataFrame, key: str, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Rows, positives, accuracy and mean score per key; rows without a key are left out."""
    return df.filter(f"coalesce({key}, '') <> ''").groupBy(key).agg(
        F.expr("count(*) AS n"), F.expr(f"sum({label}) AS n_pos"),
        F.expr(f"avg(IF(cast({score} >= {threshold!r}D AS int) = {label}, 1D, 0D)) AS accuracy"),
        F.expr(f"avg({score}) AS mean_score"),
    )


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of fold metrics; folds without a value are skipped."""
    def clean(c: str) -> str:
        return f"IF(isnan({c}), NULL, {c})"

    return folds.agg(
        F.expr(f"avg({clean('auroc')}) AS mean_auroc"), F.expr(f"stddev_pop({clean('auroc')}) AS std_auroc"),
        F.expr(f"avg({clean('pr_auc')}) AS mean_pr_auc"), F.expr(f"stddev_pop({clean('pr_auc')}) AS std_pr_auc"),
        F.expr("avg(f1) AS mean_f1"),
    )


def eval_matrix(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Per arm: accuracy, recall on unpatched releases, false alarms on patched ones, mean costs.

    ``results(arm, package, version, predicted, tool_calls, latency, cost)``;
    ``truth(package, ground_truth: map<version, 0|1>)``.
    """
    rows = truth.selectExpr("package", "explode(ground_truth) AS (version, actual)")
    joined = results.join(rows, ["package", "version"])
    return joined.groupBy("arm").agg(
        F.expr("count(*) AS n"),
        F.expr("avg(IF(predicted = actual, 1D, 0D)) AS verdict_accuracy"),
        F.expr("avg(IF(actual = 1, cast(predicted AS double), NULL)) AS malicious_recall"),
        F.expr("avg(IF(actual = 0, cast(predicted AS double), NULL)) AS patched_false_positive_rate"),
        F.expr("avg(tool_calls) AS average_tool_calls"), F.expr("avg(latency) AS average_latency_seconds"),
        F.expr("avg(cost) AS average_token_cost"),
    )
