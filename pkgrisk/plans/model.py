"""Feature matrix, boosted-tree classifier with stratified folds, batch scoring, evaluation report."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgrisk.operators import features, metrics, splits
from pkgrisk.operators.ordering import kth_values
from pkgrisk.session import shared_folder, stored

#: rows of a part of the training data, about
PART_ROWS = 500_000
#: rows up to which a table is dealt out to parts with its folds; a shuffle of more would take much of the disk
DEALT_ROWS = 1_000_000


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    numeric = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, numeric) and f.name not in exclude]


def median_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``name, value``: exact median per column (mean of the middle two), 0 where nothing is known.

    All columns go through one pass: (column, value) pairs reduced to counts per value.
    """
    pairs = ", ".join(f"struct('{c}' AS name, cast({c} AS double) AS v)" for c in columns)
    long = df.selectExpr(f"inline(array({pairs}))").filter("v IS NOT NULL AND NOT isnan(v)")
    mid = kth_values(long, "v", {"lo": "floor((n + 1) / 2)", "hi": "floor(n / 2) + 1"}, ["name"])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    return names.join(mid, "name", "left").selectExpr("name", "coalesce((lo + hi) / 2, 0D) AS value")


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """``median_rows`` as a mapping: one number for each feature column."""
    found = {r["name"]: r["value"] for r in median_rows(df, columns).collect()}
    return {c: found[c] for c in columns}


def feature_matrix(df: DataFrame, columns: Sequence[str], fill: dict[str, float]) -> DataFrame:
    """Booleans as numbers, missing values as the given fill, one ``features`` vector."""
    clean = df.withColumns({
        f"_f_{c}": F.expr(f"IF({c} IS NULL OR isnan(cast({c} AS double)), {fill[c]!r}D, cast({c} AS double))") for c in columns
    })
    inputs = [f"_f_{c}" for c in columns]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(clean).drop(*inputs)


def train(matrix: DataFrame, label: str = "label", seed: int = 42, rounds: int = 20, depth: int = 5) -> GBTClassificationModel:
    gbt = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, minInstancesPerNode=20,
    )
    # The input is read several times, and its parts are cached one by one.
    rows = matrix.withColumn(label, F.col(label).cast("double"))
    parts = -(-rows.count() // PART_ROWS)
    return gbt.fit(rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows)


def predict(model: GBTClassificationModel, matrix: DataFrame, out: str = "score") -> DataFrame:
    scored = model.transform(matrix)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def write_parts(df: DataFrame, path: str) -> DataFrame:
    """Write files of at most ``PART_ROWS`` rows and read them as one part each, without a shuffle.

    The read has a session of its own: files are not packed together where opening one counts as a whole part.
    """
    df.write.option("maxRecordsPerFile", PART_ROWS).parquet(path)
    own = df.sparkSession.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", own.conf.get("spark.sql.files.maxPartitionBytes"))
    return own.read.parquet(path)


def cross_validate(
    matrix: DataFrame, key: str, label: str = "label", k: int = 5, seed: int = 42, threshold: float = 0.5, **kwargs
) -> DataFrame:
    """One row of metrics per fold; folds are scored together, so metrics take one pass over all of them."""
    spark = matrix.sparkSession
    path = shared_folder(spark, "folds")
    if matrix.count() > DEALT_ROWS:
        training = write_parts(splits.kfold(matrix, label, key, k, seed, settled=True).select(label, "features", "fold"), path)
    else:
        splits.kfold(matrix, label, key, k, seed).write.parquet(path)
        training = spark.read.parquet(path)
    folded = spark.read.parquet(path)
    parts = []
    for i in range(k):
        model = train(training.filter(F.col("fold") != i), label, seed, **kwargs)
        parts.append(predict(model, folded.filter(F.col("fold") == i)).select("fold", label, "score"))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    path = shared_folder(spark, "fold-scores")  # the models run once, the metrics read their scores
    scored.write.parquet(path)
    scored = spark.read.parquet(path)
    f1 = scored.groupBy("fold").agg(
        F.expr("count(*) AS n_val"), F.expr(f"count_if({label} = 1) AS n_pos"),
        F.expr(f"count_if({label} = 1 AND score >= {threshold}D) AS tp"), F.expr(f"count_if({label} = 0 AND score >= {threshold}D) AS fp"),
        F.expr(f"count_if({label} = 1 AND score < {threshold}D) AS fn"),
    ).selectExpr("fold", "n_val", "n_pos", "IF(2 * tp + fp + fn = 0, 0D, 2 * tp / (2 * tp + fp + fn)) AS f1")
    roc = metrics.auroc(scored, "score", label, ["fold"]).select("fold", "auroc")
    ap = metrics.average_precision(scored, "score", label, ["fold"]).withColumnRenamed("average_precision", "pr_auc")
    return f1.join(roc, "fold").join(ap, "fold")


@dataclass(frozen=True)
class Fitted:
    """A trained model with all that scoring needs: columns, fill values and how it was trained."""

    model: GBTClassificationModel
    columns: list[str]
    fill: dict[str, float]
    about: dict

    def save(self, path: str) -> None:
        """Model and metadata below ``path``, a folder that all machines share."""
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        meta = json.dumps({"columns": self.columns, "fill": self.fill, "about": self.about})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def fit(df: DataFrame, columns: Sequence[str], key: str, label: str = "label", k: int = 5, seed: int = 42, **kwargs) -> Fitted:
    """Cross-validate, then train on all rows; the fold metrics and their means go into the metadata."""
    columns = list(columns)
    df = stored(df.select(key, label, *(c for c in columns if c not in (key, label))), "features")
    fill = medians(df, columns)
    matrix = feature_matrix(df, columns, fill).select(key, label, "features")
    folds = [r.asDict() for r in cross_validate(matrix, key, label, k, seed, **kwargs).orderBy("fold").collect()] if k else []  # one row each
    total = matrix.agg(F.expr("count(*) AS n"), F.expr(f"count_if({label} = 1) AS p")).first()
    if not 0 < total["p"] < total["n"]:
        raise ValueError("training needs both classes")
    means = {m: sum(f[m] for f in folds) / len(folds) for m in ("f1", "auroc", "pr_auc")} if folds else {}
    about = {"n_train_rows": total["n"], "positive_rate": total["p"] / total["n"], "seed": seed, "fold_metrics": folds, "cv_summary": means}
    return Fitted(train(matrix, label, seed, **kwargs), columns, fill, about)


def load(spark: SparkSession, path: str) -> Fitted:
    meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
    return Fitted(GBTClassificationModel.load(f"{path}/model"), meta["columns"], meta["fill"], meta["about"])


def batch_score(
    packages: DataFrame, model: Fitted | GBTClassificationModel | None = None, columns: Sequence[str] = (), fill: dict[str, float] | None = None
) -> DataFrame:
    """Score packages with the model when given, else heuristically; same feature code as training.

    A bare model needs its columns and fill values: other values than those of the training would change scores.
    """
    if isinstance(model, Fitted):
        model, columns, fill = model.model, model.columns, model.fill
    feats = features.extract_features(packages)
    if model is None:
        scored = features.heuristic_score(feats).withColumn("model", F.lit("heuristic"))
    else:
        if fill is None or set(columns) - set(fill):
            raise ValueError("a model is scored with the fill values that it was trained with")
        scored = features.model_evidence(predict(model, feature_matrix(feats, columns, fill))).withColumn("model", F.lit("gbt"))
    return features.threshold_decide(scored).select("package_name", "version", "score", "decision", "score_evidence", "model")


def evaluation_report(scored: DataFrame, order: str, threshold: float = 0.3) -> DataFrame:
    """One row: threshold metrics, AUROC, average precision, conformal threshold."""
    conformal = metrics.conformal_threshold(scored, order).withColumnRenamed("threshold", "conformal_threshold")
    return metrics.score_report(scored, threshold).join(F.broadcast(conformal))  # one row each


def split_evaluation(
    scored: DataFrame, order: str, split: str = "test", pattern: str = "pattern_id", threshold: float = 0.3, bins: int = 10
) -> dict[str, DataFrame]:
    """The evaluation of one split: ``overall`` with the conformal threshold, ``by_pattern`` and ``calibration``."""
    rows = scored.filter(F.col("split") == split)
    return {
        "overall": evaluation_report(rows, order, threshold),
        "by_pattern": metrics.group_breakdown(rows, pattern, threshold),
        "calibration": metrics.calibration(rows, bins),
    }
