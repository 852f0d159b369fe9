"""Table sinks: features, splits, version pairs, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pkgrisk.operators.stats import corpus_stats
from pkgrisk.sources import commits


def write_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    features.write.mode(mode).parquet(path)


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Dataset partitioned by split; returns counts per split, label and source of what was written."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    return corpus_stats(df.sparkSession.read.parquet(path))


def write_pairs(pairs: DataFrame, changes: DataFrame, path: str, run: str = "pairs") -> bool:
    """Pairs (skipped ones included, so a re-run leaves them alone) and their file changes, visible together or not at all.

    Read them with ``corpora.read_pairs`` and ``commits.read_runs``. A run that is committed is not written again.
    """
    return commits.write_run({"pairs": pairs, "changes": changes}, path, run)


def append_audit(decisions: DataFrame, path: str, run: str) -> bool:
    """Append the decisions of one run; repeating the run adds nothing. Read all runs with ``read_audit``."""
    return commits.write_run({"audit": decisions}, path, run)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return commits.read_runs(spark, path, "audit")
