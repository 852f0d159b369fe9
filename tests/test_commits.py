"""Runs that fail part way and are repeated."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pkgrisk.sources import commits, sinks


def test_a_failed_run_leaves_nothing_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "out")
    a, b = spark.range(10), spark.range(5).selectExpr("id", "'x' AS t")
    assert commits.committed(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        commits.read_runs(spark, path, "a")
    broken = b.withColumn("t", F.expr("IF(id < 4, t, raise_error('lost'))"))
    for _ in range(2):
        with pytest.raises(PySparkException, match="lost"):
            commits.write_run({"a": a, "b": broken}, path, "run/1 é")
    assert commits.committed(spark, path).count() == 0  # the first table was written, but never committed
    assert commits.write_run({"a": a, "b": b}, path, "run/1 é")
    assert not commits.write_run({"a": a, "b": b}, path, "run/1 é")
    assert commits.read_runs(spark, path, "a").count() == 10 and commits.read_runs(spark, path, "b").count() == 5
    assert commits.write_run({"a": spark.range(10, 13)}, path, "run 2")
    assert sorted(r.id for r in commits.read_runs(spark, path, "a").collect()) == list(range(13))
    assert commits.read_runs(spark, path, "b").count() == 5


def test_two_attempts_of_one_run_count_once(spark, tmp_path, monkeypatch):
    """Both start before either has committed."""
    path = str(tmp_path / "out")
    with monkeypatch.context() as m:
        m.setattr(commits, "committed", lambda s, p: s.createDataFrame([], commits.COMMIT_SCHEMA))
        commits.write_run({"a": spark.range(3)}, path, "r")
        commits.write_run({"a": spark.range(3)}, path, "r")
    assert commits.read_runs(spark, path, "a").count() == 3


def test_runs_of_different_schemas(spark, tmp_path):
    path = str(tmp_path / "out")
    commits.write_run({"t": spark.range(4).selectExpr("id", "id % 2 AS k")}, path, "1")
    commits.write_run({"t": spark.range(4, 6).selectExpr("id", "id % 2 AS k", "'n' AS extra")}, path, "2")
    rows = commits.read_runs(spark, path, "t").orderBy("id").collect()
    assert [(r.id, r.k, r.extra) for r in rows] == [(0, 0, None), (1, 1, None), (2, 0, None), (3, 1, None), (4, 0, "n"), (5, 1, "n")]


def test_audit_of_a_stream(spark, tmp_path):
    """The batch number is the run, so a batch that is tried again adds nothing."""
    path = str(tmp_path / "audit")
    for epoch in (0, 1, 1, 2, 0):
        sinks.append_audit(spark.range(epoch * 10, epoch * 10 + 10), path, f"batch {epoch}")
    assert sinks.read_audit(spark, path).count() == 30


def test_a_broken_feature_table_is_not_taken_for_a_missing_one(spark, tmp_path):
    from pkgrisk.sources import corpora

    (tmp_path / "f.parquet").mkdir()
    with pytest.raises(PySparkException):
        corpora.read_features(spark, str(tmp_path / "f.parquet")).count()
    (tmp_path / "g.jsonl").write_text('{"a": 1}\n')
    assert corpora.read_features(spark, str(tmp_path / "g.parquet")).first().a == 1
