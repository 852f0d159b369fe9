"""Runs that can be repeated: tables are staged, and one small commit makes all of them visible at once.

A run writes its tables to new folders below ``_runs`` and then one commit row that names them. Readers take the folders
of committed runs only, so what a killed attempt left behind is never read. A run id that is committed already is not
written again, and of two attempts that commit the same id the later one replaces the earlier.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_SCHEMA = "run string, name string, folder string, schema string"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """run, name, folder, schema of all committed tables."""
    try:
        return spark.read.schema(COMMIT_SCHEMA).json(f"{path.rstrip('/')}/_commits/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT_SCHEMA)


def write_run(tables: dict[str, DataFrame], path: str, run: str) -> bool:
    """Write all ``tables`` as run ``run``, or nothing; False when that run is committed already.

    A job that fails or is killed part way leaves no visible row and can simply be repeated.
    """
    spark = next(iter(tables.values())).sparkSession
    root, folder = path.rstrip("/"), hashlib.sha256(run.encode()).hexdigest()[:32]
    if not committed(spark, path).where(F.col("run") == run).isEmpty():
        return False
    attempt = f"{root}/_runs/{folder}-{uuid.uuid4().hex}"
    rows = []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{attempt}/{name}")
        rows.append((run, name, f"{attempt[len(root) + 1:]}/{name}", df.schema.json()))
    commit = spark.createDataFrame(rows, COMMIT_SCHEMA).coalesce(1)  # one file, so it appears whole
    commit.write.mode("overwrite").json(f"{root}/_commits/{folder}")
    return True


def read_runs(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All rows of a table from committed runs, with the runs' schemas merged."""
    root = path.rstrip("/")
    rows = committed(spark, path).where(F.col("name") == name).orderBy("folder").collect()  # one row for each run
    if not rows:
        raise FileNotFoundError(f"no committed run of {name} below {path}")
    several = len({r["schema"] for r in rows}) > 1
    return spark.read.option("mergeSchema", several).parquet(*[f"{root}/{r['folder']}" for r in rows])
