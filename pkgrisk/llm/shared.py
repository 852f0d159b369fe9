"""Small helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.session import stored as stored  # the operators take it from here


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_number_ids(df: DataFrame, id_col: str) -> None:
    """Refuse ids of another type: the smallest id of a group has a meaning here."""
    kind = df.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} has to be a whole number, not {kind}")
