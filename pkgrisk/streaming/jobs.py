"""Streams over inventory feeds, audit logs and state events.

Outputs go to one folder per micro-batch, overwritten when a batch is retried, so a lost
executor or a restart never doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pkgrisk.operators import gate
from pkgrisk.streaming import keyed as keyed_state

SCAN_SCHEMA = (
    "record_type string, ecosystem string, normalized_name string, package_name string, version string, "
    "source_file string, confidence string"
)


def read_scan_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def gate_stream(
    scan: DataFrame, decisions: Callable[[], DataFrame], out: str, checkpoint: str, ecosystem: str = "npm"
) -> StreamingQuery:
    """Gate a feed; ``decisions`` is called for every micro-batch, so new policy state is seen at once."""

    def write(batch: DataFrame, epoch: int) -> None:
        gated = gate.gate_inventory(gate.inventory_rows(batch, ecosystem), decisions())
        gated.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return scan.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_counters(audit: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Decisions per time window; windows close once the watermark passes them."""
    typed = audit.selectExpr("cast(ts AS timestamp) AS ts", "decision")
    if typed.isStreaming:
        typed = typed.withWatermark("ts", lateness)
    counted = typed.groupBy(F.window("ts", width), "decision").count()
    return counted.selectExpr("window.start AS window_start", "decision", "count AS n")


def counters_stream(audit: DataFrame, out: str, checkpoint: str, width: str = "1 hour", lateness: str = "10 minutes") -> StreamingQuery:
    """Counts per window, open windows included: every micro-batch writes the windows that it changed.

    Read with ``latest_counters``. The watermark bounds the state; rows later than that are not counted.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return (
        decision_counters(audit, width, lateness).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_counters(spark: SparkSession, out: str) -> DataFrame:
    """The newest count of every window and decision."""
    batches = spark.read.schema("window_start timestamp, decision string, n bigint, batch bigint").parquet(out)
    return batches.groupBy("window_start", "decision").agg(F.expr("max_by(n, batch) AS n"))


# Times as whole numbers, which the state store keeps as they are.
PLAIN = {"timestamp": "unix_micros({})", "timestamp_ntz": "unix_micros(cast({} AS timestamp))", "date": "unix_date({})"}


def first_seen_stream(
    spark: SparkSession, audit: DataFrame, out: str, checkpoint: str, order: str = "ts, event_id"
) -> StreamingQuery:
    """Each package version's earliest row, whatever the order of arrival: later ones are served from the stored verdict.

    The order of a key's earliest row so far is kept as state. A micro-batch writes the rows that are the first of their
    key, or earlier than it; read them with ``first_seen``. Nothing that earlier batches wrote is listed or read. Rows
    are reduced to one for each key and task before they meet the state, so a package asked for very often is not
    crowded into one task.
    """
    fields = audit.selectExpr(f"struct({order}) AS o").schema["o"].dataType.fields
    keyed = audit.withColumn("_o", F.expr(f"struct({order})")).select("*", *[
        F.expr(PLAIN.get(f.dataType.typeName(), "{}").format(f"_o.`{f.name}`")).alias(f"_order_{i}") for i, f in enumerate(fields)
    ]).drop("_o")
    order_schema = keyed.select(*[f"_order_{i}" for i in range(len(fields))]).schema

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple, tuple] = {}
            keys = zip(batch.column("package").to_pylist(), batch.column("version").to_pylist())
            places = zip(*(batch.column(c).to_pylist() for c in order_schema.names))
            for i, (key, own) in enumerate(zip(keys, places)):
                at = keyed_state.place(own)
                if key not in best or at < best[key][0]:
                    best[key] = at, i
            yield batch.take(pa.array(sorted(i for _, i in best.values()), pa.int64()))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    firsts = keyed.mapInArrow(reduce, keyed.schema).groupBy("package", "version").transformWithState(
        keyed_state.Earliest(order_schema, audit.columns), audit.schema, "Update", "None"
    )
    with keyed_state.state_store(spark):
        return (
            firsts.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def first_seen(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each key that ``first_seen_stream`` has written, which is the earliest one seen."""
    rows = spark.read.parquet(f"{out}/batch=*")
    columns = [c for c in rows.columns if c not in ("package", "version", "epoch")]
    newest = rows.groupBy("package", "version").agg(F.expr(f"max_by(struct({', '.join(columns)}), epoch) AS _r"))
    return newest.select("package", "version", "_r.*")


def state_stream(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Fold state events as they arrive, in any order within ``lateness``.

    A key's state is the fold of its settled events and those events that are at most ``lateness`` older than its newest
    one; nothing else of its history is kept or read, and other keys are not touched. An event within the bound has the
    effect that it has in the batch operator. An older one is kept, without effect, as ``late_events``. A micro-batch
    writes the state of its own keys; one that is left without a state gets a row without one.
    """
    width = spark.sql(f"SELECT cast(interval {lateness} AS interval day to second) AS i").selectExpr(
        "cast(extract(DAY FROM i) * 86400000000L + extract(HOUR FROM i) * 3600000000L + extract(MINUTE FROM i) * 60000000L + extract(SECOND FROM i) * 1000000 AS bigint) AS w"
    ).first()["w"]
    typed = events.selectExpr(
        "key", "unix_micros(cast(ts AS timestamp)) AS ts", "cast(seq AS bigint) AS seq", "action", "state", "rationale"
    )

    def write(batch: DataFrame, epoch: int) -> None:
        kinds = batch.withColumn("kind", F.expr("IF(problem IS NULL, 'state', 'late')"))
        kinds.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/version={epoch}")

    folded = typed.groupBy("key").transformWithState(keyed_state.StateFold(width), keyed_state.CHANGE_SCHEMA, "Update", "None")
    with keyed_state.state_store(spark):
        return (
            folded.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def _changes(spark: SparkSession, out: str, kind: str) -> DataFrame:
    schema = f"{keyed_state.CHANGE_SCHEMA}, version bigint, kind string"
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/version=*").filter(F.col("kind") == kind)


def latest_state(spark: SparkSession, out: str) -> DataFrame:
    """Every key's rows of the newest version that touched it."""
    changes = _changes(spark, out, "state").selectExpr("key", "state", "reason", "timestamp_micros(added) AS added", "version")
    newest = changes.groupBy("key").agg(F.max("version").alias("version"))
    return changes.join(newest, ["key", "version"], "left_semi").filter("state IS NOT NULL").drop("version")


def late_events(spark: SparkSession, out: str) -> DataFrame:
    """Events that came too late to have an effect."""
    return _changes(spark, out, "late").selectExpr("key", "timestamp_micros(ts) AS ts", "seq", "action", "rationale")
