"""Shards of nearly equal bytes that never separate equal texts.

Texts are ordered by a 64-bit hash, so equal texts stand together. The hash range is cut into ``units`` equal
stretches; a unit holds whole groups of equal texts and is never divided. One aggregation gives the units' sizes (a
bounded vector), the smallest feasible shard capacity is found by binary search with a greedy check, and the cuts
become comparisons with the hash: no row is shuffled to find its shard.

A unit larger than an even share (one text repeated very often) gets a shard of its own first; the others are divided
over the shards that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgrisk.llm.shared import fresh

UNIT_BITS = 16
#: rows numbered by one task at a time
SLOT_ROWS = 20_000


def greedy_ends(prefix: np.ndarray, start: int, capacity: int, shards: int) -> list[int]:
    """Ends of up to ``shards`` shards, each filled as far as ``capacity`` allows."""
    ends, at = [], start
    while at < len(prefix) - 1 and len(ends) < shards:
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        ends.append(at)
    return ends


def feasible(prefix: np.ndarray, start: int, capacity: int, shards: int) -> bool:
    last = len(prefix) - 1
    return start >= last or (shards > 0 and greedy_ends(prefix, start, capacity, shards)[-1] >= last)


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which ``sizes``, in order, fit into ``shards`` contiguous shards."""
    if len(sizes) == 0:
        return 0
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low = max(int(sizes.max()), -(-int(prefix[-1]) // shards))
    high = int(prefix[-1])
    while low < high:
        middle = (low + high) // 2
        if feasible(prefix, 0, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def contiguous_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """Ends of ``shards`` contiguous shards, none above the smallest capacity.

    Within that capacity each cut is the one nearest to an even share of what is left, as long as the rest still fits.
    """
    capacity = smallest_capacity(sizes, shards)
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    last, at, ends = len(sizes), 0, []
    for left in range(shards, 0, -1):
        if left == 1 or at >= last:
            ends.append(last)
            at = last
            continue
        furthest = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        furthest = max(at + 1, min(furthest, last - (left - 1))) if last - at >= left else furthest
        even = prefix[at] + (prefix[-1] - prefix[at]) / left
        near = int(np.searchsorted(prefix, even))
        if near > at + 1 and even - prefix[near - 1] <= prefix[near] - even:
            near -= 1
        end = min(max(near, at + 1), furthest)
        while end < furthest and not feasible(prefix, end, capacity, left - 1):
            end += 1
        ends.append(end)
        at = end
    return ends


@dataclass(frozen=True)
class Plan:
    """``alone``: units that are shards 0, 1, …; ``firsts``: first units of the later shards after the first of them."""

    shards: int
    alone: list[int]
    firsts: list[int]
    capacity: int

    def shard(self, unit: Column) -> Column:
        out = F.lit(len(self.alone))
        for first in self.firsts:
            out = out + (unit >= first).cast("int")
        for k, own in enumerate(self.alone):
            out = F.when(unit == own, k).otherwise(out)
        return out.cast("int")


def plan_units(units: np.ndarray, sizes: np.ndarray, shards: int) -> Plan:
    """Shards for units (ascending) of the given sizes."""
    alone: list[int] = []
    sizes = sizes.astype(np.int64)
    while len(sizes) > 1 and shards - len(alone) > 1:
        k = int(sizes.argmax())
        if sizes[k] * (shards - len(alone)) <= sizes.sum():
            break
        alone.append(int(units[k]))
        units, sizes = np.delete(units, k), np.delete(sizes, k)
    left = shards - len(alone)
    ends = contiguous_cuts(sizes, left)
    # a shard that starts behind the last unit stays empty
    firsts = [int(units[e]) if e < len(units) else 1 << 62 for e in ends[:-1]]
    return Plan(shards, alone, firsts, smallest_capacity(sizes, left))


def size_of(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none) and 16 for the rest of the record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def unit_of(text: Column) -> Column:
    return F.shiftright(F.xxhash64(text), 64 - UNIT_BITS)


def plan_shards(docs: DataFrame, shards: int = 40, text_col: str = "text") -> Plan:
    """One aggregation over the documents; at most 2^UNIT_BITS rows reach the driver."""
    rows = (
        docs.select(unit_of(F.col(text_col)).alias("unit"), size_of(F.col(text_col)).alias("size"))
        .groupBy("unit").agg(F.sum("size").alias("size")).collect()
    )
    rows = sorted((r["unit"], r["size"]) for r in rows)
    return plan_units(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), shards)


def assign_shards(docs: DataFrame, shards: int = 40, text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row; equal texts, and all null texts, share one.

    An existing column named ``shard_col`` is replaced. An empty table stays empty.
    """
    return docs.withColumn(shard_col, plan_shards(docs, shards, text_col).shard(unit_of(F.col(text_col))))


def number_slots(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", slot_col: str = "slot",
) -> DataFrame:
    """``docs`` with a number from 0 without gaps in each shard, in the order of a hash of id and text.

    Rows of a shard are divided by that hash into buckets of about ``SLOT_ROWS``; buckets are counted, then each row
    is ranked in its bucket only. Rows that agree in id and text take neighbouring numbers in either order. The numbers
    of buckets are joined: as a CASE they would repeat the expression of the shard for each large shard.
    """
    order, bucket, n, before, known, buckets = (fresh(docs, c) for c in ("_order", "_bucket", "_n", "_before", "_known", "_buckets"))
    rows = docs.groupBy(shard_col).count().collect()  # one row for each shard
    large = docs.sparkSession.createDataFrame(
        [(r[shard_col], -(-r["count"] // SLOT_ROWS)) for r in rows if r["count"] > SLOT_ROWS],
        T.StructType([T.StructField(known, docs.schema[shard_col].dataType), T.StructField(buckets, T.LongType())]),
    )
    ordered = docs.withColumn(order, F.xxhash64(F.col(id_col), F.col(text_col)) if text_col in docs.columns else F.xxhash64(F.col(id_col)))
    ordered = ordered.join(F.broadcast(large), F.col(shard_col) == F.col(known), "left").withColumn(  # one row for each shard
        bucket, F.pmod(F.col(order), F.coalesce(F.col(buckets), F.lit(1)))
    ).drop(known, buckets)
    counts = ordered.groupBy(shard_col, bucket).agg(F.count(F.lit(1)).alias(n)).withColumn(
        before, F.sum(n).over(Window.partitionBy(shard_col).orderBy(bucket)) - F.col(n)
    ).drop(n)
    ranked = ordered.withColumn(
        n, F.row_number().over(Window.partitionBy(shard_col, bucket).orderBy(order, id_col))
    )
    return (
        ranked.join(counts, [shard_col, bucket])
        .withColumn(slot_col, (F.col(before) + F.col(n) - 1).cast("long"))
        .drop(order, bucket, n, before)
        .select(*[c for c in docs.columns if c != slot_col], slot_col)
    )


def shard_report(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row for each document: size, checksum, law, shard and slot.

    Null ids and repeated rows are ordinary rows. The checksum of a null text is null.
    """
    text = F.col(text_col)
    slim = assign_shards(docs, shards, text_col).select(
        F.col(id_col).alias("doc_id"), size_of(text).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard",
    )
    return number_slots(slim, "doc_id", "text_crc32").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
