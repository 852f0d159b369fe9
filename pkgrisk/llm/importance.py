"""Importance resampling towards a target distribution of hashed n-grams.

A text is lower-cased and its separators are collapsed to single spaces. A pattern with boundary lookarounds, applied
with overlapping matches, then finds every run of n words as one span of that text, whose bytes are hashed with
CRC-32 into a fixed number of buckets. Buckets are counted over all documents and over all target texts; the log ratio
of the two smoothed shares is a bucket's gain, a document's weight is the sum over its features, and Gumbel noise
from a hash of its id turns the highest scores into a draw without replacement.

Counts are added up in each task, so the shuffle and the driver see one number for each bucket and task. Ranks are
given by one range partitioning of slim rows: a row's number in its partition plus the rows of the partitions before.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log
from operator import methodcaller
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgrisk.llm.flat import ALNUM, LOWER, buffers, small_batches
from pkgrisk.llm.shared import stored

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024

#: a byte of a word, lower-cased, or a space
_PLAIN = bytes(np.where(ALNUM[LOWER], LOWER, 0x20).astype(np.uint8))
_GAP = regex.compile(rb"  +")


def collapsed(raw: bytes) -> bytes:
    """Lower-cased words with one space between them."""
    return _GAP.sub(b" ", raw.translate(_PLAIN)).strip(b" ")


def patterns(low: int, high: int) -> list[regex.Pattern]:
    """One pattern for each run length, whole words at both ends."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(low, high + 1)]


def features(text: bytes, runs: list[regex.Pattern]) -> Counter[bytes]:
    """All n-grams of a collapsed text and how often each stands there."""
    found: Counter[bytes] = Counter()
    for run in runs:
        found.update(map(methodcaller("group"), run.finditer(text, overlapped=True)))
    return found


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = buffers(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield collapsed(data[a:b].tobytes())


def _count(buckets: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = patterns(low, high), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                found = features(text, runs)
                at = np.fromiter((crc32(f) % buckets for f in found), np.int64, len(found))
                np.add.at(total, at, np.fromiter(found.values(), np.int64, len(found)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    return run


@dataclass(frozen=True)
class Features:
    """Run lengths and buckets."""

    low: int = 1
    high: int = 1
    buckets: int = BUCKETS

    def counts(self, texts: DataFrame, text_col: str = "text") -> list[int]:
        """Features in each bucket over all rows; the driver gets one number for each bucket."""
        rows = (
            texts.select(F.col(text_col).cast("string")).mapInArrow(_count(self.buckets, self.low, self.high), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        )
        out = [0] * self.buckets
        for r in rows:
            out[r["bucket"]] = r["n"]
        return out

    def gains(self, source: list[int], target: list[int]) -> np.ndarray:
        """floor(1000 ln(smoothed share in the target / smoothed share in the source)) of each bucket."""
        all_s, all_t = sum(source) + self.buckets, sum(target) + self.buckets
        return np.array([floor(1000 * log(((t + 1) * float(all_s)) / ((s + 1) * float(all_t)))) for s, t in zip(source, target)], np.int64)


def _weigh(shared, of: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, gain = patterns(of.low, of.high), shared.value.tolist()
        for batch in batches:
            n_features, n_words, weight = [], [], []
            for text in _texts(batch.column(1)):
                found = features(text, runs)
                n_features.append(found.total())
                n_words.append(text.count(b" ") + 1 if text else 0)
                weight.append(sum(gain[crc32(f) % of.buckets] * n for f, n in found.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_features, n_words, weight)]],
                names=["doc_id", "n_features", "n_words", "weight"],
            )

    return run


def weigh(docs: DataFrame, target: DataFrame, of: Features = Features(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight of all documents; null and empty texts have none and weigh 0."""
    small_batches(docs.sparkSession)
    gains = of.gains(of.counts(docs, text_col), of.counts(target, target_col))
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(_weigh(shared, of), f"doc_id {kind}, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel number from 32 bits of a hash of the id, rounded down; a null id is an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(key, "utf-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``weighed`` with score and rank: the highest scores of ``percent`` of the documents that are long enough.

    Ties go to the smaller id, null ids last; rows that agree in both take neighbouring ranks.
    """
    scored = stored(weighed, "weights").select(
        "*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("open"),
        F.monotonically_increasing_id().alias("row"),  # tells equal rows apart; the table is written
    )
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = stored(
        scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked",
    ).withColumn("part", F.shiftright("at", 33))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"))
    before = sizes.select(  # one row for each partition of the range
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
        F.floor(percent * F.sum("n_open").over(Window.partitionBy()) / 100).cast("long").alias("drawn"),
    )
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(F.broadcast(before), "part").select(
        *[c for c in weighed.columns], "score", F.when(F.col("open") & (rank <= F.col("drawn")), rank).alias("rank")
    )


def importance_report(
    docs: DataFrame, target: DataFrame, of: Features = Features(), percent: int = PERCENT, least_words: int = LEAST_WORDS,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that are not drawn.

    Null and empty texts have no feature, weight 0, and are too short to be drawn. Repeated rows are documents of their
    own. Without target texts all gains follow from the smoothing alone; an empty table gives an empty result.
    """
    weighed = weigh(docs, target, of, id_col, text_col, target_col)
    return draw(weighed, percent, least_words, seed).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, columns as in ``docs``; rows that repeat a drawn id come along."""
    drawn = importance_report(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.alias("d").join(drawn.alias("r"), F.col(f"d.{id_col}").eqNullSafe(F.col("r._drawn")), "left_semi")
