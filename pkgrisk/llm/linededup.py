"""Lines that several documents share, kept in the first document only.

Two Bloom filters are built in one pass, one of lines seen once and one of lines seen at least twice. Only lines that
the second filter knows are suspected repeats; they alone are shuffled, as 128-bit digests, to be confirmed exactly
and to find the smallest id that holds them. A filter never misses a repeat: too small a filter only makes more lines
suspects.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.flat import NOT_SPACE, Texts, blocks, distinct, mix, small_batches
from pkgrisk.llm.shared import stored, whole_number_ids

LEAST_CHARS = 10
BITS_A_LINE = 12
PROBES = 4
#: bytes of one filter at most; beyond it the share of suspects grows, the result stays the same
FILTER_BYTES = 16 << 20
SEGMENT = 1 << 16
#: input partitions that one task puts into one filter, at most, where there are more than twice the cores
PARTS_A_TASK = 32
NO_ID = (1 << 63) - 1


def lines_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each line's start, end, key start, key end and text, in order; every text has at least one line."""
    n = len(texts.data)
    breaks = np.flatnonzero(texts.data == 10)
    starts = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, texts.offsets[1:]]), kind="stable")
    of = np.sort(np.concatenate([np.arange(len(texts)), texts.text_of(breaks)]), kind="stable")
    solid = np.flatnonzero(NOT_SPACE[texts.data])
    after = np.append(solid, n)
    key_start = np.minimum(after[np.searchsorted(solid, starts)], ends)
    before = np.concatenate([[-1], solid])
    key_end = np.maximum(before[np.searchsorted(solid, ends)] + 1, key_start)
    return starts, ends, key_start, key_end, of


def long_keys(texts: Texts, key_start: np.ndarray, key_end: np.ndarray) -> np.ndarray:
    """Which lines have a key of at least LEAST_CHARS code points."""
    chars = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    return chars[key_end] - chars[key_start] >= LEAST_CHARS


def bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES bit numbers of each hash."""
    step = mix(hashes + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return ((hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def set_bits(filter_: np.ndarray, at: np.ndarray) -> None:
    at = np.unique(at)
    if len(at):
        byte = at >> 3
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        filter_[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), first)


def has_bits(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def keyed(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, key hash) of the long keys of a block."""
    _, _, a, b, of = lines_of(texts)
    long = long_keys(texts, a, b)
    each = np.bincount(of[long], minlength=len(texts))
    values, each = distinct(texts.hashes(a[long], b[long]), each)
    return np.repeat(np.arange(len(each)), each), values


def _build(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for _, _, texts in blocks(batch.column(0)):
                values, times = np.unique(keyed(texts)[1], return_counts=True)
                at = bits_of(values, bits)
                again = has_bits(once, at) | (times > 1)
                set_bits(twice, at[again].ravel())
                set_bits(once, at.ravel())
        for k in range(0, len(once), SEGMENT):
            if once[k:k + SEGMENT].any():
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([k // SEGMENT], pa.int32()),
                    "once": pa.array([zlib.compress(once[k:k + SEGMENT].tobytes(), 1)], pa.binary()),
                    "twice": pa.array([zlib.compress(twice[k:k + SEGMENT].tobytes(), 1)], pa.binary()),
                })

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of two 'once' filters make a 'twice' bit: a line in both is never missed."""
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(batch.column(k).to_pylist() for k in range(3))):
            one, two = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
            if segment in seen:
                a, b = seen[segment]
                b |= two | (a & one)
                a |= one
            else:
                seen[segment] = (one.copy(), two.copy())
    for segment, (_, twice) in seen.items():
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array([segment], pa.int32()), "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary()),
        })


def repeat_filter(docs: DataFrame, text_col: str, filter_bytes: int = FILTER_BYTES) -> np.ndarray:
    """The filter of lines seen at least twice: at most ``filter_bytes`` on the driver."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select((F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("n")).agg(F.sum("n")).first()[0] or 0
    bits = 1 << max(19, min(filter_bytes * 8, lines * BITS_A_LINE).bit_length() - 1)
    parts = docs.select(text_col).rdd.getNumPartitions()
    tasks = max(1, min(parts, max(2 * spark.sparkContext.defaultParallelism, parts // PARTS_A_TASK)))
    built = docs.select(text_col).coalesce(tasks).mapInArrow(_build(bits), "segment int, once binary, twice binary")
    merged = built.repartition(max(1, min(tasks, bits // 8 // SEGMENT)), "segment").mapInArrow(_merge, "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["segment"] * SEGMENT:(r["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for low, _, texts in blocks(batch.column(1)):
                _, _, a, b, of = lines_of(texts)
                long = np.flatnonzero(long_keys(texts, a, b))
                if not len(long):
                    continue
                long = long[has_bits(filter_, bits_of(texts.hashes(a[long], b[long]), len(filter_) * 8))]
                found = {(int(of[k]) + low, digest(texts.data[a[k]:b[k]].tobytes())) for k in long}
                ids += [x for x, _ in found]
                keys += [x for _, x in found]
            if ids:
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).take(pa.array(ids, pa.int64())).cast(pa.int64()), "key": pa.array(keys, pa.binary()),
                })

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped = batch.column(2).to_pylist()
        total, gone, texts_out = [], [], []
        for low, high, texts in blocks(batch.column(1)):
            starts, ends, a, b, of = lines_of(texts)
            first = np.searchsorted(of, np.arange(high - low + 1))
            for k in range(high - low):
                x, y = int(first[k]), int(first[k + 1])
                drop = dropped[low + k]
                if not drop:
                    kept = texts.raw[texts.offsets[k]:texts.offsets[k + 1]].tobytes()
                    lost = 0
                else:
                    drop = set(drop)
                    stay = [i for i in range(x, y) if digest(texts.data[a[i]:b[i]].tobytes()) not in drop]
                    kept = b"\n".join(texts.raw[starts[i]:ends[i]].tobytes() for i in stay)
                    lost = y - x - len(stay)
                total.append(y - x)
                gone.append(lost)
                texts_out.append(kept)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts_out, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept"],
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every document.

    A null text is one empty line. Rows that repeat an id are one document; a row without id is a document after all
    others, and two such rows are the same one. Keys shorter than ten code points are left alone.
    Ids are whole numbers; others are refused.
    """
    spark = docs.sparkSession
    whole_number_ids(docs, id_col)
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(repeat_filter(docs, "text", filter_bytes).tobytes())
    suspects = stored(
        docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
        .mapInArrow(_suspects(shared), "doc_id long, key binary"), "suspects",
    )
    repeated = stored(
        suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first <> last").select("key", "first"), "repeats",
    )
    drops = (
        suspects.join(repeated, "key").where("doc_id <> first")
        .groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("key").alias("keys"))
    )
    return (
        docs.join(drops.hint("shuffle_hash"), F.coalesce("doc_id", F.lit(NO_ID)) == F.col("of"), "left")
        .select("doc_id", "text", "keys")
        .mapInArrow(_drop, "doc_id long, n_lines long, n_dropped long, kept string")
    )
