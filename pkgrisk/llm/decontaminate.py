"""Benchmark items inside documents of any length.

The chance that the minimum of an item's shingles under a random order occurs in a document is the containment of the
item in it. The index is partitioned by item size (powers of two). An item's sketch is its k smallest shingle hashes;
k belongs to the partition and is one more than the shingles that may be missing at its upper size, so at least one of
them is in every document that holds the item well enough: the search loses nothing. Items of fewer words than a
shingle have a partition for each number of words, with shingles of that width, so they too are found inside long
documents. Documents look up all their shingles in each partition, and candidates are verified by exact containment
over whole shingle sets in the same task. No document is shuffled.

The sketches travel to the tasks in blocks of at most ``BLOCK_SHINGLES`` shingles; a larger benchmark takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pkgrisk.llm.flat import ALNUM, Words, blocks, distinct, small_batches

WIDTH = 5
CONTAINMENT = 80  # per cent
BLOCK_SHINGLES = 1 << 20
_MASK_BITS = 20


@dataclass
class Part:
    """Items of one size: sorted sketch hashes and their item classes."""

    width: int
    upper: int
    hashes: np.ndarray
    classes: np.ndarray
    mask: np.ndarray


@dataclass
class Index:
    """A block of items by size, their whole shingle sets and the sketch hashes to be met; equal sets are one class."""

    parts: list[Part]
    ids: list[list]
    sets: list[np.ndarray]
    needed: np.ndarray


def may_miss(n: int, per_cent: int) -> int:
    """Shingles of n that may be missing."""
    return n * (100 - per_cent) // 100


def build_index(items: list[tuple[object, int, np.ndarray]], per_cent: int = CONTAINMENT) -> Index:
    """``items``: id, width and sorted shingles of each."""
    by_set: dict[tuple[int, bytes], int] = {}
    ids: list[list] = []
    sets: list[np.ndarray] = []
    sizes: dict[tuple[int, int], list[int]] = {}
    for item_id, width, shingles in items:
        k = by_set.setdefault((width, shingles.tobytes()), len(ids))
        if k == len(ids):
            ids.append([])
            sets.append(shingles)
            sizes.setdefault((width, 1 << (len(shingles) - 1).bit_length()), []).append(k)
        ids[k].append(item_id)
    needed, parts = np.zeros(len(sets), np.int64), []
    for (width, upper), own in sorted(sizes.items()):
        most = may_miss(upper, per_cent) + 1
        sketches = [sets[c][:most] for c in own]  # sorted: the smallest
        for c, sketch in zip(own, sketches):
            needed[c] = len(sketch) - may_miss(len(sets[c]), per_cent)
        hashes = np.concatenate(sketches)
        order = np.argsort(hashes, kind="stable")
        mask = np.zeros(1 << _MASK_BITS, bool)
        mask[(hashes & np.uint64((1 << _MASK_BITS) - 1)).astype(np.int64)] = True
        parts.append(Part(width, upper, hashes[order], np.repeat(own, [len(x) for x in sketches])[order], mask))
    return Index(parts, ids, sets, needed)


def search(index: Index, words: Words, per_cent: int = CONTAINMENT) -> Iterator[tuple[int, int, int]]:
    """(text, class, shingles found) of all texts of a block that hold an item."""
    for width in sorted({p.width for p in index.parts}):
        shingles, each = words.shingles(width)
        ends = np.cumsum(each)
        low = (shingles & np.uint64((1 << _MASK_BITS) - 1)).astype(np.int64)
        for part in index.parts:
            if part.width == width:
                yield from _search(index, part, shingles, each, ends, low, per_cent)


def _search(
    index: Index, part: Part, shingles: np.ndarray, each: np.ndarray, ends: np.ndarray, low: np.ndarray, per_cent: int,
) -> Iterator[tuple[int, int, int]]:
    at = np.flatnonzero(part.mask[low])
    if not len(at):
        return
    left, right = (np.searchsorted(part.hashes, shingles[at], side) for side in ("left", "right"))
    times = right - left
    at, left, times = at[times > 0], left[times > 0], times[times > 0]
    if not len(at):
        return
    text = np.repeat(np.searchsorted(ends, at, "right"), times)
    posting = np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    hit = np.unique(np.stack([text, part.classes[posting], posting], 1), axis=0)  # a repeated shingle counts once
    pairs, hits = np.unique(hit[:, :2], axis=0, return_counts=True)
    for (t, c), n in zip(pairs.tolist(), hits.tolist()):
        if n < index.needed[c]:
            continue
        whole = index.sets[c]
        found = int(np.isin(whole, shingles[ends[t] - each[t]:ends[t]]).sum())
        if found * 100 >= per_cent * len(whole):
            yield t, c, found


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in blocks(batch.column(1)):
            words = texts.words(ALNUM)
            width = np.minimum(words.counts, WIDTH)
            sets: list[list[int]] = [[] for _ in range(high - low)]
            for w in np.unique(width[width > 0]).tolist():
                values, each = distinct(*words.shingles(w))
                ends = np.cumsum(each)
                for i in np.flatnonzero(width == w).tolist():
                    sets[i] = values[ends[i] - each[i]:ends[i]].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array(width, pa.int32()), pa.array(sets, pa.list_(pa.int64()))],
                names=["item_id", "width", "shingles"],
            )


def _indexes(items: DataFrame, item_id: str, text_col: str, block: int) -> Iterator[Index]:
    """The benchmark in blocks; only one block is on the driver at a time."""
    source = items.select(item_id, text_col)
    kind = source.schema[0].dataType.simpleString()
    held, n = [], 0
    for r in source.mapInArrow(_item_shingles, f"item_id {kind}, width int, shingles array<bigint>").toLocalIterator():
        if r["shingles"]:
            held.append((r["item_id"], r["width"], np.array(r["shingles"], np.int64).view(np.uint64)))
            n += len(r["shingles"])
        if n >= block:
            yield build_index(held)
            held, n = [], 0
    yield build_index(held)


def _pairs(shared, id_type: pa.DataType, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows, items, sizes, counts = [], [], [], []
            for low, _, texts in blocks(batch.column(1)):
                for t, c, found in search(index, texts.words(ALNUM)):
                    for item in index.ids[c]:
                        rows.append(low + t)
                        items.append(item)
                        sizes.append(len(index.sets[c]))
                        counts.append(found)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, item_type), pa.array(sizes, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(np.array(counts) / np.array(sizes))],
                    names=["doc_id", "item_id", "n_shingles", "n_found", "containment"],
                )

    return run


def _clean(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for low, _, texts in blocks(batch.column(column)):
                for t, _, _ in search(index, texts.words(ALNUM)):
                    keep[low + t] = False
            yield pa.RecordBatch.from_arrays([pc.filter(c, pa.array(keep)) for c in batch.columns], schema=batch.schema)

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """A row for each document and item of which it holds at least 80 % of the distinct five-word shingles.

    Words are runs of letters and digits, A-Z lower-cased. An item of fewer than five words is one shingle of all its
    words and is found wherever they stand in a row. Null or wordless texts match nothing; null ids are passed on; a
    repeated row is searched again.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    slim = docs.select(id_col, text_col)
    ids, items = slim.schema[0].dataType, benchmark.select(item_id).schema[0].dataType
    schema = f"doc_id {ids.simpleString()}, item_id {items.simpleString()}, n_shingles long, n_found long, containment double"
    out = None
    for index in _indexes(benchmark, item_id, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        part = slim.mapInArrow(_pairs(shared, to_arrow_type(ids), to_arrow_type(items)), schema)
        out = part if out is None else out.unionAll(part)
    return out


def without_items(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    small_batches(docs.sparkSession)
    column = docs.columns.index(text_col)
    for index in _indexes(benchmark, item_id, item_text, block):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(index), column), docs.schema)
    return docs
