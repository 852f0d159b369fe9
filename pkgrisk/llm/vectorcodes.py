"""Product codes of vectors by Lloyd rounds over two trees.

Vectors are cut into equal consecutive parts; every part position has its own codebook of integer entries. In each
block of vectors the parts of a position form a balanced box tree whose nodes hold bounds, counts and sums; the
entries of the codebook form another. Pairs of nodes are walked from the two roots downwards. A pair is dropped when
its boxes are farther apart than the farthest two points of another pair of the same part node can be. A part node
that is left with a single entry is assigned whole, by its cached sum; the leaves that stay uncertain compare their
parts with the entries left, in integers. Ties go to the lower index, as in a plain search.

A round sends one sum and count for each codebook component and task through the shuffle and as many numbers to the
driver as the codebooks hold, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pkgrisk.llm.flat import ranges, small_batches
from pkgrisk.llm.shared import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: parts in a leaf of the part tree, and vectors of one tree
LEAF = 8
BLOCK_ROWS = 1024


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    limit = float("inf")
    return F.coalesce(
        F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (x < limit) & (x > -limit), F.lit(False))), F.lit(False)
    )


def bound(dims: int) -> int:
    """Largest size of an integer component for which the squared distance of two vectors fits 62 bits."""
    return int((2.0**62 / max(dims, 1)) ** 0.5 / 2)


def integers(flat: np.ndarray, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of all components, a row for each vector."""
    most = bound(dims)
    return np.clip(np.floor(flat.astype(np.float64) * scale), -most, most).astype(np.int64).reshape(-1, dims)


def by_part(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(vectors, dims) to (parts, vectors, dims / parts)."""
    n, dims = vectors.shape
    return np.ascontiguousarray(vectors.reshape(n, parts, dims // parts).transpose(1, 0, 2))


class BoxTree:
    """One balanced tree for every part position, all of one shape, kept level by level.

    Level l cuts the n points of a position into 2^l runs of nearly equal length; node k of position p is row
    p * 2^l + k of the level's arrays. ``order`` lists the points of all positions so that every node is one run.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        positions, n, width = points.shape
        self.positions, self.n = positions, n
        self.flat = points.reshape(positions * n, width)
        order = np.arange(positions * n)
        self.depth = 0
        while -(-n >> self.depth) > leaf:  # the longest run
            starts = self._starts(self.depth)
            if width:
                low, high = self._boxes(order, starts)
                node = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, positions * n)))
                value = self.flat[order, np.argmax(high - low, axis=1)[node]]
                order = order[np.lexsort((value, node))]
            self.depth += 1
        self.order = order
        self.starts = [self._starts(k) for k in range(self.depth + 1)]
        self.counts = [np.diff(np.append(s, positions * n)) for s in self.starts]
        self.boxes = [self._boxes(order, s) for s in self.starts]

    def _starts(self, level: int) -> np.ndarray:
        cuts = (self.n * np.arange(1 << level, dtype=np.int64)) >> level
        return (np.arange(self.positions, dtype=np.int64)[:, None] * self.n + cuts).ravel()

    def _boxes(self, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.flat[order]
        return np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)

    def sums(self, level: int) -> np.ndarray:
        return np.add.reduceat(self.flat[self.order], self.starts[level])


@dataclass
class Assigned:
    entry: np.ndarray  # (positions, points): index of the nearest entry
    total: np.ndarray  # (positions, entries, width): componentwise sums
    count: np.ndarray  # (positions, entries)
    whole: int  # points assigned with their node
    compared: int  # integer distances that were worked out


def nearest(points: np.ndarray, entries: np.ndarray) -> Assigned:
    """Nearest entry of every point, position by position: (positions, n, width) against (positions, k, width)."""
    positions, n, width = points.shape
    k = entries.shape[1]
    out = Assigned(np.zeros((positions, n), np.int64), np.zeros((positions, k, width), np.int64), np.zeros((positions, k), np.int64), 0, 0)
    if not n:
        return out
    tree, codes = BoxTree(points, LEAF), BoxTree(entries, 1)
    entry_at, total, count = out.entry.reshape(-1), out.total.reshape(positions * k, width), out.count.reshape(-1)
    p = e = np.arange(positions)
    at, of = 0, 0
    while len(p):
        (p_low, p_high), (e_low, e_high) = tree.boxes[at], codes.boxes[of]
        near, far = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for j in range(width):
            a, b, c, d = p_low[p, j], p_high[p, j], e_low[e, j], e_high[e, j]
            gap = np.maximum(np.maximum(a - d, c - b), 0)
            span = np.maximum(d - a, b - c)
            near += gap * gap
            far += span * span
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        each = np.diff(np.append(first, len(p)))
        keep = near <= np.repeat(np.minimum.reduceat(far, first), each)
        p, e = p[keep], e[keep]
        if of == codes.depth:
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            each = np.diff(np.append(first, len(p)))
            alone = first[each == 1]
            if len(alone):  # every other entry is farther from all points of the node
                node, winner = p[alone], codes.order[codes.starts[of][e[alone]]]
                np.add.at(total, winner, tree.sums(at)[node])
                np.add.at(count, winner, tree.counts[at][node])
                own = tree.order[ranges(tree.starts[at][node], tree.counts[at][node])]
                entry_at[own] = np.repeat(winner % k, tree.counts[at][node])
                out.whole += len(own)
                left = np.repeat(each != 1, each)
                p, e = p[left], e[left]
            if at == tree.depth:
                break
        # both trees go down a level, as far as they have one
        down_p, down_e = at < tree.depth, of < codes.depth
        if down_p and down_e:
            p = (2 * p[:, None] + np.array([0, 0, 1, 1])).ravel()
            e = (2 * e[:, None] + np.array([0, 1, 0, 1])).ravel()
        elif down_p:
            p, e = (2 * p[:, None] + np.array([0, 1])).ravel(), np.repeat(e, 2)
        else:
            p, e = np.repeat(p, 2), (2 * e[:, None] + np.array([0, 1])).ravel()
        at, of = at + down_p, of + down_e
        if down_e:  # a run without an entry: the tree of a codebook whose size is no power of two
            filled = codes.counts[of][e] > 0
            p, e = p[filled], e[filled]
        turn = np.argsort(p, kind="stable")
        p, e = p[turn], e[turn]
    if len(p):
        # uncertain leaves: every part of the leaf against every entry left
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        each = np.diff(np.append(first, len(p)))
        sizes = tree.counts[at][p[first]]
        point = tree.order[ranges(tree.starts[at][p[first]], sizes)]
        each = np.repeat(each, sizes)
        entry = codes.order[codes.starts[of][e[ranges(np.repeat(first, sizes), each)]]]
        pair = np.repeat(point, each)
        distance = np.zeros(len(pair), np.int64)
        for j in range(width):
            gap = tree.flat[pair, j] - codes.flat[entry, j]
            distance += gap * gap
        out.compared += len(pair)
        begin = np.cumsum(each) - each
        least = np.repeat(np.minimum.reduceat(distance, begin), each)
        entry = np.minimum.reduceat(np.where(distance == least, entry, positions * k), begin)
        entry_at[point] = entry % k
        for j in range(width):
            np.add.at(total[:, j], entry, tree.flat[point, j])
        np.add.at(count, entry, 1)
    return out


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of the codebook's length as integers."""
    return integers(column.flatten().to_numpy(zero_copy_only=False), dims)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, BLOCK_ROWS):
        yield batch.slice(low, BLOCK_ROWS)


def _sum(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        parts, k, width = book.shape
        total, count = np.zeros(book.shape, np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for block in _blocks(batch):
                found = nearest(by_part(_vectors(block.column(0), parts * width), parts), book)
                total += found.total
                count += found.count
        used = np.flatnonzero(count.ravel())
        slot = (used[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(slot, pa.int64()), "total": pa.array(total.ravel()[slot], pa.int64()),
            "n": pa.array(np.repeat(count.ravel()[used], width), pa.int64()),
        })

    return run


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        parts, k, width = book.shape
        digits = "%%0%dx" % max(2, len("%x" % (k - 1)))
        names = np.array([digits % i for i in range(k)])
        for batch in batches:
            for block in _blocks(batch):
                points = by_part(_vectors(block.column(2), parts * width), parts)
                entry = nearest(points, book).entry
                gap = points - np.take_along_axis(book, entry[:, :, None], axis=1)
                code = ["".join(row) for row in names[entry.T].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), block.column(1), pa.array(code, pa.string()), pa.array((gap * gap).sum(axis=(0, 2)))],
                    names=["vec_id", "label", "code", "error"],
                )

    return run


@dataclass
class Codebooks:
    """Integer entries by part position, entry and place within the part."""

    entries: np.ndarray

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, vector (double) of the rows whose vector is whole."""
    return vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(ArrayType(vectors.schema[vector_col].dataType.elementType)).alias("vector"),
    ).where(usable(F.col("vector")))


def learn_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` Lloyd rounds over all rows of ``kept``; None where nothing can be cut into parts.

    They start as the vectors of the smallest ids (null ids last, equal ids by vector); the first of them gives the
    length. Vectors of another length take no part. An entry that no part chose stays as it is.
    """
    spark = kept.sparkSession
    fits = (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = kept.where(fits).orderBy(*order).select(F.size("vector").alias("dims")).limit(1).collect()
    if not first:
        return None
    dims = first[0]["dims"]
    same = kept.where(F.size("vector") == dims)
    start = np.array([r["vector"] for r in same.orderBy(*order).limit(entries).collect()], np.float64)
    book = by_part(integers(start.ravel(), dims), parts)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(book)
        sums = (
            same.select("vector").mapInArrow(_sum(shared), "slot long, total long, n long")
            .groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # the size of the codebooks
        )
        after = book.ravel().copy()
        for r in sums:
            after[r["slot"]] = r["total"] // r["n"]
        book = after.reshape(book.shape)
    return Codebooks(book)


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of the rows of ``kept`` that have the codebooks' length."""
    shared = kept.sparkSession.sparkContext.broadcast(books.entries)
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.where(F.size("vector") == books.dims).mapInArrow(
        _encode(shared), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    )


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every whole vector.

    Rows whose vector is null or holds a null, infinite or NaN component are dropped, as are those that cannot be cut
    like the first one (another length). Null ids and labels and repeated rows are ordinary rows; null labels form one
    group. With fewer vectors than entries the codebooks are smaller; an empty table gives an empty result.
    Components beyond ``bound(length)``, 524,288 at 64 dimensions, count as that.
    """
    small_batches(vectors.sparkSession)
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    books = learn_codebooks(kept, parts, entries, rounds)
    if books is None:
        return kept.where("false").select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
            F.lit("").alias("codebooks_sha256"),
        )
    codes = stored(encode(kept, books), "codes")
    errors = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "known")
    return codes.join(errors, F.col("label").eqNullSafe(F.col("known"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
