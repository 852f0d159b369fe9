"""JSON arrays of any size: one file is read by many tasks, which cut it at the commas of its outermost array.

Whether a byte stands inside a string, and how deep, depends on all bytes before it. Each slice of a long file is scanned
once for what it does to both: the quotes it holds, and the brackets it opens and closes if it begins outside or inside
a string. Running sums over these rows, one for each slice, give the state at every slice's first byte, and a second
pass cuts the elements that begin in a slice, reading on behind its end for the last one. A file of one slice is read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.functions.variant import parse
from pkgrisk.session import stored
from pkgrisk.sources.archives import CHUNK_BYTES
from pkgrisk.sources.slices import CELL_BYTES, Opener, open_path, tasks_for

SLICE_BYTES = 64 << 20
#: bytes looked at in one go
STEP_BYTES = 1 << 20
SPACE = b" \t\r\n"

# What a byte outside strings does to the depth; a comma is an event that changes nothing.
STEP = np.zeros(256, np.int8)
STEP[[ord("["), ord("{")]] = 1
STEP[[ord("]"), ord("}")]] = -1
IS_EVENT = STEP != 0
IS_EVENT[ord(",")] = True
QUOTE, BACKSLASH = 34, 92


def scan(data: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Places of brackets and commas, the quotes before each, all quotes, and whether an odd run of backslashes ends here.

    ``odd`` says the same of the bytes before ``data``. A quote behind an odd run is text.
    """
    quotes = np.flatnonzero(data == QUOTE)
    slashes = np.flatnonzero(data == BACKSLASH)
    after = odd and not len(data)
    if len(slashes) or odd:
        # A run that goes on from before begins one place earlier if that part was odd.
        new = np.concatenate([[True], np.diff(slashes) != 1]) if len(slashes) else np.zeros(0, bool)
        begin = slashes[new][np.cumsum(new) - 1]
        if odd and len(slashes):
            begin = np.where(begin == 0, -1, begin)
        k = np.searchsorted(slashes, quotes) - 1
        behind = (k >= 0) & (slashes[np.maximum(k, 0)] == quotes - 1) if len(slashes) else np.zeros(len(quotes), bool)
        text = behind.copy()
        text[behind] = (quotes[behind] - begin[k[behind]]) % 2 == 1
        if odd:
            text |= quotes == 0
        quotes = quotes[~text]
        if len(data):
            ends = len(slashes) > 0 and slashes[-1] == len(data) - 1
            after = bool(ends and (len(data) - begin[-1]) % 2)
    at = np.flatnonzero(IS_EVENT[data])
    return at, np.searchsorted(quotes, at), len(quotes), after


def _steps(file: IO[bytes], start: int, end: int) -> Iterator[bytes]:
    file.seek(start)
    while start < end and (data := file.read(min(STEP_BYTES, end - start))):
        yield data
        start += len(data)


def odd_before(file: IO[bytes], at: int) -> bool:
    """Whether an odd run of backslashes ends right before ``at``."""
    n = 0
    while at:
        low = max(0, at - 4096)
        file.seek(low)
        data = file.read(at - low)
        run = len(data) - len(data.rstrip(b"\\"))
        n += run
        if run < len(data):
            break
        at = low
    return n % 2 == 1


def _effects(opener: Opener):
    """path, slice → quotes, depth change from outside a string and from inside one; for slice 0 where the array opens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                quotes, change = 0, [0, 0]
                with opener(r["path"]) as file:
                    first = first_bracket(file, r["length"]) if r["slice"] == 0 else None
                    odd = odd_before(file, r["start"])
                    for data in _steps(file, r["start"], r["end"]):
                        data = np.frombuffer(data, np.uint8)
                        at, before, n, odd = scan(data, odd)
                        inside = (before + quotes) % 2
                        step = STEP[data[at]].astype(np.int64)
                        for side in (0, 1):
                            change[side] += int(step[inside == side].sum())
                        quotes += n
                rows.append((r["path"], r["slice"], quotes, *change, first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.string(), *[pa.int64()] * 5))],
                names=["path", "slice", "quotes", "outside", "inside", "first"],
            )

    return run


def first_bracket(file: IO[bytes], length: int) -> int:
    """The place of the bracket that opens the file's array; -1 if the file holds another value or none."""
    at = 0
    for data in _steps(file, 0, length):
        if rest := data.lstrip(SPACE):
            return at + len(data) - len(rest) if rest[:1] == b"[" else -1
        at += len(data)
    return -1


def elements(file: IO[bytes], r: dict, limit: int) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(place, text, problem) of the elements whose opening bracket or comma lies in the slice."""
    first = r["first"] if r["first"] is not None else first_bracket(file, r["length"])
    if first < 0:  # another value: the whole file is one record
        if r["slice"] == 0 and r["length"] > limit:
            yield 0, None, "too_large"
        elif r["slice"] == 0:
            file.seek(0)
            if (text := file.read()).strip(SPACE):
                yield 0, text, None
        return
    depth, inside, odd = r["depth"], r["in_string"], odd_before(file, r["start"])
    begun, held, kept = None, 0, bytearray()  # the element that is being read
    base, closed = r["start"], r["start"] > first and depth <= 0
    for data in _steps(file, r["start"], r["length"]):
        if base >= r["end"] and begun is None:
            return
        raw, codes = data, np.frombuffer(data, np.uint8)
        at, before, n, odd = scan(codes, odd)
        at = at[(before + inside) % 2 == 0]
        byte = codes[at]
        after = depth + np.cumsum(STEP[byte].astype(np.int64))
        cut = ((byte == 44) & (after == 1)) | ((STEP[byte] < 0) & (after == 0))
        cut = (cut | (at == first - base)) & (not closed)
        done = 0  # bytes of this step that belong to finished elements
        for place, code in zip(at[cut].tolist(), byte[cut].tolist()):
            ends = code in (93, 125)
            if begun is not None:
                kept += raw[done:place] if held <= limit else b""
                held += place - done
                text = bytes(kept) if held <= limit else None
                if text is None:
                    yield begun, None, "too_large"
                elif not (ends and opened and not text.strip(SPACE)):  # an empty array has no element
                    yield begun, text, None
            if ends and code == 125:
                yield base + place, None, "array closed by a brace"
            begun, held, done = None, 0, place + 1
            kept.clear()
            closed = closed or ends
            if not ends and base + place < r["end"]:
                begun, opened = base + place, code != 44
            elif not ends:
                return
            if closed:
                break
        if begun is not None:
            kept += raw[done:] if held <= limit else b""
            held += len(raw) - done
        if closed:
            # Behind the array only white space may follow; every slice looks at its own bytes.
            if raw[done:max(done, r["end"] - base)].strip(SPACE):
                yield base + done, None, "text behind the array"
                return
        depth, inside, base = int(after[-1]) if len(after) else depth, (inside + n) % 2, base + len(data)
    if begun is not None:
        yield begun, None, "file ends inside the array"


RECORDS = "path string, at long, value binary, problem string"


def _cut(opener: Opener, limit: int):
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def take() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for r in batch.to_pylist():
                with opener(r["path"]) as file:
                    for at, text, problem in elements(file, r, limit):
                        n = len(text or b"")
                        if rows and held + n > CHUNK_BYTES:
                            yield take()
                            held = 0
                        rows.append((r["path"], at, text, problem))
                        held += n
        if rows:
            yield take()

    return run


def cut_arrays(files: DataFrame, slice_bytes: int = SLICE_BYTES, opener: Opener = open_path, limit: int = CELL_BYTES) -> DataFrame:
    """``path, at, value, problem``: the elements of the arrays in ``files(path, length)``, as they stand.

    ``at`` is the byte of the bracket or comma before an element, which orders a file's elements. A file that holds
    another value is one record; a blank one has none. A file that goes wrong has its good elements and rows with a
    ``problem``: it ends inside the array, or text follows it. An element beyond ``limit`` bytes is ``too_large``.
    Elements are not parsed. ``files`` may hold extra columns; a path listed twice is read once.
    """
    tasks = tasks_for(files, slice_bytes)
    listed = files.groupBy("path").agg(F.max("length").alias("length")).filter("path IS NOT NULL AND length > 0")
    cut = listed.selectExpr(
        "path", "length", f"explode(sequence(0L, (length - 1) DIV {slice_bytes}L)) AS slice"
    ).selectExpr("*", f"slice * {slice_bytes}L AS start", f"least(length, (slice + 1) * {slice_bytes}L) AS end")
    long = cut.filter(f"length > {slice_bytes}L").repartition(tasks, "path", "slice")
    effects = long.mapInArrow(_effects(opener), "path string, slice long, quotes long, outside long, inside long, first long")
    earlier = "OVER (PARTITION BY path ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    states = effects.selectExpr("*", f"coalesce(sum(quotes) {earlier}, 0L) % 2 AS in_string").selectExpr(
        "path", "slice", "in_string", f"coalesce(sum(IF(in_string = 1, inside, outside)) {earlier}, 0L) AS depth",
        "max(first) OVER (PARTITION BY path) AS first",
    )
    known = cut.join(states, ["path", "slice"], "left").selectExpr(
        "path", "length", "slice", "start", "end", "coalesce(in_string, 0L) AS in_string", "coalesce(depth, 0L) AS depth", "first",
    )
    return known.repartition(tasks, "path", "slice").mapInArrow(_cut(opener, limit), RECORDS)


def parse_elements(cut: DataFrame) -> DataFrame:
    """``path, at, rec, problem``: elements as VARIANT; one that is not JSON has problem ``bad JSON``."""
    return cut.selectExpr("path", "at", f"{parse('cast(value AS string)')} AS rec", "problem").selectExpr(
        "path", "at", "rec", "IF(problem IS NULL AND rec IS NULL, 'bad JSON', problem) AS problem"
    )


def read_json_records(
    spark: SparkSession, path: str, slice_bytes: int = SLICE_BYTES, glob: str = "*", whole_files: bool = False,
) -> DataFrame:
    """``path, at, rec, problem`` of the JSON files below ``path``: array elements of any kind, other values as one record.

    With ``whole_files`` a file with any problem gives none of its records and keeps its problem rows, as if it had been
    parsed in one piece; the records are written to the shared folder for that and read again, not cut a second time.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
        .select("path", "length")
    )
    out = parse_elements(cut_arrays(files, slice_bytes))
    if not whole_files:
        return out
    out = stored(out, "records")
    bad = out.filter("problem IS NOT NULL").select(F.col("path").alias("_bad")).distinct()
    return out.join(bad, out["path"] == bad["_bad"], "left").filter("_bad IS NULL OR problem IS NOT NULL").drop("_bad")
