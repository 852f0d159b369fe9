"""Archives of any size: members are indexed first, then read by byte ranges in many tasks.

A zip's central directory and the headers of a plain tar tell where each member lies. The index has one slim row for
each member; rows are dealt to tasks by stretches of the archive, and each task opens the file, seeks and reads its own
members only. Nothing holds more than one member, or with ``part_bytes`` one part of it. A compressed tar has no such
index and is streamed, member by member, in one task.
"""

from __future__ import annotations

import io
import stat
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from pkgrisk.sources.archives import CHUNK_BYTES, DAMAGED, ZIP_MAGIC

#: bytes of an archive that one task reads, about
SLICE_BYTES = 128 * 1024 * 1024
#: slices of fewer bytes share tasks of so many
TASK_BYTES = 16 << 20
#: a binary cell holds at most 2^31 - 1 bytes, a batch of one somewhat less
CELL_BYTES = (1 << 31) - (1 << 16)
MOST_TASKS = 50_000
INDEX = pa.schema([
    ("archive", pa.string()), ("kind", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("is_link", pa.bool_()),
    ("at", pa.int64()), ("packed", pa.int64()), ("method", pa.int32()), ("flags", pa.int32()), ("crc", pa.int64()), ("clock", pa.int32()),
    ("pieces", pa.list_(pa.struct([("to", pa.int64()), ("size", pa.int64())]))), ("problem", pa.string()),
])
PARTS = pa.schema([
    ("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("is_link", pa.bool_()), ("part", pa.int32()),
    ("content", pa.binary()), ("problem", pa.string()),
])

Opener = Callable[[str], IO[bytes]]


def open_path(path: str) -> IO[bytes]:
    """A seekable file: local paths and ``file:`` directly, other schemes by Arrow's file systems."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _zip_index(file: IO[bytes]) -> Iterator[dict]:
    with zipfile.ZipFile(file) as z:
        for m in z.infolist():
            if not m.is_dir():
                link = stat.S_ISLNK(m.external_attr >> 16)
                hour, minute, second = m.date_time[3:]
                yield {
                    "kind": "zip", "member": m.filename, "size": m.file_size, "is_link": link, "at": m.header_offset, "packed": m.compress_size,
                    "method": m.compress_type, "flags": m.flag_bits, "crc": m.CRC, "clock": hour << 11 | minute << 5 | second // 2,
                }


def _tar_index(file: IO[bytes]) -> Iterator[dict]:
    with tarfile.open(fileobj=file, mode="r:") as t:
        for m in t:
            if not m.isdir():
                sparse = getattr(m, "sparse", None)
                yield {
                    "kind": "tar", "member": m.name, "size": m.size, "is_link": m.issym() or m.islnk(), "at": m.offset_data,
                    "packed": sum(n for _, n in sparse) if sparse else m.size, "method": -1 if not m.isfile() else 0,
                    "pieces": [{"to": to, "size": n} for to, n in sparse if n] if sparse else None,
                }
            t.members = []  # the walk forgets what it has passed


def _index(opener: Opener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []

                def take() -> pa.RecordBatch:
                    out = pa.RecordBatch.from_pylist([r | {"archive": path} for r in rows], INDEX)
                    rows.clear()
                    return out

                try:
                    with opener(path) as file:
                        head = file.read(6)
                        file.seek(0)
                        if head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head == b"\xfd7zXZ\x00":
                            rows.append({"kind": "stream", "at": 0, "packed": 0})
                        else:
                            for row in _zip_index(file) if head[:4] in ZIP_MAGIC else _tar_index(file):
                                rows.append(row)
                                if len(rows) == 4096:
                                    yield take()
                except DAMAGED as exc:
                    rows.append({"kind": "broken", "at": 0, "packed": 0, "problem": f"{type(exc).__name__}: {exc}"})
                yield take()

    return run


def member_index(paths: DataFrame, opener: Opener = open_path) -> DataFrame:
    """One row for each member of the archives in column ``path``: where it lies and how it is packed.

    A compressed tar is one row of kind ``stream``. An archive that cannot be listed, wholly or from some member on, has
    a row of kind ``broken`` after the members found.
    """
    return paths.select("path").mapInArrow(_index(opener), from_arrow_schema(INDEX))


def _zip_body(file: IO[bytes], row: dict, password: bytes | None) -> IO[bytes]:
    """The unpacked bytes of a member, checked by length and CRC at the end."""
    file.seek(row["at"])
    header = file.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no local header")
    file.seek(sum(struct.unpack("<HH", header[26:30])), io.SEEK_CUR)
    info = zipfile.ZipInfo(row["member"] or "")
    info.file_size, info.compress_size, info.compress_type = row["size"], row["packed"], row["method"]
    info.flag_bits, info.CRC = row["flags"], row["crc"]
    info._raw_time = row["clock"]  # the check byte of encrypted members
    if info.flag_bits & 1 and not password:
        raise RuntimeError("password required")
    return zipfile.ZipExtFile(file, "r", info, password if info.flag_bits & 1 else None)


def _tar_parts(file: IO[bytes], row: dict, part_bytes: int) -> Iterator[bytes]:
    if row["pieces"] is None:
        file.seek(row["at"])
        left = row["size"]
        while left or row["size"] == 0:
            body = file.read(min(part_bytes, left))
            if len(body) < min(part_bytes, left):
                raise tarfile.ReadError("unexpected end of data")
            yield body
            left -= len(body)
            if not left:
                return
        return
    at, pos, part = row["at"], 0, bytearray()
    for piece in [*row["pieces"], {"to": row["size"], "size": 0}]:  # holes are zeros
        todo = [(None, piece["to"] - pos), (at, piece["size"])]
        for source, n in todo:
            if source is not None:
                file.seek(source)
            while n > 0:
                step = min(n, part_bytes - len(part))
                body = bytes(step) if source is None else file.read(step)
                if len(body) < step:
                    raise tarfile.ReadError("unexpected end of data")
                part += body
                n -= step
                if len(part) == part_bytes:
                    yield bytes(part)
                    part.clear()
        at, pos = at + piece["size"], piece["to"] + piece["size"]
    if part or not row["size"]:
        yield bytes(part)


def _stream_parts(body: IO[bytes], size: int, part_bytes: int) -> Iterator[bytes]:
    """Parts of a file that is read from front to back."""
    done = 0
    while True:
        part = body.read(min(part_bytes, size - done) if size > done else 1)
        if not part:
            break
        done += len(part)
        yield part
    if done != size:
        raise EOFError(f"{done} of {size} bytes")
    if not size:
        yield b""


def _stream(file: IO[bytes], limit: int, part_bytes: int) -> Iterator[tuple]:
    """(member, size, is_link, part, content, problem) of a compressed tar."""
    with tarfile.open(fileobj=file, mode="r|*") as t:
        for m in t:
            if m.isdir():
                continue
            link = m.issym() or m.islnk()
            if link or not m.isfile():
                yield m.name, m.size, link, 0, None, None
            elif m.size > limit:
                yield m.name, m.size, link, 0, None, "too_large"
            else:
                try:
                    for k, body in enumerate(_stream_parts(t.extractfile(m), m.size, part_bytes)):
                        yield m.name, m.size, link, k, body, None
                except DAMAGED as exc:  # nothing behind it can be found
                    yield m.name, m.size, link, -1, None, f"{type(exc).__name__}: {exc}"
                    return
            t.members = []


def _parts(file: IO[bytes], row: dict, password: bytes | None, limit: int, part_bytes: int) -> Iterator[tuple]:
    if row["kind"] == "stream":
        yield from _stream(file, limit, part_bytes)
        return
    about = row["member"], row["size"], row["is_link"]
    if row["is_link"] or row["method"] == -1:
        yield *about, 0, None, None
    elif row["size"] > limit:
        yield *about, 0, None, "too_large"
    elif row["kind"] == "zip":
        for k, body in enumerate(_stream_parts(_zip_body(file, row, password), row["size"], part_bytes)):
            yield *about, k, body, None
    else:
        for k, body in enumerate(_tar_parts(file, row, part_bytes)):
            yield *about, k, body, None


def _read(opener: Opener, password: bytes | None, limit: int, part_bytes: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, path, file = 0, None, None

        def take() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PARTS)], schema=PARTS)
            rows.clear()
            return out

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["kind"] == "broken":
                        rows.append((row["archive"], None, None, None, 0, None, row["problem"]))
                        continue
                    first = len(rows)
                    try:
                        if row["archive"] != path:
                            if file is not None:
                                file.close()
                            path = file = None
                            path, file = row["archive"], opener(row["archive"])
                        file.seek(0)
                        for member, size, link, part, body, problem in _parts(file, row, password, limit, part_bytes):
                            n = len(body or b"")
                            if rows and held + n > CHUNK_BYTES:
                                yield take()
                                held = first = 0
                            rows.append((row["archive"], member, size, link, part, body, problem))
                            held += n
                    except DAMAGED as exc:
                        if row["kind"] != "stream" and whole:  # read, but found wrong at its end
                            del rows[first:]
                        rows.append((row["archive"], row["member"], row["size"], row["is_link"], 0 if whole else -1, None, f"{type(exc).__name__}: {exc}"))
            if rows:
                yield take()
        finally:
            if file is not None:
                file.close()

    return run


def read_index(
    index: DataFrame, tasks: int, max_file_bytes: int | None = None, zip_password: str | None = None, part_bytes: int | None = None,
    slice_bytes: int = SLICE_BYTES, opener: Opener = open_path,
) -> DataFrame:
    """archive, member, size, is_link, part, content, problem of the members in ``index``.

    Without ``part_bytes`` a member is one row, part 0; a member that no cell can hold has problem ``too_large``. With it,
    a member of any size is a row for each ``part_bytes``, numbered from 0; a member that breaks off has a last row of
    part -1. Links and special files have no content. A member that cannot be read is one row with its problem.
    """
    limit = max_file_bytes if max_file_bytes is not None else (1 << 62) if part_bytes else CELL_BYTES
    dealt = index.withColumn("_slice", F.floor(F.col("at") / slice_bytes)).repartition(tasks, "archive", "_slice")
    ordered = dealt.drop("_slice").sortWithinPartitions("archive", "at")
    password = zip_password.encode() if zip_password else None
    return ordered.mapInArrow(_read(opener, password, limit, part_bytes or CELL_BYTES, not part_bytes), from_arrow_schema(PARTS))


def tasks_for(files: DataFrame, slice_bytes: int = SLICE_BYTES) -> int:
    """Tasks by the bytes of the listed files; a job over the listing alone.

    Short slices share tasks, as starting one costs more than reading such a slice; no fewer tasks than twice the cores.
    """
    total = files.agg(F.sum("length").alias("n")).first()["n"] or 0
    enough = max(2 * files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return max(1, min(MOST_TASKS, enough, -(-total // slice_bytes), int(total)))
