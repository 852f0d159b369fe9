"""Archives and directory trees → file rows. Nothing is unpacked to disk."""

from __future__ import annotations

import io
import lzma
import stat
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.operators.predicates import reject_reason

# Rows are handed back in chunks of about this many bytes, whatever the archive size.
CHUNK_BYTES = 16 * 1024 * 1024
MEMBER_SCHEMA = "archive string, member string, size bigint, is_link boolean, content binary, problem string"


# What damaged archives and members raise.
DAMAGED = (tarfile.TarError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, EOFError, OSError, ValueError)
ZIP_MAGIC = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")


def _members(data: bytes, password: bytes | None, max_file: int | None) -> Iterator[tuple]:
    """(member, size, is_link, content, problem) of a tar (any compression) or zip archive, told apart by its first bytes."""
    def fits(size: int) -> bool:
        return max_file is None or size <= max_file

    if data[:4] in ZIP_MAGIC:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if m.is_dir():
                    continue
                link = stat.S_ISLNK(m.external_attr >> 16)
                body = problem = None
                if not link and not fits(m.file_size):
                    problem = "too_large"
                elif not link:
                    try:
                        body = z.read(m, pwd=password)
                    except DAMAGED as exc:  # this member only
                        problem = f"{type(exc).__name__}: {exc}"
                yield m.filename, m.file_size, link, body, problem
        return
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
        for m in t:
            if m.isdir():
                continue
            link = m.issym() or m.islnk()
            large = m.isfile() and not fits(m.size)
            handle = t.extractfile(m) if m.isfile() and not large else None
            yield m.name, m.size, link, handle.read() if handle else None, "too_large" if large else None


def checked(members: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (NULL when safe); rejected members carry no content."""
    reason = f"coalesce({reject_reason('member', 'is_link')}, CASE WHEN problem = 'too_large' THEN problem WHEN problem IS NOT NULL THEN 'unreadable' END)"
    return members.withColumn("reject_reason", F.expr(reason)).withColumn("content", F.expr("IF(reject_reason IS NULL, content, NULL)"))


def explode_archives(archives: DataFrame, max_file_bytes: int | None = None, zip_password: str | None = None) -> DataFrame:
    """``(path, content)`` archives → one row per member with ``reject_reason`` (NULL when safe).

    For archives that lie in a table; files are read by ``read_archives``. Rejected members carry no content. Members
    above ``max_file_bytes``, if given, are rejected as ``too_large``; damaged members and archives give one row each
    with their ``problem``, and reading goes on.
    """
    password = zip_password.encode() if zip_password else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "size", "is_link", "content", "problem"]
        for pdf in batches:
            rows, held = [], 0
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    for member, size, link, body, problem in _members(data, password, max_file_bytes):
                        rows.append((path, member, size, link, body, problem))
                        held += len(body or b"")
                        if held > CHUNK_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                except DAMAGED as exc:
                    rows.append((path, None, None, None, None, f"{type(exc).__name__}: {exc}"))
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return checked(archives.select("path", "content").mapInPandas(run, MEMBER_SCHEMA))


def read_archives(
    spark: SparkSession, path: str, max_archive_bytes: int | None = None, max_file_bytes: int | None = None,
    zip_password: str | None = None, part_bytes: int | None = None, slice_bytes: int | None = None,
) -> DataFrame:
    """Members of every archive below ``path``, of any size: a zip or plain tar is read by byte ranges in many tasks.

    With ``max_archive_bytes`` larger archives are not opened and give one ``too_large`` row each; the limit is pushed
    to the file listing. With ``part_bytes`` members come in numbered parts (column ``part``), so that one larger than
    a cell can be read; see ``slices.read_index``. Only the listing is read when this is called.
    """
    from pkgrisk.sources import slices

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    opened = files if max_archive_bytes is None else files.filter(F.col("length") <= max_archive_bytes)
    size = slice_bytes or slices.SLICE_BYTES
    found = slices.read_index(
        slices.member_index(opened), slices.tasks_for(opened, size), max_file_bytes, zip_password, part_bytes, size
    )
    out = checked(found if part_bytes else found.drop("part"))
    if max_archive_bytes is None:
        return out
    closed = files.filter(F.col("length") > max_archive_bytes).selectExpr(
        "path AS archive", "cast(NULL AS string) AS member", "length AS size", "cast(NULL AS boolean) AS is_link",
        *(["-1 AS part"] if part_bytes else []), "cast(NULL AS binary) AS content", "'too_large' AS problem", "'too_large' AS reject_reason",
    )
    return out.unionByName(closed)


def strip_top_level(files: DataFrame, archive: str = "archive", path: str = "path") -> DataFrame:
    """Package-relative paths: below ``package/`` if present, else below the only top folder, else as they are."""
    top = f"IF(contains({path}, '/'), split({path}, '/')[0], NULL)"
    roots = files.groupBy(archive).agg(
        F.expr(f"bool_or(startswith({path}, 'package/')) AS _pkg"), F.expr(f"min({top}) AS _lo"), F.expr(f"max({top}) AS _hi")
    ).selectExpr(archive, "CASE WHEN _pkg THEN 'package/' WHEN _lo = _hi THEN concat(_lo, '/') ELSE '' END AS _root")
    joined = files.join(roots, archive)
    inside = joined.filter(f"startswith({path}, _root)")
    return inside.withColumn(path, F.expr(f"substring({path}, length(_root) + 1)")).drop("_root")


def read_package_tree(spark: SparkSession, root: str) -> DataFrame:
    """Unpacked packages below ``root``: first path segment is the archive, the rest the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = "substring(path, locate(:root, path) + length(:root))".replace(":root", "'" + root.rstrip("/") + "/'")
    split = files.selectExpr(f"{rel} AS rel", "content", "length AS size").selectExpr(
        "split(rel, '/')[0] AS archive", "substring(rel, locate('/', rel) + 1) AS path", "content", "size"
    )
    return strip_top_level(split)
