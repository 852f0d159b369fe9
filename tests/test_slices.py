"""Archives read by byte ranges."""

import io
import os
import random
import subprocess
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from pkgrisk.sources import archives, slices


def bodies(n=40, seed=5):
    rng = random.Random(seed)
    return {f"pkg/d{i % 3}/f{i}.bin": rng.randbytes(rng.choice([0, 1, 700, 40_000])) for i in range(n)}


def add(t, name, data):
    info = tarfile.TarInfo(name)
    info.size = len(data)
    t.addfile(info, io.BytesIO(data))


@pytest.fixture
def folder(tmp_path):
    own = bodies()
    root = tmp_path / "in" / "a b"
    os.makedirs(root)
    for kind, method in (("stored", zipfile.ZIP_STORED), ("deflated", zipfile.ZIP_DEFLATED), ("lzma", zipfile.ZIP_LZMA), ("bz", zipfile.ZIP_BZIP2)):
        with zipfile.ZipFile(root / f"{kind}.zip", "w", method) as z:
            z.mkdir("pkg")
            for name, data in own.items():
                z.writestr(name, data)
    for mode in ("", ":gz", ":bz2", ":xz"):
        for form in (tarfile.PAX_FORMAT, tarfile.GNU_FORMAT):
            with tarfile.open(root / f"t{mode[1:]}{form}.tar", f"w{mode}", format=form) as t:
                for name, data in own.items():
                    add(t, name, data)
    return str(tmp_path / "in"), own


def test_every_kind_of_archive(spark, folder):
    path, own = folder
    rows = archives.read_archives(spark, path, slice_bytes=50_000).collect()
    by = {}
    for r in rows:
        assert r.reject_reason is None and r.problem is None and r.size == len(r.content)
        by.setdefault(os.path.basename(r.archive), {})[r.member] = bytes(r.content)
    assert len(by) == 12 and all(found == own for found in by.values())


def test_one_archive_is_read_by_many_tasks(spark, folder):
    path, own = folder
    out = archives.read_archives(spark, path, slice_bytes=50_000).withColumn("task", F.spark_partition_id())
    tasks = {os.path.basename(r.archive): r.n for r in out.groupBy("archive").agg(F.countDistinct("task").alias("n")).collect()}
    assert tasks["stored.zip"] >= 4 and tasks["t1.tar"] >= 4 and tasks["tgz1.tar"] == 1


@pytest.mark.parametrize("part", [1, 999, 1 << 20])
def test_parts(spark, folder, part):
    path, own = folder
    small = [f for f in own if len(own[f]) < 1000]
    wanted = small if part == 1 else list(own)
    rows = archives.read_archives(spark, path, part_bytes=part).where(F.col("member").isin(wanted)).collect()
    by = {}
    for r in rows:
        assert len(r.content) <= part
        by.setdefault((r.archive, r.member), {})[r.part] = bytes(r.content)
    assert len(by) == 12 * len(wanted)
    for (_, member), parts in by.items():
        assert b"".join(parts[k] for k in range(len(parts))) == own[member]


def test_damaged_archives(spark, tmp_path):
    own = {"a.js": b"fine " * 500, "b.js": bytes(range(256)) * 40, "c.js": b"also fine"}
    root = tmp_path / "in"
    os.makedirs(root)
    with zipfile.ZipFile(root / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in own.items():
            z.writestr(name, data)
    raw = bytearray((root / "z.zip").read_bytes())
    at = raw.index(b"b.js") + 6
    raw[at:at + 60] = b"\xff" * 60
    (root / "z.zip").write_bytes(raw)
    with tarfile.open(root / "t.tar", "w") as t:
        for name, data in own.items():
            add(t, name, data)
    whole = (root / "t.tar").read_bytes()
    (root / "cut.tar").write_bytes(whole[:4096 + 3000])  # within the second member
    with tarfile.open(root / "g.tgz", "w:gz") as t:
        for name, data in own.items():
            add(t, name, data)
    packed = (root / "g.tgz").read_bytes()
    (root / "g.tgz").write_bytes(packed[: len(packed) // 2])
    (root / "no.zip").write_bytes(b"PK\x03\x04" + b"\x01" * 500)
    (root / "no.tar").write_bytes(b"not an archive at all")
    (root / "empty").write_bytes(b"")
    got = {}
    for r in archives.read_archives(spark, str(root)).collect():
        got.setdefault(os.path.basename(r.archive), []).append((r.member, r.reject_reason, r.content is not None))
    assert sorted(got["z.zip"]) == [("a.js", None, True), ("b.js", "unreadable", False), ("c.js", None, True)]
    assert sorted(got["t.tar"]) == [(n, None, True) for n in sorted(own)]
    assert ("a.js", None, True) in got["cut.tar"] and ("b.js", "unreadable", False) in got["cut.tar"]
    assert not any(n == "c.js" for n, _, _ in got["cut.tar"])
    assert any(reason == "unreadable" for _, reason, _ in got["g.tgz"])
    assert got["no.zip"] == got["no.tar"] == [(None, "unreadable", False)]


def test_limits_links_and_unsafe_names(spark, tmp_path):
    root = tmp_path / "in"
    os.makedirs(root)
    with tarfile.open(root / "t.tar", "w") as t:
        add(t, "ok", b"1")
        add(t, "../up", b"2")
        add(t, "big", b"z" * 99)
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    (root / "huge.zip").write_bytes(b"0" * 50_000)
    rows = archives.read_archives(spark, str(root), max_archive_bytes=20_000, max_file_bytes=50).collect()
    got = {r.member: (r.reject_reason, r.content) for r in rows}
    assert got == {"ok": (None, b"1"), "../up": ("parent_segment", None), "big": ("too_large", None), "l": ("link", None), None: ("too_large", None)}
    assert archives.read_archives(spark, str(root), 20_000, part_bytes=10).where("member = 'big'").count() == 10


def test_sparse_members(spark, tmp_path):
    """A file with holes, packed by the system's tar where there is one."""
    root = tmp_path / "in"
    os.makedirs(root)
    with open(tmp_path / "holes", "wb") as f:
        f.write(b"begin")
        f.seek(3_000_000)
        f.write(b"end")
        f.truncate(5_000_000)
    done = subprocess.run(["tar", "--sparse", "-cf", str(root / "s.tar"), "-C", str(tmp_path), "holes"], capture_output=True)
    if done.returncode or (root / "s.tar").stat().st_size > 1_000_000:
        pytest.skip("no sparse tar here")
    want = (tmp_path / "holes").read_bytes()
    (row,) = archives.read_archives(spark, str(root)).collect()
    assert bytes(row.content) == want
    parts = {r.part: bytes(r.content) for r in archives.read_archives(spark, str(root), part_bytes=999_999).collect()}
    assert b"".join(parts[k] for k in sorted(parts)) == want


def test_index_is_slim_and_memory_is_bounded(spark, tmp_path):
    """A zip larger than the memory that its reader may take: 400 MB of zeros in parts of 1 MB."""
    root = tmp_path / "in"
    os.makedirs(root)
    with zipfile.ZipFile(root / "z.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("zeros", "w") as f:
        for _ in range(400):
            f.write(bytes(1 << 20))
    index = slices.member_index(spark.createDataFrame([(str(root / "z.zip"),)], "path string"))
    assert [r.size for r in index.collect()] == [400 << 20]
    out = archives.read_archives(spark, str(root), part_bytes=1 << 20)
    assert out.agg(F.count(F.lit(1)), F.sum(F.length("content"))).first() == (400, 400 << 20)


def test_encrypted_members(spark, tmp_path):
    """Members under the old zip cipher, written here by its public description."""
    crc = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        crc[i] = c
    data, password = b"secret body " * 50, b"infected"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x.js", data)
    raw = buf.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        total = z.getinfo("x.js").CRC
    keys = [0x12345678, 0x23456789, 0x34567890]

    def step(b):
        keys[0] = keys[0] >> 8 ^ crc[(keys[0] ^ b) & 255]
        keys[1] = ((keys[1] + (keys[0] & 255)) * 134775813 + 1) & 0xFFFFFFFF
        keys[2] = keys[2] >> 8 ^ crc[(keys[2] ^ keys[1] >> 24) & 255]

    for b in password:
        step(b)
    out = bytearray()
    for b in bytes(11) + bytes([total >> 24]) + data:
        k = keys[2] | 2
        out.append(b ^ (k * (k ^ 1) >> 8 & 255))
        step(b)
    at = raw.index(data)
    raw = bytearray(raw[:at] + bytes(out) + raw[at + len(data):])
    raw[6] |= 1
    raw[18:22] = len(out).to_bytes(4, "little")
    entry = raw.index(b"PK\x01\x02")
    raw[entry + 8] |= 1
    raw[entry + 20:entry + 24] = len(out).to_bytes(4, "little")
    end = raw.index(b"PK\x05\x06")
    raw[end + 16:end + 20] = entry.to_bytes(4, "little")
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "e.zip").write_bytes(raw)
    (row,) = archives.read_archives(spark, str(tmp_path / "in"), zip_password="infected").collect()
    assert bytes(row.content) == data
    (row,) = archives.read_archives(spark, str(tmp_path / "in")).collect()
    assert row.reject_reason == "unreadable" and "password" in row.problem
