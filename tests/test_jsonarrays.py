"""JSON arrays cut by byte ranges: the same records as a parse in one piece, wherever the slices fall."""

import io
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pkgrisk.sources import jsonarrays, lines


def cut(raw: bytes, slice_bytes: int, limit: int = 1 << 30):
    """All slices of one file, states by a plain walk over the bytes."""
    out, n = [], len(raw)
    first = jsonarrays.first_bracket(io.BytesIO(raw), n) if n > slice_bytes else None
    for k in range(-(-n // slice_bytes)):
        start, inside, depth, escaped = k * slice_bytes, 0, 0, False
        for b in raw[:start]:
            if escaped:
                escaped = False
            elif b == 92:
                escaped = True
            elif b == 34:
                inside ^= 1
            elif not inside:
                depth += int(jsonarrays.STEP[b])
        row = {"slice": k, "start": start, "end": min(n, start + slice_bytes), "length": n, "in_string": inside, "depth": depth, "first": first}
        out += jsonarrays.elements(io.BytesIO(raw), row, limit)
    return out


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(alphabet='ab"\\[]{},: \né', max_size=8),
    lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(alphabet='k"\\,]', max_size=3), v, max_size=3), max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(st.lists(VALUES, max_size=6), st.integers(1, 40), st.sampled_from([None, 1]), st.booleans())
def test_any_slices_give_all_elements_in_order(values, slice_bytes, indent, ascii_only):
    raw = (" " * (slice_bytes % 3) + json.dumps(values, indent=indent, ensure_ascii=ascii_only) + "\n").encode()
    found = cut(raw, slice_bytes)
    assert [json.loads(text) for _, text, problem in found] == values
    assert all(problem is None for _, _, problem in found)
    assert [at for at, _, _ in found] == sorted({at for at, _, _ in found})


@pytest.mark.parametrize("raw,good,problems", [
    (b"[]", [], 0), (b" [ \n ] ", [], 0), (b"[1,2", [b"1"], 1), (b"[1,2] x", [b"1", b"2"], 1), (b"[1][2]", [b"1"], 1),
    (b"[1}", [b"1"], 1), (b"[", [], 1), (b'["a', [], 1), (b"   ", [], 0), (b'{"a": [1, 2]}', [b'{"a": [1, 2]}'], 0),
    (b"[1,]", [b"1", b""], 0), (b"[,1]", [b"", b"1"], 0), (b'["\\\\",1]', [b'"\\\\"', b"1"], 0), (b'[{"a":1} {"b":2}]', [b'{"a":1} {"b":2}'], 0),
])
def test_damaged_and_small_files(raw, good, problems):
    found = cut(raw, 1000)
    assert [t for _, t, p in found if p is None] == good
    assert sum(p is not None for _, _, p in found) == problems
    for size in (1, 2, 3, 5):  # a slice edge changes neither the good elements nor whether the file is good
        other = cut(raw, size)
        assert [t for _, t, p in other if p is None][:len(good)] == good
        assert any(p is not None for _, _, p in other) == (problems > 0)


def test_elements_beyond_the_limit_are_told():
    found = cut(json.dumps(["a" * 50, 1, "b" * 7]).encode(), 9, limit=20)
    assert [(t, p) for _, t, p in found] == [(None, "too_large"), (b" 1", None), (b' "bbbbbbb"', None)]


def test_runs_of_backslashes_across_steps(monkeypatch):
    monkeypatch.setattr(jsonarrays, "STEP_BYTES", 3)
    for n in range(9):
        values = ["\\" * n + '"', "\\" * n, {"k\\" * n: ["," * n]}]
        raw = json.dumps(values).encode()
        for size in (1, 4, 7):
            assert [json.loads(t) for _, t, _ in cut(raw, size)] == values


def test_scan_of_nothing():
    for odd in (False, True):
        at, before, n, after = jsonarrays.scan(np.zeros(0, np.uint8), odd)
        assert not len(at) and not n and after == odd


def test_files_read_by_several_tasks_equal_the_whole_parse(spark, tmp_path):
    rng = random.Random(3)
    root = tmp_path / "in"
    root.mkdir()
    for k in range(6):
        records = [{"id": i, "text": rng.choice(['a"b', "x\\", "[{,", "é\n"]) * rng.randint(0, 30), "n": [i, {"m": None}]} for i in range(k * 40)]
        (root / f"f{k}.json").write_text(json.dumps(records, indent=k % 2 or None), encoding="utf-8")
    (root / "one.json").write_text('{"id": "' + "y" * 900 + '"}')
    (root / "blank.json").write_text("  \n")
    (root / "empty.json").write_text("")
    (root / "bad.json").write_text('[{"id": 1}, {"id": 2')
    (root / "worse.json").write_text('[{"id": 1}, {"id": 2}, {id: 3}]')
    spark_rows = jsonarrays.read_json_records(spark, str(root), slice_bytes=1500).selectExpr(
        "regexp_extract(path, '[^/]*$', 0) AS name", "to_json(rec) AS rec", "problem"
    ).collect()
    whole = lines.parse_json_documents(
        spark.read.text(str(root), wholetext=True).selectExpr("value", "_metadata.file_name AS name")
    ).selectExpr("name", "to_json(rec) AS rec").collect()
    damaged = ("bad.json", "worse.json")
    assert sorted((r.name, r.rec) for r in spark_rows if r.name not in damaged) == sorted((r.name, r.rec) for r in whole)
    assert sorted((r.name, r.rec or r.problem) for r in spark_rows if r.name in damaged) == [
        ("bad.json", "file ends inside the array"), ("bad.json", '{"id":1}'), ("worse.json", "bad JSON"),
        ("worse.json", '{"id":1}'), ("worse.json", '{"id":2}'),
    ]
    strict = jsonarrays.read_json_records(spark, str(root), slice_bytes=1500, whole_files=True)
    assert strict.filter("problem IS NULL").count() == len(whole)
    assert strict.filter("problem IS NOT NULL").count() == 2


def test_one_file_comes_from_several_tasks(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(list(range(2000))))
    files = spark.createDataFrame([(str(path), path.stat().st_size, 1), (str(path), path.stat().st_size, 2), (None, 5, 3)], "path string, length long, slice int")
    out = jsonarrays.cut_arrays(files, slice_bytes=1000)
    rows = out.selectExpr("at", "cast(cast(value AS string) AS int) AS n", "spark_partition_id() AS task").collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.at)] == list(range(2000))
    assert len({r.task for r in rows}) > 2
    assert jsonarrays.cut_arrays(files.limit(0), slice_bytes=1000).count() == 0


def test_short_slices_share_tasks(spark):
    from pkgrisk.sources.slices import TASK_BYTES, tasks_for

    few = 2 * spark.sparkContext.defaultParallelism
    files = spark.createDataFrame([("a", 5 * TASK_BYTES), ("b", 100)], "path string, length long")
    assert tasks_for(files, 1 << 18) == max(few, 6) and tasks_for(files, 4 * TASK_BYTES) == 2
    assert tasks_for(files.filter("path = 'b'"), 10) == min(few, 10) and tasks_for(files.filter("false"), 10) == 1
