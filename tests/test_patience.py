"""Line alignment against plain properties and exact alignments."""

import random
import time

import numpy as np
import pytest

from pkgrisk.functions import patience
from pkgrisk.operators import treediff


def aligned(a, b):
    return patience.align(np.array(a, np.int64), np.array(b, np.int64))


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.mark.parametrize("values", [2, 5, 40, 1000])
def test_alignments_are_valid_and_rebuild_the_text(values):
    rng = random.Random(values)
    lost = total = 0
    for _ in range(150):
        a = [rng.randrange(values) for _ in range(rng.randrange(80))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            i = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b[i:i] = [rng.randrange(values) for _ in range(rng.randrange(6))]
            else:
                del b[i:i + rng.randrange(6)]
        match = aligned(a, b)
        at = np.flatnonzero(match >= 0)
        assert (np.diff(match[at]) > 0).all() and all(a[i] == b[match[i]] for i in at)
        runs = patience.edits(match, len(b))
        out, i, j = [], 0, 0
        for equal, p, q, c, d in runs:
            assert (p, c) == (i, j)
            out += a[p:q] if equal else b[c:d]
            i, j = q, d
        assert out == b and (i, j) == (len(a), len(b))
        lost += common(a, b) - len(at)
        total += len(a)
    assert lost <= 0.06 * total


def test_small_gaps_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(20))] for _ in range(2))
        assert (aligned(a, b) >= 0).sum() == common(a, b)


def test_unique_lines_are_anchors():
    """A moved brace does not tear two functions apart."""
    before = ["f", "{", "x", "}", "", "g", "{", "y", "}"]
    after = ["g", "{", "y", "}", "", "h", "{", "z", "}", "", "f", "{", "x", "}"]
    a, b = patience.number_lines(before * 6, after * 6)
    match = patience.align(a, b)
    at = np.flatnonzero(match >= 0)
    assert (np.diff(match[at]) > 0).all() and len(at) >= 20


def test_longest_increasing_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        v = rng.sample(range(50), rng.randrange(30))
        got = [v[i] for i in patience.increasing(v)]
        assert got == sorted(got)
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(got) == max(best, default=0)


@pytest.mark.parametrize("kind", ["unique", "repeated", "shuffled", "reversed", "all equal"])
def test_a_million_lines(kind):
    rng = np.random.default_rng(3)
    n = 1_000_000
    a = {"unique": np.arange(n), "repeated": rng.integers(0, 1000, n), "shuffled": np.arange(n), "reversed": np.arange(n), "all equal": np.zeros(n, np.int64)}[kind]
    b = np.delete(a, rng.integers(0, n, 500))
    if kind == "shuffled":
        b = rng.permutation(b)
    elif kind == "reversed":
        b = b[::-1]
    b = np.insert(b, rng.integers(0, len(b), 500), n + np.arange(500))
    start = time.time()
    match = patience.align(a, b)
    runs = patience.edits(match, len(b))
    assert time.time() - start < 60
    assert runs[-1][2] == n and runs[-1][4] == len(b)
    if kind == "unique":
        assert (match >= 0).sum() == len(np.intersect1d(a, b))


def test_groups_and_counts():
    before = "".join(f"line {i}\n" for i in range(40))
    after = before.replace("line 3\n", "line 3x\n").replace("line 8\n", "").replace("line 30\n", "line 30\nnew\n")
    text, added, removed = treediff.aligned_changes("f", before, after)
    assert (added, removed) == (2, 2)
    assert [x for x in text.split("\n") if x.startswith("@@")] == ["@@ -1,12 +1,11 @@", "@@ -29,6 +28,7 @@"]
    assert treediff.aligned_changes("f", before, before) == ("", 0, 0)
    assert treediff.aligned_changes("f", "", "a\nb") == ("--- a/f\n+++ b/f\n@@ -0,0 +1,2 @@\n+a\n+b", 2, 0)


def test_edits_rebuild_every_kind_of_line_end(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\n\n\x0bd\x0ce\x1cf\x85g h \n", "x\ny\nz", "é\n" * 50, None, "\r\n\r\n", "q\r"]
    rows = [(f"{i}-{j}", "p", a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    df = spark.createDataFrame(rows, "case_id string, path string, text_before string, text_after string")
    edits = treediff.line_edits(df.withColumn("edits_", df.path)).select("case_id", "edits").join(df, "case_id")
    for r in edits.selectExpr("case_id", "text_after", f"{treediff.apply_edits('text_before')} AS made").collect():
        assert r.made == (r.text_after or ""), r
