"""Numbered parts give the whole joined text, whatever the cuts."""

import random

import pytest

from pkgrisk.operators import parts, treediff


def joined(rows, group, separator):
    out = {}
    for r in sorted(rows, key=lambda r: r.part):
        out.setdefault(r[group], []).append(r.text)
    return {g: separator.join(t) for g, t in out.items()}


@pytest.mark.parametrize("part_chars,separator", [(1, ""), (40, "|"), (10_000_000, "\n\n")])
def test_parts_rebuild_the_text_of_hot_and_small_groups(spark, part_chars, separator):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "é", None]), i, rng.choice(["", "a", "é\U0001f600" * 9, "long " * 40, None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, i int, text string").repartition(5)
    found = parts.text_parts(df, ["g"], ["i"], "text", part_chars, separator).collect()
    want = {}
    for g, i, t in rows:
        if t is not None:
            want.setdefault(g, []).append(t)
    assert joined(found, "g", separator) == {g: separator.join(t) for g, t in want.items()}
    assert len({(r.g, r.part) for r in found}) == len(found)
    assert sum(r.n_blocks for r in found) == sum(len(t) for t in want.values())
    assert all(r.n_blocks == 1 or len(r.text) <= part_chars for r in found)


def test_a_group_comes_from_several_tasks(spark):
    df = spark.range(20_000).selectExpr("1 AS g", "id", "concat('<', id, '>') AS t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be merged
    try:
        found = parts.text_parts(df, ["g"], ["id"], "t", 5_000).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part >> 32 for r in found}) > 1
    assert joined(found, "g", "")[1] == "".join(f"<{i}>" for i in range(20_000))


def test_ties_repeats_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("a", 1, "x"), ("a", None, "z")], "part string, n_blocks int, _block string")
    row, = parts.text_parts(df, ["part"], ["n_blocks"], "_block", 100).collect()
    assert tuple(row)[0] == "a" and tuple(row)[2:] == (4, "zxxy")
    assert parts.text_parts(df.limit(0), ["part"], ["n_blocks"], "_block").count() == 0


def test_diff_parts_equal_the_packed_text(spark):
    changes = spark.range(300).selectExpr(
        "concat('c', id % 2) AS case_id", "concat('p', id, '.js') AS path", "'modified' AS change_kind", "repeat('+x', cast(id AS int)) AS unified_diff"
    )
    whole = {r.case_id: r.diff_text for r in treediff.pack_blocks(changes).collect()}
    found = parts.diff_parts(changes, 1000).collect()
    assert joined(found, "case_id", "") == whole and len(found) > 20


def test_record_parts_head_every_file(spark):
    files = spark.createDataFrame([("p", "b.js", "2"), ("p", "a.js", "1"), ("q", "c.js", None)], "package string, path string, content string")
    row, = parts.record_parts(files).collect()
    assert (row.package, row.n_blocks, row.text) == ("p", 2, "// === a.js ===\n1\n\n// === b.js ===\n2")
