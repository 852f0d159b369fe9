"""Bloom filter of keys: never misses a key, lets few others pass, and keeps their rows out of shuffles."""

import pytest
from pyspark.sql import functions as F

from pkgrisk.operators import keyfilter, labels, treediff


def test_no_key_is_missed_and_few_others_pass(spark):
    keys = spark.range(60_000).selectExpr("IF(id % 7 = 0, NULL, concat('k', id)) AS a", "id % 5 AS b")
    wanted = keys.filter("b = 3")
    passed = keyfilter.maybe_in(keys, keyfilter.key_filter(wanted, ["a", "b"]), ["a", "b"])
    assert passed.columns == keys.columns
    assert passed.filter("b = 3").count() == wanted.count()
    assert passed.filter("b <> 3").count() < 60
    table = keyfilter.key_filter(keys, ["a", "b"])
    size = table.agg(F.count("*").alias("n"), F.max(F.octet_length("_f_bits")).alias("bytes")).first()
    assert size["n"] <= keyfilter.BLOCKS and size["bytes"] == keyfilter.BLOCK_BITS // 8


@pytest.mark.parametrize("blocks", [1, 4096])
def test_a_full_filter_stays_exact_after_the_join(spark, monkeypatch, blocks):
    monkeypatch.setattr(keyfilter, "BLOCKS", blocks)
    done = spark.range(40_000).selectExpr("id AS k", "id * 2 AS v")
    cases = spark.range(30_000, 50_000).selectExpr("id AS k")
    assert labels.incremental(cases, done, ["k"]).count() == 10_000
    cached = labels.with_cached(labels.incremental(cases, done, ["k"]), done, cases, ["k"])
    assert cached.filter("cached").agg(F.count("*"), F.sum("v")).first()[:] == (10_000, sum(2 * k for k in range(30_000, 40_000)))


def test_empty_sides_repeats_and_other_types(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "k int, t string")
    none = rows.limit(0)
    assert keyfilter.prefilter(rows, none, ["k"]).count() == 0
    assert keyfilter.prefilter(none, rows, ["k"]).count() == 0
    assert keyfilter.prefilter(rows, rows, ["k"]).count() == 3
    assert keyfilter.prefilter(rows, rows.selectExpr("cast(k AS long) AS k"), ["k"]) is rows


def tree(spark, n, changed):
    return spark.range(n).selectExpr(
        "concat('case', id % 3) AS case_id", "concat('p/', id, '.js') AS path",
        f"concat(repeat(sha2(cast(id AS string), 256), 30), IF({changed}, 'changed', '')) AS content",
    )


def exchanges(node):
    """(kind, bytes) of the exchanges in a plan that has run."""
    kind = node.nodeName()
    if kind == "AdaptiveSparkPlan":
        yield from exchanges(node.executedPlan())
    elif kind.endswith("QueryStage"):
        yield from exchanges(node.plan())
    elif kind == "ReusedExchange":
        yield kind, 0
    else:
        if kind == "Exchange":
            yield kind, node.metrics().apply("dataSize").value()
        children = node.children()
        for k in range(children.size()):
            yield from exchanges(children.apply(k))


def test_contents_of_unchanged_files_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, after = tree(spark, 6000, "false"), tree(spark, 6000, "id % 500 = 1")
        changes = treediff.diff_trees(before, after, with_text=True)
        rows = changes.collect()
        assert len(rows) == 12
        for r in rows:
            assert r.change_kind == "modified" and r.text_after == r.text_before + "changed"
            assert (r.size_before, r.size_after, r.oversize) == (1920, 1927, False)
        found = list(exchanges(changes._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # 6,000 contents of 1,920 bytes a side; shuffled are two digests a file and the contents of 12 files
    assert sum(n for _, n in found) < 4_000_000, found
    assert sum(kind == "ReusedExchange" for kind, _ in found) >= 2, found
