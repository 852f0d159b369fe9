"""Sharding and mixing."""

import random
import zlib

import numpy as np
import pytest
from brute import DOC_SCHEMA, SPACE_WORD
from pyspark.sql import functions as F

from pkgrisk.llm import mixing, sharding


def best_capacity(sizes: list[int], shards: int) -> int:
    """Least largest sum over all contiguous partitions."""
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    best = list(prefix)
    for _ in range(shards - 1):
        best = [min(max(best[k], prefix[n] - prefix[k]) for k in range(n + 1)) for n in range(len(prefix))]
    return int(best[-1])


def test_smallest_capacity_and_cuts():
    rng = random.Random(1)
    for _ in range(200):
        sizes = np.array([rng.choice([1, 5, 17, 40, 100]) for _ in range(rng.randint(1, 25))])
        shards = rng.randint(1, 8)
        capacity = sharding.smallest_capacity(sizes, shards)
        assert capacity == best_capacity(sizes.tolist(), shards)
        ends = sharding.contiguous_cuts(sizes, shards)
        assert len(ends) == shards and ends[-1] == len(sizes) and ends == sorted(ends)
        assert all(sizes[a:b].sum() <= capacity for a, b in zip([0, *ends], ends))


def test_large_units_get_shards_of_their_own():
    sizes = np.array([10] * 50 + [5000, 3000] + [10] * 48)
    plan = sharding.plan_units(np.arange(100), sizes, 10)
    assert plan.alone == [50, 51] and len(plan.firsts) == 7 and plan.capacity <= 130
    assert sharding.plan_units(np.zeros(0, np.int64), np.zeros(0, np.int64), 4).firsts == [1 << 62] * 3


def texts():
    rng = random.Random(2)
    out = {i: "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 400))) for i in range(1500)}
    out |= {2000 + i: "a very frequent text " * 5 for i in range(700)} | {3000: None, 3001: None, 3002: ""}
    return out


def test_shard_report(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    own = texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in own.items()], DOC_SCHEMA)
    rows = sharding.shard_report(docs.repartition(5), 40).collect()
    assert sorted(rows) == sorted(sharding.shard_report(docs.repartition(3), 40).collect())
    shard_of, slots, sizes = {}, {}, {}
    for r in rows:
        t = own[r.doc_id]
        assert r.size == len((t or "").encode()) + 16
        assert r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert shard_of.setdefault(t, r.shard) == r.shard and r.grown_shard is None and r.law == "bytes"
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = shard_of["a very frequent text " * 5]
    rest = [sizes.get(k, 0) for k in range(40) if k != hot]
    assert max(rest) <= sum(rest) / 39 + 420 and min(rest) >= sum(rest) / 39 - 420


def plan_mentions(df, word: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_large_shards_do_not_repeat_the_shard_expression(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts().items()], DOC_SCHEMA)
    sharded = sharding.assign_shards(docs, 12)
    small = plan_mentions(sharding.number_slots(sharded), "xxhash64")
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    large = sharding.number_slots(sharded)
    assert plan_mentions(large, "xxhash64") <= 2 * small
    rows = large.withColumn("h", F.xxhash64("doc_id", "text")).collect()
    total = {s: sum(r.shard == s for r in rows) for s in {r.shard for r in rows}}
    assert sum(n > 20 for n in total.values()) > 5
    # buckets of the hash one after another, each in the order of the hash
    wanted = sorted(rows, key=lambda r: (r.shard, r.h % -(-total[r.shard] // 20), r.h))
    assert [r.slot for r in wanted] == [k for _, n in sorted(total.items()) for k in range(n)]


def test_shard_report_of_large_shards_has_a_bounded_plan(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts().items()], DOC_SCHEMA)
    small = plan_mentions(sharding.shard_report(docs, 12), "xxhash64")
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    assert plan_mentions(sharding.shard_report(docs, 12), "xxhash64") <= 2 * small


def test_shard_edges(spark, edge_docs, no_docs):
    out = sharding.number_slots(sharding.assign_shards(edge_docs.withColumn("_n", F.lit(1)).withColumn("slot", F.lit(-1)), 3))
    assert out.count() == edge_docs.count() and {c for c in out.columns} == {*edge_docs.columns, "_n", "shard", "slot"}
    assert out.where("slot < 0").count() == 0
    assert sharding.shard_report(no_docs, 3).count() == 0


def reference_shares(sizes, weights, total):
    """The excess shared again by weight, round after round."""
    out, full = [0.0] * len(sizes), set()
    left = total
    while len(full) < len(sizes):
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        for i in range(len(sizes)):
            if i not in full:
                out[i] = left * weights[i] / w
        above = [i for i in range(len(sizes)) if i not in full and out[i] > 2 * sizes[i]]
        if not above:
            break
        for i in above:
            out[i] = 2.0 * sizes[i]
            full.add(i)
            left -= out[i]
    return out


def test_share_out():
    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.choice([0, 1, 10, 100, 5000]) for _ in range(rng.randint(1, 9))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        got = mixing.share_out(sizes, weights, 1.5 * sum(sizes))
        assert got == pytest.approx(reference_shares(sizes, weights, 1.5 * sum(sizes)))
        assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "ß", "é", "Z", None])
        rows.append((i, rng.choice(["w", "w v", "w "]) * rng.randint(0, 40), "en", source, 0))
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    got = mixing.mix_report(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs.repartition(4)).collect()))
    by_id = {r[0]: r for r in rows}
    size, taken, target = {}, {}, {}
    for r in got:
        n = len(SPACE_WORD.findall(by_id[r.doc_id][1]))
        assert r.size == n and 0 <= r.taken <= 2 * n and (n == 0 or r.taken % n == 0)
        s = by_id[r.doc_id][3]
        size[s], taken[s] = size.get(s, 0) + n, taken.get(s, 0) + r.taken
        assert target.setdefault(s, (r.source_size, r.target)) == (r.source_size, r.target)
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    wanted = reference_shares([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))
    for s, w in zip(order, wanted):
        assert target[s][0] == size[s] and target[s][1] == pytest.approx(w)
        assert abs(taken[s] - w) <= 40  # half of the largest document


def test_larger_budgets_only_add_documents(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 30), "en", "ab"[i % 2], 0) for i in range(600)], DOC_SCHEMA)
    small, large = ({(r.doc_id, k) for r in mixing.mixed(docs, share=share).groupBy("doc_id").count().collect() for k in range(r["count"])} for share in (0.4, 1.1))
    assert small < large


def test_mix_edges(spark, edge_docs, no_docs):
    wide = edge_docs.withColumn("target", F.lit(1)).withColumn("_source", F.lit(2)).withColumn("below", F.lit(3))
    assert mixing.mixed(wide).columns == wide.columns
    assert mixing.mix_report(edge_docs).count() == edge_docs.count()
    assert mixing.mix_report(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
