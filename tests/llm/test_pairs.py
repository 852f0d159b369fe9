"""Near duplicates, decontamination and line dedup against brute force."""

import random

import numpy as np
import pytest
from brute import DOC_SCHEMA, NAME_WORD, edited, groups, prose, shingles
from pyspark.sql import functions as F

from pkgrisk.llm import decontaminate, linededup, neardup
from pkgrisk.llm.components import components
from pkgrisk.llm.flat import distinct


def family(seed: int, n: int, rate: float) -> dict[int, str]:
    rng = random.Random(seed)
    base = prose(rng, 120)
    return {i: " ".join(edited(rng, base, rng.random() * rate)) for i in range(n)}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOC_SCHEMA)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    texts = {i: " ".join(prose(random.Random(i), 5 + i)) for i in range(40)}
    for k, (n, rate) in enumerate(((40, 0.12), (30, 0.3), (25, 0.02))):
        texts |= {1000 * (k + 1) + i: t for i, t in family(k, n, rate).items()}
    texts |= {5000 + i: texts[1000] for i in range(30)} | {6000: None, 6001: "", 6002: "One", 6003: "one", 6004: "one two", 6005: " ONE  two\n"}
    for chunk in (neardup.CHUNK, 4):  # the second compares buckets chunk by chunk
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        for width in (2, 5):
            rows = neardup.near_duplicates(frame(spark, texts), width=width).collect()
            assert {r.doc_id: r.component_id for r in rows} == groups(texts, width)
            assert {r.doc_id: r.n_shingles for r in rows} == {k: len(shingles(t, width)) for k, t in texts.items()}


def test_one_row_of_each_group_stays(spark):
    """Repeated rows and ids, rows without id, clashing column names, ids of another type."""
    text, other = "one two three four five six seven eight", "quite another text of some words here"
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text), (3, other), (3, other + " x"), (None, "third text that stands alone here"),
            (None, "third text that stands alone here"), (None, None), (None, ""), (4, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC_SCHEMA)
    for c in ("_gone", "_again", "_key", "_row", "h", "rep", "component_id", "members"):
        docs = docs.withColumn(c, F.lit(1))
    out = neardup.without_near_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert [g[0] for g in got].count(3) == 1 and got.count((1, text)) == 1 and got.count((None, "third text that stands alone here")) == 1
    assert {g[0] for g in got} == {1, 3, 4, 5, None} and sum(g[0] is None for g in got) == 2 and len(got) == 6
    with pytest.raises(ValueError, match="whole number"):
        neardup.near_duplicates(docs.withColumn("doc_id", F.lit("a")))


def test_recall_of_exact_links_at_both_widths(spark):
    """Copies with edits on either side of the threshold: every pair at or above it is linked, at two words and five."""
    rng = random.Random(77)
    texts = {}
    for i in range(250):
        base = prose(rng, rng.randint(40, 160))
        texts[2 * i] = " ".join(base)
        texts[2 * i + 1] = " ".join(edited(rng, base, rng.random() * 0.08))
    for width in (2, 5):
        rows = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts), width=width).collect()}
        linked = total = 0
        for i in range(250):
            a, b = shingles(texts[2 * i], width), shingles(texts[2 * i + 1], width)
            near = 100 * len(a & b) >= 80 * len(a | b)
            total += near
            linked += near and rows[2 * i] == rows[2 * i + 1]
            assert near or rows[2 * i] != rows[2 * i + 1]
        assert linked == total and 50 < total < 250, (width, linked, total)


def test_a_chain_of_copies_is_one_component(spark):
    words = prose(random.Random(3), 100)
    texts = {}
    for i in range(12):  # each differs from the next a little, the ends a lot
        texts[i] = " ".join(words)
        words = words[:8 * i] + prose(random.Random(100 + i), 4) + words[8 * i + 4:]
    assert groups(texts, 2)[11] == 0 and len(shingles(texts[0], 2) & shingles(texts[11], 2)) < 60
    assert {r.component_id for r in neardup.near_duplicates(frame(spark, texts), width=2).collect()} == {0}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for overlap in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(20):
            n = 600
            same = int(2 * n * overlap / (1 + overlap))
            both = rng.integers(0, 1 << 63, 2 * n - same, dtype=np.uint64)
            a, b = np.sort(both[:n]), np.sort(both[n - same:])
            union = neardup.sketch(np.sort(np.unique(both)), np.array([len(np.unique(both))]))
            s = neardup.sketch(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert (neardup.merge(s[:1], s[1:]) == union).all()
            errors.append(float(neardup.likely_similarity(s[:1], s[1:], np.array([600.0]), np.array([600.0]))[0]) - overlap)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < neardup.SLACK


def test_near_duplicate_edges(spark, edge_docs, no_docs):
    rows = neardup.near_duplicates(edge_docs, width=5).collect()
    assert len(rows) == edge_docs.count()
    assert {r.component_id for r in rows if r.n_shingles == 0 and r.doc_id is not None} == {r.doc_id for r in rows if r.n_shingles == 0 and r.doc_id is not None}
    kept = neardup.without_near_duplicates(edge_docs.withColumn("n", F.lit(1)).withColumn("key", F.lit(2)).withColumn("rep", F.lit(3)))
    assert kept.columns[-3:] == ["n", "key", "rep"] and kept.where("doc_id IS NULL").count() == 2
    assert neardup.near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    label = {k: k for e in edges for k in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found.get(k, k) == v for k, v in label.items())


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    items = {i: " ".join(prose(rng, n)) for i, n in enumerate((3, 5, 6, 9, 17, 40, 70, 130, 40, 12, 4, 2, 1))} | {20: None, 21: "", 22: "..."}
    items[23] = items[4].upper() + "!"  # an equal set
    docs = {}
    for i in range(150):
        words = prose(rng, rng.randint(0, 400))
        item = items[rng.choice(list(items))] or ""
        docs[i] = " ".join(words[: len(words) // 2] + edited(rng, item.split(), rng.random() * 0.06) + words[len(words) // 2:])
    docs |= {200: items[0], 201: items[0] + "!", 202: None, 203: "", 204: items[6] + " " + items[6]}
    expected = set()
    for d, t in docs.items():
        for i, item in items.items():
            s = shingles(item, 5, NAME_WORD)
            own = shingles(t, min(5, len(next(iter(s), ()))) or 5, NAME_WORD)
            if s and 100 * len(s & own) >= 80 * len(s):
                expected.add((d, i, len(s), len(s & own)))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (decontaminate.BLOCK_SHINGLES, 30):  # the second takes several passes
        rows = decontaminate.contaminated(frame(spark, docs), bench, block=block).collect()
        assert {tuple(r)[:4] for r in rows} == expected and len(rows) == len(expected)
        clean = decontaminate.without_items(frame(spark, docs), bench, block=block)
        assert {r.doc_id for r in clean.collect()} == set(docs) - {e[0] for e in expected}
    assert len(expected) > 40


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(None, "no id here at all today"), (1, None), (2, "very long very long very long")], "item_id long, text string")
    pairs = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(edge_docs, bench).collect()}
    assert pairs == {(None, None), (100, 2)}
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(edge_docs, bench.limit(0)).count() == 0
    wide = edge_docs.withColumn("item_id", F.lit(1)).withColumn("containment", F.lit(2))
    assert decontaminate.without_items(wide, bench).columns == wide.columns


def lines_brute(texts: dict[int, str | None]) -> dict[int, tuple[int, int, str]]:
    from brute import LOWER

    def key(line: str) -> str:
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders: dict[str, set[int]] = {}
    for d, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(prose(rng, rng.randint(1, 6))) for _ in range(300)]
    texts = {}
    for i in range(200):
        lines = [rng.choice(pool) if rng.random() < 0.3 else " ".join(prose(rng, 5)) for _ in range(rng.randint(0, 12))]
        lines = [x.upper() if rng.random() < 0.1 else f" {x}\t\r" if rng.random() < 0.1 else x for x in lines]
        texts[i] = "\n".join(lines + ["the very common line"] * (i % 3 == 0))
    texts |= {300: None, 301: "", 302: "\n\n", 303: "üüüüüüüüü\nüüüüüüüüüü", 304: "ÜÜÜÜÜÜÜÜÜÜ\nüüüüüüüüüü\n"}
    for filter_bytes in (linededup.FILTER_BYTES, 1):  # the second filter is far too small: more suspects, the same result
        rows = linededup.dedup_lines(frame(spark, texts), filter_bytes=filter_bytes).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in rows} == lines_brute(texts)


def test_line_filter_never_misses_a_repeat():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    once, twice = np.zeros(1 << 10, np.uint8), np.zeros(1 << 10, np.uint8)
    at = linededup.bits_of(values, 1 << 13)
    linededup.set_bits(once, at.ravel())
    assert linededup.has_bits(once, at).all() and not linededup.has_bits(twice, at).any()
    assert distinct(np.array([3, 1, 1, 2], np.uint64), np.array([3, 0, 1]))[1].tolist() == [2, 0, 1]


def test_line_dedup_edges(spark, edge_docs, no_docs):
    rows = linededup.dedup_lines(edge_docs.withColumn("keys", F.lit(1)).withColumn("of", F.lit(2))).collect()
    assert len(rows) == edge_docs.count()
    assert [r.n_lines for r in rows if r.doc_id == 0] == [1]
    assert linededup.dedup_lines(no_docs).count() == 0
