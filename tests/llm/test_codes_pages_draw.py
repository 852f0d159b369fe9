"""Vector codes, main text of pages and importance resampling against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from html import unescape

import numpy as np
import pytest
from brute import LOWER, NAME_WORD
from pyspark.sql import functions as F

from pkgrisk.llm import blocks, importance, mincut, pagetext, vectorcodes
from pkgrisk.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int"


# vector codes


def test_two_trees_give_the_nearest_entries():
    rng = np.random.default_rng(1)
    for positions, n, width, k in ((3, 1, 2, 1), (16, 300, 4, 64), (2, 37, 3, 5), (4, 900, 0, 3), (1, 5, 2, 7), (3, 200, 1, 64), (2, 700, 2, 33)):
        x = np.floor(rng.normal(0, 20, (positions, n, width))).astype(np.int64)
        x[:, : n // 3] = x[:, :1]  # equal parts, and with few values many equal distances
        e = x[:, rng.integers(0, n, k)] + rng.integers(-2, 3, (positions, k, width))
        found = vectorcodes.nearest(x, e)
        plain = ((x[:, :, None] - e[:, None]) ** 2).sum(-1).argmin(-1)
        assert (found.entry == plain).all()
        assert found.compared <= positions * n * k
        for p, j in itertools.product(range(positions), range(k)):
            own = x[p][plain[p] == j]
            assert found.count[p, j] == len(own) and (found.total[p, j] == own.sum(0)).all()


def test_apart_clusters_are_assigned_whole():
    rng = np.random.default_rng(2)
    centres = np.array([[[0, 0], [5000, 0], [0, 5000], [5000, 5000]]])
    x = np.concatenate([centres + rng.integers(-9, 10, (1, 4, 2)) for _ in range(256)], axis=1)
    found = vectorcodes.nearest(x, centres)
    assert found.whole == 1024 and found.compared == 0


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for v in ints] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def assign(p):
        out = []
        for v in cut[p]:
            d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            found = assign(p)
            for j in range(len(books[p])):
                own = [v for v, (k, _) in zip(cut[p], found) if k == j]
                if own:
                    books[p][j] = tuple(sum(c) // len(own) for c in zip(*own))
    last = [assign(p) for p in range(parts)]
    sums: dict = {}
    out = []
    for i, (vec_id, _, lab) in enumerate(kept):
        error = sum(last[p][i][1] for p in range(parts))
        sums[lab] = sums.get(lab, 0) + error
        out.append((vec_id, "".join("%02x" % last[p][i][0] for p in range(parts)), error, lab))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[lab], sha) for i, c, e, lab in out), key=repr)


@pytest.mark.parametrize("n", [150, 20])
def test_codes_equal_a_plain_version(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(None, rows[0][1], 0), rows[1], rows[1], (7000, None, 1), (7001, [None] + [0.1] * 31, 1), (7002, [float("nan")] + [0.1] * 31, 1)]
    rows += [(7003, [float("-inf")] + [0.1] * 31, 1), (7004, [0.0] * 32, None)]
    table = spark.createDataFrame(rows, VECTOR_SCHEMA).withColumn("code", F.lit("x")).withColumn("vector", F.lit(1)).withColumn("error", F.lit(2))
    got = vectorcodes.compress(table.repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    assert vectorcodes.compress(spark.createDataFrame([], VECTOR_SCHEMA)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, [], 1), (2, [1.0] * 15, 1)], VECTOR_SCHEMA)).count() == 0
    mixed = [(1, [0.5] * 16, 1), (2, [1.0] * 32, 1), (3, [1e30] * 16, 2), (4, [0.5] * 16, 1)]
    rows = vectorcodes.compress(spark.createDataFrame(mixed, VECTOR_SCHEMA)).orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == [1, 3, 4] and rows[0].code == rows[2].code and rows[0].error == 0


# main text


def test_cuts_are_smallest():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 8)
        s = [rng.randint(-5, 5) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 4)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(x):
            own = sum(abs(v) for v, t in zip(s, x) if v and (v > 0) != t)
            return own + sum(w for a, b, w in edges if x[a] != x[b])

        found = mincut.label(s, edges)
        best = min(itertools.product([False, True], repeat=n), key=lambda x: (cost(x), sum(x)))
        assert (cost(found), sum(found)) == (cost(best), sum(best))


def test_long_chains():
    scores = [300] * 20_000 + [-300] * 20_000
    found = mincut.label(scores, [(i, i + 1, 60) for i in range(len(scores) - 1)])
    assert found == [True] * 20_000 + [False] * 20_000


STORY = "This is a long sentence of the story, which goes on for quite some time and says something new. It has another one too. "
PAGES = {
    "hints": (
        f'<html><body class="home has-sidebar"><div id="header"><a href=/>Home</a> <a href=/x>About us</a></div><div class="cookie-notice">'
        f"<p>We use cookies to give you the best experience on our site, and by using it you accept them. Read more.</p></div>"
        f'<div class="wrap"><div class="post"><h1>Head line</h1><p>{STORY}</p><p>Short one.</p><h2>Sub</h2><ul><li>first point</li></ul></div>'
        f'<div class="sidebar"><h3>Recent</h3><ul><li><a href=a>Some other story</a></li></ul><p>{STORY}</p></div></div>'
        f'<div class="comments"><div class="comment"><p>{STORY}</p></div></div><div id="footer">Copyright Foo.</div></body></html>',
        ["Head line", STORY, "Short one.", "Sub", "first point"],
    ),
    "no hints": (
        f"<div><div><a href=1>One</a> | <a href=2>Two</a></div><div><h1>Title</h1><p>{STORY}</p><p>{STORY}</p><p>Yes.</p><p>{STORY}</p></div>"
        f"<div><p><a href=4>Read this next thing</a></p></div><div>(c) 2020 Foo</div></div>",
        ["Title", STORY, STORY, "Yes.", STORY],
    ),
    "forms": (
        f'<form id="all"><div class="menu"><a href=1>x</a></div><article><header><h1>T</h1><span>by J</span></header><p>{STORY}</p><aside><p>{STORY}</p>'
        f"</aside><form><label>Your mail</label><input><p>Subscribe to our letter for weekly news and more.</p><button>Go</button></form><p>{STORY}</p>"
        f"<footer>Tags: a, b</footer></article></form>",
        ["T", STORY, STORY],
    ),
    "broken": (
        f'<article><p>{STORY}<p>a &lt; b &amp; c&nbsp;d &#233; &hellip; < 3<script>var x="<p>no</p>"</script><!-- <p>c --><p>end <em>of</em><b>it</b>'
        f"<br>now\n\t there</article>",
        [STORY, "a < b & c d é … < 3", "end ofit now there"],
    ),
    "comments": (
        f'<main><article><h1>T</h1><p>{STORY}</p></article><section id="comments"><h2>Comments</h2><article class="comment"><p>{STORY}</p></article>'
        f"</section></main>",
        ["T", STORY],
    ),
    "not closed": (f'<article><p>{STORY}</p><p class="x', [STORY]),
    "no element": (STORY, [STORY]),
    "only a menu": ("<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>", []),
    "empty": ("", []),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_blocks(name):
    html, expected = PAGES[name]
    assert pagetext.main_blocks(html) == [t.strip() for t in expected]


def test_blocks_in_linear_time():
    for piece in ("<a ='", "<a", "<li>", "<div>", "</div", "<p>x", "<video>", "<!--", "&", "<b"):
        blocks.Page(piece * 30_000)


def plain_text(html: str) -> str:
    out = []
    for b in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", html, re.S)[1]):
        b = re.sub(r"[\x09-\x0D\x20\xA0]+", " ", unescape(b.replace("<b>", "").replace("<br>", " "))).strip()
        out += [b] if b else []
    return "\n".join(out)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = QUERIES["op12_main_text"](spark, SF).collect()
    assert len(rows) == len(html)
    assert all(r.text == plain_text(html[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_learnt_weights_agree_with_the_labels(spark):
    w = pagetext.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    assert w[pagetext.NAMES.index("links")] < 0 < w[pagetext.NAMES.index("length")]
    for html, expected in PAGES.values():
        assert pagetext.main_blocks(html, w) == [t.strip() for t in expected]


def test_odd_pages(spark):
    schema = "page_id long, url string, html string"
    rows = [(None, None, None), (1, "u", ""), (1, "u", f"<p>{STORY}</p>"), (1, "u", f"<p>{STORY}</p>"), (2, None, f"<p>{STORY * 3000}</p>")]
    table = spark.createDataFrame(rows, schema).withColumn("key", F.lit(1)).withColumn("text", F.lit("t")).withColumn("label", F.lit(0))
    got = [tuple(r) for r in pagetext.extract(table).collect()]
    story, long = STORY.strip(), (STORY * 3000).strip()
    assert sorted(got, key=repr) == sorted(
        [(None, None, "", 0), (1, "u", "", 0), (1, "u", story, len(story)), (1, "u", story, len(story)), (2, None, long, len(long))], key=repr
    )
    assert pagetext.extract(spark.createDataFrame([], schema)).count() == 0


# importance resampling


def grams(text, low, high):
    w = NAME_WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i:i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)], len(w)


def plain_draw(docs, target, low, high, buckets, percent, least):
    def count(texts):
        out = [0] * buckets
        for t in texts:
            for f in grams(t, low, high)[0]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log(((b + 1) * float(sum(s) + buckets)) / ((a + 1) * float(sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        own, n_words = grams(text, low, high)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words >= least])
    open_ = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(open_[: percent * len(open_) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("low,high,percent", [(1, 1, 10), (1, 3, 50), (2, 2, 100)])
def test_draw_equals_a_plain_version(spark, edge_docs, low, high, percent):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    rng = random.Random(4)
    docs += [(1000 + i, " ".join(rng.choice(["Alpha", "beta-x", "gamma", "é", "7"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("open", F.lit(1))
    target = ["alpha alpha beta", None, "", "é gamma x"]
    got = importance.importance_report(
        table.repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), importance.Features(low, high, 101), percent, 5
    )
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_draw(docs, target, low, high, 101, percent, 5)


def test_drawn_rows_and_empty_tables(spark, edge_docs, no_docs):
    target = spark.createDataFrame([("very long",)], "text string")
    out = importance.resampled(edge_docs.withColumn("_drawn", F.lit(1)), target, percent=100)
    assert out.columns == [*edge_docs.columns, "_drawn"]
    assert sorted(r.doc_id for r in out.collect()) == [100]
    assert importance.importance_report(no_docs, target).count() == 0
    assert importance.importance_report(edge_docs, target.limit(0)).count() == edge_docs.count()


def test_more_rows_fit_the_target_after_the_draw(spark):
    docs = [(i, ("alpha beta " if i % 5 == 0 else "gamma delta ") * 15) for i in range(1000)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    drawn = importance.resampled(table, spark.createDataFrame([("alpha beta alpha",)], "text string"))
    assert drawn.count() == 100 and drawn.where("doc_id % 5 = 0").count() == 100
