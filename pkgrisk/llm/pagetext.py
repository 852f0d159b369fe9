"""Main text of web pages by a minimum cut.

A page is cut into text blocks. A classifier gives each block the log odds that it is main text; they and what the
elements around it say of themselves become the capacities to source and sink. Blocks that follow each other, the more
so the nearer they stand in the element tree, and blocks that are next in the same element are tied by smoothness
edges. The cut of least capacity parts content from boilerplate, so a short line between two paragraphs stays and a
long notice in a side column goes.

The classifier is a logistic regression on the block alone (length, links, punctuation, kind, place, neighbours). Its
labels are the pages' own: blocks in an article or main element against blocks in navigation, footers and the like, from
a bounded sample of pages. It is pulled towards fixed weights, which hold where the sample has no such elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.blocks import HEADINGS, Block, Page
from pkgrisk.llm.flat import small_batches
from pkgrisk.llm.mincut import label

#: pages that may be read for the classifier, and labelled blocks taken from one of them
SAMPLE_PAGES = 400
SAMPLE_BLOCKS = 48

#: capacities are whole numbers of 1/100 of log odds
UNIT = 100
MOST_ODDS = 3.0
INSIDE, HINTED, AROUND, SURE = 3.0, 2.0, -6.0, -9.0
#: an element that says it is no main text but holds this share of the page's words is a wrapper
WRAPPER = 0.7
NEXT, SAME = 0.6, 0.4

NAMES = (
    "one", "length", "links", "sentences", "commas", "closed", "paragraph", "heading", "item", "inner", "neighbours",
)
#: the weights that hold without any label, in the order of NAMES
PRIOR = np.array([-1.6, 2.2, -4.0, 1.0, 0.5, 0.8, 0.8, 0.6, -1.0, 0.5, 0.8])
#: strength of the pull; labels of one site should not outweigh what holds for pages without its markup
PULL = 0.05


def describe(blocks: list[Block]) -> np.ndarray:
    """A row of NAMES for each block."""
    n = len(blocks)
    words = np.array([b.words for b in blocks], float)
    length = np.minimum(np.log1p(words) / np.log(40.0), 1.5)
    around = np.concatenate([[0.0], length, [0.0]])
    marks = np.array([b.text.count(".") + b.text.count("!") + b.text.count("?") + b.text.count("。") for b in blocks], float)
    commas = np.array([b.text.count(",") + b.text.count("，") + b.text.count(";") for b in blocks], float)
    place = (np.arange(n) + 0.5) / max(n, 1)
    return np.stack([
        np.ones(n),
        length,
        np.array([b.link_chars / len(b.text) for b in blocks]),
        np.minimum(marks / (1 + words / 20), 1.0),
        np.minimum(commas / (1 + words / 15), 1.0),
        np.array([b.text[-1] in ".!?…。\"”»" for b in blocks], float),
        np.array([b.tag in ("p", "blockquote", "pre", "figcaption") for b in blocks], float),
        np.array([b.tag in HEADINGS for b in blocks], float),
        np.array([b.tag in ("li", "td", "th", "dt", "dd") for b in blocks], float),
        1 - np.abs(2 * place - 1),
        (around[:-2] + around[2:]) / 2,
    ], axis=1)


def surroundings(blocks: list[Block]) -> list[tuple[bool, bool]]:
    """For each block whether an element around it holds no main text, and whether that is sure."""
    total, held = 0, {}
    for b in blocks:
        total += b.words
        for number, _ in b.element.around:
            held[number] = held.get(number, 0) + b.words
    out = []
    for b in blocks:
        real = [s for number, s in b.element.around if s or held[number] < WRAPPER * total]
        title = b.tag == "h1" and b.element.within and not any(real)
        out.append((bool(real) and not title, any(real)))
    return out


def scores(blocks: list[Block], weights: np.ndarray) -> list[int]:
    """Capacities: above 0 to the content side, below 0 to the boilerplate side."""
    odds = np.clip(describe(blocks) @ weights, -MOST_ODDS, MOST_ODDS)
    out = []
    for b, x, (around, sure) in zip(blocks, odds.tolist(), surroundings(blocks)):
        x += INSIDE if b.element.within else HINTED if b.element.hinted else 0.0
        x += SURE if sure else AROUND if around else 0.0
        out.append(round(UNIT * x))
    return out


def ties(blocks: list[Block]) -> Iterator[tuple[int, int, int]]:
    """Smoothness edges: to the next block, less the farther it is in the tree, and to the next one of the same element."""
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            near = b.container == blocks[i - 1].container
            yield i - 1, i, round(UNIT * NEXT / (1 if near else max(2, b.apart)))
        before = last.get(b.container)
        if before is not None:
            yield before, i, round(UNIT * SAME)
        last[b.container] = i


def main_blocks(html: str, weights: np.ndarray = PRIOR) -> list[str]:
    """The content blocks of a page, in order."""
    blocks = Page(html).blocks
    if not blocks:
        return []
    return [b.text for b, content in zip(blocks, label(scores(blocks, weights), ties(blocks))) if content]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, content = [], []
        for html in batch.column(0):
            blocks = Page(html.as_py() or "").blocks
            if not blocks:
                continue
            x, known = describe(blocks), []
            for i, (b, (around, _)) in enumerate(zip(blocks, surroundings(blocks))):
                if around != b.element.within:
                    known.append(i)
            step = max(1, -(-len(known) // SAMPLE_BLOCKS))
            rows += x[known[::step]].tolist()
            content += [blocks[i].element.within for i in known[::step]]
        yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.list_(pa.float64())), "content": pa.array(content, pa.bool_())})


def fit(x: np.ndarray, content: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic weights by Newton steps; both classes weigh the same, the pull is towards PRIOR."""
    if len(x) == 0 or content.all() or not content.any():
        return PRIOR
    each = np.where(content, 0.5 / content.sum(), 0.5 / (~content).sum())
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - content)) + PULL * (w - PRIOR)
        bend = (x * (each * p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Weights from at most SAMPLE_PAGES pages, chosen by hash of the id, and SAMPLE_BLOCKS blocks of each."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(12))
    last = pages.select(key.alias("key")).orderBy("key").limit(SAMPLE_PAGES).agg(F.max("key").alias("last")).first()["last"]
    if last is None:
        return PRIOR
    sample = pages.where(key <= last).select(key.alias("key"), F.col(html_col).cast("string").alias("html"))
    sample = sample.orderBy("key", F.xxhash64("html")).limit(SAMPLE_PAGES).select("html")  # equal ids share a key
    rows = sample.mapInArrow(_labelled, "x array<double>, content boolean").collect()
    rows.sort()
    return fit(np.array([r["x"] for r in rows], float).reshape(len(rows), len(NAMES)), np.array([r["content"] for r in rows], bool))


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            texts = ["\n".join(main_blocks(html.as_py() or "", weights)) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    White space is that of HTML and the no-break space. A null or empty page, and one without main text, gives an empty
    text. Repeated rows and null ids or addresses are passed on.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(learn(pages, id_col, html_col))
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    types = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(_extract(shared), f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
