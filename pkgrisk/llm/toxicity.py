"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are on documents; the tokens that make them toxic are found first. A word or word beginning that occurs in
toxic documents far more often than in others (by the G test) marks its tokens in toxic documents; these token labels
train the field. Every document is then tagged by forward-backward marginals, which give offending offsets and, by
their number, largest value and sum, a calibrated score.

A chain is a sentence (or line); ``CHAIN`` words of a longer one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgrisk.llm.crf import Chains, Crf, chains_of, slots, train
from pkgrisk.llm.flat import ALNUM, Texts, Words, blocks, byte_table, small_batches
from pkgrisk.llm.shared import fresh

#: labelled documents of each class that the model is fitted on, at most, and the longest of them
SAMPLE_DOCS = 1200
SAMPLE_CHARS = 16_000
REJECT = 0.3
SPAN, DOUBT = 0.5, 0.25
_BREAKS = byte_table(b".!?\n")
_TEMPLATES = 7  # of which the first CUES can mark a token
CUES = 4


@dataclass
class Model:
    crf: Crf | None
    weights: np.ndarray  # of the constant and three statistics of the marginals
    prior: float


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def token_features(words: Words) -> np.ndarray:
    """Whole word, beginnings of 4, 5 and 6 bytes, ending of 3 bytes, the next word, a constant: tokens × templates."""
    texts, a, b = words.texts, words.starts, words.ends
    out = np.empty((len(a), _TEMPLATES), np.int32)
    out[:, 0] = slots(words.hash, 0)
    for k, n in enumerate((4, 5, 6)):
        out[:, k + 1] = slots(texts.hashes(a, np.minimum(a + n, b)), k + 1)
    out[:, 4] = slots(texts.hashes(np.maximum(b - 3, a), b), 4)
    following = np.zeros_like(words.hash)
    following[:-1] = words.hash[1:]
    following[words.first[1:][words.counts > 0] - 1] = 0  # the last word of a text has none
    out[:, 5] = slots(following, 5)
    out[:, 6] = 0
    return out


def sentences(words: Words) -> Chains:
    """Chains: a new one after a full stop, question or exclamation mark or line break, and in a new text."""
    n = len(words.starts)
    if not n:
        return chains_of(np.zeros(0, np.int64), 0)
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[words.texts.data])])
    new = np.zeros(n, bool)
    new[1:] = breaks[words.starts[1:]] > breaks[words.ends[:-1]]
    new[words.first[:-1][words.counts > 0]] = True
    return chains_of(np.flatnonzero(new), n)


def cue_slots(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that mark toxic documents: at least thirty times as frequent there, with a G statistic above 25."""
    n_docs = len(toxic)
    n1 = max(1, int(toxic.sum()))
    n0 = max(1, n_docs - int(toxic.sum()))
    marked = []
    for k in range(CUES):
        pair = np.unique(features[:, k].astype(np.int64) * n_docs + doc)
        slot, of = pair // n_docs, pair % n_docs
        values, where = np.unique(slot, return_inverse=True)
        a = np.bincount(where, toxic[of], len(values))
        b = np.bincount(where, 1 - toxic[of], len(values))
        share = (a + b) / (n1 + n0)
        g = 2 * (np.where(a > 0, a * np.log(np.maximum(a, 1) / (n1 * share)), 0) + np.where(b > 0, b * np.log(np.maximum(b, 1) / (n0 * share)), 0))
        marked.append(values[(g > 25) & ((a + 0.5) / n1 >= 30 * (b + 0.5) / n0)] * CUES + k)
    return np.concatenate(marked)


def _statistics(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Constant, log of 1 + sum, maximum and share of the toxic marginals of each text; ``counts``: its words.

    Marginals below DOUBT are left out of the sum, so that length alone does not add up.
    """
    first = np.cumsum(counts) - counts
    total = np.add.reduceat(np.append(np.where(p >= DOUBT, p, 0.0), 0.0), first) if len(counts) else np.zeros(0)
    top = np.maximum.reduceat(np.append(p, 0.0), first) if len(counts) else np.zeros(0)
    total, top = np.where(counts > 0, total, 0), np.where(counts > 0, top, 0)
    return np.stack([np.ones(len(counts)), np.log1p(total), top, np.sqrt(total / np.maximum(counts, 1))], 1)


def _described(texts: list[str]) -> tuple[np.ndarray, Chains, np.ndarray]:
    """Features of all tokens, chains, and words of each text, worked out block by block."""
    features, firsts, lengths, counts, n = [], [], [], [], 0
    for _, _, block in blocks(pa.array(texts, pa.string())):
        words = block.words(ALNUM)
        own = sentences(words)
        features.append(token_features(words))
        firsts.append(own.starts + n)
        lengths.append(own.lengths)
        counts.append(words.counts)
        n += len(words.starts)
    return np.concatenate(features), Chains(np.concatenate(firsts), np.concatenate(lengths)), np.concatenate(counts)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(beta))
        step = np.linalg.solve(hess, x.T @ (w * (y - p)) - penalty * beta)
        beta += np.clip(step, -5, 5)
    return beta


def _field(features: np.ndarray, chains: Chains, doc: np.ndarray, toxic: np.ndarray, part: np.ndarray) -> Crf | None:
    """The field of the documents in ``part``; None where no word tells toxic ones."""
    own = part[doc]
    cues = cue_slots(features[own], (np.cumsum(part) - 1)[doc[own]], toxic[part])  # documents renumbered within the part
    if not len(cues):
        return None
    tagged = np.zeros(len(features), bool)
    for k in range(CUES):
        tagged |= np.isin(features[:, k], cues[cues % CUES == k] // CUES)
    state = (tagged & (toxic[doc] == 1)).astype(np.int64)
    holds = np.add.reduceat(state, chains.starts) > 0
    learn = part[doc[chains.starts]]
    others = np.flatnonzero(learn & ~holds)
    others = np.random.default_rng(3).permutation(others)[: 6 * max(200, int((learn & holds).sum()))]
    rows = np.sort(np.concatenate([np.flatnonzero(learn & holds), others]))
    return train(features, state, Chains(chains.starts[rows], chains.lengths[rows]), 2, epochs=10, batches=24)


def fit(texts: list[str], toxic: np.ndarray, prior: float) -> Model:
    """A model from labelled texts; ``prior``: share of toxic documents among all labelled ones.

    The field learns from all texts. Its scores are calibrated on statistics of each half of the texts, every other one
    of either class, under a field learnt from the other half. With fewer than two toxic texts or no other, nothing is
    learnt and every score is next to 0; without a word that tells toxic texts, every score is the prior.
    """
    toxic = toxic.astype(np.int64)
    if toxic.sum() < 2 or toxic.sum() == len(toxic):
        return Model(None, np.array([-30.0, 0, 0, 0]), prior)
    features, chains, counts = _described(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    crf = _field(features, chains, doc, toxic, np.ones(len(texts), bool))
    if crf is None:
        return Model(None, np.array([np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)), 0, 0, 0]), prior)
    half = np.where(toxic == 1, np.cumsum(toxic), np.cumsum(1 - toxic)) % 2 == 0
    p = np.zeros(len(features))
    for fold in (half, ~half):
        other = _field(features, chains, doc, toxic, ~fold) if toxic[~fold].any() else None
        if other is not None:
            own = fold[doc]
            p[own] = other.marginals(other.scores(features), chains)[own, 1]
    weight = np.where(toxic == 1, prior / toxic.sum(), (1 - prior) / (1 - toxic).sum()) * len(toxic)
    return Model(crf, _logistic(_statistics(p, counts), toxic, weight), prior)


def _fit(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(labels, np.int64), prior))], pa.binary())], names=["model"])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most SAMPLE_DOCS documents of each class, by hash of the id; labels of held-out ids are never read.

    A document with several labels is toxic if one of them says so; null labels and null ids are left out. The texts of
    the sample meet in one task, which fits the model; the driver gets the fitted model only.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("known")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("known", F.lit(11))
    chosen = None
    for label in (1, 0):
        part = known.where(F.col("label") == label).orderBy(order, "known").limit(SAMPLE_DOCS)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = (  # at most 2 × SAMPLE_DOCS ids are broadcast
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("known"))
        .where(F.length("text") <= SAMPLE_CHARS)
        .select("doc_id", "text", "label").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "text").limit(2 * SAMPLE_DOCS)
    )
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = counts.get(1, 0) / total if total else 0.0
    fitted = rows.select("text", "label").mapInArrow(_fit(prior), "model binary").collect()  # a limit has one partition, in order
    return pickle.loads(fitted[0]["model"]) if fitted else fit([], np.zeros(0, np.int64), prior)


def tag(model: Model, texts: Texts) -> tuple[np.ndarray, list[str]]:
    """Score and toxic spans (start:end in code points, comma-joined) of each text."""
    words = texts.words(ALNUM)
    spans = [""] * len(texts)
    p = np.zeros(len(words.starts))
    if model.crf is not None and len(p):
        p = model.crf.marginals(model.crf.scores(token_features(words)), sentences(words))[:, 1]
        at = np.flatnonzero(p >= SPAN)
        if len(at):
            chars = np.concatenate([[0], np.cumsum((texts.raw & 0xC0) != 0x80)])
            of = texts.text_of(words.starts[at])
            base = chars[texts.offsets[of]]
            found: dict[int, list[str]] = {}
            for k, x, y in zip(of.tolist(), (chars[words.starts[at]] - base).tolist(), (chars[words.ends[at]] - base).tolist()):
                found.setdefault(k, []).append(f"{x}:{y}")
            for k, own in found.items():
                spans[k] = ",".join(own)
    z = _statistics(p, words.counts) @ model.weights
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def _score(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for _, _, texts in blocks(batch.column(column)):
                s, o = tag(shared.value, texts)
                scores.append(s)
                spans += o
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array(spans, pa.string())], names=[*map(str, range(batch.num_columns + 2))]
            )

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", spans_col: str = "spans") -> DataFrame:
    """``docs`` with a score from 0 to 1 and the toxic spans of every text.

    The text alone is scored; a null text is an empty one. Columns of the two names are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col, spans_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(spans_col, T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(shared, docs.columns.index(text_col)), schema)


def toxic_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    return score(slim, learn(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "spans"
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, columns as they are."""
    name, spans = fresh(docs, "_toxicity"), fresh(docs, "_toxic_spans")
    model = learn(docs, labels, id_col, text_col)
    return score(docs, model, text_col, name, spans).where(F.col(name) < REJECT).select(*docs.columns)
