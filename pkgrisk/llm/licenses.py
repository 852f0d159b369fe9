"""Licence notices by a positional index of rare words.

Templates are short notices. The document frequency of every template word is counted over the whole corpus; each
template is entered in an index under its words of highest IDF, with their positions. A file's occurrences of such
words are looked up, and the postings of one template are intersected by relative position: words that belong to the
same notice agree in (place in the file - place in the template), up to a few inserted words. A template that gathers
enough of its rare words' weight is a match only if its mandatory key phrase stands there word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.flat import ALNUM, Texts, Words, blocks, small_batches

# Phrases whose places are counted, and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Label, notice, mandatory key phrase.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", "gnu general public license"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
)

RARE_WORDS = 5
#: share of the rare words' weight that has to agree, and places by which words may have moved
ENOUGH = 0.6
SLACK = 3


def word_hashes(phrase: str) -> np.ndarray:
    raw = phrase.encode()
    return Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).words(ALNUM).hash


@dataclass
class Index:
    vocabulary: np.ndarray  # sorted hashes of all template words
    weight: np.ndarray  # their IDF
    templates: list[np.ndarray]  # vocabulary numbers of the words
    keys: list[tuple[int, np.ndarray]]  # place and hashes of the key phrase
    postings: dict[int, list[tuple[int, int]]]  # rare vocabulary number -> (template, place)
    rare: np.ndarray


def vocabulary() -> np.ndarray:
    return np.unique(np.concatenate([word_hashes(notice) for _, notice, _ in TEMPLATES]))


def build_index(frequency: np.ndarray, documents: int) -> Index:
    """``frequency``: documents that hold each word of the vocabulary."""
    vocab = vocabulary()
    weight = np.array([1 + log((documents + 1) / (f + 1)) for f in frequency])
    templates, keys, postings = [], [], {}
    for t, (_, notice, key) in enumerate(TEMPLATES):
        words = np.searchsorted(vocab, word_hashes(notice))
        phrase = word_hashes(key)
        own = vocab[words]
        at = next((i for i in range(len(own) - len(phrase) + 1) if (own[i:i + len(phrase)] == phrase).all()), 0)
        templates.append(words)
        keys.append((at, phrase))
        distinct = sorted(set(words.tolist()), key=lambda w: (-weight[w], w))[:RARE_WORDS]
        for w in distinct:
            postings.setdefault(w, []).extend((t, int(q)) for q in np.flatnonzero(words == w))
    rare = np.zeros(len(vocab), bool)
    rare[list(postings)] = True
    return Index(vocab, weight, templates, keys, postings, rare)


def numbers(words: Words, vocab: np.ndarray) -> np.ndarray:
    """Vocabulary number of each word, or -1."""
    at = np.minimum(np.searchsorted(vocab, words.hash), len(vocab) - 1)
    return np.where(vocab[at] == words.hash, at, -1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary()
    counts, documents = np.zeros(len(vocab), np.int64), 0
    for batch in batches:
        documents += batch.num_rows
        for low, high, texts in blocks(batch.column(0)):
            words = texts.words(ALNUM)
            number = numbers(words, vocab)
            at = np.flatnonzero(number >= 0)
            pair = np.unique(texts.text_of(words.starts[at]) * len(vocab) + number[at])
            counts += np.bincount(pair % len(vocab), minlength=len(vocab))
    yield pa.RecordBatch.from_pydict({"word": pa.array([*range(len(vocab)), -1], pa.int32()), "n": pa.array([*counts.tolist(), documents], pa.int64())})


def corpus_index(docs: DataFrame, text_col: str = "text") -> Index:
    """Document frequencies over all documents; one number for each template word reaches the driver."""
    found = {r["word"]: r["n"] for r in docs.select(text_col).mapInArrow(_count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return build_index(np.array([found.get(k, 0) for k in range(len(vocabulary()))]), found.get(-1, 0))


def places(words: Words, phrase: np.ndarray) -> np.ndarray:
    """Numbers of the words at which a phrase begins, in one text."""
    n = len(words.hash) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words.hash[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words.hash[at + k] == phrase[k]]
    text = words.texts.text_of(words.starts)
    return at[text[at] == text[at + len(phrase) - 1]] if len(at) else at


def notices(index: Index, hashes: np.ndarray, number: np.ndarray) -> tuple[set[str], float]:
    """Labels of the notices in one text, and the best share of a template's whole weight found at one alignment."""
    votes: dict[int, list[tuple[int, int]]] = {}
    for p in np.flatnonzero(index.rare[number] & (number >= 0)).tolist():
        for t, q in index.postings[int(number[p])]:
            votes.setdefault(t, []).append((p - q, int(number[p])))
    labels, best = set(), 0.0
    for t, found in votes.items():
        words = index.templates[t]
        rare = {int(w) for w in words if any(x == t for x, _ in index.postings.get(int(w), ()))}
        need = ENOUGH * sum(index.weight[w] for w in rare)
        found.sort()
        low = 0
        tried = None
        for high in range(len(found)):
            while found[high][0] - found[low][0] > SLACK:
                low += 1
            if sum(index.weight[w] for w in {w for _, w in found[low:high + 1]}) < need or found[low][0] == tried:
                continue
            tried = found[low][0]
            begin, end = max(0, tried - SLACK), min(len(hashes), tried + len(words) + 2 * SLACK)
            at, phrase = index.keys[t]
            here = hashes[begin:end]
            if any((here[i:i + len(phrase)] == phrase).all() for i in range(len(here) - len(phrase) + 1)):
                labels.add(TEMPLATES[t][0])
                held = set(number[begin:end].tolist())
                best = max(best, sum(index.weight[w] for w in words if w in held) / sum(index.weight[w] for w in words))
    return labels, min(1.0, float(best))


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        base = [(word_hashes(p), label) for p, label in BASE_PHRASES]
        for batch in batches:
            for low, high, texts in blocks(batch.column(1)):
                words = texts.words(ALNUM)
                n = len(texts)
                total = np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                own: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in base:
                    at = places(words, phrase)
                    if len(at):
                        of = texts.text_of(words.starts[at])
                        np.add.at(total, of, 1)
                        np.minimum.at(first, of, at - words.first[of])
                        np.maximum.at(last, of, at - words.first[of])
                        for k in of.tolist():
                            own[k].add(label)
                number = numbers(words, index.vocabulary)
                score = np.where(total > 0, 1.0, 0.0)
                all_ = [set(x) for x in own]
                hit = np.flatnonzero((number >= 0) & index.rare[number])
                for k in np.unique(texts.text_of(words.starts[hit])).tolist() if len(hit) else ():
                    a, b = words.first[k], words.first[k + 1]
                    labels, share = notices(index, words.hash[a:b], number[a:b])
                    all_[k] |= labels
                    score[k] = max(score[k], share)
                none = total == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(words.counts, pa.int64()), pa.array(total), pa.array(first, mask=none),
                     pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in own]), pa.array([",".join(sorted(x)) for x in all_]),
                     pa.array(score)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, phrase places, labels and score of every text.

    Words are runs of letters, digits and everything above ASCII, A-Z lower-cased. A null or empty text has no word,
    no label and score 0; repeated rows and null ids are passed on. ``score`` is 1 where a base phrase stands, else the
    share of the best notice's weight.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(corpus_index(slim))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(
        _find(shared),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
