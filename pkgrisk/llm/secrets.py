"""Credentials in texts: fixed formats, and further strings whose format likelihood is that of a credential.

Strings of the fixed formats are the labelled credentials. Counter-examples are ordinary words and long tokens that are
not an unbroken mix of letters and digits; such mixes without a label may be either. From all distinct values of each, a
probabilistic automaton over classes of characters is inferred: tasks count moves, and the tables of counts add up.
Every token of LEAST_WORD and more characters of every text, and its parts between = and /, is then scored by the
difference of its mean log likelihoods, and added where the score is above that of nearly all counter-examples; tasks
count these by steps of the score. For a token of fewer than LEAST_TOKEN characters, these are the unlabelled tokens of
its length, mixes too: a short format that is common without a label is no credential. No short token without a mix of
letters and digits scores above the threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.automata import MOVES, classes, count_moves, infer_counts, likelihood, likelihoods, symbols
from pkgrisk.llm.flat import Texts, blocks, buffers, byte_table, small_batches
from pkgrisk.llm.shared import stored

# Formats of credentials.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 and more
KINDS = ("assign", "access", "hex")

TOKEN = byte_table(b"0123456789+/_=.-" + bytes(range(65, 91)) + bytes(range(97, 123)))
_MARKS = byte_table(b"=/")
PARTS = (TOKEN & ~byte_table(b"="), TOKEN & ~_MARKS)
LEAST_TOKEN, LEAST_WORD = 16, 6
#: what the values of one kind weigh together at most; all of them are counted
WEIGHT = 300
#: steps of the score by which counter-examples are counted
STEPS = 1024
#: values already given that a task remembers
REMEMBERED = 1 << 18
#: share of the counter-examples that may score as high as a credential
FALSE_RATE = 0.002


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the fixed formats, leftmost and without overlap in each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out


def hex_spans(text: str) -> list[tuple[int, int, int, str]]:
    return [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]


@dataclass
class Model:
    credentials: tuple
    others: tuple
    threshold: float
    short: dict[int, float] = field(default_factory=dict)  # thresholds of lengths below LEAST_TOKEN; the others have none

    def score(self, value: str) -> float:
        word = symbols(value)
        return (likelihood(self.credentials, word) - likelihood(self.others, word)) / (len(word) + 1)


    def short_keys(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the stretches of fewer than LEAST_TOKEN bytes are above the threshold of their length."""
        length = ends - starts
        limit = np.array([self.short.get(n, np.inf) for n in range(LEAST_TOKEN)])[length]
        word = classes(texts.raw)
        score = likelihoods(self.credentials, word, starts, length) - likelihoods(self.others, word, starts, length)
        return score / (length + 1) > limit


_HEX_BYTES = byte_table(b"0123456789abcdef")


def stretches(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of TOKEN, of what follows a run's first =, and of the parts between = and /."""
    raw = texts.raw
    a, b = texts.runs(TOKEN, raw)
    fits = b - a >= LEAST_WORD
    a, b = a[fits], b[fits]
    marks = np.flatnonzero(_MARKS[raw])
    if not len(marks):
        return a, b
    equals = np.append(marks[raw[marks] == 61], len(raw))
    first = equals[np.searchsorted(equals, a)]
    found = [(a, b), (first[first < b] + 1, b[first < b])]
    for member in PARTS:
        x, y = texts.runs(member, raw)
        fits = y - x >= LEAST_WORD
        x, y = x[fits], y[fits]
        beside = _MARKS[raw[np.maximum(x - 1, 0)]] | _MARKS[raw[np.minimum(y, len(raw) - 1)]]
        found.append((x[beside], y[beside]))
    pairs = np.unique(np.concatenate([(x << 32) | y for x, y in found]))
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    fits = b - a >= LEAST_WORD
    return a[fits], b[fits]


Token = tuple[int, int, str]


def candidates(column: pa.Array, model: Model | None = None) -> Iterator[tuple[int, str, list[tuple[int, int, int, str]], list[Token]]]:
    """Row, text, base spans and other tokens (start, end, value) of each text; offsets are code points.

    The tokens are the long ones, and of shorter ones those that are credentials by ``model``.
    """
    for low, high, texts in blocks(column):
        starts, ends = stretches(texts)
        wanted = ends - starts >= LEAST_TOKEN
        if model is not None:
            short = np.flatnonzero(~wanted)
            wanted[short] = model.short_keys(texts, starts[short], ends[short])
        starts, ends = starts[wanted], ends[wanted]
        of = texts.text_of(starts)
        first = np.searchsorted(of, np.arange(high - low + 1))
        a, b = texts.runs(_HEX_BYTES, texts.raw)
        has_hex = np.zeros(high - low, bool)
        has_hex[texts.text_of(a[b - a >= 24])] = True
        for k in range(high - low):
            raw = texts.raw[texts.offsets[k]:texts.offsets[k + 1]].tobytes()
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            if has_hex[k]:
                base += hex_spans(text)
            base.sort()
            tokens = []
            if first[k + 1] > first[k]:
                ascii_ = len(raw) == len(text)
                for x, y in zip((starts[first[k]:first[k + 1]] - texts.offsets[k]).tolist(), (ends[first[k]:first[k + 1]] - texts.offsets[k]).tolist()):
                    at = x if ascii_ else len(raw[:x].decode("utf-8", "replace"))
                    value = raw[x:y].decode("ascii")
                    if not any(p < at + y - x and q > at for p, _, q, _ in base):
                        tokens.append((at, at + y - x, value))
            yield low + k, text, base, tokens


def added(model: Model, tokens: list[Token]) -> list[tuple[int, int]]:
    """Credentials among a text's tokens, the longest of those that overlap."""
    keys = [(a, b) for a, b, value in tokens if len(value) < LEAST_TOKEN or model.score(value) > model.threshold]
    out: list[tuple[int, int]] = []
    for a, b in sorted(keys, key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1]:  # parts of one run
            if b - a > out[-1][1] - out[-1][0]:
                out[-1] = (a, b)
        else:
            out.append((a, b))
    return out


def undecided(value: str) -> bool:
    """A token with an unbroken mix of letters and digits between = and /, which may be a credential."""
    parts = [value, *(p for p in re.split("[=/]", value) if len(p) >= LEAST_WORD)]
    return any(p.isalnum() and not p.isalpha() and not p.isdigit() for p in parts)


def _unlabelled(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which stretches do not overlap a labelled assignment; the other formats are longer than the stretches here."""
    inside = np.zeros(len(texts.raw) + 1, np.int64)
    for k in np.unique(texts.text_of(np.flatnonzero((texts.raw == 61) | (texts.raw == 58)))).tolist():
        low = texts.offsets[k]
        text = texts.raw[low:texts.offsets[k + 1]].tobytes().decode("utf-8", "replace")
        for a, kind, b, _ in base_spans(text):
            if kind == 0:
                x = low + len(text[:a].encode())
                inside[x:x + len(text[a:b].encode())] = 1
    upto = np.concatenate([[0], np.cumsum(inside)])
    return upto[ends] == upto[starts]


def _words(column: pa.Array) -> Iterator[set[bytes]]:
    """The unlabelled tokens below LEAST_TOKEN of each block."""
    for _, _, texts in blocks(column):
        starts, ends = stretches(texts)
        fits = (ends - starts < LEAST_TOKEN) & _unlabelled(texts, starts, ends)
        raw = texts.raw.tobytes()
        yield {raw[a:b] for a, b in zip(starts[fits].tolist(), ends[fits].tolist())}


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind and value of all labelled credentials and counter-examples; some values several times."""
    seen: set[tuple[int, str] | bytes] = set()  # saves rows only
    for batch in batches:
        kinds: list[int] = []
        values: list[str] = []
        for _, _, base, tokens in candidates(batch.column(0)):
            own = {(k, value) for _, k, _, value in base} | {(3, value) for _, _, value in tokens if not undecided(value)}
            own = {x for x in own if len(x[1]) > 256 or x not in seen}
            kinds += [k for k, _ in own]
            values += [v for _, v in own]
            seen |= {x for x in own if len(x[1]) <= 256}
        for words in _words(batch.column(0)):
            words -= seen
            kinds += [len(w) for w in words]
            values += [w.decode("ascii") for w in words]
            seen |= words
        if len(seen) > REMEMBERED:
            seen.clear()
        yield _valued(kinds, values)


def _valued(kinds: list[int], values: list[str]) -> pa.RecordBatch:
    """Kind, whether it is a token below LEAST_TOKEN that may be a credential, and value."""
    mixed = [k > 3 and undecided(v) for k, v in zip(kinds, values)]
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(mixed, pa.bool_()), pa.array(values, pa.string())], names=["kind", "mixed", "value"])


def _group(kind: int) -> int:
    """The table of counts that a kind belongs to: one for each long kind, one for the shorter tokens."""
    return min(kind, 4)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group, move and count, and move -1 with the number of values, of the values of a task.

    Short tokens that may be credentials are left to their threshold.
    """
    tables: dict[int, np.ndarray] = {}
    sizes: dict[int, int] = {}
    for batch in batches:
        batch = batch.filter(pc.invert(batch.column(1)))
        groups = np.minimum(batch.column(0).to_numpy(), 4)
        for g in np.unique(groups).tolist():
            raw, offsets = buffers(batch.column(2).filter(pa.array(groups == g)))
            lengths = np.diff(offsets)
            tables[g] = tables.get(g, 0) + count_moves(classes(raw), lengths)
            sizes[g] = sizes.get(g, 0) + len(lengths)
    for g, table in tables.items():
        move = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(move) + 1, g, np.int32)), pa.array(np.append(move, -1)), pa.array(np.append(table[move], sizes[g]))], names=["grp", "move", "n"]
        )


def _scores(shared):
    """Kind, whether a short token may be a credential, step of its score, number and highest score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            found: dict[tuple[int, bool, int], tuple[int, float]] = {}
            for kind, mixed, value in zip(*(c.to_pylist() for c in batch.columns)):
                score = model.score(value)
                key = (kind, mixed, int(score * STEPS // 1))
                n, top = found.get(key, (0, score))
                found[key] = (n + 1, max(top, score))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in found], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.int64()))]
                + [pa.array([v[i] for v in found.values()], t) for i, t in enumerate((pa.int64(), pa.float64()))],
                names=["kind", "mixed", "step", "n", "top"],
            )

    return run


def _inferred(tables: dict[int, np.ndarray], sizes: dict[int, int], groups: tuple[int, ...]) -> tuple:
    """The automaton of some groups, each weighing as many values as it has, at most WEIGHT."""
    return infer_counts(sum(tables[g] * min(1.0, WEIGHT / sizes[g]) for g in groups if g in tables))


def _thresholds(model: Model, steps: list[tuple[int, bool, int, int, float]], sizes: dict[int, int]) -> None:
    """Set the thresholds from (kind, may be a credential, step, number, highest score) of all counter-examples."""
    weighed = [(step, n * min(1.0, WEIGHT / sizes[_group(kind)]), top) for kind, mixed, step, n, top in steps if not mixed]
    above = FALSE_RATE * sum(w for _, w, _ in weighed)
    model.threshold = max(0.25, _passed(weighed, above))
    for length in range(LEAST_WORD, LEAST_TOKEN):
        own = [x for x in steps if x[0] == length]
        common = _passed([(step, n, top) for _, _, step, n, top in own], int(FALSE_RATE * sum(x[3] for x in own))) if own else model.threshold
        model.short[length] = max([0.25, common, *(top for _, mixed, _, _, top in own if not mixed)])


def _passed(steps: list[tuple[int, float, float]], above: float) -> float:
    """The highest score of the first step, from above, that with those over it holds more than ``above``."""
    held: dict[int, tuple[float, float]] = {}
    for step, n, top in steps:
        before = held.get(step, (0.0, top))
        held[step] = (before[0] + n, max(before[1], top))
    for step in sorted(held, reverse=True):
        above -= held[step][0]
        if above < 0:
            break
    return held[step][1]


def fit(credentials: list[str], others: list[str], short: list[str] | None = None) -> Model | None:
    """A model of listed values; None without examples of both sorts: then only the fixed formats are found.

    ``short``: counter-examples of fewer than LEAST_TOKEN characters, for the threshold of each length.
    """
    table = _valued([0] * len(credentials) + [3] * len(others) + [len(v) for v in short or ()], [*credentials, *others, *(short or ())])
    tables = pa.Table.from_batches(_tables(iter([table])), schema=_TABLES).to_pylist()
    return _model([(r["grp"], r["move"], r["n"]) for r in tables], lambda model: [
        tuple(r.values()) for b in _scores(_Held(model))(iter([table.slice(len(credentials))])) for r in b.to_pylist()
    ])


_TABLES = pa.schema([("grp", pa.int32()), ("move", pa.int64()), ("n", pa.int64())])


@dataclass
class _Held:
    value: Model


def _model(counts: list[tuple[int, int, int]], scored) -> Model | None:
    """From the counts of all moves; ``scored`` gives the scores of the counter-examples by a model, by steps."""
    tables: dict[int, np.ndarray] = {}
    sizes: dict[int, int] = {}
    for g, move, n in counts:
        if move < 0:
            sizes[g] = n
        else:
            tables.setdefault(g, np.zeros(MOVES))[move] = n
    if not sizes.keys() & {0, 1, 2} or not sizes.keys() & {3, 4}:
        return None
    model = Model(_inferred(tables, sizes, (0, 1, 2)), _inferred(tables, sizes, (3, 4)), 0.0)
    _thresholds(model, scored(model), sizes)
    return model


def learn(docs: DataFrame, text_col: str = "text") -> Model | None:
    """From all distinct values of the corpus; the driver gets counts by state, and counts by steps of the score."""
    found = stored(docs.select(text_col).mapInArrow(_examples, "kind int, mixed boolean, value string").distinct(), "credentials")
    counts = found.mapInArrow(_tables, "grp int, move long, n long").groupBy("grp", "move").agg(F.sum("n").alias("n")).collect()

    def scored(model: Model) -> list:
        steps = found.where("kind >= 3").mapInArrow(_scores(found.sparkSession.sparkContext.broadcast(model)), "kind int, mixed boolean, step long, n long, top double")
        return steps.groupBy("kind", "mixed", "step").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()

    return _model(counts, scored)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for _, _, base, tokens in candidates(batch.column(1), model):
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                own = [(a, k, b, KINDS[k]) for a, k, b, _ in base]
                digests.append(hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in own).encode()).hexdigest())
                if model is not None:
                    own += [(a, 3, b, "key") for a, b in added(model, tokens)]
                    own.sort()
                spans.append(",".join(f"{n}:{a}:{b}" for a, _, b, n in own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Counts and digest of the fixed formats and all spans of every text.

    A null or empty text has none; repeated rows and null ids are passed on. ``model`` may be given; otherwise it is
    learnt from ``docs``.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(slim))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(
        _find(shared), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
