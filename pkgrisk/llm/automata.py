"""Probabilistic automata from counts: states of a graded automaton that are statistically compatible are merged.

Before the merging, a state is the number of characters read (up to PLACES - 1) and the classes of the last two of
them. So the counts of all moves are a table of fixed size, whatever the number of values, and tables add up.
"""

from __future__ import annotations

from math import log, sqrt

import numpy as np

# classes of characters: digit, a-f, other lower case, A-F, other upper case, + and /, =, the rest
SYMBOLS = 8
_CLASS = np.full(256, 7, np.uint8)
_CLASS[48:58] = 0
_CLASS[97:103] = 1
_CLASS[103:123] = 2
_CLASS[65:71] = 3
_CLASS[71:91] = 4
_CLASS[[43, 47]] = 5
_CLASS[61] = 6
END = SYMBOLS
FLOOR = 1e-3


def symbols(value: str) -> list[int]:
    return _CLASS[np.frombuffer(value.encode("latin-1", "replace"), np.uint8)].tolist()


PLACES = 64
_NONE = SYMBOLS  # in place of a character before the beginning
_PAIRS = (SYMBOLS + 1) ** 2
STATES = PLACES * _PAIRS
START = _NONE * (SYMBOLS + 1) + _NONE
#: size of a table of counts: moves by symbol and endings of each state
MOVES = STATES * (SYMBOLS + 1)


def count_moves(word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of the moves of values whose symbols stand one behind the other in ``word``."""
    starts = np.cumsum(lengths) - lengths
    # each value with its end as one more place
    at = np.arange(len(word) + len(lengths)) - np.repeat(starts + np.arange(len(lengths)), lengths + 1)
    symbol = np.insert(word.astype(np.int64), starts + lengths, END)
    last = np.where(at > 0, np.roll(symbol, 1), _NONE)
    second = np.where(at > 1, np.roll(symbol, 2), _NONE)
    state = np.minimum(at, PLACES - 1) * _PAIRS + second * (SYMBOLS + 1) + last
    return np.bincount(state * (SYMBOLS + 1) + symbol, minlength=MOVES)


class Automaton:
    """States with counts of passing strings, of endings and of moves by symbol, from a table of counts."""

    def __init__(self, counts: np.ndarray) -> None:
        self.next: list[dict[int, int]] = []
        self.moves: list[dict[int, float]] = []
        table = np.asarray(counts, float).reshape(STATES, SYMBOLS + 1)
        self.total: list[float] = table.sum(axis=1).tolist()
        self.ends: list[float] = table[:, END].tolist()
        for state, row in enumerate(table.tolist()):
            place, last = min(state // _PAIRS + 1, PLACES - 1), state % (SYMBOLS + 1)
            moves = {s: n for s, n in enumerate(row[:SYMBOLS]) if n} if self.total[state] else {}
            self.moves.append(moves)
            self.next.append({s: place * _PAIRS + last * (SYMBOLS + 1) + s for s in moves})
        self.root = list(range(STATES))  # a merged state points to the one that holds its counts

    def find(self, state: int) -> int:
        while self.root[state] != state:
            self.root[state] = state = self.root[self.root[state]]
        return state

    def _agree(self, a: int, b: int, alpha: float) -> bool:
        """Hoeffding's test on endings and all moves, of the states and of what follows them."""
        todo, seen = [(a, b)], {(a, b)}
        bound = sqrt(0.5 * log(2 / alpha))
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            width = bound * (1 / sqrt(n) + 1 / sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > width:
                return False
            for s in self.moves[a].keys() | self.moves[b].keys():
                if abs(self.moves[a].get(s, 0) / n - self.moves[b].get(s, 0) / m) > width:
                    return False
                if s in self.next[a] and s in self.next[b]:
                    pair = self.find(self.next[a][s]), self.find(self.next[b][s])
                    if pair[0] != pair[1] and pair not in seen:
                        seen.add(pair)
                        todo.append(pair)
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add ``blue`` to ``red``, and what follows it by a symbol to what follows the other by it."""
        todo = [(red, blue)]
        while todo:
            a, b = (self.find(x) for x in todo.pop())
            if a == b:
                continue
            self.root[b] = a
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for s, n in self.moves[b].items():
                self.moves[a][s] = self.moves[a].get(s, 0) + n
            for s, child in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child

    def merge_states(self, alpha: float = 0.01) -> Automaton:
        """Red states stay; each blue state, a red one's child, is merged into the first that agrees or turns red."""
        red = [START]
        at = 0
        while at < len(red):
            state = red[at]
            at += 1
            for s in sorted(self.next[self.find(state)]):
                child = self.find(self.next[self.find(state)][s])
                known = dict.fromkeys(map(self.find, red))
                if child in known:
                    continue
                partner = next((r for r in known if self._agree(r, child, alpha)), None)
                if partner is None:
                    red.append(child)
                else:
                    self._fold(partner, child)
        return self

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities and next states (state × symbol); the last column is the end, the last state unknown."""
        reach = [self.find(START)]
        order = {reach[0]: 0}
        for state in reach:
            for s in sorted(self.next[state]):
                if (child := self.find(self.next[state][s])) not in order:
                    order[child] = len(reach)
                    reach.append(child)
        n = len(reach)
        prob = np.zeros((n + 1, SYMBOLS + 1))
        to = np.full((n + 1, SYMBOLS), n, np.int64)
        for state in reach:
            i = order[state]
            for s, count in self.moves[state].items():
                prob[i, s] = count / self.total[state]
                to[i, s] = order[self.find(self.next[state][s])]
            prob[i, END] = self.ends[state] / self.total[state] if self.total[state] else 0.0
        return np.log((1 - FLOOR) * prob + FLOOR / (SYMBOLS + 1)), to


def infer_counts(counts: np.ndarray, alpha: float = 0.01) -> tuple[list[list[float]], list[list[int]]]:
    """Log probabilities and moves of the automaton that a table of counts suggests."""
    logs, to = Automaton(counts).merge_states(alpha).table()
    return logs.tolist(), to.tolist()


def counts_of(values: list[str]) -> np.ndarray:
    """``count_moves`` of a list of values."""
    raw = [v.encode("latin-1", "replace") for v in values]
    return count_moves(classes(np.frombuffer(b"".join(raw), np.uint8)), np.array([len(v) for v in raw], np.int64))


def infer(values: list[str], alpha: float = 0.01) -> tuple[list[list[float]], list[list[int]]]:
    """The automaton that the values suggest."""
    return infer_counts(counts_of(values), alpha)


def likelihood(model: tuple[list[list[float]], list[list[int]]], word: list[int]) -> float:
    """Log likelihood of a whole word."""
    logs, to = model
    state, total = 0, 0.0
    for s in word:
        total += logs[state][s]
        state = to[state][s]
    return total + logs[state][END]


def classes(raw: np.ndarray) -> np.ndarray:
    """Symbols of a buffer of bytes."""
    return _CLASS[raw]


def likelihoods(model: tuple[list[list[float]], list[list[int]]], word: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``likelihood`` of many stretches of the symbols ``word``, a step of all at a time."""
    logs, to = np.array(model[0]), np.array(model[1])
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], -lengths[order]
    state, total = np.zeros(len(at), np.int64), np.zeros(len(at))
    for t in range(-int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(n, -t, "left"))  # those longer than t
        s = word[at[:k] + t]
        total[:k] += logs[state[:k], s]
        state[:k] = to[state[:k], s]
    out = np.empty(len(at))
    out[order] = total + logs[state, END]
    return out
