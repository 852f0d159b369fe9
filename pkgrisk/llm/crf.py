"""A linear-chain conditional random field over hashed features, in numpy batches.

Tokens of many chains lie in flat arrays; step t of every chain that is longer than t is taken at once. Messages are
scaled at every step, so chains of any length are safe. A chain is a sentence; callers cut very long ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from pkgrisk.llm.flat import mix

FEATURE_BITS = 18


@dataclass
class Chains:
    """Tokens ``starts[i] .. starts[i] + lengths[i]`` are chain i."""

    starts: np.ndarray
    lengths: np.ndarray
    order: np.ndarray = field(init=False)

    def __post_init__(self):
        self.order = np.argsort(-self.lengths, kind="stable")

    def steps(self):
        """Positions of the tokens at step 0, 1, … of all chains that reach it."""
        starts, lengths = self.starts[self.order], self.lengths[self.order]
        if not len(lengths) or lengths[0] == 0:
            return
        reach = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
        for t, n in enumerate(reach):
            yield starts[:n] + t


def chains_of(first: np.ndarray, n: int) -> Chains:
    """Chains from the sorted positions of their first tokens among n tokens."""
    return Chains(first, np.diff(np.append(first, n)))


@dataclass
class Crf:
    weights: np.ndarray  # features × states
    moves: np.ndarray  # from × to, log space
    begin: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Sum of weights for each token; ``features``: tokens × templates."""
        out = self.weights[features[:, 0]].astype(np.float64)
        for k in range(1, features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def _messages(self, scores: np.ndarray, chains: Chains):
        local = np.exp(scores - scores.max(1, keepdims=True))
        move, begin = np.exp(self.moves), np.exp(self.begin)
        ahead, steps, norm = np.empty_like(local), list(chains.steps()), np.ones(len(local))
        for t, at in enumerate(steps):
            a = (begin if t == 0 else ahead[at - 1] @ move) * local[at]
            norm[at] = a.sum(1)
            ahead[at] = a / norm[at, None]
        back = np.ones_like(local)
        for t in range(len(steps) - 2, -1, -1):
            at = steps[t + 1]
            b = (back[at] * local[at]) @ move.T
            back[at - 1] = b / b.sum(1, keepdims=True)
        return local, move, ahead, back, steps

    def marginals(self, scores: np.ndarray, chains: Chains) -> np.ndarray:
        """Probability of each state at each token by forward and backward messages."""
        if not len(scores):
            return scores
        _, _, ahead, back, _ = self._messages(scores, chains)
        p = ahead * back
        return p / p.sum(1, keepdims=True)

    def decode(self, scores: np.ndarray, chains: Chains) -> np.ndarray:
        """The best state sequence of each chain (Viterbi)."""
        n, k = scores.shape
        best, source, steps = np.empty((n, k)), np.zeros((n, k), np.int8), list(chains.steps())
        for t, at in enumerate(steps):
            if t == 0:
                best[at] = self.begin + scores[at]
            else:
                all_ = best[at - 1][:, :, None] + self.moves
                source[at] = all_.argmax(1)
                best[at] = all_.max(1) + scores[at]
        state = np.zeros(n, np.int64)
        if n:
            last = chains.starts + chains.lengths - 1
            state[last] = best[last].argmax(1)
            for t in range(len(steps) - 1, 0, -1):
                at = steps[t]
                state[at - 1] = source[at, state[at]]
        return state


def train(
    features: np.ndarray, states: np.ndarray, chains: Chains, n_states: int, epochs: int = 12, rate: float = 0.2,
    penalty: float = 1e-4, batches: int = 6, seed: int = 7,
) -> Crf:
    """Maximum likelihood with AdaGrad over shuffled groups of chains."""
    model = Crf(np.zeros((1 << FEATURE_BITS, n_states), np.float32), np.zeros((n_states, n_states)), np.zeros(n_states))
    used = np.unique(features)
    small = np.searchsorted(used, features)  # train on the features that occur only
    weights = np.zeros((len(used), n_states))
    sums = [np.full_like(x, 1e-6) for x in (weights, model.moves, model.begin)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(chains.starts)), batches):
            if not len(part):
                continue
            lengths = chains.lengths[part]
            first = np.cumsum(lengths) - lengths
            rows = np.arange(lengths.sum()) + np.repeat(chains.starts[part] - first, lengths)
            own, f, y = Chains(first, lengths), small[rows], states[rows]
            scores = weights[f].sum(1)
            local, move, ahead, back, steps = model._messages(scores, own)
            p = ahead * back
            p /= p.sum(1, keepdims=True)
            gap = p
            gap[np.arange(len(y)), y] -= 1  # expected less observed
            g_moves = np.zeros_like(model.moves)
            for at in steps[1:]:
                both = ahead[at - 1][:, :, None] * move[None] * (local[at] * back[at])[:, None, :]
                g_moves += (both / both.sum((1, 2), keepdims=True)).sum(0)
                np.subtract.at(g_moves, (y[at - 1], y[at]), 1)
            g_begin = gap[first].sum(0)
            g_weights = np.stack([
                np.bincount(f.ravel(), np.repeat(gap[:, k], f.shape[1]), len(used)) for k in range(n_states)
            ], 1)
            n = len(part)
            for value, grad, total in zip((weights, model.moves, model.begin), (g_weights, g_moves, g_begin), sums):
                grad = grad / n + penalty * value
                total += grad**2
                value -= rate * grad / np.sqrt(total)
    model.weights[used] = weights
    return model


def slots(hashes: np.ndarray, template: int) -> np.ndarray:
    """Feature numbers of one template's hashes."""
    salted = mix(hashes ^ np.uint64((template + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (salted >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
