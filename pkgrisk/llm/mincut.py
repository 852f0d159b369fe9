"""Minimum cuts of small graphs: a two-sided labelling with unary costs and symmetric smoothness edges."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class Graph:
    """Nodes 0 … n - 1 between a source (n) and a sink (n + 1); capacities are integers."""

    def __init__(self, n: int):
        self.n = n
        self.to: list[int] = []
        self.left: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(self, a: int, b: int, forth: int, back: int = 0) -> None:
        """Edges 2k and 2k + 1 are each other's reverse."""
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [forth, back]

    def levels(self) -> list[int]:
        """Distance from the source over edges with capacity left, -1 where there is none."""
        level = [-1] * (self.n + 2)
        level[self.n] = 0
        queue = deque([self.n])
        while queue:
            a = queue.popleft()
            for k in self.out[a]:
                b = self.to[k]
                if self.left[k] and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def flow(self) -> int:
        """Largest flow, phase by phase along shortest paths; the capacities left stay in ``left``."""
        source, sink, total = self.n, self.n + 1, 0
        while (level := self.levels())[sink] >= 0:
            turn = [0] * (self.n + 2)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    most = min(self.left[k] for k in path)
                    total += most
                    cut = 0
                    for i in range(len(path) - 1, -1, -1):
                        k = path[i]
                        self.left[k] -= most
                        self.left[k ^ 1] += most
                        if not self.left[k]:
                            cut = i
                    at = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                own, i = self.out[at], turn[at]
                while i < len(own) and not (self.left[own[i]] and level[self.to[own[i]]] == level[at] + 1):
                    i += 1
                turn[at] = i
                if i < len(own):
                    path.append(own[i])
                    at = self.to[own[i]]
                elif path:
                    at = self.to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break
        return total


def label(scores: list[int], edges: Iterable[tuple[int, int, int]]) -> list[bool]:
    """The labelling of least cost: a positive score is paid for False, a negative one for True, and every edge
    (a, b, weight) where a and b differ. Of several such labellings the one with the fewest True."""
    graph = Graph(len(scores))
    for i, s in enumerate(scores):
        if s > 0:
            graph.edge(graph.n, i, s)
        elif s < 0:
            graph.edge(i, graph.n + 1, -s)
    for a, b, weight in edges:
        if weight > 0:
            graph.edge(a, b, weight, weight)
    graph.flow()
    return [x >= 0 for x in graph.levels()[: len(scores)]]
