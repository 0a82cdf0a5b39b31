"""The edges of some labels as one machine holds them, and the search from one node along an automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np

#: Rounds after which, and nodes up to which, a round goes node by node: arrays are dear for a few nodes, and a long
#: path is a round for each hop.
DEEP, FEW = 64, 256


class Cells:
    """Edges by label (``cells``: sources and targets) in dense numbers of ``nodes``, sorted ids."""

    def __init__(self, names: Sequence[str], row: np.ndarray, col: np.ndarray, kind: np.ndarray) -> None:
        """``kind`` is the place of each edge's label in ``names``."""
        self.nodes = np.unique(np.concatenate([row, col]))
        row, col = (np.searchsorted(self.nodes, x).astype(np.int32) for x in (row, col))
        self.cells = {name: (row[kind == i], col[kind == i]) for i, name in enumerate(names)}
        self._onward: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
        self._lists: dict[tuple[str, bool], tuple[list[int], list[int]]] = {}

    def onward(self, name: str, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where each node's targets along a label begin, and the targets."""
        key = name, inverse
        if key not in self._onward:
            row, col = self.cells[name][::-1] if inverse else self.cells[name]
            starts = np.append(0, np.cumsum(np.bincount(row, minlength=len(self.nodes))))
            self._onward[key] = starts, col[np.argsort(row, kind="stable")]
        return self._onward[key]

    def listed(self, name: str, inverse: bool) -> tuple[list[int], list[int]]:
        """The same as lists."""
        key = name, inverse
        if key not in self._lists:
            self._lists[key] = tuple(x.tolist() for x in self.onward(name, inverse))
        return self._lists[key]

    def search(self, node: int, states: int, moves: Iterable[tuple[int, tuple[str, bool], int]], accepting: Iterable[int], target: int | None = None, check: Callable[[], None] = lambda: None) -> np.ndarray:
        """Ids of the nodes that are reached from an id in state 0, each once, in an accepting state.

        ``moves`` are (from, (label, inverse), to). A node is met once in each state, so the work is that of
        the edges times the moves, however long the paths. ``target`` is the only id that is wanted: the
        search ends there (others may be missing). ``check`` is called in each round.
        """
        accepting = sorted(accepting)
        n, at = len(self.nodes), int(np.searchsorted(self.nodes, node))
        if at == n or self.nodes[at] != node:  # no edge; the path may be empty all the same
            return np.array([node] if 0 in accepting else [], np.int64)
        stop = None
        if target is not None:
            stop = int(np.searchsorted(self.nodes, target))
            if stop == n or self.nodes[stop] != target:
                return np.zeros(0, np.int64)
        out: dict[int, list[tuple[tuple[str, bool], int]]] = {}
        for a, label, b in moves:
            out.setdefault(a, []).append((label, b))
        marks = [bytearray(n) for _ in range(states)]
        seen = [np.frombuffer(m, np.uint8) for m in marks]
        marks[0][at] = 1
        new: dict[int, np.ndarray | list[int]] = {0: [at]}
        rounds = 0
        while new and (stop is None or not any(marks[q][stop] for q in accepting)):
            check()
            alone = rounds >= DEEP and sum(map(len, new.values())) <= FEW
            rounds += 1
            ahead: dict[int, list] = {}
            for a, active in new.items():
                for label, b in out.get(a, ()):
                    if alone:
                        starts, to = self.listed(*label)
                        mark, met = marks[b], ahead.setdefault(b, [])
                        for x in active if isinstance(active, list) else active.tolist():
                            for y in to[starts[x] : starts[x + 1]]:
                                if not mark[y]:
                                    mark[y] = 1
                                    met.append(y)
                        continue
                    starts, to = self.onward(*label)
                    first = starts[active]
                    count = starts[np.asarray(active) + 1] - first
                    to = to[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                    to = np.unique(to[seen[b][to] == 0])
                    seen[b][to] = 1
                    ahead.setdefault(b, []).append(to)
            new = {b: met if alone else np.concatenate(met) for b, met in ahead.items()}
            new = {b: met for b, met in new.items() if len(met)}
        found = np.zeros(n, bool)
        for q in accepting:
            found |= seen[q] != 0
        return self.nodes[found]
