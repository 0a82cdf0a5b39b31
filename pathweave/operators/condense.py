"""Strongly connected components of a relation that one machine holds, and reachability over them.

All nodes of a component reach the same nodes, so sources are carried along the components' acyclic
relation instead, once over its levels: the work doesn't grow with the length of paths, and a cycle of any
size is a single node.
"""

from __future__ import annotations

import numpy as np


def components_of(starts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The component of each node of a graph in compressed form; a component's number is below those that
    lead to it.

    One depth-first search that keeps the open path as a stack of merged stretches: an edge back into the
    path merges all stretches above its end.
    """
    n = len(starts) - 1
    first, edges = starts.tolist(), target.tolist()
    component, place = [-1] * n, [-1] * n
    n_components = 0
    for root in range(n):
        if place[root] >= 0:
            continue
        path, stretches, nodes = [(root, first[root])], [0], [root]
        place[root] = 0
        while path:
            node, edge = path[-1]
            if edge < first[node + 1]:
                path[-1] = (node, edge + 1)
                to = edges[edge]
                if place[to] < 0:
                    place[to] = len(nodes)
                    stretches.append(len(nodes))
                    nodes.append(to)
                    path.append((to, first[to]))
                elif component[to] < 0:
                    while stretches[-1] > place[to]:
                        stretches.pop()
                continue
            path.pop()
            if stretches[-1] == place[node]:
                stretches.pop()
                for member in nodes[place[node] :]:
                    component[member] = n_components
                del nodes[place[node] :]
                n_components += 1
    return np.array(component, np.int64)


class Condensed:
    """The components of an adjacency, their members, and the levels of their acyclic relation."""

    def __init__(self, adjacency) -> None:
        self.ids = adjacency.ids
        self.component = components_of(adjacency.starts, adjacency.target)
        n = int(self.component.max()) + 1 if len(self.component) else 0
        source = np.repeat(np.arange(len(self.ids)), np.diff(adjacency.starts))
        a, b = self.component[source], self.component[adjacency.target]
        self.cyclic = np.zeros(n, bool)
        self.cyclic[a[a == b]] = True
        edges = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        order = np.argsort(self.component, kind="stable")
        self.members = order
        self.member_starts = np.searchsorted(self.component[order], np.arange(n + 1))
        # The level of a component: the most edges on a path to it. Numbers fall along edges.
        level = [0] * n
        for x, y in edges[::-1].tolist():
            if level[x] >= level[y]:
                level[y] = level[x] + 1
        level = np.array(level, np.int64)
        by = np.lexsort((edges[:, 1], level[edges[:, 1]])) if len(edges) else np.zeros(0, np.int64)
        self.source, self.target = edges[by, 0], edges[by, 1]
        self.levels = np.append(np.flatnonzero(np.diff(level[self.target], prepend=-1)), len(by)) if len(by) else np.zeros(1, np.int64)
        self.n = n

    def reach(self, slot: np.ndarray, node: np.ndarray, words: int, block_bytes: int) -> np.ndarray:
        """Bit sets (a row of words for each component) of the slots that reach it by one step or more."""
        total = np.zeros((self.n, words), np.uint64)
        seed = self.component[node]
        np.bitwise_or.at(total, (seed, slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
        found = np.where(self.cyclic[:, None], total, np.uint64(0))
        most = max(1, block_bytes // (8 * words))
        for lo, hi in zip(self.levels[:-1].tolist(), self.levels[1:].tolist(), strict=True):
            # A level's sources are all of lower levels, so they are finished; edges go in slices.
            for at in range(lo, hi, most):
                to = min(hi, at + most)
                target = self.target[at:to]
                first = np.flatnonzero(np.diff(target, prepend=-1))
                bits = np.bitwise_or.reduceat(total[self.source[at:to]], first, axis=0)
                found[target[first]] |= bits
                total[target[first]] |= bits
        return found
