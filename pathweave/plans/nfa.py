"""The automaton of a path expression, and evaluation on the product of graph and automaton.

The automaton has a state for each label of the expression (and one to begin in): from a state the labels
that may come next lead on. A pair (node, state) is a node of the product graph, whose step relation is a
union of label scans; one propagation from the starts answers the query, and no closure within the
expression has to be finished first.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.operators.propagate import TILE, States, carried, check, most_edges, propagate
from pathweave.operators.relation import BoolMatrix
from pathweave.sources.graph import GraphStore

from .ast import Alt, Concat, Label, Opt, Path, Plus, Star, nullable, reverse


@dataclass(frozen=True)
class Automaton:
    """States 0 (the beginning) to n; ``moves`` are (from, label, to); ``accepting`` are the states to end in."""

    states: int
    moves: tuple[tuple[int, Label, int], ...]
    accepting: frozenset[int]

    def next(self, states: Iterable[int], label: Label, forward: bool = True) -> set[int]:
        """The states that a label leads to, or with ``forward`` false those it comes from."""
        at = set(states)
        return {t if forward else s for s, x, t in self.moves if x == label and (s if forward else t) in at}


def automaton(path: Path) -> Automaton:
    """Positions, what may be first, last and follow: the automaton without empty moves."""
    leaves: list[Label] = [Label("")]
    follow: set[tuple[int, int]] = set()

    def visit(p: Path) -> tuple[set[int], set[int]]:
        match p:
            case Label():
                leaves.append(p)
                return {len(leaves) - 1}, {len(leaves) - 1}
            case Alt(parts):
                ends = [visit(q) for q in parts]
                return set().union(*(e[0] for e in ends)), set().union(*(e[1] for e in ends))
            case Concat(parts):
                first, last = visit(parts[0])
                empty = nullable(parts[0])
                for q in parts[1:]:
                    f, end = visit(q)
                    follow.update((a, b) for a in last for b in f)
                    first = first | f if empty else first
                    last = last | end if nullable(q) else end
                    empty = empty and nullable(q)
                return first, last
            case Star(part) | Plus(part):
                first, last = visit(part)
                follow.update((a, b) for a in last for b in first)
                return first, last
            case Opt(part):
                return visit(part)
        raise TypeError(p)

    first, last = visit(path)
    moves = sorted({(0, f) for f in first} | follow)
    return Automaton(len(leaves), tuple((a, leaves[b], b) for a, b in moves), frozenset(last | ({0} if nullable(path) else set())))


def merged(machine: Automaton, start: bool = True) -> Automaton:
    """The same language with fewer states: those that lead to the same ones by the same labels, and are alike in
    ending there, are one. Without ``start`` no other is one with the beginning."""
    kind: list = [(q in machine.accepting, not start and q == 0) for q in range(machine.states)]
    while True:
        number: dict = {}
        at = [number.setdefault(k, len(number)) for k in kind]
        kind = [(at[q], frozenset((x, at[b]) for a, x, b in machine.moves if a == q)) for q in range(machine.states)]
        if len(set(kind)) == len(number):
            break
    moves = sorted({(at[a], x, at[b]) for a, x, b in machine.moves}, key=lambda m: (m[0], m[2], m[1].name, m[1].inverse))
    return Automaton(len(number), tuple(moves), frozenset(at[q] for q in machine.accepting))


def shared(machine: Automaton, edges: dict[Label, int], nodes: int, start: bool = True) -> tuple[list[tuple[int, Label, int]], list[tuple[int, int]]]:
    """Moves, and jumps (from, to) without a label, that stand for the machine's moves.

    A state that has all moves of another one and more jumps there instead, where a jump at each node is less than
    the edges of those moves. Without ``start`` there are no jumps at the beginning.
    """
    own = {q: frozenset((x, b) for a, x, b in machine.moves if a == q) for q in range(machine.states)}
    cost = {q: sum(edges[x] for x, _ in own[q]) for q in own}
    moves, jumps = [], []
    for q in own:
        ends = q in machine.accepting
        fits = [p for p in own if (own[p] < own[q] or own[p] == own[q] and ends and p not in machine.accepting) and (ends or p not in machine.accepting) and cost[p] > nodes and (start or (p and q))]
        to = max(fits, key=cost.get, default=None)
        moves += [(q, x, b) for a, x, b in machine.moves if a == q and (to is None or (x, b) not in own[to])]
        jumps += [] if to is None else [(q, to)]
    return moves, jumps


def product_steps(graph: GraphStore, machine: Automaton) -> DataFrame:
    """Edges of the product graph; the node (x, q) is x * states + q."""
    n = machine.states
    by_label: dict[Label, list[tuple[int, int]]] = {}
    for a, label, b in machine.moves:
        by_label.setdefault(label, []).append((a, b))
    out: DataFrame | None = None
    for label, pairs in by_label.items():
        base = graph.label(label.name)
        cells = (base.T if label.inverse else base).pairs
        moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("m")
        steps = cells.select("row", "col", moves).select((F.col("row") * n + F.col("m.a")).alias("row"), (F.col("col") * n + F.col("m.b")).alias("col"))
        out = steps if out is None else out.unionByName(steps)
    return out


def product_edges(graph: GraphStore, machine: Automaton, start: bool = True) -> tuple[tuple[np.ndarray, np.ndarray], States] | None:
    """Edges of the product graph in dense numbers and what these stand for; None where the labels' edges, or
    twice as many of the product, are more than are sent to tasks."""
    most = most_edges()
    labels = {label for _, label, _ in machine.moves}
    held = graph.cells({label.name for label in labels}, most)
    if held is None:
        return None
    nodes = held.nodes
    counts = {label: len(held.cells[label.name][0]) for label in labels}
    moves, jumps = shared(machine, counts, len(nodes), start)
    if sum(counts[label] for _, label, _ in moves) + len(jumps) * len(nodes) > 2 * most:
        return None
    rows, cols = [], []
    for label in labels:
        x, y = (c.astype(np.int64) for c in held.cells[label.name])
        x, y = (y, x) if label.inverse else (x, y)
        for a, b in ((a, b) for a, other, b in moves if other == label):
            rows.append(x * machine.states + a)
            cols.append(y * machine.states + b)
    every = np.arange(len(nodes)) * machine.states
    for a, b in jumps:
        rows.append(every + a)
        cols.append(every + b)
    return (np.concatenate(rows), np.concatenate(cols)), States(nodes, machine.states, tuple(sorted(machine.accepting)))


def numbered(graph: GraphStore, machine: Automaton) -> bool:
    """Whether all nodes times the states, as :func:`product_steps` numbers them, are longs."""
    edges = graph.edges.where(F.col("p").isin(*{label.name for _, label, _ in machine.moves}))
    least, most = edges.agg(F.min(F.least("s", "o")), F.max(F.greatest("s", "o"))).first()
    return least is None or (least > -(1 << 62) // machine.states and most < (1 << 62) // machine.states)


def from_one(graph: GraphStore, path: Path, row: int | None, col: int | None, deadline: float | None = None) -> BoolMatrix | None:
    """The relation of a path from a bound end, by a search at the driver over its labels' edges; None where these
    are more than are sent to tasks. No product graph is made or sent."""
    if row is None:
        found = from_one(graph, reverse(path), col, None, deadline)
        return None if found is None else found.T
    machine = merged(automaton(path))
    held = graph.cells({label.name for _, label, _ in machine.moves}, most_edges())
    if held is None:
        return None
    moves = [(a, (label.name, label.inverse), b) for a, label, b in machine.moves]
    nodes = held.search(row, machine.states, moves, machine.accepting, col, lambda: check(deadline))
    starts = np.append(np.arange(0, len(nodes), TILE), len(nodes)).astype(np.int32)
    blocks = graph.spark.createDataFrame(pa.table({"cols": pa.ListArray.from_arrays(pa.array(starts), pa.array(nodes))}))
    return BoolMatrix(blocks.select(F.lit(row).cast("long").alias("row"), F.explode("cols").alias("col"))).restrict(col=col)


def evaluate(graph: GraphStore, path: Path, row: int | None = None, col: int | None = None, strategy: str = "auto", deadline: float | None = None) -> BoolMatrix:
    """The relation of a path, by one propagation on the product graph."""
    if row is None and col is not None:
        return evaluate(graph, reverse(path), col, None, strategy, deadline).T
    check(deadline)
    if row is not None and strategy == "auto":
        found = from_one(graph, path, row, col, deadline)
        if found is not None:
            return found
    start = row is not None or graph.all_ends  # else some begin at nodes where the empty path is not theirs
    machine = merged(automaton(path), start)
    n = machine.states
    starts = BoolMatrix.one(graph.spark, row, row).pairs if row is not None else graph.identity().pairs
    product = product_edges(graph, machine, start) if strategy != "joins" else None
    if product is not None:
        check(deadline)
        edges, states = product
        found = BoolMatrix(carried(starts, edges, True, None, strategy, row is not None, states))
        beside = None if row is not None or graph.all_ends else _beside(graph, machine)
        if beside is not None and not beside.isEmpty():
            found = BoolMatrix(found.pairs.unionByName(carried(beside, edges, True, None, strategy, False, replace(states, accepting=states.accepting[states.accepting[:1] == (0,) :]))))
        return found.restrict(col=col)
    if not numbered(graph, machine):
        raise OverflowError(f"ids beyond 2^62 / {n} in a product graph of this size")
    seeds = starts.select("row", (F.col("col") * n).alias("col"))
    reached = propagate(seeds, product_steps(graph, machine), True, strategy=strategy, deadline=deadline, single=row is not None)
    state = F.pmod("col", F.lit(n))
    ends = reached.where(state.isin(*machine.accepting))
    if row is None and not graph.all_ends:
        more = propagate(_beside(graph, machine).select("row", (F.col("col") * n).alias("col")), product_steps(graph, machine), True, strategy=strategy, deadline=deadline)
        ends = ends.unionByName(more.where(state.isin(*(machine.accepting - {0}))))
    ends = ends.select("row", F.expr(f"(col - pmod(col, {n})) div {n}").alias("col"))
    return BoolMatrix(ends.distinct()).restrict(col=col)


def _beside(graph: GraphStore, machine: Automaton) -> DataFrame:
    """(x, x) for sources of first edges that are not in the universe: the empty path is none of theirs."""
    out: DataFrame | None = None
    for label in {label for a, label, _ in machine.moves if a == 0}:
        base = graph.label(label.name)
        ends = (base.T if label.inverse else base).pairs.select("row")
        out = ends if out is None else out.unionByName(ends)
    ids = graph.nodes.select(F.col("id").alias("row"))
    return out.distinct().join(ids, "row", "left_anti").select("row", F.col("row").alias("col"))
