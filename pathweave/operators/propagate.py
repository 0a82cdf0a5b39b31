"""Reachability along a step relation, the one recursive operator that all closures come down to.

``propagate(seeds, step)`` is seeds · step*, or seeds · step+ without the seeds themselves. A closure
of the step relation has the identity as seeds, a single-source one a single pair, a product followed
by a closure the product.

All strategies give the same pairs. Where the step relation has at most ``BROADCAST_EDGES`` edges
(counted, never assumed) it goes to all tasks, and each task carries blocks of sources along it as bit
sets, 64 sources to a word: one job, no matter how long the paths are. What goes is a compressed
adjacency (``broadcast``), or, where a trial search from several sources is not over after ``DEEP`` rounds, its
strongly connected components (``condense``). Beyond that many edges the driver runs a semi-naive loop of joins
(``joins``): only the pairs that are new are joined again, and each round's result is written, so that
plans stay small. A closure with open ends that is not over after ``SHALLOW`` rounds is squared from there
on, which doubles the length of paths in each round.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.session import written

from .condense import Condensed

#: Edges of a step relation up to which it is sent to all tasks: 2 million, 32 MB.
BROADCAST_EDGES = 2_000_000
#: Bytes of bit sets that a task holds for a block of sources.
BLOCK_BYTES = 64_000_000
#: Bits that a task unpacks at a time, and pairs that one row of sources and nodes may stand for: Spark holds
#: what a row is exploded to.
SLICE, TILE = 1 << 20, 1 << 16
#: Rounds of a trial search after which the components are taken, and of joins after which squares are.
DEEP, SHALLOW = 64, 8
SCHEMA = "row long, col long"


class Timeout(RuntimeError):
    """The deadline of a query passed between two steps."""


def check(deadline: float | None) -> None:
    """Raise :class:`Timeout` if the deadline (of ``time.monotonic``) has passed."""
    if deadline is not None and time.monotonic() > deadline:
        raise Timeout


def most_edges() -> int:
    """Edges up to which a step relation is sent to all tasks."""
    return BROADCAST_EDGES


def small_edges(step: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Both columns of the step relation, or None if it has more than ``most`` rows."""
    got = step.limit(most + 1).toArrow()
    if got.num_rows > most:
        return None
    return got.column("row").to_numpy(), got.column("col").to_numpy()


class Adjacency:
    """Edges by their source in dense numbers: ids (sorted), starts of each source's targets, targets."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray) -> None:
        self.ids = np.unique(np.concatenate([rows, cols]))
        source, target = np.searchsorted(self.ids, rows), np.searchsorted(self.ids, cols)
        order = np.lexsort((target, source))
        self.target = target[order]
        self.starts = np.searchsorted(source[order], np.arange(len(self.ids) + 1))

    def dense(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dense numbers of nodes, and which of them the relation knows at all."""
        if not len(self.ids):
            return np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
        at = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        return at, self.ids[at] == nodes

    def deep(self, rounds: int) -> bool:
        """Whether a search from 64 nodes, dealt evenly over all, goes on for more than so many rounds."""
        some = np.unique(np.linspace(0, len(self.ids) - 1, 64).astype(np.int64)) if len(self.ids) else np.zeros(0, np.int64)
        seen = np.zeros(len(self.ids), bool)
        active = some
        for _ in range(rounds):
            if not len(active):
                return False
            count = self.starts[active + 1] - self.starts[active]
            edge = np.repeat(self.starts[active] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            active = np.unique(self.target[edge])
            active = active[~seen[active]]
            seen[active] = True
        return len(active) > 0

    def reach(self, slot: np.ndarray, node: np.ndarray, words: int, stop: tuple[int, int] | None = None) -> np.ndarray:
        """Bit sets (a row of words for each node) of the slots that reach it by one step or more.

        ``slot`` and ``node`` are the seeds. A round carries only bits that are new, along the edges of the
        nodes that have any. ``stop`` is (slot, node): the search ends when that bit is set. A single slot
        is carried node by node after ``DEEP`` rounds, so that a long path is not a round for each hop.
        """
        n = len(self.ids)
        found = np.zeros((n, words), np.uint64)
        new = np.zeros((n, words), np.uint64)
        np.bitwise_or.at(new, (node, slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
        active = np.unique(node)
        rounds, alone = 0, words == 1 and not slot.any()
        while len(active):
            if alone and rounds == DEEP:
                self._walk(found, active, None if stop is None else stop[1])
                break
            rounds += 1
            count = self.starts[active + 1] - self.starts[active]
            edge = np.repeat(self.starts[active] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            if not len(edge):
                break
            target = self.target[edge]
            order = np.argsort(target, kind="stable")
            target, source = target[order], np.repeat(active, count)[order]
            first = np.flatnonzero(np.diff(target, prepend=-1))
            # Edges into one target are combined in slices, so that no copy grows beyond a block.
            into, bits = target[first], np.empty((len(first), words), np.uint64)
            ends = np.append(first[1:], len(target))
            per = max(1, BLOCK_BYTES // (8 * words))
            lo = 0
            while lo < len(first):
                hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + per, side="right")))
                bits[lo:hi] = np.bitwise_or.reduceat(new[source[first[lo] : ends[hi - 1]]], first[lo:hi] - first[lo], axis=0)
                lo = hi
            bits &= ~found[into]
            alive = bits.any(1)
            new[active] = 0
            active = into[alive]
            new[active] = bits[alive]
            found[active] |= bits[alive]
            if stop is not None and found[stop[1], stop[0] >> 6] >> np.uint64(stop[0] & 63) & np.uint64(1):
                break
        return found

    def _walk(self, found: np.ndarray, active: np.ndarray, stop: int | None) -> None:
        """Sets the bit of slot 0 for all nodes that the active ones lead to, or until ``stop`` has it."""
        starts, target = self.starts.tolist(), self.target.tolist()
        seen, ahead = bytearray((found[:, 0] != 0).tobytes()), active.tolist()
        while ahead and (stop is None or not seen[stop]):
            node = ahead.pop()
            for to in target[starts[node] : starts[node + 1]]:
                if not seen[to]:
                    seen[to] = 1
                    ahead.append(to)
        found[:, 0] = np.frombuffer(seen, np.uint8)


def blocks_of(sources: np.ndarray, ids: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of bit sets (a row of words for each node, a bit for each source) as full blocks: sources, and
    the nodes that all of them reach.

    Sources that reach the same nodes share a block, as all of a component do; so what a task hands over is
    far smaller than the pairs that come of it.
    """
    n, words = found.shape
    across = np.zeros((len(sources), -(-max(1, n) // 64) * 8), np.uint8)  # of each source the bits of its nodes
    step = max(8, SLICE // (64 * words) // 8 * 8)
    for i in range(0, n, step):
        bits = np.packbits(np.unpackbits(found[i : i + step].view(np.uint8), axis=1, bitorder="little", count=len(sources)).T, axis=1, bitorder="little")
        across[:, i // 8 : i // 8 + bits.shape[1]] = bits
    rows = across.view(np.uint64)
    odd = np.random.default_rng(7).integers(0, 1 << 63, rows.shape[1], np.uint64) | np.uint64(1)
    mark = np.array([np.multiply(r, odd).sum(dtype=np.uint64) for r in rows], np.uint64)
    _, first, group = np.unique(mark, return_index=True, return_inverse=True)
    # Sources of one hash whose bits differ all the same get blocks of their own.
    alone = np.array([i for i, g in enumerate(group.tolist()) if i != first[g] and not np.array_equal(rows[i], rows[first[g]])], np.int64)
    group[alone] = len(first) + np.arange(len(alone))
    first = np.append(first, alone)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(first)))
    per = max(1, SLICE // max(1, n))
    for lo in range(0, len(first), per):
        hi = min(len(first), lo + per)
        which, node = np.nonzero(np.unpackbits(across[first[lo:hi]], axis=1, bitorder="little", count=n))
        start = int(ends[lo - 1]) if lo else 0
        to = np.searchsorted(which, np.arange(hi - lo), "right")
        groups = list(zip(np.split(sources[order[start : ends[hi - 1]]], ends[lo : hi - 1] - start), np.split(ids[node], to[:-1]), strict=True))
        if all(len(x) * len(y) <= TILE for x, y in groups):
            yield _batch(groups)
            continue
        for x, y in groups:
            wide = min(len(x), 256)
            high = max(1, TILE // wide)
            tiles = [(x[i : i + wide], y[j : j + high]) for i in range(0, len(x), wide) for j in range(0, len(y), high)]
            for i in range(0, len(tiles), 64):
                yield _batch(tiles[i : i + 64])


def _batch(tiles: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = []
    for side in zip(*tiles, strict=True):
        starts = np.append(0, np.cumsum([len(x) for x in side])).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(side))))
    return pa.RecordBatch.from_arrays(columns, ["rows", "cols"])


def _kernel(shared, keep_seeds: bool, target: int | None):
    """Carries the seeds of a partition, sorted by row, in blocks of sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph: Adjacency
        condensed: Condensed | None
        states: States | None
        graph, condensed, states = shared.value
        words = int(min(64, max(1, BLOCK_BYTES // (16 * max(1, len(graph.ids))))))

        def block(rows: np.ndarray, cols: np.ndarray) -> Iterator[pa.RecordBatch]:
            sources, slot = np.unique(rows, return_inverse=True)
            few = -(-len(sources) // 64)
            node, known = graph.dense(cols) if states is None else states.begin(graph, cols)
            stop = None
            if target is not None and len(sources) == 1 and states is None:
                at, there = graph.dense(np.array([target]))
                stop = (0, int(at[0])) if there[0] else None
            if condensed is not None:
                found = condensed.reach(slot[known], node[known], few, BLOCK_BYTES)
                found = found[condensed.component]  # of each node the bits of its component
            else:
                found = graph.reach(slot[known], node[known], few, stop)
            if keep_seeds:
                np.bitwise_or.at(found, (node[known], slot[known] >> 6), np.uint64(1) << (slot[known] & 63).astype(np.uint64))
                if states is None or 0 in states.accepting:
                    left, right = rows[~known], cols[~known]
                    for i in range(0, len(left), TILE):
                        yield _batch([(left[j : j + 1], right[j : j + 1]) for j in range(i, min(len(left), i + TILE))])
            ids, found = (graph.ids, found) if states is None else states.end(graph, found)
            yield from blocks_of(sources, ids, found)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            rows, cols = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held.append((rows, cols))
            rows, cols = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            begins = np.flatnonzero(np.diff(rows, prepend=rows[:1] - 1)) if len(rows) else np.zeros(0, np.int64)
            # Whole blocks go; the last source may go on in the next batch.
            while len(begins) > 64 * words:
                cut = begins[64 * words]
                yield from block(rows[:cut], cols[:cut])
                rows, cols = rows[cut:], cols[cut:]
                begins = begins[64 * words :] - cut
            held = [(rows, cols)]
        if held and len(held[0][0]):
            yield from block(*held[0])

    return run


@dataclass(frozen=True)
class States:
    """What the nodes of a product graph stand for: number ``at * n + state`` is the node ``nodes[at]`` in a state.

    Seeds are nodes in state 0; of what is reached, the nodes in an accepting state are the result, each once.
    """

    nodes: np.ndarray
    n: int
    accepting: tuple[int, ...]

    def begin(self, graph: Adjacency, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dense numbers of nodes in state 0, and which of them the product graph has."""
        if not len(self.nodes):
            return np.zeros(len(cols), np.int64), np.zeros(len(cols), bool)
        at = np.minimum(np.searchsorted(self.nodes, cols), len(self.nodes) - 1)
        node, known = graph.dense(at * self.n)
        return node, known & (self.nodes[at] == cols)

    def end(self, graph: Adjacency, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes, and the bits that any of their accepting states has."""
        keep = np.flatnonzero(np.isin(graph.ids % self.n, self.accepting))
        at = graph.ids[keep] // self.n
        first = np.flatnonzero(np.diff(at, prepend=-1))
        if not len(first):
            return self.nodes[:0], found[:0]
        return self.nodes[at[first]], np.bitwise_or.reduceat(found[keep], first, axis=0)


def carried(seeds: DataFrame, edges: tuple[np.ndarray, np.ndarray], keep_seeds: bool, target: int | None = None, strategy: str = "auto", single: bool = False, states: States | None = None) -> DataFrame:
    """Pairs of distinct seeds · step* or seeds · step+ by search in the tasks; ``edges`` go to all of them."""
    spark = seeds.sparkSession
    graph = Adjacency(*edges)
    condensed = Condensed(graph) if strategy == "condense" or (strategy == "auto" and not single and graph.deep(DEEP)) else None
    shared = spark.sparkContext.broadcast((graph, condensed, states))  # bounded by the callers
    # Few seeds may have very many pairs: a number of partitions is given, as those of unknown number are merged by size.
    parts = [] if single else [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    # By a hash of the row: after a distinct by row Spark leaves out a repartition by the same, and merges the distinct's.
    dealt = seeds.repartition(*parts, F.xxhash64("row")).sortWithinPartitions("row")
    blocks = dealt.mapInArrow(_kernel(shared, keep_seeds, target), "rows array<long>, cols array<long>")
    return blocks.select(F.explode("rows").alias("row"), "cols").select("row", F.explode("cols").alias("col"))


def propagate(seeds: DataFrame, step: DataFrame, keep_seeds: bool, target: int | None = None, strategy: str = "auto", deadline: float | None = None, edges: tuple[np.ndarray, np.ndarray] | None = None, single: bool = False) -> DataFrame:
    """Distinct pairs (row, col) of seeds · step* (``keep_seeds``) or seeds · step+.

    ``target`` says that only pairs with this col are wanted: the search of a single source may end when
    it is reached (other pairs may then be missing; the caller filters). ``strategy`` is auto, broadcast,
    condense or joins. ``edges`` are the step relation's, where the caller has read them; ``single`` says that
    all seeds have one row.
    """
    check(deadline)
    seeds, step = seeds.select("row", "col").distinct(), step.select("row", "col")
    if strategy in ("auto", "broadcast", "condense"):
        edges = edges if edges is not None else small_edges(step, BROADCAST_EDGES)
        if edges is not None:
            check(deadline)
            return carried(seeds, edges, keep_seeds, target, strategy, single)
        if strategy != "auto":
            raise ValueError(f"the step relation has more than {BROADCAST_EDGES} edges")
    return semi_naive(seeds, step, keep_seeds, target, deadline)


def semi_naive(seeds: DataFrame, step: DataFrame, keep_seeds: bool, target: int | None = None, deadline: float | None = None) -> DataFrame:
    """The loop of joins: each round joins the pairs that are new with the step relation."""
    step = written(step.distinct(), "step").select(F.col("row").alias("mid"), F.col("col").alias("to"))
    new = written(seeds, "seeds")
    found: DataFrame | None = new if keep_seeds else None
    k = 0
    while True:
        check(deadline)
        ahead = new.join(step, new["col"] == step["mid"]).select("row", F.col("to").alias("col")).distinct()
        if found is not None:
            ahead = ahead.join(found, ["row", "col"], "left_anti")
        new = written(ahead, f"new-{k}")
        if new.isEmpty():
            return found if found is not None else new
        # Rounds pile up as a union of files; from time to time they become one table.
        found = new if found is None else found.unionByName(new)
        k += 1
        if k % 8 == 0:
            found = written(found, f"found-{k}")
        if target is not None and not new.where(F.col("col") == target).isEmpty():
            return found


def closed(step: DataFrame, strategy: str = "auto", deadline: float | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct pairs of step+, both ends open; ``strategy`` may be squaring, too. With ``nodes`` (column row,
    distinct) step* over these."""
    step = step.select("row", "col")
    if strategy == "squaring":
        return reflexive(squaring(step, deadline), nodes)
    edges = None
    if strategy != "joins":
        edges = small_edges(step, BROADCAST_EDGES)
        if edges is None and strategy == "auto":
            return reflexive(shallow_then_squared(step, deadline), nodes)
    starts = step.select("row").distinct()
    own = lambda rows: rows.select("row", F.col("row").alias("col"))
    if nodes is None or edges is None:
        return reflexive(propagate(own(starts), step, False, strategy=strategy, deadline=deadline, edges=edges), nodes)
    # The search keeps its seeds, so that no pair is compared with (x, x) again; other sources have no such pair.
    whole = propagate(own(nodes), step, True, strategy=strategy, deadline=deadline, edges=edges)
    beside = starts.join(nodes, "row", "left_anti")
    if beside.isEmpty():
        return whole
    return whole.unionByName(propagate(own(beside), step, False, strategy=strategy, deadline=deadline, edges=edges))


def reflexive(pairs: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Distinct pairs and (x, x) for all ``nodes``; only pairs of that kind are compared. The pairs are read twice."""
    if nodes is None:
        return pairs
    same = pairs.where("row = col").unionByName(nodes.select("row", F.col("row").alias("col"))).distinct()
    return pairs.where("row != col").unionByName(same)


def shallow_then_squared(step: DataFrame, deadline: float | None = None) -> DataFrame:
    """step+ by joins for ``SHALLOW`` rounds, then, if there are longer paths, by squares of what was found."""
    step = written(step.select("row", "col").distinct(), "step")
    onward = step.select(F.col("row").alias("mid"), F.col("col").alias("to"))
    found = new = step
    for k in range(SHALLOW):
        check(deadline)
        ahead = new.join(onward, new["col"] == onward["mid"]).select("row", F.col("to").alias("col")).distinct()
        new = written(ahead.join(found, ["row", "col"], "left_anti"), f"new-{k}")
        if new.isEmpty():
            return found
        found = found.unionByName(new)
    return squared(found, deadline)


def squaring(step: DataFrame, deadline: float | None = None) -> DataFrame:
    """step+ by repeated squaring: rounds in the logarithm of the longest path, for very long chains.

    Within a strongly connected component all nodes reach all, and squares of such pairs would cost the cube of
    its size. Where the edges can be read (``BROADCAST_EDGES``) components are found first, their acyclic relation is
    squared, and pairs of components become the pairs of their members.
    """
    step = step.select("row", "col").distinct()
    edges = small_edges(step, BROADCAST_EDGES)
    condensed = Condensed(Adjacency(*edges)) if edges is not None else None
    if condensed is None or condensed.n == len(condensed.ids):
        return squared(step, deadline)
    check(deadline)
    spark = step.sparkSession
    cyclic = np.flatnonzero(condensed.cyclic)
    pairs = spark.createDataFrame(pa.table({"row": cyclic, "col": cyclic}))
    if len(condensed.source):
        pairs = pairs.unionByName(squared(spark.createDataFrame(pa.table({"row": condensed.source, "col": condensed.target})), deadline))
    # Members in parts, so that two parts make no more pairs than a tile has.
    side = int(TILE**0.5)
    parts = [(c, condensed.ids[condensed.members[i : min(b, i + side)]]) for c, (a, b) in enumerate(zip(condensed.member_starts[:-1].tolist(), condensed.member_starts[1:].tolist(), strict=True)) for i in range(a, b, side)]
    component = pa.array([c for c, _ in parts], pa.int64())
    ends = np.append(0, np.cumsum([len(x) for _, x in parts])).astype(np.int32)
    members = spark.createDataFrame(pa.table({"component": component, "part": pa.array(range(len(parts)), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for _, x in parts])))}))
    # Only numbers of parts are dealt out, in pairs, so that tasks get as many tiles; a node of the step relation is in
    # one part, so the members can be sent.
    numbers = members.select(F.col("component").alias("row"), "part"), members.select(F.col("component").alias("col"), F.col("part").alias("other"))
    tiles = pairs.join(F.broadcast(numbers[0]), "row").join(F.broadcast(numbers[1]), "col").select("part", "other")
    dealt = tiles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = F.broadcast(members.select("part", F.col("ids").alias("rows")))
    right = F.broadcast(members.select(F.col("part").alias("other"), F.col("ids").alias("cols")))
    blocks = dealt.join(left, "part").join(right, "other").select("rows", "cols")
    return blocks.select(F.explode("rows").alias("row"), "cols").select("row", F.explode("cols").alias("col"))


def squared(step: DataFrame, deadline: float | None = None) -> DataFrame:
    """step+ of distinct pairs by joins of what was found with itself."""
    found = written(step, "square-0")
    n, k = found.count(), 0
    while True:
        check(deadline)
        k += 1
        right = found.select(F.col("row").alias("mid"), F.col("col").alias("to"))
        longer = found.join(right, found["col"] == right["mid"]).select("row", F.col("to").alias("col"))
        found = written(found.unionByName(longer).distinct(), f"square-{k}")
        after = found.count()
        if after == n:
            return found
        n = after
