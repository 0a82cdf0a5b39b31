"""Evaluation of path expressions over a graph.

Bound ends go down the tree: they filter labels, start the search of closures, and decide from which side
a concatenation is joined. With both ends open, a concatenation joins its cheapest neighbours first, and
a closure in it is searched only from the pairs that its neighbour has.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from contextlib import suppress
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.operators.propagate import Timeout, check
from pathweave.operators.relation import BoolMatrix
from pathweave.session import intermediates
from pathweave.sources.graph import GraphStore

from .ast import Alt, Concat, Label, Opt, Path, Plus, Star, labels, mandatory_labels, reverse
from .nfa import evaluate as evaluate_nfa
from .nfa import from_one
from .parser import PathSyntaxError, parse_path, parse_query
from .rewrite import simplify

CLOSURES = (Star, Plus)
#: From this many estimated pairs on, a relation is not shuffled to meet a bound query's few pairs: these
#: are counted, and up to FRONTIER of them (16 bytes each) are sent to where the relation is scanned.
LARGE, FRONTIER = 10_000_000, 200_000


def closures_in(path: Path) -> bool:
    """Whether the expression repeats anything."""
    match path:
        case Star() | Plus():
            return True
        case Concat(parts) | Alt(parts):
            return any(map(closures_in, parts))
        case Opt(part):
            return closures_in(part)
    return False


def whole_closures(path: Path, both_open: bool) -> bool:
    """Whether the algebra would compute a closure over all nodes only as an operand: one that is repeated again, one
    of several branches within a concatenation, or, with both ends open, one that meets another closure."""
    match path:
        case Star(part) | Plus(part):
            return closures_in(part)
        case Opt(part):
            return whole_closures(part, both_open)
        case Alt(parts):
            return any(whole_closures(p, both_open) for p in parts)
        case Concat(parts):
            bare = [p.part if isinstance(p, Opt) else p for p in parts]
            if any(closures_in(p) and (not isinstance(p, CLOSURES) or whole_closures(p, both_open)) for p in bare):
                return True
            return both_open and sum(map(closures_in, parts)) > 1
    return False


def plain(path: Path) -> bool:
    """Whether no part of the expression may be empty."""
    match path:
        case Star() | Opt():
            return False
        case Concat(parts) | Alt(parts):
            return all(map(plain, parts))
        case Plus(part):
            return plain(part)
    return True


def from_bound_ends(path: Path, row: bool, col: bool) -> bool:
    """Whether an end is bound, and the algebra that starts there takes a part that may be empty as the automaton
    does: as no step at all, also at a node beside the universe. Only within an operand it is the identity."""

    def onward(p: Path) -> bool:
        return plain(p) or (isinstance(p, CLOSURES) and plain(p.part)) or (isinstance(p, Opt) and onward(p.part))

    def begins(p: Path) -> bool:
        match p:
            case Star(part) | Plus(part):
                return plain(part)
            case Opt(part):
                return begins(part)
            case Alt(parts):
                return all(map(begins, parts))
            case Concat(parts):
                return begins(parts[0]) and all(map(onward, parts[1:]))
        return True

    return (row or col) and (not row or begins(path)) and (not col or begins(reverse(path)))


@dataclass
class Solver:
    """Answers path queries over ``graph``.

    ``on_unknown`` says what an unknown label or constant gives: ``empty`` (the whole query has no answer),
    ``error``, or ``no_edges`` (a label that the graph doesn't have is the empty relation, so that the rest of
    the query may still answer; an unknown constant gives no answer). ``strategy`` is that of closures; ``engine`` is ``algebra`` or ``nfa``. ``timeout`` is in
    seconds and looked at between jobs.
    """

    graph: GraphStore
    on_unknown: str = "empty"
    strategy: str = "auto"
    engine: str = "algebra"
    timeout: float | None = None
    _deadline: float | None = field(default=None, repr=False)
    _known: dict[Path, BoolMatrix] = field(default_factory=dict, repr=False)

    # -- entry ------------------------------------------------------------------------------------
    def solve(self, subject: str | int | None, path: str | Path, object_: str | int | None) -> BoolMatrix:
        """The pairs (s, o) that the path joins; an end that is None is a variable."""
        tree = simplify(parse_path(path) if isinstance(path, str) else path)
        self._deadline = None if self.timeout is None else time.monotonic() + self.timeout
        self._known = {}
        ends = []
        unknown = [] if self.on_unknown == "no_edges" else sorted(labels(tree) - self.graph.labels())
        for end in (subject, object_):
            ends.append(None if end is None else self.graph.node_id(end))
            if end is not None and ends[-1] is None:
                unknown.append(str(end))
        if unknown:
            if self.on_unknown == "error":
                raise KeyError(f"not in the graph: {', '.join(unknown)}")
            return BoolMatrix.empty(self.graph.spark)
        if mandatory_labels(tree) - self.graph.labels():  # no match can do without a label that has no edge
            return BoolMatrix.empty(self.graph.spark)
        if self.engine == "nfa":
            return evaluate_nfa(self.graph, tree, ends[0], ends[1], self.strategy, self._deadline)
        if self.strategy == "auto" and closures_in(tree) and from_bound_ends(tree, *(end is not None for end in ends)):
            found = from_one(self.graph, tree, *ends, self._deadline)
            if found is not None:
                return found
        if whole_closures(tree, ends == [None, None]):
            # Relations within the path would be as large as all pairs of nodes; the product graph has none.
            with suppress(OverflowError):
                return evaluate_nfa(self.graph, tree, ends[0], ends[1], self.strategy, self._deadline)
        return self.evaluate(tree, ends[0], ends[1])

    # -- the tree ---------------------------------------------------------------------------------
    def evaluate(self, path: Path, row: int | None = None, col: int | None = None) -> BoolMatrix:
        """The relation of a tree, restricted to a row and a column."""
        check(self._deadline)
        if row is None and col is None and path in self._known:
            return self._known[path]
        match path:
            case Label(name, inverse):
                base = self.graph.label(name)
                out = (base.T if inverse else base).restrict(row, col)
            case Alt(parts):
                first, *rest = [self.evaluate(p, row, col) for p in parts]
                out = first.or_(*rest)
            case Opt(part):
                out = self.evaluate(part, row, col).or_(self._identity(row, col))
            case Star(part) | Plus(part):
                out = self.evaluate(part).closure(isinstance(path, Star), self.graph.nodes, row, col, self.strategy, self._deadline)
            case Concat(parts):
                out = self._chain(list(parts), row, col)
            case _:
                raise TypeError(path)
        if row is None and col is None:
            self._known[path] = out
        return out

    def _identity(self, row: int | None, col: int | None) -> BoolMatrix:
        """(x, x) over the universe, or over the bound ends, which belong to it."""
        if row is None and col is None:
            return self.graph.identity()
        if row is not None and col is not None and row != col:
            return BoolMatrix.empty(self.graph.spark)
        node = row if row is not None else col
        return BoolMatrix.one(self.graph.spark, node, node)

    def _chain(self, parts: list[Path], row: int | None, col: int | None) -> BoolMatrix:
        """A concatenation, from the bound end, or in the order of estimated cost."""
        if row is None and col is not None:
            return self._chain([reverse(p) for p in reversed(parts)], col, None).T
        if row is not None and col is not None and self._estimate(parts[-1]) < self._estimate(parts[0]):
            return self._walk([reverse(p) for p in reversed(parts)], col, row).T
        return self._walk(parts, row, col) if row is not None else self._join_cheapest(parts)

    def _walk(self, parts: list[Path], row: int, col: int | None) -> BoolMatrix:
        """From the bound row through all parts; the last meets the column."""
        found = self.evaluate(parts[0], row, col if len(parts) == 1 else None)
        for i, part in enumerate(parts[1:], 1):
            if not isinstance(part, CLOSURES) and self._estimate(part) >= LARGE:
                found = self._sent(found)
            found = self._after(found, part, col if i == len(parts) - 1 else None, True)
        return found

    def _sent(self, found: BoolMatrix) -> BoolMatrix:
        """The pairs as a broadcast table if they are few, else as they are."""
        check(self._deadline)
        pairs = found.pairs.limit(FRONTIER + 1).toArrow()
        if pairs.num_rows > FRONTIER:
            return found
        return BoolMatrix(F.broadcast(self.graph.spark.createDataFrame(pairs)), found.dims)

    def _after(self, found: BoolMatrix, part: Path, col: int | None = None, single: bool = False) -> BoolMatrix:
        """``found`` times one more part; closures and options need no relation of their own. ``single``: it has one row."""
        if isinstance(part, CLOSURES):
            from_seeds = found.mult_closure(self.evaluate(part.part), isinstance(part, Star), strategy=self.strategy, deadline=self._deadline, single=single)
            return from_seeds.restrict(col=col)
        if isinstance(part, Opt):
            return found.restrict(col=col).or_(self._after(found, part.part, col, single))
        return found.mult(self.evaluate(part), col=col)

    def _join_cheapest(self, parts: list[Path]) -> BoolMatrix:
        """Both ends open: neighbours with the least estimated sizes are joined first.

        Closures wait until a neighbour is there to be their seeds; only if all are closures is one of them
        computed whole.
        """
        done: list[tuple[Path | None, BoolMatrix | None, float]] = [(p, None, self._estimate(p)) for p in parts]

        def relation(i: int) -> BoolMatrix:
            path, got, _ = done[i]
            return got if got is not None else self.evaluate(path)

        def is_closure(i: int) -> bool:
            return done[i][1] is None and isinstance(done[i][0], CLOSURES)

        while len(done) > 1:
            choices = range(len(done) - 1)
            free = [i for i in choices if not (is_closure(i) and is_closure(i + 1))] or list(choices)
            i = min(free, key=lambda k: done[k][2] + done[k + 1][2])
            left, right = done[i], done[i + 1]
            if is_closure(i + 1):
                got = self._after(relation(i), right[0])
            elif is_closure(i):
                got = relation(i + 1).T.mult_closure(self.evaluate(left[0].part).T, isinstance(left[0], Star), strategy=self.strategy, deadline=self._deadline).T
            else:
                got = relation(i).mult(relation(i + 1))
            size = left[2] * right[2] / max(1.0, self._ends())
            done[i : i + 2] = [(None, got, max(size, 1.0))]
        return relation(0)

    def _ends(self) -> float:
        stats = self.graph.stats().values()
        return float(max((max(s[1], s[2]) for s in stats), default=1))

    def _estimate(self, path: Path) -> float:
        """A guess at the number of pairs, from the labels' edge counts."""
        match path:
            case Label(name):
                return float(self.graph.stats().get(name, (0, 0, 0))[0])
            case Alt(parts):
                return sum(map(self._estimate, parts))
            case Concat(parts):
                size = 1.0
                for p in parts:
                    size *= max(1.0, self._estimate(p))
                return size / max(1.0, self._ends()) ** (len(parts) - 1)
            case Opt(part):
                return self._estimate(part) + self._ends()
            case Star(part) | Plus(part):
                return self._ends() ** 2 + self._estimate(part)
        raise TypeError(path)


RESULT = "query_id int, n_pairs long, status string, elapsed_ns long"


def run_workload(graph: GraphStore, lines: Iterable[str], timeout: float | None = 60.0, **options) -> DataFrame:
    """Answer the query lines one after the other: query_id (from 1), n_pairs, status, elapsed_ns.

    Blank lines are skipped but counted. ``status`` is ok, unknown (a label or constant the graph doesn't
    have: 0 pairs), timeout (n_pairs null) or error (a line that can't be read, n_pairs null). A query that
    runs over its time is cancelled in Spark. What a query wrote on its way is deleted when it is counted.
    """
    spark = graph.spark
    rows = []
    for i, line in enumerate(lines, 1):
        if not line.strip():
            continue
        began, status, n = time.perf_counter_ns(), "ok", None
        tag = f"pathweave-query-{i}-{began}"
        timer = None
        try:
            query = parse_query(line)
            solver = Solver(graph, on_unknown="error", timeout=timeout, **options)
            if timeout is not None:
                timer = _cancel_after(spark, tag, timeout)
            spark.addTag(tag)
            with intermediates(spark):
                n = solver.solve(query.subject, query.path, query.object).count()
        except KeyError:
            status, n = "unknown", 0
        except PathSyntaxError:
            status = "error"
        except Timeout:
            status = "timeout"
        except Exception:
            if not (timer is not None and timer.fired.is_set()):
                raise
            status = "timeout"
        finally:
            spark.removeTag(tag)
            if timer is not None:
                timer.cancel()
        rows.append((i, n, status, time.perf_counter_ns() - began))
    return spark.createDataFrame(rows, RESULT)


def _cancel_after(spark, tag: str, seconds: float):
    """A running timer that cancels the jobs of a tag; ``fired`` tells whether it did."""
    import threading

    fired = threading.Event()

    def act() -> None:
        fired.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, act)
    timer.daemon = True
    timer.fired = fired
    timer.start()
    return timer


__all__ = ["Solver", "Timeout", "run_workload"]
