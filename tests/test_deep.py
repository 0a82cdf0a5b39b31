"""Strategies for deep and cyclic graphs, storage, and what the oracle reads."""

import os
import random
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave import oracle, session, shapes
from pathweave.operators.condense import Condensed, components_of
from pathweave.operators.propagate import Adjacency, carried, closed, propagate, shallow_then_squared
from pathweave.operators.relation import BoolMatrix
from pathweave.operators.search import Cells
from pathweave.plans import Solver
from pathweave.plans.ast import Alt, Concat, Label, Opt, Plus, Star
from pathweave.plans.nfa import automaton, merged, shared
from pathweave.plans.parser import parse_path
from pathweave.plans.rewrite import simplify
from pathweave.sources.graph import GraphStore, read_pairs, write_pairs
from pathweave.sources.tables import events_graph

from test_relation import closed_by_search


def adjacency(edges):
    return Adjacency(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64))


@pytest.mark.parametrize("seed", range(40))
def test_condensed_reaches_the_same(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 30)
    edges = list({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 60))})
    graph = adjacency(edges)
    condensed, size = Condensed(graph), len(graph.ids)
    slots = np.arange(size)
    found = condensed.reach(slots, slots, 1, 100)[condensed.component]
    got = {(int(graph.ids[s]), int(graph.ids[t])) for t in range(size) for s in range(size) if int(found[t, 0]) >> s & 1}
    assert got == closed_by_search(set(edges))


def test_components_of_a_large_cycle_and_a_long_chain():
    n = 100_000
    ring, chain = adjacency([(i, (i + 1) % n) for i in range(n)]), adjacency([(i, i + 1) for i in range(n)])
    assert set(components_of(ring.starts, ring.target)) == {0}
    assert sorted(components_of(chain.starts, chain.target)) == list(range(n + 1))
    assert ring.deep(64) and chain.deep(64) and not adjacency([(0, i) for i in range(1, 50)]).deep(3)


def test_closures_of_deep_graphs(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("id AS row", "id + 1 AS col")
    start = BoolMatrix.one(spark, 3, 3).pairs
    assert propagate(start, chain, False).count() == n - 3
    ring = spark.range(n).selectExpr("id AS row", f"(id + 1) % {n} AS col")
    assert propagate(start, ring, False).count() == n
    small = spark.range(300).selectExpr("id AS row", "(id + 1) % 300 AS col")
    assert closed(small).distinct().count() == 300 * 300


def test_open_closures_beyond_the_broadcast_are_squared(spark, monkeypatch):
    monkeypatch.setattr(sys.modules["pathweave.operators.propagate"], "BROADCAST_EDGES", 3)
    edges = {(i, i + 1) for i in range(40)} | {(40, 30), (7, 100)}
    step = spark.createDataFrame(sorted(edges), "row long, col long")
    want = closed_by_search(edges)
    for got in (closed(step), shallow_then_squared(step), BoolMatrix(step).closure().pairs):
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_events_follow_each_other_over_ranges(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, 1_600_000_000 + rng.randrange(30), rng.randrange(9), rng.choice("ab"), float(i)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type", "value")
    events.repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {(a[2], a[3], b[2]) for a, b in zip(order, order[1:], strict=False)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "5", "400"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert {tuple(r) for r in events_graph(spark, str(tmp_path)).edges.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("few", [None, 0, 200])
def test_few_events_are_one_window(spark, tmp_path, monkeypatch, few):
    """Builds of rpq_shape_cv_then_star_or_star: few events are put in order without ranges or tables on the way, many
    over ranges; ties in time, rows without a user, type or value, and the last event are as in SQL."""
    rng = random.Random(5)
    rows = [(i, 1_600_000_000 + rng.randrange(9), rng.choice([*range(9), None]), rng.choice(["a", "b", None]), rng.choice([50.0, 70.0, None])) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type", "value")
    events.repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {(a[2], a[3], b[2]) for a, b in zip(order, order[1:], strict=False) if a[4] == 70 and None not in (a[2], a[3], b[2])}
    module, made = sys.modules["pathweave.sources.tables"], []
    monkeypatch.setattr(module, "written", lambda df, tag, whole=module.written: made.append(tag) or whole(df, tag))
    if few is not None:
        monkeypatch.setattr(module, "FEW_EVENTS", few)
    graph = events_graph(spark, str(tmp_path), 60.0)
    got = [tuple(r) for r in graph.edges.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[0] for r in graph.nodes.select("id").collect()} == set(range(9))
    assert bool(made) == (few == 0)


def test_pairs_files(spark, tmp_path):
    triples = {(i % 97, 1 + (i > 2900), i) for i in range(3000)} | {(5, 12, 4294967295)}
    frame = spark.createDataFrame(sorted(triples), "s long, p int, o long")
    write_pairs(frame.unionByName(frame), str(tmp_path))
    assert {tuple(r) for r in read_pairs(spark, str(tmp_path)).select("s", "p", "o").collect()} == triples
    names = sorted(x.name for x in tmp_path.iterdir() if x.name.endswith(".pairs"))
    assert names[0].startswith("0001") and "0012.pairs" in names
    assert sum(x.stat().st_size for x in tmp_path.glob("0001*.pairs")) == 8 * sum(p == 1 for _, p, _ in triples)
    with pytest.raises(ValueError, match="32-bit"):
        write_pairs(spark.createDataFrame([(1, 1, -1)], "s long, p int, o long"), str(tmp_path))


def test_a_stored_graph_has_its_figures(spark, tmp_path):
    edges = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, "b", 1)], "s long, p string, o long")
    nodes = spark.createDataFrame([(1, "one"), (2, "<two>"), (3, "the third"), (4, "alone")], "id long, term string")
    for made, count in ((GraphStore.from_edges(edges), 3), (GraphStore.from_edges(edges, nodes), 4)):
        made.save(str(tmp_path / str(count)))
        got = GraphStore.load(spark, str(tmp_path / str(count)))
        assert got.stats() == {"a": (2, 2, 2), "b": (1, 1, 1)} == made.stats()
        assert got.nodes.count() == count and got.node_id(2) == 2 and got.node_id(9) is None
        assert {tuple(r) for r in Solver(got).solve(None, "a+", None).pairs.collect()} == {(1, 2), (2, 3), (1, 3)}
    assert (got.node_id("two"), got.node_id("<the third>"), got.node_id("four")) == (2, 3, None)


@pytest.mark.parametrize("named", [False, True])
def test_nodes_are_saved_while_edges_are(spark, tmp_path, monkeypatch, named):
    """Builds of rpq_shape_vc_then_star_then_star: the nodes don't wait for the edges, where these don't give them."""
    module = sys.modules["pathweave.sources.graph"]

    def last(edges, path, write=module.write_partitioned):
        until = time.monotonic() + 60
        while not (tmp_path / "nodes" / "_SUCCESS").exists():
            assert time.monotonic() < until
            time.sleep(0.05)
        write(edges, path)

    monkeypatch.setattr(module, "write_partitioned", last)
    edges = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "s long, p string, o long")
    nodes = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four")], "id long, term string")
    GraphStore.from_edges(edges, nodes if named else nodes.select("id")).save(str(tmp_path))
    got = GraphStore.load(spark, str(tmp_path))
    assert got.stats() == {"a": (1, 1, 1), "b": (1, 1, 1)} and got.nodes.count() == 4
    assert got.node_id("four" if named else "4") == 4 and {tuple(r) for r in got.edges.collect()} == {(1, "a", 2), (2, "b", 3)}


def test_intermediates_are_deleted(spark, tmp_path):
    with session.intermediates(spark):
        kept = session.written(spark.range(5), "x")
        assert kept.count() == 5
        path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert not os.path.exists(path)
    matrix = BoolMatrix.from_cells(spark, [(1, 2)]).materialized()
    assert matrix.count() == 1 and os.path.exists(matrix.path.removeprefix("file://"))
    matrix.destroy()
    assert not os.path.exists(matrix.path.removeprefix("file://"))


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def as_tuples(path):
    match path:
        case Label(name, inverse):
            return ("^", ("label", name)) if inverse else ("label", name)
        case Concat(parts) | Alt(parts):
            sign, out = "/" if isinstance(path, Concat) else "|", as_tuples(parts[0])
            for p in parts[1:]:
                out = (sign, out, as_tuples(p))
            return out
        case Star(part) | Plus(part) | Opt(part):
            return ({Star: "*", Plus: "+", Opt: "?"}[type(path)], as_tuples(part))


@pytest.mark.parametrize("path", sorted({r for _, signs, _ in shapes.shapes() for r in shapes.readings(signs)}))
def test_both_parsers_read_the_same(path):
    """An inverse in front of a repetition is one of the label to the engine, of all to the oracle: the same pairs."""

    def inward(tree, flip=False):
        match tree:
            case ("label", _):
                return ("^", tree) if flip else tree
            case ("^", part):
                return inward(part, not flip)
            case (sign, part):
                return (sign, inward(part, flip))
            case (sign, left, right):
                sides = (inward(left, flip), inward(right, flip))
                return (sign, *(sides[::-1] if flip and sign == "/" else sides))

    assert inward(oracle.tree_of(path)) == as_tuples(parse_path(path))


def test_shapes():
    assert len(shapes.shapes()) == len(set(shapes.shapes())) == 102
    for _, signs, _ in shapes.shapes():
        for path in shapes.readings(signs):
            assert "".join(c for c in path if c in "*+?/|^") == signs
        assert len(set(shapes.readings(signs))) == len(shapes.readings(signs))


def two_rings(spark, n, p):
    """A ring of a and chords of b, every p-th node; all nodes but the last are in the universe."""
    edges = [(i, "a", (i + 1) % n) for i in range(n)] + [(i, "b", (i * 7 + 3) % n) for i in range(0, n, p)] + [(n, "a", 0)]
    nodes = spark.range(n).toDF("id")
    return GraphStore.from_edges(spark.createDataFrame(edges, "s long, p string, o long"), nodes), edges


def searched(edges, n, path):
    """All pairs of a path, by sets."""
    base = {p: {(s, o) for s, q, o in edges if q == p} for p in "ab"}
    same = {(i, i) for i in range(n)}

    def product(x, y):
        to = {}
        for a, b in y:
            to.setdefault(a, set()).add(b)
        return {(a, c) for a, b in x for c in to.get(b, ())}

    def of(tree):
        match tree:
            case Label(name, inverse):
                return {(o, s) for s, o in base[name]} if inverse else base[name]
            case Alt(parts):
                return set().union(*map(of, parts))
            case Concat(parts):
                out = of(parts[0])
                for part in parts[1:]:
                    out = product(out, of(part))
                return out
            case Opt(part):
                return of(part) | same
            case Star(part) | Plus(part):
                plus = closed_by_search(of(part))
                return plus | same if isinstance(tree, Star) else plus

    return of(parse_path(path))


#: A path of each finding, and how the ends are bound there.
HEAVY = {
    "rpq_shape_cv_or_then_star_or_star": ("(a|b/a*|b*)*", (2, None)), "rpq_shape_vc_plus_then_plus": ("(a+/b)+", (None, 7)),
    "rpq_shape_vc_then_star_or_then_star": ("a/(b*|a)/b*", (None, 7)), "rpq_shape_vv_plus_then_star": ("a+/b*", (None, None)),
    "rpq_shape_cv_then_star_or_star": ("a/(b*|a*)", (2, None)), "rpq_shape_vc_then_star_then_star": ("(a/b*/a)*", (None, 7)),
    "rpq_shape_cv_then_star_or_star_or_then_star_or_star": ("(a/b*|a*|b/a*|b)*", (2, None)),
    "rpq_shape_vc_star_then_star_then_star_then_star_then_star": ("(a*/b*/a*/b*/a)*", (None, 7)), "both ends": ("(a+/b)*", (2, 5)), "beside the universe": ("(a/b*)*", (None, None)),
}


@pytest.mark.parametrize("name", HEAVY)
def test_closures_of_closures_need_no_relation_of_all_pairs(spark, monkeypatch, name):
    module = sys.modules["pathweave.operators.propagate"]
    monkeypatch.setattr(module, "BROADCAST_EDGES", 1500)

    def never(*args, **kwargs):
        raise AssertionError("a relation within the path was sought")

    n = 60
    graph, edges = two_rings(spark, n, 5)
    path, (row, col) = HEAVY[name]
    want = {(a, b) for a, b in searched(edges, n, path) if row in (None, a) and col in (None, b)}
    monkeypatch.setattr(module, "semi_naive", never)
    monkeypatch.setattr(Solver, "_join_cheapest", never)
    got = [tuple(r) for r in Solver(graph).solve(row, path, col).pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # Beyond what is sent, and with ids that leave no room for states, the answer is the same.
    monkeypatch.undo()
    if name in ("both ends", "beside the universe", "rpq_shape_vv_plus_then_star"):
        monkeypatch.setattr(module, "BROADCAST_EDGES", 3)
        assert {tuple(r) for r in Solver(graph).solve(row, path, col).pairs.collect()} == want


def test_ids_that_leave_no_room_for_states(spark, monkeypatch):
    top = (1 << 63) - 1
    edges = [(top, "a", 1), (1, "b", top), (1, "a", -(1 << 63)), (-(1 << 63), "b", 5)]
    graph = GraphStore.from_edges(spark.createDataFrame(edges, "s long, p string, o long"))
    want = {(top, top), (top, 5), (1, 1), (1, 5), (5, 5), (-(1 << 63), -(1 << 63))}
    for most in (2_000_000, 2):
        monkeypatch.setattr(sys.modules["pathweave.operators.propagate"], "BROADCAST_EDGES", most)
        assert {tuple(r) for r in Solver(graph).solve(None, "(a+/b)*", None).pairs.collect()} == want


def test_reflexive_closures_are_not_dealt_out_again(spark):
    """clos_star: pairs go from the search to the result without an exchange."""
    step = spark.range(50).selectExpr("id AS row", "(id * 3 + 1) % 50 AS col").union(spark.createDataFrame([(77, 3)], "row long, col long"))
    nodes = spark.range(60).toDF("id")
    for strategy in ("auto", "condense", "squaring", "joins"):
        star = BoolMatrix(step).closure(True, nodes, strategy=strategy).pairs
        got = [tuple(r) for r in star.collect()]
        assert len(got) == len(set(got)) and set(got) == closed_by_search({tuple(r) for r in step.collect()}) | {(i, i) for i in range(60)}
    plan = BoolMatrix(step).closure(True, nodes).pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


@pytest.mark.parametrize("seed", range(6))
def test_blocks_are_the_pairs_of_the_bits(monkeypatch, seed):
    module = sys.modules["pathweave.operators.propagate"]
    monkeypatch.setattr(module, "SLICE", 512)
    monkeypatch.setattr(module, "TILE", 300)
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 900)), int(rng.integers(1, 190))
    kinds = rng.random((3, n)) < rng.random((3, 1))
    bits = kinds[rng.integers(0, 3, k)] if seed % 2 else rng.random((k, n)) < 0.1
    packed = np.packbits(np.pad(bits, ((0, -k % 64), (0, 0))).T, axis=1, bitorder="little")
    ids, sources = np.arange(n) * 5, np.arange(k) + 1000
    got = []
    for batch in module.blocks_of(sources, ids, np.ascontiguousarray(packed).view(np.uint64)):
        for rows, cols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            assert len(rows) * len(cols) <= 300 or len(cols) == 1
            got += [(r, c) for r in rows for c in cols]
    k_at, n_at = np.nonzero(bits)
    assert sorted(got) == sorted(zip(sources[k_at].tolist(), ids[n_at].tolist(), strict=True))


@pytest.mark.parametrize("name", ["clos_squaring_ev", "clos_squaring_sparse"])
def test_components_are_not_squared(spark, monkeypatch, name):
    """What is squared is the relation of components, here a chain of four with a ring of 300 at its end."""
    module = sys.modules["pathweave.operators.propagate"]
    edges = {(i, (i + 1) % 300) for i in range(300)} | {(400, 401), (401, 402), (402, 5), (500, 500)}
    seen = []
    whole = module.squared
    monkeypatch.setattr(module, "squared", lambda step, deadline=None: seen.append(step.count()) or whole(step, deadline))
    reflexive = name == "clos_squaring_ev"
    got = [tuple(r) for r in BoolMatrix.from_cells(spark, edges).closure(reflexive, spark.range(600).toDF("id"), strategy="squaring").pairs.collect()]
    want = closed_by_search(edges) | ({(i, i) for i in range(600)} if reflexive else set())
    assert seen == [3] and len(got) == len(set(got)) and set(got) == want


BOUND = [name for name, (_, ends) in HEAVY.items() if ends != (None, None)]


@pytest.mark.parametrize("name", BOUND)
def test_a_label_goes_once_into_the_product_however_often_it_may_come_next(spark, monkeypatch, name):
    """What is sent is bounded by the labels' edges and nodes, not by the moves of the automaton."""
    module = sys.modules["pathweave.operators.propagate"]
    n = 60
    graph, edges = two_rings(spark, n, 5)
    path, (row, col) = HEAVY[name]
    leaves = sum(path.count(x) for x in "ab")
    monkeypatch.setattr(module, "BROADCAST_EDGES", max(len(edges), (leaves * len(edges) // 2 + 2 * n) // 2 + 1))

    def never(*args, **kwargs):
        raise AssertionError("rounds of joins")

    monkeypatch.setattr(module, "semi_naive", never)
    want = {(a, b) for a, b in searched(edges, n, path) if row in (None, a) and col in (None, b)}
    got = [tuple(r) for r in Solver(graph).solve(row, path, col).pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", BOUND)
def test_one_source_is_searched_without_components(spark, monkeypatch, name):
    """From a bound end paths of any length are walked in the task; nothing is condensed at the driver."""
    module = sys.modules["pathweave.operators.propagate"]

    def never(*args, **kwargs):
        raise AssertionError("components of the whole graph")

    monkeypatch.setattr(module, "Condensed", never)
    monkeypatch.setattr(module, "DEEP", 3)
    monkeypatch.setattr(Adjacency, "deep", lambda self, rounds: True)
    n = 60
    graph, edges = two_rings(spark, n, 5)
    path, (row, col) = HEAVY[name]
    for way in (path, "a+", "b/a*", "a/b*/a?"):
        want = {(a, b) for a, b in searched(edges, n, way) if row in (None, a) and col in (None, b)}
        assert {tuple(r) for r in Solver(graph).solve(row, way, col).pairs.collect()} == want


def words_of(machine, longest, moves=None, jumps=()):
    """All words up to a length that an automaton accepts."""
    moves, words, now = moves or machine.moves, set(), {((), 0)}

    def jumped(at):
        while more := {(w, b) for w, q in at for a, b in jumps if a == q} - at:
            at = at | more
        return at

    for _ in range(longest + 1):
        now = jumped(now)
        words |= {w for w, q in now if q in machine.accepting}
        now = {((*w, x), b) for w, q in now for a, x, b in moves if a == q}
    return words


@pytest.mark.parametrize("start", [True, False])
@pytest.mark.parametrize("sign", sorted({signs for _, signs, _ in shapes.shapes() if "*" in signs or "+" in signs}))
def test_merged_states_and_jumps_keep_the_language(sign, start):
    for path in shapes.readings(sign):
        whole = automaton(simplify(parse_path(path)))
        less = merged(whole, start)
        moves, jumps = shared(less, {x: 10 for _, x, _ in whole.moves}, 5, start)
        longest = 4 if len(whole.moves) < 60 else 2
        assert less.states <= whole.states and len(moves) <= len(less.moves)
        assert start or not [1 for _, _, b in less.moves if b == 0] + [1 for j in jumps if 0 in j]
        assert words_of(whole, longest) == words_of(less, longest) == words_of(less, longest, moves, jumps)


def test_sources_are_dealt_out_also_after_a_distinct(spark):
    edges = np.array([(i, (i + 1) % 64) for i in range(64)], np.int64)
    nodes = spark.range(64).select("id").unionByName(spark.range(64).select("id"))
    found = carried(BoolMatrix.identity(nodes).pairs, (edges[:, 0], edges[:, 1]), True, strategy="broadcast")
    tasks = {r[0] for r in found.selectExpr("spark_partition_id()").distinct().collect()}
    assert len(tasks) == 4 and found.count() == 64 * 64


def test_edges_and_constants_are_read_once_for_all_readings(spark, monkeypatch):
    graph, edges = two_rings(spark, 60, 5)
    frame, reads = type(graph.edges), []
    for name in ("toArrow", "collect"):
        monkeypatch.setattr(frame, name, lambda self, whole=getattr(frame, name): reads.append(1) or whole(self))
    paths = ("a/(b*|a)/b*", "(a/b*|a/b)*", "(^a*/b)+")
    found = [Solver(graph).solve(None, path, 7).pairs for path in paths]
    assert len(reads) <= 3  # figures, the constant, edges
    monkeypatch.undo()
    for path, pairs in zip(paths, found, strict=True):
        assert {tuple(r) for r in pairs.collect()} == {(a, b) for a, b in searched(edges, 60, path) if b == 7}


#: Findings whose paths are searched from their bound end.
FROM_ONE = ["rpq_shape_vc_star_then_star_then_star_then_star_then_star", "rpq_shape_cv_then_star_or_star", "rpq_shape_vc_then_star_then_star"]


@pytest.mark.parametrize("name", FROM_ONE)
def test_from_one_end_no_product_is_made_or_sent(spark, monkeypatch, name):
    def never(*args, **kwargs):
        raise AssertionError("a product graph, or edges sent to tasks")

    for module in ("pathweave.plans.nfa", "pathweave.operators.propagate"):
        monkeypatch.setattr(sys.modules[module], "carried", never)
    graph, edges = two_rings(spark, 60, 5)
    path, (row, col) = HEAVY[name]
    for way in (path, "(a|^b)+", "b+/a*"):
        want = {(a, b) for a, b in searched(edges, 60, way) if row in (None, a) and col in (None, b)}
        got = [tuple(r) for r in Solver(graph).solve(row, way, col).pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("deep, few", [(64, 256), (0, 256), (2, 3)])
def test_search_from_one_node(monkeypatch, deep, few):
    """Rounds of arrays and rounds node by node find what sets do, whatever the mix."""
    module = sys.modules["pathweave.operators.search"]
    monkeypatch.setattr(module, "DEEP", deep)
    monkeypatch.setattr(module, "FEW", few)
    rng = random.Random(7)
    for path in ("(a+/b)+", "a/(b*|a)/b*", "(a/b*|^a|b/a?)*", "(a*/b*/^a*/b*/a)*", "(a|b)?", "a/b+"):
        n = rng.randint(5, 40)
        edges = sorted({(rng.randrange(n), rng.choice("ab"), rng.randrange(n)) for _ in range(2 * n)})
        cells = Cells(["a", "b"], *(np.array(c, np.int64) for c in ([10 * s for s, _, _ in edges], [10 * o for _, _, o in edges], ["ab".index(p) for _, p, _ in edges])))
        machine = merged(automaton(simplify(parse_path(path))))
        moves = [(a, (x.name, x.inverse), b) for a, x, b in machine.moves]
        pairs = searched(edges, n, path)
        for source in range(n):
            want = sorted(10 * o for s, o in pairs if s == source)
            assert cells.search(10 * source, machine.states, moves, machine.accepting).tolist() == want
            for o in range(n):
                assert (10 * o in cells.search(10 * source, machine.states, moves, machine.accepting, 10 * o)) == ((source, o) in pairs)
    assert cells.search(3, machine.states, moves, machine.accepting).tolist() == []  # a/b+ from a node without edges
    n = 20_000
    chain = Cells(["a"], np.arange(n), np.arange(n) + 1, np.zeros(n, np.int32))
    assert chain.search(5, 2, [(0, ("a", False), 1), (1, ("a", False), 1)], {1}).tolist() == list(range(6, n + 1))


def test_tiles_of_large_components_are_dealt_out_evenly(spark):
    """clos_squaring_sparse: a ring of five parts is 25 tiles for 4 tasks, not five rows of five."""
    n = 1280
    ring = spark.range(n).selectExpr("id AS row", f"(id + 1) % {n} AS col")
    tasks = [r["count"] for r in closed(ring, "squaring").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == n * n and max(tasks) < 0.32 * n * n
