import importlib
import random

import pytest

from pathweave.functions import bitmaps
from pathweave.operators.relation import BoolMatrix
from pathweave.plans.ast import Alt, Concat, Label, Opt, Plus, Star
from pathweave.plans.executor import Solver, run_workload
from pathweave.plans.nfa import automaton
from pathweave.sources.graph import GraphStore, check_predicates, read_dictionary, read_pairs, read_triples

module = importlib.import_module("pathweave.operators.propagate")

M = {
    "empty": set(), "loop": {(1, 1)}, "chain": {(1, 2), (2, 3), (3, 4)}, "cycle": {(1, 2), (2, 3), (3, 1), (3, 4)},
    "two": {(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)}, "far": {(1_000_000, 5), (5, 2_000_000_000)}, "a": {(1, 2), (1, 3)}, "b": {(1, 3), (4, 3)},
}
ENDS = [(None, None), (1, None), (None, 3), (1, 3), (99, None), (None, 99)]


def cells(matrix):
    rows = [(r["row"], r["col"]) for r in matrix.pairs.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def cut(pairs, row, col):
    return {(r, c) for r, c in pairs if row in (None, r) and col in (None, c)}


def product(a, b):
    return {(x, z) for x, y in a for w, z in b if y == w}


def closed(pairs):
    out = set(pairs)
    while (more := out | product(out, pairs)) != out:
        out = more
    return out


@pytest.fixture(scope="module")
def m(spark):
    return {k: BoolMatrix.from_cells(spark, v) for k, v in M.items()}


def test_makers(spark, m):
    assert cells(BoolMatrix.empty(spark)) == set()
    assert cells(BoolMatrix.one(spark, 3, 9)) == {(3, 9)}
    assert cells(BoolMatrix.identity(spark.createDataFrame([(1,), (2,), (2,)], "id long"))) == {(1, 1), (2, 2)}
    assert cells(BoolMatrix.of(spark.createDataFrame([(1, 2), (1, 2), (2, 3), (None, 1)], "x long, y long"))) == {(1, 2), (2, 3)}
    assert cells(m["chain"].T) == {(2, 1), (3, 2), (4, 3)}


def test_accessors(m):
    assert m["chain"].access(2, 3)
    assert not m["chain"].access(3, 2)
    assert m["cycle"].count() == 4
    assert m["cycle"].degree(row=3) == 2
    assert {tuple(r) for r in m["cycle"].collect(2, 3, None, 3).collect()} == {(2, 3), (3, 1)}


@pytest.mark.parametrize(("x", "y"), [("a", "b"), ("empty", "b"), ("a", "empty"), ("cycle", "two")])
def test_sets_and_products(m, x, y):
    for row, col in ENDS[:4]:
        a, b = cut(M[x], row, col), cut(M[y], row, col)
        assert cells(m[x].or_(m[y], row=row, col=col)) == a | b
        assert cells(m[x].and_(m[y], row, col)) == a & b
        assert cells(m[x].sub(m[y], row, col)) == a - b
        assert cells(m[x].xor(m[y], row, col)) == a ^ b
        assert cells(m[x].mult(m[y], row, col)) == cut(product(M[x], M[y]), row, col)


@pytest.mark.parametrize(("name", "strategy"), [*((n, "broadcast") for n in ("empty", "loop", "chain", "cycle", "two", "far")), ("cycle", "joins"), ("empty", "joins")])
def test_closures(spark, m, name, strategy):
    nodes = spark.createDataFrame([(x,) for p in M.values() for c in p for x in c] + [(99,)], "id long").distinct()
    universe = {r["id"] for r in nodes.collect()}
    plus = closed(M[name])
    star = plus | {(x, x) for x in universe}
    for row, col in ENDS[:5] if strategy == "broadcast" else ENDS[:4]:
        assert cells(m[name].closure(False, nodes, row, col, strategy)) == cut(plus, row, col)
        assert cells(m[name].closure(True, nodes, row, col, strategy)) == cut(star, row, col)


def test_squaring_and_fused(m):
    assert cells(m["cycle"].closure(strategy="squaring")) == closed(M["cycle"])
    for reflexive in (False, True):
        step = closed(M["cycle"]) | ({(x, x) for x in range(5)} if reflexive else set())
        for row, col in ENDS[:4]:
            assert cells(m["a"].mult_closure(m["cycle"], reflexive, row, col)) == cut(product(M["a"], step), row, col)
            assert cells(m["cycle"].closure_mult(m["b"], reflexive, row, col)) == cut(product(step, M["b"]), row, col)


def test_large_step_relation_is_not_broadcast(m, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_EDGES", 2)
    assert cells(m["cycle"].closure()) == closed(M["cycle"])
    with pytest.raises(ValueError, match="more than"):
        m["cycle"].closure(strategy="broadcast")


def test_many_sources_in_one_block(spark):
    pairs = {(i, i + 1) for i in range(300)} | {(300, 7)}
    assert cells(BoolMatrix.from_cells(spark, pairs).closure()) == closed_by_search(pairs)


def closed_by_search(pairs):
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    out = set()
    for s in ahead:
        todo, seen = list(ahead[s]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ahead.get(x, ())
        out |= {(s, x) for x in seen}
    return out


def test_vectors_and_bitmaps(spark, m):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    vector = nodes.selectExpr("id", "cast(id AS double) AS v")
    want = {x: float(sum(c for r, c in M["cycle"] if r == x)) for x in range(1, 6)}
    assert {r["id"]: r["v"] for r in m["cycle"].mult_vector(vector, nodes).collect()} == want
    want = {x: float(sum(r for r, c in M["cycle"] if c == x)) for x in range(1, 6)}
    assert {r["id"]: r["v"] for r in m["cycle"].vector_mult(vector, nodes).collect()} == want
    wide = BoolMatrix.from_cells(spark, {(1, 0), (1, 32767), (1, 32768), (1, 65536), (2, 40000)})
    bits = bitmaps.to_bitmaps(wide.pairs)
    assert {tuple(r) for r in bitmaps.to_pairs(bits).collect()} == cells(wide)
    assert bitmaps.cardinality(bits).first()["n"] == 5


def test_save_and_load(spark, m, tmp_path):
    m["two"].save(str(tmp_path / "m"))
    assert cells(BoolMatrix.load(spark, str(tmp_path / "m"))) == M["two"]


def test_files(spark, tmp_path):
    import numpy as np

    (tmp_path / "t.dat").write_text("1 1 2\n2 1 3\n1 1 2\n010 2 1\n")
    (tmp_path / "t.SO").write_text("1 <one>\n2 <two words>\n3 <three>\n10 <ten>\n")
    (tmp_path / "t.P").write_text("1 <knows>\n2 <likes>\n")
    triples = read_triples(spark, str(tmp_path / "t.dat"))
    assert {tuple(r) for r in triples.collect()} == {(1, 1, 2), (2, 1, 3), (10, 2, 1)}
    check_predicates(triples, 2)
    with pytest.raises(ValueError, match="not between"):
        check_predicates(triples, 1)
    assert {tuple(r) for r in read_dictionary(spark, str(tmp_path / "t.SO")).collect()} >= {(2, "<two words>")}
    graph = GraphStore.from_files(spark, *(str(tmp_path / f"t.{x}") for x in ("dat", "SO", "P")))
    assert cells(Solver(graph).solve("<one>", "<knows>+", None)) == {(1, 2), (1, 3)}
    assert cells(Solver(graph).solve(None, "<likes>/<knows>", "<two words>")) == {(10, 2)}
    graph.save(str(tmp_path / "g"))
    assert GraphStore.load(spark, str(tmp_path / "g")).stats() == {"knows": (2, 2, 2), "likes": (1, 1, 1)}
    (tmp_path / "pairs").mkdir()
    np.array([[1, 2], [4_000_000_000, 3]], "<u4").tofile(tmp_path / "pairs/0007.pairs")
    assert {tuple(r) for r in read_pairs(spark, str(tmp_path / "pairs")).collect()} == {(1, 7, 2), (4_000_000_000, 7, 3)}


# -- random graphs and expressions against a search on the product with the automaton ------------------


def search(edges, nodes, tree):
    """All pairs of a path, in plain Python."""
    machine = automaton(tree)
    ahead = {}
    for s, p, o in edges:
        ahead.setdefault((s, p, False), set()).add(o)
        ahead.setdefault((o, p, True), set()).add(s)
    out = set()
    for start in nodes:
        todo, seen = [(start, 0)], {(start, 0)}
        while todo:
            x, q = todo.pop()
            if q in machine.accepting:
                out.add((start, x))
            for a, label, b in machine.moves:
                if a == q:
                    for y in ahead.get((x, label.name, label.inverse), ()):
                        if (y, b) not in seen:
                            seen.add((y, b))
                            todo.append((y, b))
    return out


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return Label(rng.choice("pqr"), rng.random() < 0.3)
    kind = rng.choice([Concat, Concat, Alt, Star, Plus, Opt])
    if kind in (Concat, Alt):
        return kind(tuple(random_tree(rng, depth - 1) for _ in range(rng.randint(2, 3))))
    return kind(random_tree(rng, depth - 1))


@pytest.mark.parametrize("seed", range(4))
def test_random_paths(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(12))
    edges = {(rng.choice(nodes), rng.choice("pqr"), rng.choice(nodes)) for _ in range(18)} | {(0, p, 1) for p in "pqr"}
    graph = GraphStore.from_edges(spark.createDataFrame(sorted(edges), "s long, p string, o long"), spark.createDataFrame([(n,) for n in nodes], "id long"))
    tree = random_tree(rng, 3)
    want = search(edges, nodes, tree)
    for row, col in [(None, None), (0, None), (None, 1), (0, 1)]:
        for engine in ("algebra", "nfa"):
            assert cells(Solver(graph, engine=engine).solve(row, tree, col)) == cut(want, row, col), (tree, row, col, engine)


@pytest.mark.parametrize("frontier", [0, 1000])
def test_few_pairs_are_sent_to_large_relations(spark, monkeypatch, frontier):
    executor = importlib.import_module("pathweave.plans.executor")
    monkeypatch.setattr(executor, "LARGE", 0)
    monkeypatch.setattr(executor, "FRONTIER", frontier)
    edges = {(1, "p", 2), (1, "p", 3), (2, "q", 4), (3, "q", 4), (4, "r", 1), (9, "q", 4)}
    graph = GraphStore.from_edges(spark.createDataFrame(sorted(edges), "s long, p string, o long"))
    tree = Concat((Label("p"), Label("q"), Opt(Label("r"))))
    want = search(edges, range(10), tree)
    solver = Solver(graph)
    found = solver.solve(1, tree, None)
    assert cells(found) == cut(want, 1, None) == {(1, 4), (1, 1)}
    assert cells(solver.solve(None, tree, 1)) == cut(want, None, 1)
    plan = found.pairs._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == bool(frontier)


def test_workload(spark):
    edges = spark.createDataFrame([(1, "p", 2), (2, "p", 3)], "s long, p string, o long")
    graph = GraphStore.from_edges(edges)
    got = run_workload(graph, ["?x <p>+ ?y", "", "<1> <p>* <3>", "?x <q> ?y", "<9> <p> ?y", "?x <p", "?x <p>/(<p> ?y"], timeout=120).collect()
    assert [(r["query_id"], r["n_pairs"], r["status"]) for r in got] == [(1, 3, "ok"), (3, 1, "ok"), (4, 0, "unknown"), (5, 0, "unknown"), (6, None, "error"), (7, None, "error")]
    assert all(r["elapsed_ns"] > 0 for r in got)
    late = run_workload(graph, ["?x <p>+ ?y"], timeout=0.0).collect()[0]
    assert (late["n_pairs"], late["status"]) == (None, "timeout")
    with pytest.raises(KeyError):
        Solver(graph, on_unknown="error").solve(None, "q", None)
