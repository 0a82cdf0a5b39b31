"""The registry of queries over the derived graphs, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave import oracle, shapes
from pathweave.functions import bitmaps
from pathweave.operators.propagate import propagate, shallow_then_squared
from pathweave.operators.relation import BoolMatrix
from pathweave.plans.executor import Solver, run_workload
from pathweave.plans.nfa import automaton
from pathweave.plans import ast
from pathweave.plans.parser import PathSyntaxError, parse_path
from pathweave.plans.rewrite import simplify
from pathweave.session import scratch
from pathweave.sources import tables
from pathweave.sources.graph import GraphStore, check_predicates, label_stats, max_vertex, read_dictionary, read_pairs, read_triples, write_pairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_BUILD = {
    "ev": tables.events_graph,
    "sparse": lambda spark, d: tables.events_graph(spark, d, 60.0),
    "fk": tables.keys_graph,
    "conv": tables.turns_graph,
}
_BUILT: dict[tuple[str, str, str], GraphStore] = {}


def graph(spark: SparkSession, sf_dir: str, kind: str) -> GraphStore:
    """A derived graph, built and stored once a session as an index is: edges by label, nodes sorted, figures."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _BUILT:
        path = scratch(spark, "graph")
        _BUILD[kind](spark, sf_dir).save(path)
        _BUILT[key] = GraphStore.load(spark, path)
    return _BUILT[key]


def _pairs(matrix: BoolMatrix | DataFrame) -> DataFrame:
    pairs = matrix.pairs if isinstance(matrix, BoolMatrix) else matrix
    return pairs.select(F.col("row").alias("s"), F.col("col").alias("o"))


def _number(value: int, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(int(value),)], "n long")


def _add(name: str, sql: str | None, run: Query) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


# -- sources, statistics ------------------------------------------------------------------------------
_add("scan_edges", f"{oracle.prelude('fk')} SELECT s, p, o FROM g", lambda spark, d: graph(spark, d, "fk").edges)
_add("label_stats", f"{oracle.prelude('ev')} SELECT p, count(*) AS n_edges, count(DISTINCT s) AS n_src, count(DISTINCT o) AS n_dst FROM g GROUP BY p", lambda spark, d: label_stats(graph(spark, d, "ev").edges))
_add("max_vertex", f"{oracle.prelude('fk')} SELECT max(greatest(s, o)) AS max_id FROM g", lambda spark, d: max_vertex(graph(spark, d, "fk").edges))


def _numbered(g: GraphStore) -> tuple[dict[str, int], DataFrame]:
    """Labels numbered from 1 in their order, and triples (s, p, o) with these numbers."""
    numbers = {p: i for i, p in enumerate(sorted(g.labels()), 1)}
    number = F.coalesce(*[F.when(F.col("p") == p, F.lit(i)) for p, i in numbers.items()])
    return numbers, g.edges.select("s", number.alias("p"), "o")


_NUMBERS = "k AS (SELECT p, CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS i FROM (SELECT DISTINCT p FROM g) t)"


def _triples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with numbered predicates to a text file, read again, checked and counted by predicate."""
    numbers, triples = _numbered(graph(spark, sf_dir, "conv"))
    path = scratch(spark, "triples")
    triples.select(F.concat_ws(" ", "s", "p", "o")).write.text(path)
    return check_predicates(read_triples(spark, path), len(numbers)).groupBy("p").agg(F.count("*").alias("n"))


def _out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check says of triples with one predicate too many."""
    numbers, triples = _numbered(graph(spark, sf_dir, "conv"))
    try:
        check_predicates(triples, len(numbers) - 1)
    except ValueError as error:
        return spark.createDataFrame([(str(error),)], "message string")
    return spark.createDataFrame([], "message string")


def _pairs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with numbered predicates to binary files and back."""
    _, triples = _numbered(graph(spark, sf_dir, "ev"))
    path = scratch(spark, "pairs")
    write_pairs(triples, path)
    return read_pairs(spark, path)


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names as a dictionary file (terms with spaces in them) and back."""
    path = scratch(spark, "terms")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(" the nation "), "n_name")).write.text(path)
    return read_dictionary(spark, path)


def _from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph from three text files, asked for by terms: which suppliers are in a nation."""
    folder = scratch(spark, "files")
    _, triples = _numbered(graph(spark, sf_dir, "fk"))
    triples.select(F.concat_ws(" ", "s", "p", "o")).write.text(f"{folder}/t")
    names = {p: i for i, p in enumerate(sorted(graph(spark, sf_dir, "fk").labels()), 1)}
    spark.createDataFrame([(f"{i} <{p}>",) for p, i in names.items()], "value string").write.text(f"{folder}/p")
    graph(spark, sf_dir, "fk").nodes.select(F.concat(F.col("id").cast("string"), F.lit(" <node "), F.col("id").cast("string"), F.lit(">"))).write.text(f"{folder}/n")
    g = GraphStore.from_files(spark, f"{folder}/t", f"{folder}/n", f"{folder}/p")
    return _pairs(Solver(g).solve(None, "<in_nation>", "<node 28>"))


_add("triples_text_and_range_check", f"{oracle.prelude('conv')}, {_NUMBERS} SELECT i AS p, count(*) AS n FROM g JOIN k USING (p) GROUP BY i", _triples_round_trip)
_add("triples_out_of_range", f"{oracle.prelude('conv')}, {_NUMBERS} SELECT 'predicate id ' || max(i) || ' is not between 1 and ' || (max(i) - 1) AS message FROM k", _out_of_range)
_add("pairs_files", f"{oracle.prelude('ev')}, {_NUMBERS} SELECT s, i AS p, o FROM g JOIN k USING (p)", _pairs_files)
_add("dictionary_file", "SELECT CAST(n_nationkey AS BIGINT) AS id, 'the nation ' || n_name AS term FROM nation", _dictionary)
_add("graph_from_files", oracle.query_sql("fk", "in_nation", None, 28), _from_files)


def _mat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "matrix")
    graph(spark, sf_dir, "ev").label("click").save(path)
    return _pairs(BoolMatrix.load(spark, path))


def _graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "graph")
    graph(spark, sf_dir, "fk").save(path)
    return _pairs(GraphStore.load(spark, path).label("in_nation"))


_add("mat_roundtrip", oracle.query_sql("ev", "click"), _mat_round_trip)
_add("graph_roundtrip", oracle.query_sql("fk", "in_nation"), _graph_round_trip)

# -- constructors, accessors --------------------------------------------------------------------------
_EV = oracle.prelude("ev")
_CLICK, _VIEW = "SELECT s, o FROM g WHERE p = 'click'", "SELECT s, o FROM g WHERE p = 'view'"


def _ev(make: Callable[[GraphStore], BoolMatrix | DataFrame]) -> Query:
    return lambda spark, d: _pairs(make(graph(spark, d, "ev")))


_add("mat_identity", f"{_EV} SELECT id AS s, id AS o FROM v", _ev(lambda g: g.identity()))
_add("mat_one", "SELECT CAST(3 AS BIGINT) AS s, CAST(5 AS BIGINT) AS o", _ev(lambda g: BoolMatrix.one(g.spark, 3, 5)))
_add("mat_empty_sum", f"{_EV} {_CLICK}", _ev(lambda g: BoolMatrix.empty(g.spark).or_(g.label("click"))))
_add("mat_transpose", f"{_EV} SELECT o AS s, s AS o FROM g WHERE p = 'click'", _ev(lambda g: g.label("click").T))
_add("mat_copy", f"{_EV} {_CLICK}", _ev(lambda g: g.label("click").copy()))
_add("mat_access", f"{_EV} SELECT CAST(count(*) AS BIGINT) AS n FROM g WHERE p = 'click' AND s = 0 AND o = 7", lambda spark, d: _number(graph(spark, d, "ev").label("click").access(0, 7), spark))
_add("mat_collect_range", f"{_EV} {_CLICK} AND s BETWEEN 2 AND 9 AND o BETWEEN 4 AND 60", _ev(lambda g: g.label("click").collect(2, 9, 4, 60)))
_add("mat_collect_open", f"{_EV} {_CLICK} AND s >= 5", _ev(lambda g: g.label("click").collect(row_from=5)))
_add("mat_collect_count", f"{_EV} SELECT count(*) AS n FROM g WHERE p = 'click' AND s BETWEEN 2 AND 9", lambda spark, d: _number(graph(spark, d, "ev").label("click").collect(2, 9).count(), spark))
_add("mat_count", f"{_EV} SELECT count(*) AS n FROM g WHERE p = 'click'", lambda spark, d: _number(graph(spark, d, "ev").label("click").count(), spark))
_add("mat_space", f"{_EV} SELECT 2 * count(*) AS n FROM g WHERE p = 'click'", lambda spark, d: _number(graph(spark, d, "ev").label("click").space(), spark))
_add("mat_degree", f"{_EV} SELECT count(*) AS n FROM g WHERE p = 'click' AND o = 7", lambda spark, d: _number(graph(spark, d, "ev").label("click").degree(col=7), spark))

_CELLS = [(1, 2), (1, 2), (2, 3), (1000000, 5), (5, 2000000000), (3, 3)]
_add("mat_from_cells", f"SELECT DISTINCT CAST(s AS BIGINT) AS s, CAST(o AS BIGINT) AS o FROM (VALUES {', '.join(map(str, _CELLS))}) t(s, o)", lambda spark, d: _pairs(BoolMatrix.from_cells(spark, _CELLS)))
_add("mat_of_repeats", "SELECT DISTINCT o_custkey AS s, o_orderkey % 100 AS o FROM orders", lambda spark, d: _pairs(BoolMatrix.of(spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.col("o_orderkey") % 100))))


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights, widths and cells of a relation, its transpose, a sum and a product of two."""
    a, b = BoolMatrix.from_cells(spark, [(0, 1), (2, 4)], (3, 5)), BoolMatrix.from_cells(spark, [(4, 0), (6, 1)], (7, 2))
    made = {"a": a, "transpose": a.T, "sum": a.or_(b), "and": a.and_(b), "product": a.mult(b)}
    return spark.createDataFrame([(k, *m.dims, m.count()) for k, m in made.items()], "what string, height int, width int, n long")


_add("mat_dims", "SELECT * FROM (VALUES ('a', 3, 5, 2::BIGINT), ('transpose', 5, 3, 2), ('sum', 7, 5, 4), ('and', 7, 5, 0), ('product', 3, 2, 1)) t(what, height, width, n)", _dims)


def _destroyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a materialized relation, counted before its table is deleted."""
    kept = graph(spark, sf_dir, "ev").label("click").materialized()
    n = kept.count()
    kept.destroy()
    return _number(n, spark)


_add("mat_destroy", f"{_EV} SELECT count(*) AS n FROM g WHERE p = 'click'", _destroyed)

# -- sets and products, with each restriction -----------------------------------------------------------
_ENDS: dict[str, tuple[int | None, int | None]] = {"": (None, None), "_row": (0, None), "_col": (None, 7), "_cell": (0, 7)}


def _bound(sql: str, end: str) -> str:
    """The rows of a query at its own first row, column or cell (by s, then o)."""
    where = {"": "", "_row": " WHERE s = (SELECT min(s) FROM q)", "_col": " WHERE o = (SELECT min(o) FROM q)"}
    return f"{_EV}, q AS ({sql}) SELECT s, o FROM q" + (where[end] if end in where else " ORDER BY s, o LIMIT 1")


def _at_own_ends(make: Callable[..., BoolMatrix], end: str) -> Query:
    """An operation restricted to the first row, column or cell of its own unrestricted result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir, "ev")
        a, b = g.label("click"), g.label("view")
        if not end:
            return _pairs(make(a, b, None, None))
        cells = make(a, b, None, None).pairs.agg(F.min("row").alias("row"), F.min("col").alias("col"), F.min(F.struct("row", "col")).alias("cell")).first()
        row, col = {"_row": (cells["row"], None), "_col": (None, cells["col"]), "_cell": cells["cell"] or (None, None)}[end]
        return _pairs(make(a, b, row, col))

    return run


for _name, (_sql, _run) in {
    "sum": (f"{_CLICK} UNION {_VIEW}", lambda a, b, s, o: a.or_(b, row=s, col=o)),
    "dif": (f"{_CLICK} EXCEPT {_VIEW}", lambda a, b, s, o: a.sub(b, s, o)),
    "xor": (f"({_CLICK} EXCEPT {_VIEW}) UNION ({_VIEW} EXCEPT {_CLICK})", lambda a, b, s, o: a.xor(b, s, o)),
    "and": (f"{_CLICK} INTERSECT {_VIEW}", lambda a, b, s, o: a.and_(b, s, o)),
    "mult": (oracle.pairs_sql("click/view"), lambda a, b, s, o: a.mult(b, s, o)),
}.items():
    for _end in _ENDS:
        _add(f"mat_{_name}{_end}", _bound(_sql, _end), _at_own_ends(_run, _end))

_VEC = "SELECT id, CAST(id % 7 AS DOUBLE) AS v FROM v"


def _vector(g: GraphStore) -> DataFrame:
    return g.nodes.select("id", (F.col("id") % 7).cast("double").alias("v"))


_add("mat_vec_mult", f"{_EV}, x AS ({_VEC}) SELECT v.id, coalesce(sum(x.v), 0) AS v FROM v LEFT JOIN (SELECT * FROM g WHERE p = 'click') e ON e.s = v.id LEFT JOIN x ON x.id = e.o GROUP BY v.id", lambda spark, d: (lambda g: g.label("click").mult_vector(_vector(g), g.nodes))(graph(spark, d, "ev")))
_add("vec_mat_mult", f"{_EV}, x AS ({_VEC}) SELECT v.id, coalesce(sum(x.v), 0) AS v FROM v LEFT JOIN (SELECT * FROM g WHERE p = 'click') e ON e.o = v.id LEFT JOIN x ON x.id = e.s GROUP BY v.id", lambda spark, d: (lambda g: g.label("click").vector_mult(_vector(g), g.nodes))(graph(spark, d, "ev")))
_add("bitmap_product", f"{_EV} SELECT s, o FROM ({oracle.pairs_sql('click/view')}) q", _ev(lambda g: bitmaps.to_pairs(bitmaps.product(g.label("click").pairs, bitmaps.to_bitmaps(g.label("view").pairs)))))
_add("bitmap_product_count", f"{_EV} SELECT count(*) AS n FROM ({oracle.pairs_sql('click/view')}) q", lambda spark, d: (lambda g: bitmaps.cardinality(bitmaps.product(g.label("click").pairs, bitmaps.to_bitmaps(g.label("view").pairs))))(graph(spark, d, "ev")))

# -- closures -----------------------------------------------------------------------------------------


def _sparse(make: Callable[[GraphStore], BoolMatrix | DataFrame]) -> Query:
    return lambda spark, d: _pairs(make(graph(spark, d, "sparse")))


for _end, (_s, _o) in _ENDS.items():
    for _name, _path, _reflexive in (("plus", "click+", False), ("star", "click*", True)):
        _add(f"clos_{_name}{_end}", oracle.query_sql("sparse", _path, _s, _o), _sparse(lambda g, r=_reflexive, s=_s, o=_o: g.label("click").closure(r, g.nodes, s, o)))
    for _name, _path, _reflexive in (("plus", "view/click+", False), ("star", "view/click*", True)):
        _add(f"mult_clos_{_name}{_end}", oracle.query_sql("sparse", _path, _s, _o), _sparse(lambda g, r=_reflexive, s=_s, o=_o: g.label("view").mult_closure(g.label("click"), r, s, o)))
    for _name, _path, _reflexive in (("plus", "click+/view", False), ("star", "click*/view", True)):
        _add(f"clos_mult_{_name}{_end}", oracle.query_sql("sparse", _path, _s, _o), _sparse(lambda g, r=_reflexive, s=_s, o=_o: g.label("click").closure_mult(g.label("view"), r, s, o)))
_add("clos_squaring", oracle.query_sql("conv", "next+"), lambda spark, d: _pairs(graph(spark, d, "conv").label("next").closure(strategy="squaring")))
for _name in ("joins", "squaring", "condense", "broadcast"):
    _add(f"clos_{_name}_sparse", oracle.query_sql("sparse", "click+"), _sparse(lambda g, x=_name: g.label("click").closure(strategy=x)))
    _add(f"clos_{_name}_ev", oracle.query_sql("ev", "view*"), _ev(lambda g, x=_name: g.label("view").closure(True, g.nodes, strategy=x)))
_add("clos_ev_row", oracle.query_sql("ev", "view+", 0), _ev(lambda g: g.label("view").closure(row=0)))
_add("clos_ev_cell", oracle.query_sql("ev", "view+", 0, 7), _ev(lambda g: g.label("view").closure(row=0, col=7)))
_add("clos_shallow_then_squared", oracle.query_sql("conv", "next+"), lambda spark, d: _pairs(shallow_then_squared(graph(spark, d, "conv").label("next").pairs)))
_add("clos_condense_row", oracle.query_sql("sparse", "(click|error)+", 0), _sparse(lambda g: g.label("click").or_(g.label("error")).closure(row=0, strategy="condense")))
_add("clos_joins", oracle.query_sql("conv", "next+"), lambda spark, d: _pairs(graph(spark, d, "conv").label("next").closure(strategy="joins")))
_add("clos_chains", oracle.query_sql("conv", "next*"), lambda spark, d: (lambda g: _pairs(g.label("next").closure(True, g.nodes)))(graph(spark, d, "conv")))
_add("clos_joins_row", oracle.query_sql("sparse", "click+", 0), _sparse(lambda g: g.label("click").closure(row=0, strategy="joins")))
_add("propagate_seeds", oracle.query_sql("sparse", "view/(click|error)+"), _sparse(lambda g: propagate(g.label("view").pairs, g.label("click").or_(g.label("error")).pairs, False)))

# -- path expressions ---------------------------------------------------------------------------------


def _rpq(name: str, kind: str, path: str, s: int | None = None, o: int | None = None, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(Solver(graph(spark, sf_dir, kind), **options).solve(s, path, o))

    _add(name, oracle.query_sql(kind, path, s, o), run)


def _rpq_cell(name: str, kind: str, path: str, **options) -> None:
    """Both ends bound to the first pair of the path's own answer."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        solver = Solver(graph(spark, sf_dir, kind), **options)
        first = solver.solve(None, path, None).pairs.agg(F.min(F.struct("row", "col")).alias("cell")).first()["cell"]
        return _pairs(solver.solve(first["row"], path, first["col"]) if first else BoolMatrix.empty(spark))

    _add(name, oracle.first_sql(kind, path), run)


_MODES = {"vv": (None, None), "cv": (0, None), "vc": (None, 7)}
for _name, _path in {
    "label": "click", "inverse": "<%click>", "conc3": "click/view/error", "or3": "click|view|error", "opt": "click?", "inverse_opt": "<%click>?",
    "star": "click*", "plus": "click+", "inverse_group": "^(click/view|error)", "or_closure": "purchase|signup+|error+", "conc_closure": "view/click+", "closure_conc": "click*/view", "group_star": "(click/^view)*",
}.items():
    for _mode, (_s, _o) in _MODES.items():
        _rpq(f"rpq_{_name}_{_mode}", "sparse", _path, _s, _o)
    _rpq_cell(f"rpq_{_name}_cc", "sparse", _path)
for _name, _path in {"star": "click*", "plus": "click+", "or3": "click|view|error"}.items():
    _rpq(f"rpq_{_name}_cc_fixed", "sparse", _path, 0, 7)


def _shape(kinds: tuple[str, str], operators: str) -> Query:
    """All readings of a shape, numbered; a constant subject is 0, a constant object 7."""
    ends = [None if kind == "v" else x for kind, x in zip(kinds, (0, 7), strict=True)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        solver = Solver(graph(spark, sf_dir, "sparse"))
        out = None
        for i, path in enumerate(shapes.readings(operators), 1):
            pairs = _pairs(solver.solve(ends[0], path, ends[1])).select(F.lit(i).alias("reading"), "s", "o")
            out = pairs if out is None else out.unionByName(pairs)
        return out

    return run


def _shape_sql(kinds: tuple[str, str], operators: str) -> str:
    where = " AND ".join(f"{c} = {x}" for c, x, kind in (("s", 0, kinds[0]), ("o", 7, kinds[1])) if kind == "c") or "true"
    parts = [f"SELECT {i} AS reading, s, o FROM ({oracle.pairs_sql(path)}) q WHERE {where}" for i, path in enumerate(shapes.readings(operators), 1)]
    return f"{oracle.prelude('sparse')} {' UNION ALL '.join(parts)}"


_NAMES = {"*": "star", "+": "plus", "?": "opt", "/": "then", "|": "or", "^": "inv"}
for _a, _signs, _b in shapes.shapes():
    _add(f"rpq_shape_{_a}{_b}_{'_'.join(_NAMES[x] for x in _signs)}", _shape_sql((_a, _b), _signs), _shape((_a, _b), _signs))

_rpq("rpq_keys_vv", "fk", "places/contains/supplied_by")
_rpq("rpq_keys_cv", "fk", "places/contains/supplied_by/in_nation/in_region", 0)
_rpq("rpq_keys_vc", "fk", "places/contains/supplied_by/in_nation", None, 28)
_rpq("rpq_keys_inverse", "fk", "^in_nation/places", 28, None)
_rpq("rpq_keys_region", "fk", "(in_nation|places)/in_region?", None, 13)
_rpq("rpq_turns", "conv", "user/(assistant|user)*")
_rpq("rpq_nested_star", "sparse", "click**", 0)
_rpq("rpq_nested_plus_opt", "sparse", "click+?", None, 7)
_rpq("nfa_vv", "sparse", "click/(error|^view)*", None, None, engine="nfa")
_rpq("nfa_cv", "sparse", "(click/error)+|view?", 0, None, engine="nfa")
_rpq("nfa_vc", "sparse", "click/error*/purchase?", None, 7, engine="nfa")
_rpq_cell("nfa_cc", "sparse", "(click|error)*/view", engine="nfa")

_NOTHING = "SELECT CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS o WHERE false"
_add("rpq_unknown_predicate", _NOTHING, lambda spark, d: _pairs(Solver(graph(spark, d, "sparse")).solve(None, "click|nothing*", None)))
_rpq("rpq_label_without_edges", "sparse", "click|nothing/view|(nothing)+", 0, None, on_unknown="no_edges")
_add("rpq_mandatory_without_edges", _NOTHING, lambda spark, d: _pairs(Solver(graph(spark, d, "sparse"), on_unknown="no_edges").solve(None, "click/(view*)/nothing+", None)))
_add("rpq_unknown_constant", _NOTHING, lambda spark, d: _pairs(Solver(graph(spark, d, "sparse")).solve(-1, "click*", None)))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = automaton(parse_path("click/(error|view)*"))
    return spark.createDataFrame([(a, x.name, b) for a, x, b in machine.moves], "a long, p string, b long")


_add("nfa_moves", "SELECT * FROM (VALUES (0::BIGINT, 'click', 1::BIGINT), (1, 'error', 2), (1, 'view', 3), (2, 'error', 2), (2, 'view', 3), (3, 'error', 2), (3, 'view', 3)) t(a, p, b)", _states)

# -- expressions as such: what the helpers say of some, against what is known -------------------------------


def _table(rows: list[tuple], schema: str) -> Query:
    return lambda spark, d: spark.createDataFrame(rows, schema)


def _status(text: str) -> str:
    try:
        return ast.show(parse_path(text))
    except PathSyntaxError:
        return "error"


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({names})"


#: What an empty part, a class, a stray sign and the like come to.
_SYNTAX = {"a": "<a>", "a//b": "error", "()": "error", "a|": "error", "[a-z]": "error", "a.b": "<a.b>", "[^a]": "error", "*a": "error", "(a": "error", "a)": "error", "a b": "<a>/<b>", "^(a/b)": "<%b>/<%a>", "a#": "error", "((a))": "<a>", "^^a": "<a>", "a|b/c": "<a>|<b>/<c>"}
_add("path_syntax", _values(list(_SYNTAX.items()), "path, says"), _table([(p, _status(p)) for p in _SYNTAX], "path string, says string"))
_MANDATORY = {"a/b*/c+": "a,c", "(a/b)|(b/c)": "b", "a|b": "", "(a|a/b)/c?": "a", "(a/b)+": "a,b", "^a/b": "a,b"}
_add("path_mandatory_labels", _values(list(_MANDATORY.items()), "path, labels"), _table([(p, ",".join(sorted(ast.mandatory_labels(parse_path(p))))) for p in _MANDATORY], "path string, labels string"))
_LABELS = {"a/b*/c+": 3, "a|a|^a": 1, "(a/b)*/(b/c)?": 3}
_add("path_label_count", _values(list(_LABELS.items()), "path, n"), _table([(p, len(ast.labels(parse_path(p)))) for p in _LABELS], "path string, n int"))
_SPLIT = [("a/b*/c", 0, None, "<a>", "<b>*/<c>"), ("a/b*/c", 1, "<a>/<b>*", "<c>", None), ("a", 0, None, "<a>", None), ("(a|b)/c/^d/e?", 1, "(<a>|<b>)/<c>", "<%d>", "<e>?")]


def _split(path: str, k: int) -> tuple:
    left, label, right = ast.split(parse_path(path), k)
    return path, k, left and ast.show(left), ast.show(label), right and ast.show(right)


_add("path_split", _values(_SPLIT, "path, k, before, label, after"), _table([_split(p, k) for p, k, *_ in _SPLIT], "path string, k int, before string, label string, after string"))
_SIMPLER = {"a**": "<a>*", "a+?": "<a>*", "(a|b)|a": "<a>|<b>", "a/(b/c)": "<a>/<b>/<c>", "(a+)+": "<a>+", "a??": "<a>?"}
_add("path_simplify", _values(list(_SIMPLER.items()), "path, simpler"), _table([(p, ast.show(simplify(parse_path(p)))) for p in _SIMPLER], "path string, simpler string"))
_LEAVES = [("a/(b|^a)*", 1, "a", False), ("a/(b|^a)*", 2, "b", False), ("a/(b|^a)*", 3, "a", True)]


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which label each state of the automaton is entered by."""
    rows = {(b, x.name, x.inverse) for _, x, b in automaton(parse_path("a/(b|^a)*")).moves}
    return spark.createDataFrame([("a/(b|^a)*", *r) for r in sorted(rows)], "path string, leaf int, label string, inverse boolean")


_add("path_leaves", _values(_LEAVES, "path, leaf, label, inverse"), _leaves)

_WORKLOAD = [("?x", "<click>/<error>*", "<7>"), ("<0>", "<click>+", "?y"), ("?x", "<click>|<%error>", "?y"), ("<0>", "<view>?", "<7>"), ("?x", "<nothing>", "?y"), ("<0>", "(<click>/<view>)*", "<7>")]


def _workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [" ".join(q) for q in _WORKLOAD]
    return run_workload(graph(spark, sf_dir, "sparse"), [*lines, "", "<0> ( ?y"], timeout=600).select("query_id", "n_pairs", "status")


def _workload_sql() -> str:
    parts = []
    for i, (s, path, o) in enumerate(_WORKLOAD, 1):
        ends = [None if x.startswith("?") else int(x[1:-1]) for x in (s, o)]
        status = "unknown" if "nothing" in path else "ok"
        parts.append(f"SELECT CAST({i} AS INTEGER) AS query_id, count(*) AS n_pairs, '{status}' AS status FROM ({oracle.pairs_sql(path)}) q WHERE {' AND '.join(f'{c} = {x}' for c, x in zip('so', ends, strict=True) if x is not None) or 'true'}")
    parts.append("SELECT 8, NULL, 'error'")
    return f"{oracle.prelude('sparse')} " + " UNION ALL ".join(parts)


_add("workload_counts", _workload_sql(), _workload)
