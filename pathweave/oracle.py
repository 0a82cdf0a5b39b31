"""Path expressions as plain SQL, the independent answer that queries are held against.

Nothing here is used to answer a query, and nothing of what answers queries is used here: paths are read by
operator precedence on a stack, into nested tuples. Closures are ``WITH RECURSIVE ... UNION``, which ends on
cycles.
"""

from __future__ import annotations

import re

#: A path as nested tuples: ("label", name), ("^", path), ("*" or "+" or "?", path), ("/" or "|", path, path).
Tree = tuple

_EVENTS = """
SELECT DISTINCT s, p, o FROM (
  SELECT user_id AS s, event_type AS p, lead(user_id) OVER (ORDER BY ts, event_id) AS o, value FROM events
) t WHERE o IS NOT NULL{more}"""

_KEYS = """
SELECT DISTINCT o_custkey * 8 AS s, 'places' AS p, o_orderkey * 8 + 1 AS o FROM orders
UNION SELECT l_orderkey * 8 + 1, 'contains', l_partkey * 8 + 2 FROM lineitem
UNION SELECT l_partkey * 8 + 2, 'supplied_by', l_suppkey * 8 + 3 FROM lineitem
UNION SELECT CAST(c_custkey AS BIGINT) * 8, 'in_nation', CAST(c_nationkey AS BIGINT) * 8 + 4 FROM customer
UNION SELECT CAST(s_suppkey AS BIGINT) * 8 + 3, 'in_nation', CAST(s_nationkey AS BIGINT) * 8 + 4 FROM supplier
UNION SELECT CAST(n_nationkey AS BIGINT) * 8 + 4, 'in_region', CAST(n_regionkey AS BIGINT) * 8 + 5 FROM nation"""

_TURNS = """
SELECT a.conv_id * w + a.turn AS s, 'next' AS p, a.conv_id * w + a.turn + 1 AS o
FROM conversations a, (SELECT max(turn) + 1 AS w FROM conversations) m WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)
UNION SELECT a.conv_id * w + a.turn, a.role, a.conv_id * w + a.turn + 1
FROM conversations a, (SELECT max(turn) + 1 AS w FROM conversations) m WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""

#: Edges and nodes of each graph.
GRAPHS = {
    "ev": (_EVENTS.format(more=""), "SELECT DISTINCT user_id AS id FROM events"),
    "sparse": (_EVENTS.format(more=" AND value > 60"), "SELECT DISTINCT user_id AS id FROM events"),
    "fk": (_KEYS, "SELECT s AS id FROM g UNION SELECT o FROM g"),
    "conv": (_TURNS, "SELECT DISTINCT conv_id * w + turn AS id FROM conversations, (SELECT max(turn) + 1 AS w FROM conversations) m"),
}


def prelude(graph: str) -> str:
    """The common tables g (edges) and v (nodes)."""
    edges, nodes = GRAPHS[graph]
    return f"WITH g AS ({edges}), v AS ({nodes})"


#: How strongly operators bind.
_BINDS = {"|": 1, "/": 2, "^": 3}


def tree_of(text: str) -> Tree:
    """A path's tree: operands and operators on two stacks."""
    operands: list[Tree] = []
    operators: list[str] = []

    def reduce() -> None:
        sign = operators.pop()
        if sign == "^":
            operands.append(("^", operands.pop()))
        else:
            right = operands.pop()
            operands.append((sign, operands.pop(), right))

    for token in re.findall(r"<[^>]*>|[A-Za-z_]\w*|[()|/*+?^]", text):
        if token == "(":
            operators.append(token)
        elif token == ")":
            while operators[-1] != "(":
                reduce()
            operators.pop()
        elif token in "*+?":
            operands.append((token, operands.pop()))  # binds to what stands right before it
        elif token == "^":
            operators.append(token)
        elif token in "/|":
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[token]:
                reduce()
            operators.append(token)
        else:
            name = token.strip("<>")
            operands.append(("^", ("label", name[1:])) if name[0] == "%" else ("label", name))
    while operators:
        reduce()
    (whole,) = operands
    return whole


def pairs_sql(path: Tree | str) -> str:
    """A query for the pairs (s, o) of a path over g and v."""
    if isinstance(path, str):
        path = tree_of(path)
    match path:
        case ("label", name):
            return f"SELECT s, o FROM g WHERE p = '{name}'"
        case ("^", part):
            return f"SELECT o AS s, s AS o FROM ({pairs_sql(part)}) i"
        case ("/", left, right):
            return f"SELECT DISTINCT a.s, b.o FROM ({pairs_sql(left)}) a JOIN ({pairs_sql(right)}) b ON a.o = b.s"
        case ("|", left, right):
            return f"SELECT s, o FROM ({pairs_sql(left)}) u UNION SELECT s, o FROM ({pairs_sql(right)}) w"
        case ("?", part):
            return f"SELECT s, o FROM ({pairs_sql(part)}) u UNION SELECT id AS s, id AS o FROM v"
        case ("+", part):
            return f"WITH RECURSIVE b AS MATERIALIZED ({pairs_sql(part)}), r(s, o) AS (SELECT s, o FROM b UNION SELECT r.s, b.o FROM r JOIN b ON r.o = b.s) SELECT s, o FROM r"
        case ("*", part):
            return f"SELECT s, o FROM ({pairs_sql(('+', part))}) u UNION SELECT id AS s, id AS o FROM v"
    raise TypeError(path)


def query_sql(graph: str, path: Tree | str, s: int | None = None, o: int | None = None) -> str:
    """The whole query with bound ends."""
    where = " AND ".join(f"{c} = {x}" for c, x in (("s", s), ("o", o)) if x is not None)
    return f"{prelude(graph)} SELECT s, o FROM ({pairs_sql(path)}) q" + (f" WHERE {where}" if where else "")


def first_sql(graph: str, path: Tree | str) -> str:
    """The first pair of the answer by (s, o): what a query with both these ends bound must find."""
    return f"{prelude(graph)} SELECT s, o FROM ({pairs_sql(path)}) q ORDER BY s, o LIMIT 1"
