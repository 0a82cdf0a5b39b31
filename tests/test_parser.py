import pytest

from pathweave.plans.ast import Alt, Concat, Label, Opt, Plus, Star, labels, mandatory_labels, nullable, reverse, show, split
from pathweave.plans.nfa import automaton
from pathweave.plans.parser import PathSyntaxError, parse_path, parse_query
from pathweave.plans.rewrite import simplify

A, B, C = Label("a"), Label("b"), Label("c")


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("<a>", A), ("a", A), ("<%a>", Label("a", True)), ("^a", Label("a", True)), ("^^a", A), ("a/b", Concat((A, B))), ("a b", Concat((A, B))),
        ("a|b/c", Alt((A, Concat((B, C))))), ("(a|b)/c", Concat((Alt((A, B)), C))), ("a/b*", Concat((A, Star(B)))), ("(a/b)*", Star(Concat((A, B)))),
        ("a+?", Opt(Plus(A))), ("^(a/b|c)", Alt((Concat((Label("b", True), Label("a", True))), Label("c", True)))), ("^a*", Star(Label("a", True))),
        ("<http://x.org/p#1>/<%b c>", Concat((Label("http://x.org/p#1"), Label("b c", True)))),
    ],
)
def test_parse(text, tree):
    assert parse_path(text) == tree
    assert parse_path(show(tree)) == tree


@pytest.mark.parametrize("text", ["", "a|", "(a", "a)", "*a", "()", "a//b", "[a-z]", "a|*", "/a"])
def test_syntax_errors(text):
    with pytest.raises(PathSyntaxError):
        parse_path(text)


@pytest.mark.parametrize(("text", "to"), [("a**", "a*"), ("a?*", "a*"), ("a+*", "a*"), ("a*?", "a*"), ("a??", "a?"), ("a+?", "a*"), ("a*+", "a*"), ("a?+", "a*"), ("a++", "a+"), ("(a/(b/c))/a", "a/b/c/a"), ("a|(b|a)", "a|b")])
def test_simplify(text, to):
    assert simplify(parse_path(text)) == parse_path(to)


def test_tree_helpers():
    tree = parse_path("a/(b|c)*/a?/b+")
    assert labels(tree) == {"a", "b", "c"}
    assert mandatory_labels(tree) == {"a", "b"}
    assert reverse(reverse(tree)) == tree
    assert not nullable(tree)
    assert nullable(parse_path("a*/b?|c"))
    left, leaf, right = split(parse_path("a/b*/c"), 1)
    assert (left, leaf, right) == (Concat((A, Star(B))), C, None)


def test_query_lines():
    q = parse_query("?x <a>/<%b>* <7>\r\n")
    assert (q.subject, q.object) == (None, "<7>")
    assert q.path == Concat((A, Star(Label("b", True))))
    assert parse_query("<1> <a> | <b> ?longname").path == Alt((A, B))
    with pytest.raises(PathSyntaxError):
        parse_query("?x <a>")


def test_automaton():
    m = automaton(parse_path("a/(b|c)*"))
    assert m.states == 4
    assert m.accepting == {1, 2, 3}
    assert m.next({1}, B) == {2}
    assert m.next({2}, B, forward=False) == {1, 2, 3}


def operator_readings(signs: str) -> list[str]:
    """Expressions whose operators, in the order they are written, are ``signs``, over labels in turn."""
    out, at = "a", 0
    for s in signs:
        if s in "*+?":
            out += s
        elif s == "^":
            out = "^" + out if at == 0 else out + "/^b"
        else:
            at += 1
            out += s + "bcde"[at % 4]
    return [out, f"({out})"]


@pytest.mark.parametrize("signs", ["/*", "*", "+", "/", "|*", "*/*", "*/*/*/*/*", "/?", "^", "|", "/*/", "?/", "+/+", "||", "/|", "*|*", "/^", "^/", "?|?", "////", "|||||", "+?", "/+"])
def test_shapes_parse(signs):
    for text in operator_readings(signs):
        assert simplify(parse_path(text))
