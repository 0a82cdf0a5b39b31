"""Parsing of path expressions and query lines.

    alternation   a|b          lowest
    concatenation a/b or a b
    repetition    a* a+ a?     highest, may be stacked
    inverse       ^a or <%label>
    label         <label>, or a bare word
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .ast import Alt, Concat, Label, Opt, Path, Plus, Star, reverse

_TOKEN = re.compile(r"\s*(?:(?P<label><%?[^<>]+>)|(?P<word>[A-Za-z_][\w:.\-]*)|(?P<sign>[()|/*+?^]))")


class PathSyntaxError(ValueError):
    """A path expression or query line that can't be read."""


def tokens(text: str) -> list[str]:
    """The tokens of an expression; bare words come as labels."""
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        found = _TOKEN.match(text, at)
        if not found:
            raise PathSyntaxError(f"unexpected {text[at : at + 10]!r} at {at} in {text!r}")
        out.append(f"<{found['word']}>" if found["word"] else found["label"] or found["sign"])
        at = found.end()
    return out


def parse_path(text: str) -> Path:
    """The tree of an expression; an empty (sub)expression is an error."""
    left = tokens(text)[::-1]

    def fail() -> PathSyntaxError:
        return PathSyntaxError(f"unexpected {left[-1] if left else 'end'!r} in {text!r}")

    def alternation() -> Path:
        parts = [concatenation()]
        while left and left[-1] == "|":
            left.pop()
            parts.append(concatenation())
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def concatenation() -> Path:
        parts = [repetition()]
        while left and left[-1] not in "|)":
            if left[-1] == "/":
                left.pop()
            parts.append(repetition())
        return parts[0] if len(parts) == 1 else Concat(tuple(parts))

    def repetition() -> Path:
        inverses = 0
        while left and left[-1] == "^":
            left.pop()
            inverses += 1
        out = atom()
        while left and left[-1] in "*+?":
            out = {"*": Star, "+": Plus, "?": Opt}[left.pop()](out)
        return reverse(out) if inverses % 2 else out

    def atom() -> Path:
        if not left:
            raise fail()
        if left[-1] == "(":
            left.pop()
            out = alternation()
            if not left or left.pop() != ")":
                raise PathSyntaxError(f"missing ) in {text!r}")
            return out
        if left[-1][0] != "<":
            raise fail()
        name = left.pop()[1:-1]
        return Label(name[1:], True) if name[0] == "%" else Label(name)

    out = alternation()
    if left:
        raise fail()
    return out


@dataclass(frozen=True)
class Query:
    """A line ``subject path object``; an end is None where it is a variable."""

    subject: str | None
    path: Path
    object: str | None


def parse_query(line: str) -> Query:
    """Split a line at its first and last token; what stands between is the path."""
    words = line.split()
    if len(words) < 3:
        raise PathSyntaxError(f"a query has a subject, a path and an object: {line!r}")
    end = lambda w: None if w.startswith("?") else w
    return Query(end(words[0]), parse_path(" ".join(words[1:-1])), end(words[-1]))
