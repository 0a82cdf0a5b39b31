"""The shapes of a public workload of path queries, and the readings that their operators allow.

A shape names its ends (``v`` a variable, ``c`` a constant) and its operators in the order in which they stand
in the text; labels and parentheses are left out. A reading puts them back.
"""

from __future__ import annotations

import re

#: The distinct shapes of the workload.
SHAPES = """
c * v; c + v; c /* v; c /*|* v; c /*|*|/*|* v; c /+ v; c //+ v; c /?/?/?/?/? v; c /?/?/?/?/?/? v; c ?/* v; c ^ v; c ^* v
c ^*/* v; c ^*/^ v; c ^+ v; c ^/* v; c ^/+ v; c ^/^* v; c ^/^*+ v; c ^|*+ v; c ^|+ v; c ^|^+ v; c ^||+ v; c ^|||+ v; c | v; c |* v
c |/*|* v; c |/|? v; c |||* v; c |||+ v
v * c; v */ c; v */ v; v */* c; v */*+ c; v */*/* c; v */*/*/*/* c; v */^ c; v *|* c; v + c; v + v; v +/* v; v +/+ c; v +| c; v +|+ c
v / c; v / v; v /* c; v /* v; v /*+ c; v /*/ c; v /*/* c; v /*/^ c; v /*| c; v /*|* c; v /*|/* c; v /+ c; v // c; v //* c; v //** c; v //+ c
v ///// c; v ///? c; v //?/? c; v //?/?/?/? c; v /? c; v /? v; v /?/* c; v /?/? c; v /^ v; v /^* v; v /| c; v ? c; v ?/* c; v ?/+ c; v ?/? c
v ^ c; v ^ v; v ^*/^?/ c; v ^+/+ c; v ^/ v; v ^/* v; v ^?/^* c; v ^|+ c; v | c; v | v; v |* c; v |+ c; v |/ c; v |/* c; v |/^ c; v |/|//|/// c; v |^ v
v || c; v || v; v ||/* c; v ||/* v; v ||^/||^ v; v |||| v; v ||||| c; v ||||| v; v ||||||||||/** c
"""
LABELS = ["click", "error", "purchase", "signup", "view"]


def shapes() -> list[tuple[str, str, str]]:
    """(kind of subject, operators, kind of object) of each shape."""
    return [tuple(x.split()) for x in re.split(r"[;\n]", SHAPES) if x.strip()]


def operands(operators: str) -> tuple[list[str], list[str]]:
    """The operands with their own signs (labels in turn), and the infix operators between them."""
    pieces = re.split(r"([/|])", operators)
    out = []
    for i, signs in enumerate(pieces[::2]):
        inverse = "^" in signs
        out.append(("^" if inverse else "") + LABELS[i % len(LABELS)] + signs.replace("^", ""))
    return out, pieces[1::2]


def flat(parts: list[str], infix: list[str]) -> str:
    """The operands with the operators between them."""
    return parts[0] + "".join(a + b for a, b in zip(infix, parts[1:], strict=True))


def readings(operators: str) -> list[str]:
    """Path expressions whose operators stand in this order, different ones only.

    As it stands; with the last repetition over all that stands before it; with alternations bound before
    concatenations; and with both, the repetition over all.
    """
    parts, infix = operands(operators)

    def tight(parts: list[str], infix: list[str]) -> str:
        groups, rest = [[parts[0]]], []
        for sign, part in zip(infix, parts[1:], strict=True):
            if sign == "|":
                groups[-1].append(part)
            else:
                rest.append(sign)
                groups.append([part])
        return flat([f"({'|'.join(g)})" if len(g) > 1 else g[0] for g in groups], rest)

    def over_all(write) -> str:
        signs = re.search(r"[*+?]*$", parts[-1])[0]
        return f"({write([*parts[:-1], parts[-1].removesuffix(signs)], infix)}){signs}"

    out = [flat(parts, infix)]
    if infix and parts[-1][-1] in "*+?":
        out.append(over_all(flat))
    if {"/", "|"} <= set(infix):
        out.append(tight(parts, infix))
        if parts[-1][-1] in "*+?":
            out.append(over_all(tight))
    return out
