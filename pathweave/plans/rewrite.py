"""Rules on path expressions that keep their meaning."""

from __future__ import annotations

from .ast import Alt, Concat, Label, Opt, Path, Plus, Star

#: (outer, inner) repetitions and what both are together.
_STACKED = {(Plus, Plus): Plus, (Opt, Opt): Opt}


def simplify(path: Path) -> Path:
    """Flatten nested concatenations and alternations, drop repeated branches, fold stacked repetitions.

    Any two stacked repetitions are a star, but for ``++`` (a plus) and ``??`` (an option).
    """
    match path:
        case Label():
            return path
        case Concat(parts):
            flat: list[Path] = []
            for p in map(simplify, parts):
                flat += p.parts if isinstance(p, Concat) else (p,)
            return flat[0] if len(flat) == 1 else Concat(tuple(flat))
        case Alt(parts):
            flat = []
            for p in map(simplify, parts):
                flat += [q for q in (p.parts if isinstance(p, Alt) else (p,)) if q not in flat]
            return flat[0] if len(flat) == 1 else Alt(tuple(flat))
        case Star(part) | Plus(part) | Opt(part):
            outer, inner = type(path), simplify(part)
            if isinstance(inner, (Star, Plus, Opt)):
                return _STACKED.get((outer, type(inner)), Star)(inner.part)
            return outer(inner)
    raise TypeError(path)
