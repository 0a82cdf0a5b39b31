"""Path expressions as trees."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Path:
    """A path expression."""


@dataclass(frozen=True)
class Label(Path):
    """The edges of a label, followed backwards if ``inverse``."""

    name: str
    inverse: bool = False


@dataclass(frozen=True)
class Concat(Path):
    """One path after the other."""

    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Alt(Path):
    """Any of the paths."""

    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Star(Path):
    """The path any number of times, none included."""

    part: Path


@dataclass(frozen=True)
class Plus(Path):
    """The path once or more."""

    part: Path


@dataclass(frozen=True)
class Opt(Path):
    """The path or nothing."""

    part: Path


def reverse(path: Path) -> Path:
    """The expression for the same pairs the other way round: labels are inverted, parts swap."""
    match path:
        case Label(name, inverse):
            return Label(name, not inverse)
        case Concat(parts):
            return Concat(tuple(reverse(p) for p in reversed(parts)))
        case Alt(parts):
            return Alt(tuple(map(reverse, parts)))
        case Star(part) | Plus(part) | Opt(part):
            return type(path)(reverse(part))
    raise TypeError(path)


def nullable(path: Path) -> bool:
    """Whether the expression matches the empty path."""
    match path:
        case Star() | Opt():
            return True
        case Plus(part):
            return nullable(part)
        case Concat(parts):
            return all(map(nullable, parts))
        case Alt(parts):
            return any(map(nullable, parts))
    return False


def labels(path: Path) -> set[str]:
    """All labels in the expression."""
    match path:
        case Label(name):
            return {name}
        case Concat(parts) | Alt(parts):
            return set().union(*map(labels, parts))
        case Star(part) | Plus(part) | Opt(part):
            return labels(part)
    raise TypeError(path)


def mandatory_labels(path: Path) -> set[str]:
    """Labels that every match of the expression has: if one of them has no edge, nothing matches."""
    match path:
        case Label(name):
            return {name}
        case Concat(parts):
            return set().union(*map(mandatory_labels, parts))
        case Alt(parts):
            return set.intersection(*map(mandatory_labels, parts))
        case Plus(part):
            return mandatory_labels(part)
    return set()


def split(path: Path, k: int) -> tuple[Path | None, Label, Path | None]:
    """What may come before and after the ``k``-th label (from 0) of a top-level concatenation's leaves.

    Only leaves that are not under an alternation or a repetition can be split at.
    """
    parts = path.parts if isinstance(path, Concat) else (path,)
    spots = [i for i, p in enumerate(parts) if isinstance(p, Label)]
    i = spots[k]
    side = lambda ps: None if not ps else ps[0] if len(ps) == 1 else Concat(tuple(ps))
    return side(parts[:i]), parts[i], side(parts[i + 1 :])


def show(path: Path) -> str:
    """The expression as text that parses to the same tree."""
    match path:
        case Label(name, inverse):
            return f"<{'%' if inverse else ''}{name}>"
        case Concat(parts):
            return "/".join(f"({show(p)})" if isinstance(p, (Alt, Concat)) else show(p) for p in parts)
        case Alt(parts):
            return "|".join(f"({show(p)})" if isinstance(p, Alt) else show(p) for p in parts)
        case Star(part) | Plus(part) | Opt(part):
            inner = f"({show(part)})" if isinstance(part, (Alt, Concat)) else show(part)
            return inner + {Star: "*", Plus: "+", Opt: "?"}[type(path)]
    raise TypeError(path)
