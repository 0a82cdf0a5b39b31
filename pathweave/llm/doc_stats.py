"""Statistics of a document that the quality classifier and the quality rules look at.

All are taken over the whole text. Words are runs of characters that are not ASCII white space.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from .common import utf8

#: The exact counts of the base rules.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Model inputs, each between 0 and about 1 and derived from the counts.
FEATURES = [
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "point_share", "shout_share", "other_ascii_share", "beyond_ascii_share", "word_symbols",
    "dup_line_share", "repeat_word_share", "distinct_word_share", "stutter_share", "line_words", "short_line_share", "log_lines", "capital_words",
]
#: The symbols that the base rules count.
SYMBOLS = "#*$%&|<>"

_OTHER, _CONT, _SPACE, _LOWER, _UPPER, _DIGIT, _POINT, _SHOUT, _SYMBOL, _LEAD = range(10)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[0x80:0xC0] = _CONT
    table[0xC0:] = _LEAD
    for chars, kind in ((" \t\n\r\x0b\x0c", _SPACE), ("abcdefghijklmnopqrstuvwxyz", _LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), (".,;:'\"()-", _POINT), ("!?", _SHOUT), (SYMBOLS, _SYMBOL)):
        table[[ord(c) for c in chars]] = kind
    return table


_CLASSES = _byte_classes()


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of ``width`` words found twice or more, the first one included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    at = np.flatnonzero(np.fromiter((times[w] > 1 for w in windows), bool, len(windows)))
    marked = np.zeros(len(words), bool)
    for i in range(width):
        marked[at + i] = True
    return int(marked.sum())


def duplicate_lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word that equal an earlier line, lines with a word, and those of under three words."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines), sum(len(x.split(None, 3)) < 3 for x in lines)


def measure(texts: pa.StringArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts (int64 arrays) and the matrix of FEATURES of each text; nulls count as empty."""
    buf, offsets = utf8(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n, dtype=np.int64) * 16, np.diff(offsets))
    kinds = np.bincount(doc + _CLASSES[buf], minlength=16 * n).reshape(n, 16)
    raw = buf.tobytes()
    rows = np.zeros((n, 9), np.int64)
    for i in range(n):
        text = raw[offsets[i] : offsets[i + 1]]
        words = text.split()
        if not words:
            continue
        dup, lines, short = duplicate_lines(text)
        stutter = sum(map(bytes.__eq__, words, words[1:]))
        capital = sum(map(bytes.isupper, words))
        rows[i] = len(words), dup, repeated_window_words(words), lines, short, len(set(words)), stutter, capital, 0
    chars = np.diff(offsets) - kinds[:, _CONT]
    base = {"n_words": rows[:, 0], "word_chars": chars - kinds[:, _SPACE], "n_symbols": kinds[:, _SYMBOL], "n_dup_lines": rows[:, 1], "n_repeat_words": rows[:, 2]}
    words, solid, lines = np.maximum(rows[:, 0], 1), np.maximum(base["word_chars"], 1), np.maximum(rows[:, 3], 1)
    letters = np.maximum(kinds[:, _LOWER] + kinds[:, _UPPER], 1)
    columns = [
        np.log1p(rows[:, 0]) / 10, np.minimum(solid / words / 20, 2), kinds[:, _SYMBOL] / solid, kinds[:, _UPPER] / letters, kinds[:, _DIGIT] / solid, kinds[:, _POINT] / solid, kinds[:, _SHOUT] / solid, kinds[:, _OTHER] / solid, kinds[:, _LEAD] / solid,
        np.minimum(kinds[:, _SYMBOL] / words, 3) / 3, rows[:, 1] / lines, rows[:, 2] / words, rows[:, 5] / words, rows[:, 6] / words, np.minimum(words / lines / 100, 2), rows[:, 4] / lines, np.log1p(rows[:, 3]) / 10, rows[:, 7] / words,
    ]
    return base, np.stack(columns, 1).astype(np.float64)
