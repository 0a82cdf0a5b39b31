"""Substring deduplication by a sparse suffix array.

Of all suffixes of all texts (at word starts) only those at minimisers are kept: in each window of
``MIN_WORDS`` words the word gram of least hash. Which it is depends on the window alone, so two texts with
a common window keep suffixes at the same place of it. The kept suffixes are sorted, by their first 16
bytes and then by the digest of their first gram, and each is compared with its neighbours: suffixes that
begin with the same gram are next to each other. A suffix without such a neighbour is dropped; the array's
ranges meet at their edges, so the words in spans don't depend on how many there are (which earlier text a span
names may). The windows of the
others are matched on the texts, extended to the left and right (see :mod:`.passages`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import span_hashes, text_chunks
from .passages import MIN_WORDS, RUN, RUN_SCHEMA, cut_out, least_in, matches, occurrences, rows_of, run_table, runs_of, shared_runs, window_spans

#: Word positions of which the one with the least gram is kept.
SPAN = 32


def window_minimisers(hashes: np.ndarray, docs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of all runs of ``span`` positions in one text, and the position of least hash in each.

    The rightmost of equal ones is taken, so that a run of one repeated word keeps few of them.
    """
    size = np.bincount(docs) if len(docs) else np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(docs))  # positions from here to the text's end
    begin = np.flatnonzero(left >= span)
    return begin, least_in(hashes >> np.uint64(1), begin, begin + span - 1)


def minimisers(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Positions with the least hash among ``SPAN`` in a row within one text (the whole text if shorter)."""
    if not len(docs):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    last = np.append(first[1:], len(docs)) - 1
    short = last - first + 1 < SPAN
    return np.union1d(window_minimisers(hashes, docs, SPAN)[1], least_in(hashes >> np.uint64(1), first[short], last[short]))


def suffixes(texts: pa.StringArray, width: int) -> tuple[np.ndarray, ...]:
    """The kept suffixes: text, first 16 bytes as two numbers that sort alike, digest of the first gram, first
    and last window of ``width`` words that the suffix was kept for."""
    span = min(SPAN, max(1, width * 5 // 8))
    buf, doc, k, start, end = window_spans(texts, width - span + 1)
    grams = span_hashes(buf, start, end)
    begin, best = window_minimisers(grams, doc, span)
    first, last = runs_of(best, doc[begin])
    at = best[first]
    place = start[at][:, None] + np.arange(16)
    head = np.where(place < end[at][:, None], np.append(buf, np.zeros(16, np.uint8))[place], np.uint8(0))  # of the gram alone
    heads = [np.ascontiguousarray(head[:, i : i + 8]).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63) for i in (0, 8)]
    return doc[at], *(h.view(np.int64) for h in heads), grams[at].view(np.int64), k[begin[first]].astype(np.int32), k[begin[last]].astype(np.int32)


def suffix_runs(docs: DataFrame, width: int, tag: str = "suffixes") -> DataFrame:
    """Runs of windows kept for suffixes that a neighbour in the array begins like, as
    :func:`.passages.shared_runs` gives them."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                doc, head, more, gram, first, last = suffixes(texts, width)
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(more), *run_table(doc, gram, first, last, part, texts, width)], ["head", "more", *RUN])

    return shared_runs(rows_of(docs).mapInArrow(kept, f"head long, more long, {RUN_SCHEMA}"), ["head", "more"], tag)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each span of a document that is a passage of another one too: doc_id, mark, start, end, n_words,
    other_id, other_start.

    Places are bytes of the UTF-8 text; ``mark`` is xxhash64 of the text. ``other_id`` is null for the first
    place of a passage. Documents without such a passage have no row; null and empty texts have none, nor
    have rows without a doc_id, nor an empty table. Rows that share a doc_id count as a document for each
    text that they have. A passage that stands only in one text, however often, is none. Columns other
    than doc_id and text are not looked at. A worker needs some 60 bytes for each byte of the longest text.
    """
    return occurrences(matches(docs, suffix_runs(docs, min_words), min_words, "suffixes"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every repeated passage taken out but in its first place; columns stay the same."""
    found = repeated_passages(docs, min_words).where("other_id IS NOT NULL")
    return cut_out(docs, found.select("doc_id", "mark", "start", "end"))
