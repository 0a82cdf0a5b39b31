"""Substring deduplication by content-defined chunks, cut by a gear rolling hash.

The gear hash of the last ``WINDOW`` bytes is looked at after each word, and a chunk runs from one place
where it is least to the next. In each window of ``MIN_WORDS`` words the chunk begins after the word of least
hash in the window's first part and ends at the word of least hash among those that keep it between 14
and 20 words. All hashes looked at are of bytes inside the window, so it is
the same chunk wherever the window stands: an insertion moves chunks only near itself, and no passage of
``MIN_WORDS`` words, however short these are, can hide.

Chunks are deduplicated by digest: sorted by it, those that stand in one place only are dropped, and with them
all windows they were taken from. What is left is compared on the texts (see :mod:`.passages`).

``chunk_ends`` cuts whole texts at bytes by the same hash, with no regard to words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import span_hashes, text_chunks, utf8, words_of
from .passages import MIN_WORDS, RUN, RUN_SCHEMA, cut_out, least_in, matches, occurrences, rows_of, run_table, runs_of, shared_runs

#: A chunk of bytes ends where so many top bits of the hash are zero; sizes in bytes; 52 on average.
BITS, LEAST, MOST = 5, 20, 128
#: Bytes that the hash depends on.
WINDOW = 32

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = 2 * h + gear[byte] modulo 2**32, begun anew in each text.

    As 32 doublings push a byte out, the sum over the last 32 bytes is built by doubling its length; the
    first bytes of each text, whose sums would go back into the text before, are taken by themselves.
    """

    def rolled(h: np.ndarray) -> np.ndarray:
        width = 1
        while width < WINDOW:
            h[..., width:] += h[..., :-width] << np.uint32(width)
            width *= 2
        return h

    h = rolled(_GEAR[buf])
    place = offsets[:-1][:, None] + np.arange(WINDOW)
    inside = place < offsets[1:][:, None]
    begin = np.zeros(place.shape, np.uint32)
    begin[inside] = _GEAR[buf[place[inside]]]
    h[place[inside]] = rolled(begin)[inside]
    return h


def chunk_ends(buf: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks, as offsets in the text; the last is the text's end."""
    hits = np.flatnonzero(gear_hashes(buf, offsets) >> np.uint32(32 - BITS) == 0) + 1
    first = np.searchsorted(hits, offsets, side="right")
    out = []
    for i in range(len(offsets) - 1):
        base, size = int(offsets[i]), int(offsets[i + 1] - offsets[i])
        ends, last = [], 0
        for hit in (hits[first[i] : first[i + 1]] - base).tolist():
            while hit - last > MOST:
                last += MOST
                ends.append(last)
            if hit - last >= LEAST:
                ends.append(hit)
                last = hit
        while size - last > MOST:
            last += MOST
            ends.append(last)
        if size > last:
            ends.append(size)
        out.append(ends)
    return out


def window_chunks(texts: pa.StringArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of all windows of ``width`` words: text, digest, first and last window that has this chunk.

    A chunk has at most two fifths of the window's words and 70 % of those at least. A window with too few
    bytes for that is a chunk itself.
    """
    buf, offsets = utf8(texts)
    starts, ends, before = words_of(buf, offsets)
    n = np.maximum(np.diff(before) - width + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    if not len(doc):
        return doc, np.zeros(0, np.uint64), doc, doc
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    word = before[doc] + k
    most = max(1, width * 2 // 5)
    least = max(1, most * 7 // 10)
    gear = gear_hashes(buf, offsets)[ends - 1]
    low, high = np.searchsorted(ends, starts[word] + WINDOW), word + (width - 1 - most)
    cut = word - 1  # the last word before the chunk
    roomy = np.flatnonzero(low <= high)
    cut[roomy] = least_in(gear, low[roomy], high[roomy])
    first, last = runs_of(cut * 2 + (low > high), doc)
    begin, whole = cut[first], low[first] > high[first]
    end = begin + width
    end[~whole] = least_in(gear, begin[~whole] + least, begin[~whole] + most)
    return doc[first], span_hashes(buf, starts[begin + 1], ends[end]), k[first], k[last]


def chunk_runs(docs: DataFrame, width: int, tag: str = "chunks") -> DataFrame:
    """Runs of windows whose chunk another run has too, as :func:`.passages.shared_runs` gives them."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                yield pa.RecordBatch.from_arrays(run_table(*window_chunks(texts, width), part, texts, width), RUN)

    return shared_runs(rows_of(docs).mapInArrow(chunked, RUN_SCHEMA), [], tag)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each span of a document that is a passage of another one too: doc_id, mark, start, end, n_words,
    other_id, other_start.

    Places are bytes of the UTF-8 text; ``mark`` is xxhash64 of the text. ``other_id`` is null for the first
    place of a passage, which deduplication keeps. Documents without such a passage have no row; null and
    empty texts have none, nor have rows without a doc_id, nor an empty table. Rows that share a doc_id
    count as a document for each text that they have. A passage that stands only in one text, however
    often, is none. Columns other than doc_id and text are not looked at. A worker needs some 60 bytes
    for each byte of the longest text.
    """
    return occurrences(matches(docs, chunk_runs(docs, min_words), min_words, "chunks"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every repeated passage taken out but in its first place; columns stay the same.

    Rows stay, if with an empty text where nothing else was in them. Each row loses what its own text
    repeats, also where rows share an id.
    """
    found = repeated_passages(docs, min_words).where("other_id IS NOT NULL")
    return cut_out(docs, found.select("doc_id", "mark", "start", "end"))
