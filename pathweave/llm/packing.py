"""Packing of tokenised documents into sequences by cutting-stock column generation.

A document longer than a sequence is cut into whole sequences and one rest, so what is left to pack is
a histogram of rest lengths: fewer than ``capacity`` numbers, however large the corpus. On it the
driver solves the linear program of the cutting-stock problem. Columns are patterns, multisets of
lengths that fit one sequence; a knapsack dynamic program over the dual prices finds the column that
helps most, until none does or a dual bound shows the rest of the gap to be small. The pattern counts
are rounded down, the few pieces left over go first-fit by falling length, and the plan is a table of
rank ranges per length class. Documents are ranked within their class and look their place up.

The histogram counts lengths in classes of ``UNIT`` tokens (a piece counts as its class's greatest
length), which keeps the program at ``capacity / UNIT`` rows; it costs less than UNIT tokens a piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import text_chunks, written

CAPACITY = 1024
#: Tokens in a length class.
UNIT = 8


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of lengths within ``capacity`` with the highest sum of prices: its value and counts."""
    order = np.argsort(lengths)
    size, price = lengths[order], prices[order]
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if k := upto[c]:
            gains = value[c - size[:k]] + price[:k]
            best = int(gains.argmax())
            if gains[best] > value[c] + 1e-12:
                value[c], last[c] = gains[best], best
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[order[last[c]]] += 1
            c -= int(size[last[c]])
    return float(value[capacity]), counts


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.002, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, a near-optimal basic solution of the linear program.

    Revised simplex with an explicit inverse of the basis. ``gap`` is the share of the objective by
    which the result may exceed the bound that the duals and the knapsack value prove; ``most`` ends
    the search earlier, which costs padding, not correctness.
    """
    m = len(lengths)
    fit = capacity // lengths
    patterns = [np.eye(m, dtype=np.int64)[i] * fit[i] for i in range(m)]
    inverse, x = np.diag(1.0 / fit), demand / fit
    for _ in range(most):
        prices = inverse.sum(0)  # every pattern costs one sequence
        value, counts = knapsack(lengths, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-9 or x.sum() - x.sum() / value <= gap * x.sum():
            break
        column = inverse @ counts
        usable = column > 1e-9
        ratio = np.full(m, np.inf)
        ratio[usable] = x[usable] / column[usable]
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * column, 0)
        x[out] = step
        patterns[out] = counts
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
    return [(p, float(v)) for p, v in zip(patterns, x, strict=True) if v > 1e-9]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces per sequence, slot) for all pieces.

    The piece of rank r within its length lies in sequence ``first + (r - first rank) // per``, in slot
    ``slot + (r - first rank) % per`` of it. Every rank of every length is in one row.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequence = histogram.get(capacity, 0)
    if sequence:
        rows.append((capacity, 0, sequence, 0, 1, 0))
    lengths = np.array(sorted(k for k in histogram if k < capacity and histogram[k] > 0), np.int64)
    if not len(lengths):
        return rows
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    used = np.zeros(len(lengths), np.int64)

    def place(counts: np.ndarray, times: int) -> None:
        nonlocal sequence, left
        slot = 0
        for i in np.flatnonzero(counts)[::-1]:
            per = int(counts[i])
            rows.append((int(lengths[i]), int(used[i]), int(used[i]) + per * times, sequence, per, slot))
            used[i] += per * times
            slot += per
        left = left - counts * times
        sequence += times

    for counts, times in column_generation(lengths, left.astype(float), capacity):
        whole = int(min([times + 1e-9, *(left[counts > 0] // counts[counts > 0])]))
        if whole > 0:
            place(counts, whole)
    # What rounding left: fewer sequences than patterns, filled first-fit by falling length.
    room: list[int] = []
    inside: list[np.ndarray] = []
    for i in range(len(lengths) - 1, -1, -1):
        for _ in range(int(left[i])):
            at = next((k for k, r in enumerate(room) if r >= lengths[i]), None)
            if at is None:
                at = len(room)
                room.append(capacity)
                inside.append(np.zeros(len(lengths), np.int64))
            room[at] -= int(lengths[i])
            inside[at][i] += 1
    for counts in inside:
        place(counts, 1)
    return rows


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Each document's ids with ``end_id`` behind, cut after every ``capacity`` ids.

    Columns: doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers),
    doc_tokens. A null text is an empty one: one piece, the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part, texts in text_chunks(batch):
                ids, at = coder.encode(texts)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                size = np.diff(at) + 1
                begin = np.cumsum(size) - size
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(size[doc] - start, capacity)
                raw, first = memoryview(ids.tobytes()), begin[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                doc_id = part.column(0).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pack all documents; a row for each piece with its ``sequence_id`` and ``offset``.

    Repeated rows are packed as often as they come, a null doc_id as any other id. An empty table
    gives an empty result. Columns other than doc_id and text are left out.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, end_id), "pieces").withColumn("kind", F.ceil(F.col("length") / UNIT))
    total = cut.groupBy("kind").agg(F.count("*").alias("n")).collect()  # at most capacity / UNIT rows
    histogram = {int(r["kind"]): int(r["n"]) for r in total}
    rows = plan(histogram, capacity // UNIT)
    places = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "p_kind long, first_rank long, end_rank long, first_sequence long, per long, p_slot long")
    # Ranks: counted within salted parts of a class, so that no class is one task's work.
    salts = max(64, sum(histogram.values()) // 500_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("kind", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("kind", "salt", (F.sum("n").over(Window.partitionBy("kind").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("kind", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(before, ["kind", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    here = (F.col("kind") == F.col("p_kind")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    placed = ranked.join(F.broadcast(places), here)  # the plan's rows are bounded by the classes
    turn = F.col("rank") - F.col("first_rank")
    placed = placed.withColumn("sequence_id", (F.col("first_sequence") + F.floor(turn / F.col("per"))).cast("long")).withColumn("slot", F.col("p_slot") + F.pmod(turn, F.col("per")))
    upto = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (upto - F.col("length")).alias("offset"))
