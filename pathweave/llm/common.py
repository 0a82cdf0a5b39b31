"""Helpers the training-data operators share: tables, the shared folder, Arrow chunks, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.session import open_input, open_output, scratch, shared_dir, written  # noqa: F401  for the operators

#: Bytes of text that numpy code looks at in one go; one longer text is a chunk of its own.
CHUNK_BYTES = 1_000_000
#: Rows in one Arrow batch sent to a Python worker, and its bytes (and one row at most).
ARROW_ROWS, ARROW_BYTES = 512, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of ``sf_dir``, which may be any path that Spark reads."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a batch of long texts, or of pairs of them, stays a few megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def held_out() -> Column:
    """True for the fold that no model sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def chance(key: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key alone, in steps of 2**-53: as fine for the largest tables."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) * F.lit(2.0**-53)


def sampled(df: DataFrame, key: str, rate: float, seed: int) -> DataFrame:
    """About ``rate`` of the rows, the same ones on every run and in every partitioning."""
    if rate >= 1:
        return df
    return df.where(chance(key, seed) < F.lit(float(rate)))


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Slices of ``batch`` with at most ``limit`` bytes of text (or one row), nulls as empty texts."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def utf8(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets at which they start (one more than texts)."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shifts and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def is_ascii_space(buf: np.ndarray) -> np.ndarray:
    """Where a byte is one of the six ASCII white-space characters that end a word."""
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


#: The modulus of the span hash (a prime, 2**31 - 1) and two bases below it, drawn once at random.
_PRIME = (1 << 31) - 1
_BASES = tuple(int(x) for x in np.random.default_rng(31).integers(1 << 20, _PRIME, 2))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base`` modulo the prime."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), _PRIME)) % np.uint64(_PRIME)])
        if len(have) <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``buf``, equal for equal bytes wherever they stand.

    Two polynomials in random bases modulo a prime, 62 bits together: a difference of two spans of n bytes
    is a polynomial with at most n roots, so n of 2**31 bases at most make them meet, squared for two. (A
    modulus that is a power of two has texts that meet in every base.)
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    byte = buf.astype(np.uint64)
    byte += np.uint64(1)
    total = np.zeros(len(buf) + 1, np.uint64)
    parts = []
    for base in _BASES:
        np.multiply(byte, _powers(base, len(buf)), out=total[1:])  # below 2**40
        if len(buf) > 1 << 23:
            total %= np.uint64(_PRIME)  # so that the sums stay exact
        np.cumsum(total, out=total)
        down = _powers(pow(base, -1, _PRIME), len(buf) + 1)[starts]
        parts.append((total[ends] - total[starts]) % np.uint64(_PRIME) * down % np.uint64(_PRIME))
        total[0] = 0
    return mix64(parts[0] | parts[1] << np.uint64(31))


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and for each text the number of words before it.

    A word is a longest run of bytes that are not ASCII white space; it never crosses a text's end.
    """
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~is_ascii_space(buf)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """``buf`` with A-Z as a-z and all else as it is."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
