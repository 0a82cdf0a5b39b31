"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter bank holds all languages: every slot is a machine word with a bit for each language, so
that the slots of an n-gram, combined by AND, give the mask of all languages that contain it. A text
counts, for each language, how many of its n-grams carry the language's bit; the expected number of
false positives is taken off, and the largest corrected share decides.

Learning reads about ``max_texts`` texts of each language at most (a documented bound on what is learned
from, not on what is scored) and keeps an n-gram for a language unless another one has it many times
as often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chance, held_out, mix64, text_chunks

#: Characters in an n-gram; letters only, with one space for each stretch of other characters.
N = 4
UNDETERMINED = "und"
#: Languages that a filter bank may have: a bit each.
MOST_LANGUAGES = 10_000


def _letter_table() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a space."""
    global _TABLE
    if _TABLE is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE = table
    return _TABLE


_TABLE: np.ndarray | None = None


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the text each belongs to, and the number of letters of each text.

    Only n-grams of a text with a letter are given, and a text is taken with a space before it.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    chars = _letter_table()[points]
    letter = chars != 32
    letters = np.bincount(doc[letter], minlength=len(texts))
    # One space for each stretch of other characters, and one before every text.
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~new[1:]
    chars, doc, new = chars[keep], doc[keep], np.flatnonzero(np.diff(doc[keep], prepend=-1))
    chars, doc = np.insert(chars, new, 32), np.insert(doc, new, doc[new])
    # The end: one space more, and no n-gram over it belongs to two texts.
    chars = np.append(chars, np.full(N, 32, np.uint32)).astype(np.uint64)
    doc = np.append(doc, -1 - np.arange(N, dtype=np.int32))
    with np.errstate(over="ignore"):
        h = np.zeros(len(chars) - N + 1, np.uint64)
        for i in range(N):
            h = h * np.uint64(0x100000001B3) + chars[i : len(chars) - N + 1 + i]
    same = doc[: len(h)] == doc[N - 1 :]
    return mix64(h[same]), doc[: len(h)][same], letters


@dataclass
class LanguageFilters:
    """The filter bank: ``slots`` has a mask of languages, ``rates`` their false positive rates."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    rates: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram hash the masks of languages whose filter has it (a row of words)."""
        m = np.uint64(len(self.slots) - 1)
        out = self.slots[(h & m).astype(np.int64)]
        step = (h >> np.uint64(32)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for _ in range(self.hashes - 1):
                h = h + step
                out = out & self.slots[(h & m).astype(np.int64)]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, corrected share of the best language, and number of n-grams for each text.

        The score is the winner's part of the corrected shares of the best two languages, times how
        much of the text its filter explains. A text without a letter is ``und`` with score 0.
        """
        h, doc, letters = grams(texts)
        n, k = len(texts), len(self.languages)
        masks = self.masks(h)
        total = np.maximum(np.bincount(doc, minlength=n), 1)
        hits = np.zeros((n, max(k, 1)))
        for i in range(k):
            bit = (masks[:, i // 8] >> np.uint8(i % 8)) & 1
            hits[:, i] = np.bincount(doc, weights=bit, minlength=n)
        share = np.clip((hits / total[:, None] - self.rates) / np.maximum(1 - self.rates, 1e-9), 0, 1)
        best = share.argmax(1)
        top = share[np.arange(n), best]
        second = np.partition(share, -2, axis=1)[:, -2] if k > 1 else np.zeros(n)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(top > 0, top * top / (top + second), 0.0)
        known = (letters > 0) & (k > 0)
        langs = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)]
        return langs, np.where(known, np.clip(score, 0, 1), 0.0), np.where(known, top, 0.0), np.bincount(doc, minlength=n)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each (language, n-gram) in the batches of one task."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang: str) -> pa.RecordBatch:
        h, c = sums.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    for batch in batches:
        for part, texts in text_chunks(batch):
            langs = np.array(part.column("lang").to_pylist())
            for lang in np.unique(langs):
                h, _, _ = grams([t for t, x in zip(texts.to_pylist(), langs, strict=True) if x == lang])
                old = sums.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                u, c = np.unique(h, return_counts=True)
                both, at = np.unique(np.concatenate([old[0], u]), return_inverse=True)
                sums[lang] = both, np.bincount(at, weights=np.concatenate([old[1], c])).astype(np.int64)
                if len(both) > 500_000:
                    yield out(lang)
    for lang in list(sums):
        yield out(lang)


def fit(docs: DataFrame, max_texts: int = 1500, bits_per_gram: int = 16, least_share: float = 0.03) -> LanguageFilters:
    """Learn the filters from ``text`` and ``lang`` of the rows outside the held-out fold.

    ``max_texts`` bounds the texts of one language that are read (in expectation: texts are drawn by a hash
    of their id). An n-gram is kept for a language if it makes up at least ``least_share`` of what it makes
    up where it is most frequent. Rows with a null text or language teach nothing; without any such row the
    filters are empty and every text is ``und``. More than ``MOST_LANGUAGES`` values of ``lang`` are an error.
    """
    docs = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return LanguageFilters([], np.zeros((1, 1), np.uint8), 1, np.zeros(1))
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))  # of equal shares the more frequent language wins
    rates = docs.sparkSession.createDataFrame([(lang, min(1.0, max_texts / n)) for lang, n in sizes.items()], "lang string, rate double")
    sample = docs.join(F.broadcast(rates), "lang").where(chance("doc_id", 11) < F.col("rate"))  # a row for each language
    counts = sample.select("text", "lang").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # An n-gram that another language has many times as often is a quotation or a wrong mark, and is not
    # taken for the language's own.
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("all")).alias("share"))
    most_of = F.max("share").over(Window.partitionBy("gram"))
    kept = shares.withColumn("most", most_of).where(F.col("share") >= F.lit(least_share) * F.col("most")).groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    # What comes here is the n-grams of the bounded sample, 8 bytes each.
    rows = kept.toArrow()
    got = {lang: grams_.values.to_numpy().view(np.uint64) for lang, grams_ in zip(rows.column("lang").to_pylist(), rows.column("grams").combine_chunks() if rows.num_rows else [], strict=True)}
    most = max((len(g) for g in got.values()), default=1)
    size = 1 << max(10, math.ceil(math.log2(max(1, most) * bits_per_gram)))
    filters = LanguageFilters(languages, np.zeros((size, (len(languages) + 7) // 8), np.uint8), 3, np.zeros(len(languages)))
    mask = np.uint64(size - 1)
    for i, lang in enumerate(languages):
        h = got.get(lang, np.zeros(0, np.uint64)).copy()
        step = (h >> np.uint64(32)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for _ in range(filters.hashes):
                at = (h & mask).astype(np.int64)
                filters.slots[at, i // 8] |= np.uint8(1 << (i % 8))
                h = h + step
        filters.rates[i] = ((filters.slots[:, i // 8] >> np.uint8(i % 8)) & 1).mean() ** filters.hashes
    return filters


def identify(docs: DataFrame, filters: LanguageFilters, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``known_share`` and ``n_grams`` to the columns ``keep`` of ``docs``.

    Every row is scored on its whole text. Null and empty texts, and texts without a letter, get
    ``und`` and 0. Repeated rows get equal results, an empty table an empty one; columns of the same names
    are replaced, others pass through. Of equal shares the language with more texts wins.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score", "known_share", "n_grams")]
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the sample: max_texts of each language
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double", "known_share double", "n_grams long"])
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in text_chunks(batch):
                langs, score, share, size = model.predict(texts.to_pylist())
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(score), pa.array(share), pa.array(size.astype(np.int64))], [*keep, "lang_pred", "score", "known_share", "n_grams"])

    return source.mapInArrow(run, schema)
