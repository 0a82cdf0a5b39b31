"""Exact repeated passages: what an index of texts finds is compared on the texts themselves.

Both deduplication by chunks and by suffixes end here. An index tells, for each window of ``min_words``
words, whether a part of it that depends on the window alone stands elsewhere too. Of windows with such
a part a digest is taken; every window that stands in two texts puts its text and the least that has it
in one pair. In a pair all common windows are looked up, each match is compared byte by byte, extended to
the left and right as far as it goes and cut to whole words.

A text is known by its row's doc_id and a digest of the text (``mark``), so rows that share an id keep
to their own texts. Rows with equal id and text count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import span_hashes, text_chunks, utf8, words_of, written

#: A passage counts when it has this many words: over 50.
MIN_WORDS = 51
#: Ids up to which a set of ids is broadcast (16 bytes each) rather than joined by a shuffle.
BROADCAST_IDS = 200_000
#: Texts that one task compares with one other text, about.
GROUP = 20_000
#: How texts are joined, at every size, so that small inputs tell of large ones.
JOIN = "merge"
_SPACES = frozenset(b" \t\n\r\x0b\x0c")
ROW = ["doc", "mark"]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the common prefix of two byte arrays."""
    n, at, step = min(len(a), len(b)), 0, 256
    while at < n:
        to = min(n, at + step)
        differ = a[at:to] != b[at:to]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, step * 2
    return n


def extend(a: bytes, b: bytes, at: int, other: int) -> tuple[int, int, int] | None:
    """The longest match of ``a`` and ``b`` that has ``a[at]`` on ``b[other]``, cut to whole words.

    Returns start and end in ``a`` and the number of words, or None if the bytes differ there.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    right = _common(x[at:], y[other:])
    left = _common(x[:at][::-1], y[:other][::-1])
    start, end, shift = at - left, at + right, other - at
    if start >= end:
        return None

    def inside_word(i: int) -> bool:
        """Whether either text has a word go on over the place before ``a[i]``."""
        return any(0 < k < len(t) and t[k - 1] not in _SPACES and t[k] not in _SPACES for t, k in ((a, i), (b, i + shift)))

    while start < end and inside_word(start):
        start += 1
        while start < end and a[start - 1] not in _SPACES:
            start += 1
    while end > start and inside_word(end):
        end -= 1
        while end > start and a[end] not in _SPACES:
            end -= 1
    while start < end and a[start] in _SPACES:
        start += 1
    while end > start and a[end - 1] in _SPACES:
        end -= 1
    words = len(a[start:end].split())
    return (start, end, words) if words else None


def rows_of(docs: DataFrame) -> DataFrame:
    """``doc``, ``mark`` and ``text`` of all rows that have an id and a text."""
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text")


def window_spans(texts: pa.StringArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of ``texts``, and of each window of ``width`` words its text, number in it, start and end."""
    buf, offsets = utf8(texts)
    starts, ends, before = words_of(buf, offsets)
    n = np.maximum(np.diff(before) - width + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    word = before[doc] + k
    return buf, doc, k, starts[word], ends[word + width - 1]


def least_in(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each range first..last of places the one with the least value, the rightmost of equal ones.

    Ranges have one place at least; each is looked up as two ranges of a power of two.
    """
    if not len(first):
        return np.zeros(0, np.int64)

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] <= values[a], b, a)

    level = np.frexp((last - first + 1).astype(float))[1] - 1
    out, best = np.empty(len(first), np.int64), np.arange(len(values))
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = better(best[first[at]], best[last[at] - (1 << k) + 1])
        if len(best) > 1 << k:
            best = better(best[: -(1 << k)], best[1 << k :])
    return out


def runs_of(chosen: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last indexes of runs of windows of one text for which the same is chosen."""
    first = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    return first, np.append(first[1:], len(chosen))[: len(first)] - 1


def run_table(doc: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray, part: pa.RecordBatch, texts: pa.StringArray, width: int) -> list[pa.Array]:
    """Columns doc, mark, key, first, last, span of runs of windows; ``span`` is a digest of all bytes of a run."""
    buf, offsets = utf8(texts)
    starts, ends, before = words_of(buf, offsets)
    span = span_hashes(buf, starts[before[doc] + first], ends[before[doc] + last + (width - 1)]) if len(doc) else np.zeros(0, np.uint64)
    own = pa.array(doc)
    return [part.column(0).take(own), part.column(1).take(own), pa.array(key.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(span.view(np.int64))]


RUN = ["doc", "mark", "key", "first", "last", "span"]
RUN_SCHEMA = "doc long, mark long, key long, first int, last int, span long"


class _Groups:
    """Rows in order, in groups of equal values of some columns: each row's first (doc, mark) of its group."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys
        self.last: tuple | None = None
        self.head = (0, 0)

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each row begins a group, and the doc and mark that its group begins with."""
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy()
        values = [column(k) for k in self.keys]
        begins = np.ones(batch.num_rows, bool)
        begins[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
        begins[0] = self.last != tuple(v[0] for v in values)
        at = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), -1))
        heads = [np.where(at >= 0, column(name)[at], own) for name, own in zip(ROW, self.head, strict=True)]
        self.last, self.head = tuple(v[-1] for v in values), (heads[0][-1], heads[1][-1])
        return begins, heads[0], heads[1]


def _with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs in the order of key, span and row those whose key a run next to them has (``sure``), and the
    first and last of all (``edge``), whose neighbours may be in other partitions.

    ``other`` and ``other_mark`` are the first text with equal bytes in the run; null for that one.
    """
    names = ["doc", "mark", "key", "first", "last", "other", "other_mark", "sure", "edge"]
    groups = _Groups(["key", "span"])
    held: pa.RecordBatch | None = None
    same_held, key_held, first_held = False, 0, False

    def out(rows: pa.RecordBatch, sure: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(sure), pa.array(edge)], names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        begins, doc, mark = groups.of(batch)
        rows = [batch.column(batch.schema.get_field_index(c)) for c in names[:5]]
        batch = pa.RecordBatch.from_arrays([*rows, pa.array(doc, mask=begins), pa.array(mark, mask=begins)], names[:7])
        key = rows[2].to_numpy()
        same = np.append(held is not None and key_held == key[0], key[1:] == key[:-1])
        if held is not None and (same_held or same[0] or first_held):
            yield out(held, np.array([same_held or bool(same[0])]), np.array([first_held]))
        sure, edge = same[:-1] | same[1:], np.zeros(n - 1, bool)
        if held is None and n > 1:
            edge[0] = True
        at = np.flatnonzero(sure | edge)
        if len(at):
            yield out(batch.take(pa.array(at)), sure[at], edge[at])
        # The last row waits for its next one.
        held, same_held, key_held, first_held = batch.slice(n - 1), bool(same[-1]), key[-1], held is None and n == 1
    if held is not None:
        yield out(held, np.array([same_held]), np.array([True]))


def shared_runs(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """Runs of windows (doc, mark, first, last, other, other_mark) whose key another run has, too.

    The runs (``RUN``, and columns that ``order`` begins with) are sorted over ranges and compared with their
    neighbours. Of runs with equal bytes ``other`` is null for the first of a range, and that first for the rest.
    """
    order = [*order, "key", "span", *ROW, "first"]
    sorted_ = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    schema = "doc long, mark long, key long, first int, last int, other long, other_mark long, sure boolean, edge boolean"
    near = written(sorted_.mapInArrow(_with_neighbours, schema), f"{tag}-runs")
    # A key of one run in each of two ranges: the two rows at the edges of each range are looked at.
    edges = near.where("edge AND NOT sure")
    across = near.where("edge").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return near.where("sure").unionByName(edges.join(F.broadcast(across), "key", "left_semi").select(*near.columns)).drop("key", "sure", "edge")


def _to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows in the order of digest and row: pairs of each text with the first that has the window.

    A range's first window, and the first text of its last one, come as rows of their own (``edge``).
    """
    names = ["doc", "mark", "other", "other_mark", "digest", "edge"]
    groups = _Groups(["digest"])
    seen = False
    doc = mark = np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        _, doc, mark = groups.of(batch)
        own = np.stack([*(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ROW), doc, mark], 1)
        pairs = np.unique(own[(own[:, 0] != own[:, 2]) | (own[:, 1] != own[:, 3])], axis=0)
        if not seen:
            seen, begin = True, batch.column(batch.schema.get_field_index("digest"))[0].as_py()
            pairs = np.append(pairs, own[:1], 0)
            yield pa.RecordBatch.from_arrays([*(pa.array(pairs[:, i]) for i in range(4)), pa.array(np.full(len(pairs), begin)), pa.array(np.arange(len(pairs)) == len(pairs) - 1)], names)
        elif len(pairs):
            yield pa.RecordBatch.from_arrays([*(pa.array(pairs[:, i]) for i in range(4)), pa.array(np.zeros(len(pairs), np.int64)), pa.array(np.zeros(len(pairs), bool))], names)
    if seen:
        row = [*groups.head, *groups.head, groups.last[0], True]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in row[:5]] + [pa.array([True])], names)


def window_pairs(windows: DataFrame, tag: str) -> DataFrame:
    """Pairs (doc, mark, other, other_mark) that put every text of a window (doc, mark, digest) with an earlier
    one that has it, but for the first."""
    order = ["digest", *ROW]
    sorted_ = windows.repartitionByRange(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    pairs = written(sorted_.mapInArrow(_to_first, "doc long, mark long, other long, other_mark long, digest long, edge boolean"), f"{tag}-met")
    # A window in several ranges: two rows of each range tell the first text of all.
    edges = pairs.where("edge").select("digest", *ROW)
    least = edges.groupBy("digest").agg(F.min(F.struct(*ROW)).alias("least")).select("digest", F.col("least.doc").alias("other"), F.col("least.mark").alias("other_mark"))
    over = edges.join(F.broadcast(least), "digest").select(*ROW, "other", "other_mark")
    names = [*ROW, "other", "other_mark"]
    return pairs.where("NOT edge").select(*names).unionByName(over).where("doc != other OR mark != other_mark")


def texts_of(docs: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """``doc``, ``mark`` and ``text`` of the rows in ``ids``, written; rows that come more than once come once."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = written(rows_of(docs).join(wanted, ROW, "left_semi"), f"{tag}-texts")
    if texts.groupBy(*ROW).count().where("count > 1").isEmpty():
        return texts
    return written(texts.groupBy(*ROW).agg(F.min("text").alias("text")), f"{tag}-texts-once")


def matches(docs: DataFrame, runs: DataFrame, width: int, tag: str) -> DataFrame:
    """All passages of ``width`` words or more that a text has in common with an earlier text that has one of
    their windows; looked at are the windows in ``runs`` (see :func:`shared_runs`).

    Runs with equal bytes have equal windows: their first text (in a range) stands for all others, each of which
    meets it, and only its windows are digested. Which earlier text a passage is found in may thus depend on where
    ranges are cut; which words are in passages, and which of them come later than in another text, doesn't. Returns doc, mark, start, end (bytes), n_words, other, other_mark,
    other_start for ``doc``'s side of each match. Of a passage that stands several times in a text, each
    place is in a match, but not all with each other.
    """
    alike = runs.where("other IS NOT NULL AND (doc != other OR mark != other_mark)").select(*ROW, "other", "other_mark")
    texts = texts_of(docs, written(runs.select(*ROW).distinct(), f"{tag}-ids"), tag)
    lists = runs.where("other IS NULL").groupBy(*ROW).agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # of one text

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in text_chunks(batch):
                buf, doc, k, start, end = window_spans(held, width)
                base = np.searchsorted(doc, np.arange(len(held) + 1))
                keep = np.zeros(len(doc) + 1, np.int64)
                places = part.column(2)
                owner = np.repeat(np.arange(len(held)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
                first, last = (places.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                np.add.at(keep, base[owner] + first, 1)
                np.add.at(keep, base[owner] + last + 1, -1)
                at = np.flatnonzero(np.cumsum(keep)[:-1] > 0)
                own = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(span_hashes(buf, start[at], end[at]).view(np.int64))], [*ROW, "digest"])

    windows = lists.join(texts.hint(JOIN), ROW).select(*ROW, "runs", "text").mapInArrow(digests, "doc long, mark long, digest long")
    return _compared(written(window_pairs(windows, tag).unionByName(alike).distinct(), f"{tag}-pairs"), texts, width, tag)


def _starts(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``a`` that lie alike in ``b``, each window on its first place there: first window
    in ``a``, that in ``b``, and windows in the run. ``order`` sorts ``b``, equal values by their places."""
    at = order[np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)]
    i = np.flatnonzero(b[at] == a)
    j = at[i]
    first = np.flatnonzero((np.diff(i, prepend=-2) != 1) | (np.diff(j, prepend=-2) != 1))
    return i[first], j[first], np.diff(np.append(first, len(i)))


class _Text:
    """A text with the digests of its windows and their places."""

    def __init__(self, text: str, digest: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.text, self.digest, self.start, self.end = text, digest, start, end
        self.order = np.argsort(digest, kind="stable")

    @classmethod
    def of(cls, texts: pa.StringArray, width: int) -> list[_Text]:
        buf, doc, _, start, end = window_spans(texts, width)
        digest = span_hashes(buf, start, end)
        cuts, base = np.searchsorted(doc, np.arange(len(texts) + 1)), utf8(texts)[1]
        return [cls(t, digest[x:y], start[x:y] - o, end[x:y] - o) for t, x, y, o in zip(texts.to_pylist(), cuts[:-1], cuts[1:], base[:-1], strict=True)]

    def common(self, other: _Text, min_words: int) -> Iterator[tuple[int, int, int, int]]:
        """Start, end, words and start in ``other`` of the passages both have."""
        if not len(self.digest) or not len(other.digest):
            return
        a, b = self.text.encode(), other.text.encode()
        i, j, n = _starts(self.digest, other.digest, other.order)
        j2, i2, n2 = _starts(other.digest, self.digest, self.order)
        i, j, n = np.append(i, i2), np.append(j, j2), np.append(n, n2) - 1
        done: list[tuple[int, int, int]] = []
        for s, e, t, u in zip(self.start[i].tolist(), self.end[i + n].tolist(), other.start[j].tolist(), other.end[j + n].tolist(), strict=True):
            # Both places of the run may be in matches already, if with other places (a run of one word).
            if any(p <= s and e <= q for p, q, _ in done) and any(p + d <= t and u <= q + d for p, q, d in done):
                continue
            found = extend(a, b, s, t)
            if found is not None and found[2] >= min_words:
                done.append((found[0], found[1], t - s))
                yield (*found, found[0] + t - s)


def _compared(pairs: DataFrame, texts: DataFrame, min_words: int, tag: str) -> DataFrame:
    """The passages that the pairs (doc, mark, other, other_mark) have in common.

    All texts that meet one other text come after it, in groups of about ``GROUP`` at most, so that a text
    met by many is sent once to each group and its windows are digested once.
    """
    salts = -(-pairs.count() // GROUP)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64(*ROW), F.lit(max(1, salts))))
    key = ["other", "other_mark", "salt"]
    # Only texts in pairs move: of all that share a part of a window about half have a whole one in common.
    ids = written(pairs.select(*ROW).distinct(), f"{tag}-met-ids")
    met = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ROW, "left_semi")
    whole = texts.select(F.col("doc").alias("other"), F.col("mark").alias("other_mark"), "text")
    heads = salted.select(*key).distinct().join(whole.hint(JOIN), ["other", "other_mark"]).select(*key, F.lit(0).alias("turn"), F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("mark"), "text")
    tails = salted.join(met.hint(JOIN), ROW).select(*key, F.lit(1).alias("turn"), *ROW, "text")
    dealt = heads.unionByName(tails).repartition(*key).sortWithinPartitions(*key, "turn")
    names = ["doc", "mark", "start", "end", "n_words", "other", "other_mark", "other_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = None
        for batch in batches:
            for part, held in text_chunks(batch):
                rows: list[tuple[int, ...]] = []
                columns = (part.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
                for other_doc, other_mark, turn, doc, mark, text in zip(*columns, _Text.of(held, min_words), strict=True):
                    if not turn:
                        other = text
                        continue
                    rows += [(doc, mark, s, e, n, other_doc, other_mark, t) for s, e, n, t in text.common(other, min_words)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(8)], names)

    return written(dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names)), f"{tag}-matches")


def occurrences(found: DataFrame) -> DataFrame:
    """Both sides of each match, one row for a span: doc_id, mark, start, end, n_words, other_id, other_start.

    ``other_id`` is null for a span that is in no earlier place of any match: it is the one to keep.
    "Earlier" is a smaller id; of rows with one id the smaller mark; in one text the smaller start.
    """
    here, there = F.struct("doc", "mark", "start"), F.struct(F.col("other").alias("doc"), F.col("other_mark").alias("mark"), F.col("other_start").alias("start"))
    length = F.col("end") - F.col("start")
    ours = found.select(F.col("doc").alias("doc_id"), "mark", "start", "end", "n_words", F.when(here > there, there).alias("source"))
    theirs = found.select(
        F.col("other").alias("doc_id"), F.col("other_mark").alias("mark"), F.col("other_start").alias("start"), (F.col("other_start") + length).alias("end"), "n_words",
        F.when(there > here, here).alias("source"),
    )
    both = ours.unionByName(theirs).groupBy("doc_id", "mark", "start", "end").agg(F.max("n_words").alias("n_words"), F.min("source").alias("source"))
    return both.select("doc_id", "mark", "start", "end", "n_words", F.col("source.doc").alias("other_id"), F.col("source.start").alias("other_start"))


def cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans (doc_id, mark, start, end: bytes of the UTF-8 text) taken out of ``text``.

    Each row loses spans of its own text alone. ``n_chars`` is set anew where the column is there. Rows
    without a span stay as they are.
    """
    cuts = spans.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__cuts"))  # of one text
    lists = written(cuts.withColumnsRenamed({"doc_id": "__cut_id", "mark": "__cut_mark"}), "cuts")
    names = docs.columns
    own = (docs["doc_id"].cast("long") == lists["__cut_id"]) & (F.xxhash64(docs["text"]) == lists["__cut_mark"])
    if lists.count() <= BROADCAST_IDS:
        # Only rows that lose something move; of no row both parts have it, as the ids are the same.
        ids = F.broadcast(lists.select("__cut_id", "__cut_mark"))
        cut = docs.join(ids, own, "left_semi")
        same = (cut["doc_id"].cast("long") == lists["__cut_id"]) & (F.xxhash64(cut["text"]) == lists["__cut_mark"])
        met = cut.join(lists.hint(JOIN), same).select(*[cut[c] for c in names], "__cuts")
        met = met.unionByName(docs.join(ids, own, "left_anti").select(*names, F.lit(None).cast(lists.schema["__cuts"].dataType).alias("__cuts")))
    else:
        met = docs.join(lists.hint(JOIN), own, "left").select(*[docs[c] for c in names], "__cuts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            texts = columns["text"].to_pylist()
            for i, cuts in enumerate(batch.column(len(names)).to_pylist()):
                if cuts and texts[i] is not None:
                    raw, at, kept = texts[i].encode(), 0, []
                    for cut in cuts:
                        kept.append(raw[at : max(at, cut["start"])])
                        at = max(at, cut["end"])
                    texts[i] = b"".join([*kept, raw[at:]]).decode().strip()
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return met.mapInArrow(run, schema)
