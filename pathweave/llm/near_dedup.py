"""Near duplicates by an LSH forest of MinHash signatures.

A document is its set of word shingles. Documents with equal sets are one node from the start. A node
has ``TREES`` orders ("trees") of ``LABELS`` MinHash values each; in every order nodes are sorted by
their values, and nodes next to each other with a common prefix of two values or more are candidates.

1. Neighbours: in each order a node meets the two before it. The likeliest of them and a few others are
   confirmed on their full sets and contract the nodes into components, so that large groups of near
   copies are settled by a number of links in proportion to their size.
2. The rest: in each region of a common two-value prefix, nodes of different components are screened
   against each other by their signatures, wherever they stand in the order. A region with over
   ``REGION`` nodes is screened in tiles of about as many, in which all its nodes of different components
   meet. Nodes with a likely partner get their sets, and what reaches the threshold links the components;
   a tile gives out no more links than it has components.

A pair of similarity 0.8 shares a two-value prefix in one of 16 orders but with chance 1e-7, and the
screen (128 values, at least 88 equal) lets it pass with chance 0.999. Each link is confirmed with
``100 * intersection >= 80 * union`` on the full sets, as sets of 64-bit values made of the words' hashes by
two polynomials in random bases (see ``common.span_hashes``).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, mix64, span_hashes, text_chunks, utf8, words_of, written
from .components import components

TREES, LABELS = 16, 8
VALUES = TREES * LABELS
#: Nodes of a tile; a region of no more is one.
REGION = 4096
#: Shingles of a tile for each of its nodes, on average: regions of longer texts have more tiles, of fewer nodes.
PER_NODE = 512
#: Neighbours of a node, besides its likeliest, that are confirmed in the first step.
RANDOM_LINKS = 4
#: Ids up to which a set of ids is broadcast (8 bytes each) rather than joined by a shuffle.
BROADCAST_IDS = 200_000

_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.StringArray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    Words are runs of other than ASCII white space, with A-Z in lower case. A text of fewer words has
    one shingle, all of them; one without words has none.
    """
    buf, offsets = utf8(texts)
    buf = lower_ascii(buf)
    starts, ends, before = words_of(buf, offsets)
    h = span_hashes(buf, starts, ends)
    counts = np.diff(before)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for i in range(width):
            rolled = mix64(rolled * np.uint64(0x9E6C63D0876A9A47) + h[i : len(h) - width + 1 + i])
        out = []
        for at, n in zip(before[:-1].tolist(), counts.tolist(), strict=True):
            if n >= width:
                out.append(np.unique(rolled[at : at + n - width + 1]))
            elif n:
                acc = np.full(1, n, np.uint64)
                for i in range(n):
                    acc = mix64(acc * np.uint64(0x9E6C63D0876A9A47) + h[at + i : at + i + 1])
                out.append(acc)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of 64-bit hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        x = low[i : i + 2048, None] ^ _XOR
        x *= _ODD
        np.minimum(best, x.min(0), out=best)
    return best


def _signed(docs: DataFrame, width: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                sets = shingle_sets(texts, width)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                marks = np.zeros((len(sets), 2), np.uint64)
                with np.errstate(over="ignore"):
                    for i, s in enumerate(sets):
                        marks[i] = s.sum(dtype=np.uint64), mix64(s + np.uint64(0x51)).sum(dtype=np.uint64)
                signs = [signature(s).tobytes() if len(s) else None for s in sets]
                cols = [part.column(0), pa.array(sizes), pa.array(marks[:, 0].view(np.int64)), pa.array(marks[:, 1].view(np.int64)), pa.array(signs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_a", "set_b", "sign"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, sign binary")


def _signs(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sign")).to_pylist()), np.uint32).reshape(-1, VALUES)


def _regions(signs: np.ndarray) -> np.ndarray:
    """For each signature and tree the region: a hash of the tree and its first two values."""
    labels = signs.reshape(-1, TREES, LABELS).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(mix64(labels[:, :, 0] << np.uint64(32) | labels[:, :, 1]) + np.arange(TREES, dtype=np.uint64)[None, :])


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each signature a byte of every value, and the regions, both as bytes."""
    for batch in batches:
        signs = _signs(batch)
        low = np.ascontiguousarray(signs.view(np.uint8).reshape(len(signs), VALUES, 4)[:, :, 0])
        regions = _regions(signs)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([x.tobytes() for x in regions], pa.binary())], ["node", "n", "low", "regions"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and tree: the region (tree and first two values) and the other six in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        labels = _signs(batch).reshape(-1, TREES, LABELS).astype(np.uint64)
        region = _regions(_signs(batch))
        rest = [(labels[:, :, i] << np.uint64(32) | labels[:, :, i + 1]).ravel().view(np.int64) for i in (2, 4, 6)]
        node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), TREES)
        tree = np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)
        size = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), TREES)
        yield pa.RecordBatch.from_arrays([pa.array(region.ravel().view(np.int64)), *map(pa.array, rest), pa.array(node), pa.array(tree), pa.array(size)], ["region", "r1", "r2", "r3", "node", "tree", "size"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order: those that share their region with a row next to them, with the two nodes before.

    The first and last rows of a partition stay in any case, as their region may go on in the next.
    """
    tail: pa.Table | None = None
    first = True

    def out(table: pa.Table, skip: int, last: bool) -> pa.RecordBatch:
        region, node = table.column("region").to_numpy(), table.column("node").to_numpy()
        n = len(region)
        same1 = np.zeros(n, bool)
        same1[1:] = region[1:] == region[:-1]
        same2 = np.zeros(n, bool)
        same2[2:] = region[2:] == region[:-2]
        keep = same1.copy()
        keep[:-1] |= same1[1:]
        if not skip:
            keep[0] = True
        if last:
            keep[-1] = True
        keep[:skip] = False
        keep[n - (0 if last else 1) :] = False
        at = np.flatnonzero(keep)
        p1 = pa.array(node[np.maximum(at - 1, 0)], mask=~same1[at])
        p2 = pa.array(node[np.maximum(at - 2, 0)], mask=~same2[at])
        return pa.RecordBatch.from_arrays([*(pa.array(table.column(c).to_numpy()[at]) for c in ("region", "r1", "r2", "r3", "node", "tree", "size")), p1, p2], ["region", "r1", "r2", "r3", "node", "tree", "size", "p1", "p2"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        # Three rows go over to the next batch: two to look back to, one that waits for its next row.
        whole = table if tail is None else pa.concat_tables([tail, table])
        skip = 0 if first else tail.num_rows - 1
        yield out(whole, skip, False)
        tail, first = whole.slice(max(0, whole.num_rows - 3)), False
    if tail is not None:
        # The last row has not been given out yet.
        n = tail.num_rows
        yield out(tail, n - 1, True)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the values of two signatures (or of one and many), taken by a byte of each, are equal."""
    return (a == b).sum(-1, dtype=np.int16)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    """A column of equally long binary values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, str]) -> Iterator[pa.Table]:
    """Rows of each run of equal keys together; runs are of bounded size."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys)
        cuts = [0, *(1 + np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]))).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and (x[a], y[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = (x[a], y[a])
    if held:
        yield pa.Table.from_batches(held)


def _likely(table: pa.Table, least: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a region (i, and all j > i) in different components whose sizes and signatures leave the
    threshold possible. A pair counts only in the first tree it shares a region in."""
    part, n, tree = (table.column(c).to_numpy() for c in ("part", "n", "tree"))
    low = _matrix(table.column("low"), np.uint8, VALUES)
    regions = _matrix(table.column("regions"), np.uint64, TREES)
    for i in range(len(part) - 1):
        js = i + 1 + np.flatnonzero((part[i + 1 :] != part[i]) & (np.minimum(n[i + 1 :], n[i]) * 100 >= np.maximum(n[i + 1 :], n[i]) * percent))
        if len(js) and tree[i]:
            js = js[~(regions[js, : tree[i]] == regions[i, : tree[i]]).any(1)]
        if len(js):
            js = js[_agreement(low[i], low[js]) >= least]
            if len(js):
                yield i, js


def _shared_counts(sets: list[np.ndarray]):
    """A function (i, js) -> sizes of the intersections of set i with the sets js.

    Sets become rows of bits over their common vocabulary where that takes little memory.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    words, code = np.unique(np.concatenate(sets), return_inverse=True)
    width = -(-len(words) // 64)
    if width * 8 * len(sets) > 64_000_000:
        return lambda i, js: np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in js), np.int64, len(js))
    bits = np.zeros((len(sets), width), np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    np.bitwise_or.at(bits, (owner, code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
    return lambda i, js: np.bitwise_count(bits[js] & bits[i]).sum(1, dtype=np.int64)


def tiles(rows: DataFrame) -> DataFrame:
    """The rows (region, node, part, ...) of regions with several parts, with a ``block`` for each tile they are in.

    Two nodes of different parts of a region meet in a tile at least. A region of up to ``REGION`` rows, and
    ``PER_NODE`` times as many shingles (column size, where there is one), is one tile. In others the nodes of the
    commonest part, which need not meet each other, and all others are dealt into blocks of half a tile each; a
    block of the others meets every block.
    """
    size = F.col("size") if "size" in rows.columns else F.lit(0)
    sizes = rows.groupBy("region", "part").agg(F.count("*").alias("n"), F.sum(size).alias("w")).groupBy("region").agg(F.sum("n").alias("rows"), F.sum("w").alias("weight"), F.max(F.struct("n", "part", "w")).alias("most")).where("most.n < rows")
    own_share = lambda n, w: F.greatest(n, F.ceil(w / F.lit(PER_NODE)))
    sizes = sizes.select("region", F.col("most.part").alias("major"), own_share(F.col("rows"), F.col("weight")).alias("rows"), own_share(F.col("most.n"), F.col("most.w")).alias("n_major"), own_share(F.col("rows") - F.col("most.n"), F.col("weight") - F.col("most.w")).alias("n_few"))
    met = rows.join(written(sizes, "mixed"), "region")
    blocks = lambda n: F.ceil(n / F.lit(max(1, REGION // 2))).cast("long")
    met = met.withColumn("few", blocks(F.col("n_few"))).withColumn("many", blocks(F.col("n_major")))
    mine = F.col("part") == F.col("major")
    own = F.pmod(F.xxhash64("node"), F.when(mine, F.col("many")).otherwise(F.col("few"))) + F.when(mine, F.col("few")).otherwise(F.lit(0))
    meets = F.sequence(F.lit(0).cast("long"), F.col("few") + F.when(mine, F.lit(0)).otherwise(F.col("many")) - 1)
    met = met.withColumn("own", own).withColumn("meets", F.explode(F.when(F.col("rows") <= REGION, F.array(F.lit(-1).cast("long"))).otherwise(meets)))
    met = met.where("meets != own").withColumn("block", F.when(F.col("meets") < 0, F.lit(0)).otherwise(F.shiftleft(F.least("own", "meets"), 31).bitwiseOR(F.greatest("own", "meets"))).cast("long"))
    return met.drop("rows", "major", "n_major", "n_few", "few", "many", "own", "meets")


class NearDuplicates:
    """The job for one table of documents; :func:`near_duplicates` is the way in."""

    def __init__(self, docs: DataFrame, width: int, percent: int) -> None:
        self.docs, self.width, self.percent = docs, width, percent
        self.spark = docs.sparkSession
        j = percent / 100
        self.least = int(VALUES * (j - 3.1 * np.sqrt(j * (1 - j) / VALUES)))

    def screened(self, pairs: DataFrame, signs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose signatures and set sizes leave the threshold possible, with ``equal``."""
        left = signs.select(F.col("node").alias("a"), F.col("low").alias("low_a"), F.col("n").alias("n_a"))
        right = signs.select(F.col("node").alias("b"), F.col("low").alias("low_b"), F.col("n").alias("n_b"))
        met = pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                equal = _agreement(_matrix(batch.column(2), np.uint8, VALUES), _matrix(batch.column(3), np.uint8, VALUES))
                at = np.flatnonzero(equal >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(equal[at].astype(np.int32))], ["a", "b", "equal"])

        return met.select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long, equal int")

    def texts_of(self, ids: DataFrame, tag: str) -> DataFrame:
        """``node`` and ``text`` of the documents with these ids, written."""
        wanted = ids.select(F.col("node").alias("doc_id")).distinct()
        if ids.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        return written(self.docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), tag)

    def confirmed(self, pairs: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
        """The pairs that reach the threshold on their full sets."""
        width, percent = self.width, self.percent
        met = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        met = met.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: OrderedDict[int, np.ndarray] = OrderedDict()

            def of(ids: list[int], texts: pa.StringArray) -> list[np.ndarray]:
                marks = [hash((i, t)) for i, t in zip(ids, texts.to_pylist(), strict=True)]
                new = [k for k, m in enumerate(marks) if m not in known]
                here = dict(zip([marks[k] for k in new], shingle_sets(texts.take(pa.array(new, pa.int64())), width), strict=True)) if new else {}
                got = [here[m] if m in here else known[m] for m in marks]
                known.update(here)
                while len(known) > 256:
                    known.popitem(last=False)
                return got

            for batch in batches:
                for part, text_b in text_chunks(batch, "text_b", 500_000):
                    text_a = part.column(part.schema.get_field_index("text_a")).cast(pa.string())
                    ids_a, ids_b = part.column(0).to_pylist(), part.column(1).to_pylist()
                    keep = []
                    for k, (x, y) in enumerate(zip(of(ids_a, text_a), of(ids_b, text_b), strict=True)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if both and 100 * both >= percent * (len(x) + len(y) - both):
                            keep.append(k)
                    at = pa.array(keep, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], ["a", "b"])

        return written(met.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), tag)

    def cross_links(self, members: DataFrame, parts: DataFrame, signs: DataFrame) -> DataFrame:
        """Links between components (a, b) that nodes in a common region make, confirmed on full sets."""
        rows = members.select("region", "tree", "node", "size").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        rows = tiles(rows).select("region", "block", "tree", "node", "part").join(signs, "node")
        least, percent, width = self.least, self.percent, self.width
        columns = ["region", "block", "tree", "node", "part", "n", "low", "regions"]

        def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The rows that have a likely partner in their region."""
            for table in _blocks(batches, ("region", "block")):
                found = np.zeros(table.num_rows, bool)
                for i, js in _likely(table, least, percent):
                    found[i] = True
                    found[js] = True
                if found.any():
                    yield from table.filter(pa.array(found)).combine_chunks().to_batches()

        dealt = rows.select(*columns).repartition("region", "block").sortWithinPartitions("region", "block")
        likely = written(dealt.mapInArrow(involved, "region long, block long, tree int, node long, part long, n long, low binary, regions binary"), "likely")
        texts = self.texts_of(likely.select("node").distinct(), "likely-texts")

        def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Links that join components within a region: no more than it has components."""
            for table in _blocks(batches, ("region", "block")):
                part = table.column("part").to_numpy()
                sets = []
                for chunk in table.to_batches():
                    for _, texts in text_chunks(chunk):
                        sets += shingle_sets(texts, width)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                shared = _shared_counts(sets)
                _, group = np.unique(part, return_inverse=True)
                made: list[tuple[int, int]] = []
                for i, js in _likely(table, least, percent):
                    js = js[group[js] != group[i]]
                    if not len(js):
                        continue
                    both = shared(i, js)
                    for j in js[100 * both >= percent * (size[i] + size[js] - both)]:
                        if group[j] != group[i]:
                            made.append((part[i], part[j]))
                            group[group == group[j]] = group[i]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], ["a", "b"])

        met = likely.join(texts, "node").select(*columns, "text").repartition("region", "block").sortWithinPartitions("region", "block")
        return written(met.mapInArrow(links, "a long, b long"), "cross-links")

    def run(self) -> DataFrame:
        signed = written(_signed(self.docs, self.width), "signed")
        kind = signed.schema["doc_id"].dataType
        ids = signed.withColumn("id", F.col("doc_id").cast("long"))
        groups = ids.where("n_shingles > 0 AND id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("sign").alias("sign"))
        nodes = written(groups, "nodes")
        order = ["region", "r1", "r2", "r3", "node"]
        rows = nodes.select("node", "n", "sign").mapInArrow(_orders, "region long, r1 long, r2 long, r3 long, node long, tree int, size long")
        rows = rows.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        members = written(rows.mapInArrow(_neighbours, "region long, r1 long, r2 long, r3 long, node long, tree int, size long, p1 long, p2 long"), "members")
        signs = nodes.select("node", "n", "sign").mapInArrow(_compact, "node long, n long, low binary, regions binary")

        near = members.select("node", F.explode(F.array("p1", "p2")).alias("p")).where("p IS NOT NULL AND p != node")
        pairs = written(self.screened(near.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), signs), "screened")
        texts = self.texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "texts")
        # Each node's likeliest neighbour first, and a few others taken by hashes: likeliest ones alone make
        # many small clusters of a large group, some random ones more join them into one.
        pair = F.struct("a", "b")
        ends = pairs.select(F.col("a").alias("node"), "equal", pair.alias("pair")).unionByName(pairs.select(F.col("b").alias("node"), "equal", pair.alias("pair")))
        likeliest = F.max(F.struct("equal", "pair"))["pair"]
        others = [F.min(F.struct(F.xxhash64("pair", F.lit(i)).alias("h"), "pair"))["pair"] for i in range(RANDOM_LINKS)]
        best = ends.groupBy("node").agg(F.array(likeliest, *others).alias("some")).select(F.explode("some").alias("pair")).select("pair.a", "pair.b").distinct()
        links = self.confirmed(best, texts, "links")
        parts = written(components(links), "parts")

        # All others, as far as the first links did not join their components.
        again = self.cross_links(members, parts.withColumnRenamed("id", "node"), signs)
        upper = written(components(again), "upper")

        lower = nodes.select("set_a", "set_b", "node").join(parts, F.col("node") == F.col("id"), "left").select("set_a", "set_b", F.coalesce("component", "node").alias("part"))
        final = lower.join(upper, F.col("part") == F.col("id"), "left").select("set_a", "set_b", F.coalesce("component", "part").alias("component"))
        final = written(final, "components")
        linked = ids.where("n_shingles > 0").join(final, ["set_a", "set_b"], "left").select("doc_id", "id", "n_shingles", "component")
        alone = ids.where("n_shingles = 0").select("doc_id", "id", "n_shingles", F.lit(None).cast("long").alias("component"))
        out = linked.unionByName(alone)
        own = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
        return out.select("doc_id", "n_shingles", own.cast(kind).alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept (doc_id =
    component_id). Texts without words have no shingle and are linked with nothing. Rows that share a
    doc_id count as one document: a link of any of them is a link of all. A row without doc_id has no
    component and is kept. Columns other than doc_id and text are not looked at.
    """
    return NearDuplicates(docs, width, percent).run()
