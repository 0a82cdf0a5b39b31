"""Edge-labelled graphs: reading, checking, storing, and the figures that plans are made with."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.operators.relation import BoolMatrix
from pathweave.operators.search import Cells
from pathweave.session import delete, exists, open_output

#: Labels up to which statistics and dictionaries of labels come to the driver.
MOST_LABELS = 1_000_000
_NODES = "id long, term string"
_STATS = "p string, n_edges long, n_src long, n_dst long"


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """A text file of ``s p o`` integers, one triple a line, in decimal; malformed lines are an error."""
    reader = spark.read.schema("s long, p int, o long").option("sep", " ").option("mode", "FAILFAST")
    return reader.csv(path).distinct()


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A text file of ``id term`` lines; the term is all that follows the first space."""
    parts = F.split("value", " ", 2)
    return spark.read.text(path).where("value != ''").select(parts[0].cast("long").alias("id"), parts[1].alias("term"))


def check_predicates(triples: DataFrame, n_predicates: int) -> DataFrame:
    """``triples`` as they are, if all predicate ids are from 1 to ``n_predicates``; else an error."""
    odd = triples.where(~F.col("p").between(1, n_predicates)).limit(1).collect()
    if odd:
        raise ValueError(f"predicate id {odd[0]['p']} is not between 1 and {n_predicates}")
    return triples


def max_vertex(edges: DataFrame) -> DataFrame:
    """One row with the largest vertex id, as ``max_id`` (null for no edges)."""
    return edges.agg(F.max(F.greatest("s", "o")).alias("max_id"))


def label_stats(edges: DataFrame) -> DataFrame:
    """For each label p: n_edges, n_src and n_dst (distinct ends)."""
    return edges.groupBy("p").agg(F.count("*").alias("n_edges"), F.countDistinct("s").alias("n_src"), F.countDistinct("o").alias("n_dst"))


def write_partitioned(edges: DataFrame, path: str) -> None:
    """A folder for each label, so that a query reads only the labels in it.

    Rows are rebalanced by label: labels with few edges share a task, one with many gets several.
    """
    edges.hint("rebalance", "p").sortWithinPartitions("p", "s", "o").write.partitionBy("p").mode("overwrite").parquet(path)


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Binary files ``NNNN.pairs`` (or ``NNNN-K.pairs``) of little-endian unsigned 32-bit (s, o): columns s, p
    (the number NNNN in the name), o."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pairs").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p = int(path.rsplit("/", 1)[-1].removesuffix(".pairs").split("-")[0])
                cells = np.frombuffer(content.as_buffer(), "<u4").reshape(-1, 2).astype(np.int64)
                for i in range(0, len(cells), 1 << 18):
                    part = cells[i : i + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(np.full(len(part), p, np.int32)), pa.array(part[:, 1])], ["s", "p", "o"])

    return files.mapInArrow(run, "s long, p int, o long").distinct()


def write_pairs(triples: DataFrame, folder: str) -> None:
    """Binary files of little-endian unsigned 32-bit (s, o) from triples (s, p int, o): ``NNNN.pairs`` for
    predicate NNNN.

    Tasks write ranges of the sorted triples, so that a predicate with many is not one task's work; it then
    has further files ``NNNN-K.pairs`` that belong behind the first. Other files in the folder stay. Ids
    and predicates that don't fit are an error.
    """
    spark = triples.sparkSession
    odd = triples.where("NOT (s BETWEEN 0 AND 4294967295 AND o BETWEEN 0 AND 4294967295 AND p >= 0)").limit(1).collect()
    if odd:
        raise ValueError(f"not an unsigned 32-bit pair: {tuple(odd[0])}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        now, stream, done = None, None, []
        for batch in batches:
            s, p, o = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.diff(p, prepend=p[:1] - 1)) if len(p) else []
            for a, b in zip(cuts, [*cuts[1:], len(p)], strict=True):
                if p[a] != now:
                    if stream is not None:
                        stream.close()
                    now = int(p[a])
                    # A name of the try: one that failed leaves nothing that is taken for a result.
                    done.append((now, task.partitionId(), f"{folder}/_parts/{now}-{task.partitionId()}-{task.taskAttemptId()}"))
                    stream = open_output(done[-1][2])
                stream.write(np.stack([s[a:b], o[a:b]], 1).astype("<u4").tobytes())
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["p", "part", "file"])

    order = ["p", "s", "o"]
    dealt = triples.select("s", F.col("p").cast("int").alias("p"), "o").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    files = sorted((r["p"], r["part"], r["file"]) for r in dealt.mapInArrow(run, "p int, part int, file string").collect())  # a row for each file
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, (p, _, file) in enumerate(files):
        k = i - next(j for j in range(i, -1, -1) if j == 0 or files[j - 1][0] != p)
        target = path(f"{folder}/{p:04d}{f'-{k}' if k else ''}.pairs")
        system.delete(target, False)
        system.rename(path(file), target)
    system.delete(path(f"{folder}/_parts"), True)


@dataclass
class GraphStore:
    """``edges`` [s long, p string, o long] without repeats, and the universe ``nodes`` [id long, term string].

    Labels are strings; ``stats`` are collected on first use, or read where the graph was stored. ``terms`` are
    the nodes in the order of their terms, where the graph was stored. With ``plain`` a node's term is its id
    in decimal, and no table of terms is needed.
    """

    edges: DataFrame
    nodes: DataFrame
    terms: DataFrame | None = None
    stored_stats: DataFrame | None = None
    all_ends: bool = False
    plain: bool = False
    _stats: dict[str, tuple[int, int, int]] | None = field(default=None, repr=False)
    _cells: Cells | None = field(default=None, repr=False, compare=False)
    _ids: dict[str | int, int | None] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None) -> GraphStore:
        """From any DataFrame with s, p, o; without ``nodes`` the universe is all ends of edges."""
        edges = edges.select(F.col("s").cast("long").alias("s"), F.col("p").cast("string").alias("p"), F.col("o").cast("long").alias("o")).dropna().distinct()
        if nodes is None:
            return cls(edges, cls._ends(edges), all_ends=True, plain=True)
        if "term" not in nodes.columns:
            ids = nodes.select(F.col(nodes.columns[0]).cast("long").alias("id")).dropna().distinct()
            return cls(edges, ids.withColumn("term", F.col("id").cast("string")), plain=True)
        return cls(edges, nodes.select(F.col("id").cast("long").alias("id"), "term"))

    @staticmethod
    def _ends(edges: DataFrame) -> DataFrame:
        """All ends of edges as nodes."""
        ids = edges.select(F.explode(F.array("s", "o")).alias("id")).distinct()
        return ids.withColumn("term", F.col("id").cast("string"))

    @classmethod
    def from_files(cls, spark: SparkSession, triples: str, nodes: str | None = None, predicates: str | None = None) -> GraphStore:
        """From the three text files: triples, vertex dictionary and predicate dictionary."""
        edges = read_triples(spark, triples)
        label = F.col("p").cast("string")
        if predicates is not None:
            names = read_dictionary(spark, predicates).select(F.col("id").cast("int").alias("p"), F.regexp_replace("term", "^<|>$", "").alias("name"))
            edges = edges.join(names, "p").select("s", F.col("name").alias("p"), "o")
        else:
            edges = edges.select("s", label.alias("p"), "o")
        return cls.from_edges(edges, read_dictionary(spark, nodes) if nodes is not None else None)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def label(self, p: str) -> BoolMatrix:
        """The relation of one label: a filter that reaches the scan, and partition pruning where stored so."""
        return BoolMatrix(self.edges.where(F.col("p") == p).select(F.col("s").alias("row"), F.col("o").alias("col")))

    def identity(self) -> BoolMatrix:
        return BoolMatrix.identity(self.nodes.select("id"))

    def stats(self) -> dict[str, tuple[int, int, int]]:
        """Label → (edges, about how many sources, targets); one aggregation, a row for each label.

        What plans need; :func:`label_stats` has exact figures. Of a stored graph they are read.
        """
        if self._stats is None:
            table = self.stored_stats if self.stored_stats is not None else self._count(self.edges)
            rows = table.limit(MOST_LABELS + 1).collect()
            if len(rows) > MOST_LABELS:
                raise ValueError(f"the graph has more than {MOST_LABELS} labels")
            self._stats = {r["p"]: (r["n_edges"], r["n_src"], r["n_dst"]) for r in rows}
        return self._stats

    @staticmethod
    def _count(edges: DataFrame) -> DataFrame:
        counts = F.count("*").alias("n_edges"), F.approx_count_distinct("s").alias("n_src"), F.approx_count_distinct("o").alias("n_dst")
        return edges.groupBy("p").agg(*counts)

    def labels(self) -> set[str]:
        """The labels that edges have."""
        return set(self.stats())

    def cells(self, names: Iterable[str], most: int) -> Cells | None:
        """The edges of labels, read in one job and kept for the next query of the same labels (the last read ones
        only); None if they are more than ``most``."""
        names, stats = sorted(set(names)), self.stats()
        if sum(stats.get(name, (0, 0, 0))[0] for name in names) > most:
            return None
        if self._cells is None or not set(names) <= set(self._cells.cells):
            self._cells = None
            kind = F.array_position(F.array(*map(F.lit, names)), F.col("p")) - 1
            got = self.edges.where(F.col("p").isin(names)).select("s", "o", kind.cast("int").alias("kind")).toArrow()
            self._cells = Cells(names, *(got.column(i).to_numpy() for i in range(3)))
        return self._cells

    def node_id(self, term: str | int) -> int | None:
        """The id of a constant: an id, or a term with or without <>; None if the graph doesn't have it. A constant
        is looked up once."""
        if term not in self._ids:
            self._ids[term] = self._node_id(term)
        return self._ids[term]

    def _node_id(self, term: str | int) -> int | None:
        bare = term[1:-1] if isinstance(term, str) and term.startswith("<") and term.endswith(">") else term
        if isinstance(term, int):
            rows = self.nodes.where(F.col("id") == term)
        elif self.plain:
            number = int(bare) if re.fullmatch(r"0|-?[1-9]\d{0,18}", bare) else None
            if number is None or not -(1 << 63) <= number < 1 << 63:
                return None
            rows = self.nodes.where(F.col("id") == number)
        else:
            rows = (self.nodes if self.terms is None else self.terms).where(F.col("term").isin(term, bare, f"<{bare}>"))
        found = rows.select("id").limit(1).collect()
        return found[0]["id"] if found else None

    def save(self, path: str) -> None:
        """Edges in a folder for each label; nodes sorted by id and again by term, so that a constant is found
        in few row groups; the labels' figures beside them. Nodes are written while edges or figures are."""
        with ThreadPoolExecutor(1) as beside:
            save_nodes = inheritable_thread_target(self.spark)(self._save_nodes)
            waited = None if self.all_ends else beside.submit(save_nodes, self.nodes, path)
            write_partitioned(self.edges, f"{path}/edges")
            edges = self._stored_edges(self.spark, path)
            if waited is None:
                waited = beside.submit(save_nodes, self._ends(edges), path)
            self._count(edges).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")  # a row for each label
            waited.result()

    def _save_nodes(self, nodes: DataFrame, path: str) -> None:
        nodes = nodes.select("id") if self.plain else nodes
        nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
        delete(self.spark, f"{path}/terms")
        if not self.plain:
            nodes = self.spark.read.schema(_NODES).parquet(f"{path}/nodes")
            nodes.repartitionByRange("term", "id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def _stored_edges(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema("s long, o long, p string").option("basePath", f"{path}/edges").parquet(f"{path}/edges").select("s", "p", "o")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphStore:
        edges, stats = cls._stored_edges(spark, path), spark.read.schema(_STATS).parquet(f"{path}/stats")
        if not exists(spark, f"{path}/terms"):
            ids = spark.read.schema("id long").parquet(f"{path}/nodes")
            return cls(edges, ids.withColumn("term", F.col("id").cast("string")), stored_stats=stats, plain=True)
        nodes, terms = (spark.read.schema(_NODES).parquet(f"{path}/{name}") for name in ("nodes", "terms"))
        return cls(edges, nodes, terms, stats)
