"""Sparse Boolean matrices as distinct pairs (row, col) in a DataFrame, and their algebra.

Every operation is declarative but for closures, which come down to :mod:`.propagate`. Restrictions to
a row or a column are filters on the inputs, which Catalyst pushes to the scan. A relation is immutable:
transposing or copying one costs a projection or nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.session import delete, scratch

from .propagate import SCHEMA, closed, propagate


@dataclass(frozen=True)
class BoolMatrix:
    """``pairs`` has columns row and col (long) without repeats or nulls; ``dims`` are (height, width) if known."""

    pairs: DataFrame
    dims: tuple[int, int] | None = None
    path: str | None = None  # of a materialized relation

    # -- making -----------------------------------------------------------------------------------
    @classmethod
    def of(cls, pairs: DataFrame, dims: tuple[int, int] | None = None) -> BoolMatrix:
        """From a DataFrame with two columns (or more, with row and col among them); repeats collapse."""
        row, col = ("row", "col") if {"row", "col"} <= set(pairs.columns) else pairs.columns[:2]
        out = pairs.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"))
        return cls(out.where("row IS NOT NULL AND col IS NOT NULL").distinct(), dims)

    @classmethod
    def from_cells(cls, spark: SparkSession, cells: Iterable[tuple[int, int]], dims: tuple[int, int] | None = None) -> BoolMatrix:
        """From Python pairs."""
        return cls(spark.createDataFrame(sorted(set(cells)), SCHEMA), dims)

    @classmethod
    def empty(cls, spark: SparkSession, dims: tuple[int, int] | None = None) -> BoolMatrix:
        return cls(spark.createDataFrame([], SCHEMA), dims)

    @classmethod
    def one(cls, spark: SparkSession, row: int, col: int, dims: tuple[int, int] | None = None) -> BoolMatrix:
        """The matrix of a single cell."""
        return cls(spark.range(1).select(F.lit(row).cast("long").alias("row"), F.lit(col).cast("long").alias("col")), dims)

    @classmethod
    def identity(cls, nodes: DataFrame, dims: tuple[int, int] | None = None) -> BoolMatrix:
        """(x, x) for each x in the first column of ``nodes``, distinct."""
        node = F.col(nodes.columns[0]).cast("long")
        return cls(nodes.select(node.alias("row")).distinct().select("row", F.col("row").alias("col")), dims)

    # -- looking ----------------------------------------------------------------------------------
    @property
    def T(self) -> BoolMatrix:
        """The transpose."""
        dims = self.dims and (self.dims[1], self.dims[0])
        return BoolMatrix(self.pairs.select(F.col("col").alias("row"), F.col("row").alias("col")), dims)

    def copy(self) -> BoolMatrix:
        return self

    def count(self) -> int:
        """The number of cells that are set."""
        return self.pairs.count()

    def space(self) -> int:
        """Words that the cells take: what plans compare."""
        return 2 * self.count()

    def access(self, row: int, col: int) -> bool:
        """Whether a cell is set."""
        return not self.restrict(row, col).pairs.isEmpty()

    def collect(self, row_from: int | None = None, row_to: int | None = None, col_from: int | None = None, col_to: int | None = None) -> DataFrame:
        """The cells within inclusive bounds; None leaves a side open."""
        out = self.pairs
        for column, low, high in (("row", row_from, row_to), ("col", col_from, col_to)):
            if low is not None:
                out = out.where(F.col(column) >= low)
            if high is not None:
                out = out.where(F.col(column) <= high)
        return out

    def degree(self, row: int | None = None, col: int | None = None) -> int:
        """Cells in a row, a column, or both."""
        return self.restrict(row, col).count()

    def restrict(self, row: int | None = None, col: int | None = None) -> BoolMatrix:
        """Only the cells of a row and of a column."""
        out = self.pairs
        if row is not None:
            out = out.where(F.col("row") == F.lit(row).cast("long"))
        if col is not None:
            out = out.where(F.col("col") == F.lit(col).cast("long"))
        return replace(self, pairs=out, path=None)

    # -- sets -------------------------------------------------------------------------------------
    def _dims_with(self, other: BoolMatrix) -> tuple[int, int] | None:
        if self.dims is None or other.dims is None:
            return self.dims or other.dims
        return max(self.dims[0], other.dims[0]), max(self.dims[1], other.dims[1])

    def or_(self, *others: BoolMatrix, row: int | None = None, col: int | None = None) -> BoolMatrix:
        """The union of two or more: one union and one distinct."""
        out, dims = self.restrict(row, col).pairs, self.dims
        for other in others:
            out = out.unionByName(other.restrict(row, col).pairs)
            dims = BoolMatrix(out, dims)._dims_with(other)
        return BoolMatrix(out.distinct(), dims)

    sum = or_

    def and_(self, other: BoolMatrix, row: int | None = None, col: int | None = None) -> BoolMatrix:
        """Cells in both."""
        return BoolMatrix(self.restrict(row, col).pairs.join(other.restrict(row, col).pairs, ["row", "col"], "left_semi"), self._dims_with(other))

    def sub(self, other: BoolMatrix, row: int | None = None, col: int | None = None) -> BoolMatrix:
        """Cells in this one alone."""
        return BoolMatrix(self.restrict(row, col).pairs.join(other.restrict(row, col).pairs, ["row", "col"], "left_anti"), self._dims_with(other))

    def xor(self, other: BoolMatrix, row: int | None = None, col: int | None = None) -> BoolMatrix:
        """Cells in exactly one: counted in one aggregation over both."""
        both = self.restrict(row, col).pairs.unionByName(other.restrict(row, col).pairs)
        return BoolMatrix(both.groupBy("row", "col").agg(F.count("*").alias("n")).where("n = 1").select("row", "col"), self._dims_with(other))

    # -- products ---------------------------------------------------------------------------------
    def mult(self, other: BoolMatrix, row: int | None = None, col: int | None = None) -> BoolMatrix:
        """The Boolean product: (x, z) for which some y has (x, y) here and (y, z) there."""
        left, right = self.restrict(row).pairs, other.restrict(col=col).pairs
        left = left.select("row", F.col("col").alias("mid"))
        right = right.select(F.col("row").alias("mid"), "col")
        if row is not None and col is not None:  # one cell: any common middle is enough
            out = left.join(right, "mid").select("row", "col").limit(1)
        else:
            out = left.join(right, "mid").select("row", "col").distinct()
        return BoolMatrix(out, self.dims and other.dims and (self.dims[0], other.dims[1]))

    def mult_vector(self, vector: DataFrame, nodes: DataFrame) -> DataFrame:
        """W[r] = sum of V[c] over the cells (r, c), for every node (0 where there is none).

        ``vector`` has id and v; the result has the same columns, one row for each row of ``nodes``.
        """
        met = self.pairs.join(vector.select(F.col("id").alias("col"), "v"), "col")
        sums = met.groupBy(F.col("row").alias("id")).agg(F.sum("v").alias("v"))
        ids = nodes.select(F.col(nodes.columns[0]).cast("long").alias("id")).distinct()
        return ids.join(sums, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))

    def vector_mult(self, vector: DataFrame, nodes: DataFrame) -> DataFrame:
        """W[c] = sum of V[r] over the cells (r, c)."""
        return self.T.mult_vector(vector, nodes)

    # -- closures ---------------------------------------------------------------------------------
    def closure(self, reflexive: bool = False, nodes: DataFrame | None = None, row: int | None = None, col: int | None = None, strategy: str = "auto", deadline: float | None = None) -> BoolMatrix:
        """The transitive closure, or with ``reflexive`` the transitive and reflexive one over ``nodes``.

        With ``row`` or ``col`` only what the bound end reaches is searched; with both the search starts at
        the end with fewer cells and ends when it meets the other. A bound node belongs to the universe.
        """
        spark = self.pairs.sparkSession
        if row is None and col is None:
            if reflexive and nodes is None:
                raise ValueError("a reflexive closure needs the nodes")
            universe = BoolMatrix.identity(nodes).pairs.select("row").dropna() if reflexive else None
            return BoolMatrix(closed(self.pairs, strategy, deadline, universe), self.dims)
        if row is None:
            return self.T.closure(reflexive, nodes, row=col, strategy=strategy, deadline=deadline).T
        if col is not None and self.degree(col=col) < self.degree(row=row):
            return self.T.closure_from(col, row, reflexive, strategy, deadline).T
        return BoolMatrix(self.closure_from(row, col, reflexive, strategy, deadline).pairs, self.dims)

    def closure_from(self, row: int, col: int | None, reflexive: bool, strategy: str = "auto", deadline: float | None = None) -> BoolMatrix:
        """What ``row`` reaches, or whether it reaches ``col``."""
        seed = BoolMatrix.one(self.pairs.sparkSession, row, row).pairs
        out = propagate(seed, self.pairs, reflexive, target=col, strategy=strategy, deadline=deadline, single=True)
        return BoolMatrix(out, self.dims).restrict(col=col)

    def mult_closure(self, step: BoolMatrix, reflexive: bool, row: int | None = None, col: int | None = None, strategy: str = "auto", deadline: float | None = None, single: bool = False) -> BoolMatrix:
        """This times the closure of ``step``, which is searched only from where this one leads. ``single`` says
        that all its cells are in one row."""
        if row is None and col is not None:
            # From the column's side: what leads to it, then one product.
            reached = step.closure(True, row=None, col=col, strategy=strategy, deadline=deadline) if reflexive else step.closure(False, col=col, strategy=strategy, deadline=deadline)
            return self.mult(reached)
        seeds = self.restrict(row).pairs
        out = propagate(seeds, step.pairs, reflexive, target=col, strategy=strategy, deadline=deadline, single=single or row is not None)
        return BoolMatrix(out, self.dims).restrict(col=col)

    def closure_mult(self, other: BoolMatrix, reflexive: bool, row: int | None = None, col: int | None = None, strategy: str = "auto", deadline: float | None = None) -> BoolMatrix:
        """The closure of this times ``other``: the same from the other side."""
        return other.T.mult_closure(self.T, reflexive, row=col, col=row, strategy=strategy, deadline=deadline).T

    # -- storing ----------------------------------------------------------------------------------
    def save(self, path: str) -> None:
        """Write the cells as Parquet, sorted by row within files, so that row ranges skip row groups."""
        self.pairs.sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, dims: tuple[int, int] | None = None) -> BoolMatrix:
        return cls(spark.read.schema(SCHEMA).parquet(path), dims)

    def materialized(self) -> BoolMatrix:
        """The same cells, computed once and written to the shared folder."""
        path = scratch(self.pairs.sparkSession, "matrix")
        self.pairs.write.parquet(path)
        return replace(BoolMatrix.load(self.pairs.sparkSession, path, self.dims), path=path)

    def destroy(self) -> None:
        """Delete the table of a materialized relation; nothing that reads it can be used after that."""
        if self.path is not None:
            delete(self.pairs.sparkSession, self.path)
