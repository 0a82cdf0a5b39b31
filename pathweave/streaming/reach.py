"""Reachability kept up to date under a stream of edges.

Each micro-batch of new edges adds to the transitive closure only the pairs that these edges make: the
closure's pairs that lead to a new edge, over the edge, and on along all edges known so far. A batch's
edges and pairs lie in folders of its number, which a repeated run of the batch writes anew from the
folders before it, so that the result is the same however often a batch is tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathweave.operators.propagate import propagate
from pathweave.operators.relation import BoolMatrix

_KIND = "row long, col long, batch long"


class ReachableStream:
    """The closure of a stream of edges (s, o), stored under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _stored(self, what: str, before: int | None = None) -> DataFrame:
        folder = f"{self.path}/{what}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], "row long, col long")
        rows = self.spark.read.schema(_KIND).parquet(folder)
        return (rows if before is None else rows.where(F.col("batch") < before)).select("row", "col")

    def pairs(self) -> DataFrame:
        """The closure so far: distinct pairs (s, o)."""
        return self._stored("pairs").select(F.col("row").alias("s"), F.col("col").alias("o"))

    def add(self, edges: DataFrame, batch: int) -> None:
        """Take in a batch of edges (s, o)."""
        known, before = self._stored("pairs", batch), self._stored("edges", batch)
        new = BoolMatrix.of(edges.select(F.col("s").alias("row"), F.col("o").alias("col"))).pairs
        new = new.join(before, ["row", "col"], "left_anti")
        new.write.mode("overwrite").parquet(f"{self.path}/edges/batch={batch}")
        new = self.spark.read.schema("row long, col long").parquet(f"{self.path}/edges/batch={batch}")
        ahead = new.select(F.col("row").alias("mid"), "col")
        leading = known.select("row", F.col("col").alias("mid")).join(ahead, "mid").select("row", "col")
        seeds = leading.unionByName(new)
        made = propagate(seeds, before.unionByName(new), True)
        made.join(known, ["row", "col"], "left_anti").write.mode("overwrite").parquet(f"{self.path}/pairs/batch={batch}")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Follow a streaming DataFrame with columns s and o."""
        writer = stream.writeStream.foreachBatch(lambda edges, batch: self.add(edges, batch))
        return writer.option("checkpointLocation", f"{self.path}/progress").trigger(**(trigger or {"availableNow": True})).start()
