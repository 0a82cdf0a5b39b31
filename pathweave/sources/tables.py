"""Graphs derived from the relational tables: clicks of users one after the other, foreign keys, conversations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.session import written

from .graph import GraphStore

#: Tags of the foreign-key graph's ids, id = key * 8 + tag.
CUSTOMER, ORDER, PART, SUPPLIER, NATION, REGION = range(6)

#: Events up to which one task puts all in order; to sample and deal out ranges takes longer for so few.
FEW_EVENTS = 1_000_000


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (user, label, value) in order each with the next row's user (``kind`` 0); the last of the
    partition comes without (1), and one row more has the first user (2)."""
    part = TaskContext.get().partitionId()
    held: pa.Table | None = None

    def out(rows: pa.Table, to: pa.Array, kind: int) -> list[pa.RecordBatch]:
        n = rows.num_rows
        columns = [*(rows.column(i) for i in range(3)), to, pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, kind, np.int32))]
        return pa.Table.from_arrays(columns, ["s", "p", "value", "o", "part", "kind"]).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is None:
            yield from out(rows.slice(0, 1), pa.nulls(1, pa.int64()), 2)
        else:
            rows = pa.concat_tables([held, rows])
        held = rows.slice(rows.num_rows - 1)
        yield from out(rows.slice(0, rows.num_rows - 1), rows.column(0).slice(1), 0)
    if held is not None:
        yield from out(held, pa.nulls(1, pa.int64()), 1)


def _over_ranges(events: DataFrame) -> DataFrame:
    """Rows (s, p, value, o): each event's user, type and value, and the user of the next one, over ranges."""
    ordered = events.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id")
    rows = ordered.select("user_id", "event_type", "value").mapInArrow(_followed, "s long, p string, value double, o long, part int, kind int")
    rows = written(rows, "followed")
    over = F.lead("s").over(Window.orderBy("part")).alias("over")
    nexts = rows.where("kind = 2").select("part", over)  # a row for each range
    return rows.where("kind < 2").join(F.broadcast(nexts), "part").withColumn("o", F.when(F.col("kind") == 1, F.col("over")).otherwise(F.col("o")))


def events_graph(spark: SparkSession, sf_dir: str, least_value: float | None = None) -> GraphStore:
    """From each user to the user of the next event in time, labelled by the event's type.

    Up to FEW_EVENTS are one window. Beyond, events are dealt out by ranges of (ts, event_id); the last event of a
    range is followed by the first of the next range that has any, so that no task sees more than its range.
    ``least_value`` keeps only edges of events with a larger value.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    if events.count() <= FEW_EVENTS:
        edges = events.select(F.col("user_id").alias("s"), F.col("event_type").alias("p"), "value", F.lead("user_id").over(Window.orderBy("ts", "event_id")).alias("o"))
    else:
        edges = _over_ranges(events)
    if least_value is not None:
        edges = edges.where(F.col("value") > least_value)
    return GraphStore.from_edges(edges.select("s", "p", "o"), events.select("user_id"))


def _id(column: str, tag: int) -> F.Column:
    return F.col(column).cast("long") * 8 + tag


def keys_graph(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Customers, orders, parts, suppliers, nations and regions, by their foreign keys."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, orders, lineitem, supplier, nation = map(read, ("customer", "orders", "lineitem", "supplier", "nation"))

    def edge(df: DataFrame, s: str, tag_s: int, p: str, o: str, tag_o: int) -> DataFrame:
        return df.select(_id(s, tag_s).alias("s"), F.lit(p).alias("p"), _id(o, tag_o).alias("o"))

    edges = [
        edge(orders, "o_custkey", CUSTOMER, "places", "o_orderkey", ORDER),
        edge(lineitem, "l_orderkey", ORDER, "contains", "l_partkey", PART),
        edge(lineitem, "l_partkey", PART, "supplied_by", "l_suppkey", SUPPLIER),
        edge(customer, "c_custkey", CUSTOMER, "in_nation", "c_nationkey", NATION),
        edge(supplier, "s_suppkey", SUPPLIER, "in_nation", "s_nationkey", NATION),
        edge(nation, "n_nationkey", NATION, "in_region", "n_regionkey", REGION),
    ]
    whole = edges[0]
    for more in edges[1:]:
        whole = whole.unionByName(more)
    return GraphStore.from_edges(whole)


def turns_graph(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Each turn of a conversation to the next one, under ``next`` and under the speaker's role.

    A turn's id is conv_id * width + turn, where width is the largest turn and one.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    width = (turns.agg(F.max("turn").alias("most")).first()["most"] or 0) + 1
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn")).distinct()
    rows = turns.join(after, ["conv_id", "turn"], "left_semi")
    s = F.col("conv_id") * width + F.col("turn")
    edges = rows.select(s.alias("s"), F.lit("next").alias("p"), (s + 1).alias("o")).unionByName(rows.select(s.alias("s"), F.col("role").alias("p"), (s + 1).alias("o")))
    return GraphStore.from_edges(edges, turns.select(s.alias("id")))
