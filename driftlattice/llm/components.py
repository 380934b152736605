"""Connected components of a graph of links: joined within tasks first, then by least labels and pointer jumping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from driftlattice.llm.textbuf import checkpointed, forget


def stars(batches):
    """Each node of a task's edges and the least node that they join it to."""
    forget()
    of: dict = {}

    def root(x):
        while of[x] != x:
            of[x] = x = of[of[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = root(of.setdefault(x, x)), root(of.setdefault(y, y))
            of[max(x, y)] = min(x, y)
    if of:
        yield pa.RecordBatch.from_arrays([pa.array(list(of), kind), pa.array([root(x) for x in of], kind)], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 1 << 16) -> DataFrame:
    """(node, component): the least node of each node's component. Nodes without edges are left out; nulls are no nodes.

    Tasks of about `most` edges each join what they hold, so that an edge is left for each of its nodes. Where that took
    two tasks and more, each round takes the least label among neighbours, summed up per task before rows are dealt out,
    then follows labels twice; rounds grow with the logarithm of the longest chain of what is left.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    kind = edges.select("a").union(edges.select("b")).schema["a"].dataType
    edges = edges.select(F.col("a").cast(kind), F.col("b").cast(kind))
    tasks = max(1, -(-edges.count() // most))
    joined = checkpointed(edges.repartition(tasks).mapInArrow(stars, StructType([StructField("node", kind), StructField("component", kind)])))
    if tasks == 1:
        return joined
    edges = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a != b")
    both = checkpointed(edges.union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    labels = checkpointed(labels)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "least").alias("new"), F.col("component").alias("old"))
        to = new.select(F.col("node").alias("at"), F.col("new").alias("further"))
        new = checkpointed(new.join(to, F.col("new") == F.col("at")).select("node", F.col("further").alias("component"), (F.col("further") != F.col("old")).alias("moved")))
        labels = new.select("node", "component")
        if new.filter("moved").isEmpty():
            return labels
