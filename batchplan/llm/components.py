"""Connected components: by alternating large-star and small-star steps on edge frames, or in one task if the edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchplan.llm.spark_io import freeing, settled


#: So many edges at most (some 20 MB) go through one task instead of some dozen shuffles.
FEW = 250_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(n):
            while root.setdefault(n, n) != n:
                root[n] = n = root[root[n]]
            return n

        schema = None
        for b in batches:
            schema = b.schema
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = find(u), find(v)
                root[max(u, v)] = min(u, v)
        if root:
            yield pa.RecordBatch.from_arrays([pa.array(list(root), schema.field(0).type), pa.array([find(n) for n in list(root)], schema.field(0).type)], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(freeing(join), f"node {kind}, root {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node of its component.

    Beyond FEW edges each step only takes minima over neighbours, so a node of very many edges is aggregated before the shuffle; edges stay in
    frames, and only their number and a checksum reach the driver. No edges give an empty result.
    """
    current = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if current.count() <= FEW:
        return _in_one_task(current)
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        current = settled(small.distinct())
        seen = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        if seen == mark:
            break
        mark = seen
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
