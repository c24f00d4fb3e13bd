"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch


def _scatter(x: Column) -> Column:
    """A bijection of longs without regard to order, so that chains of ids contract in few rounds."""
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id) for each node of an edge; component_id is the smallest node.

    In each round every node hooks to its least neighbour in a scattered order,
    pointers jump twice, and edges shrink to edges between roots; the rounds grow
    with the logarithm of the nodes. Only counts reach the driver.
    """
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    raw = scratch.save(ends.distinct())
    label = raw.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", _scatter(F.col("node")))
    label = scratch.save(label)
    live = scratch.save(raw.where("a <> b").select(_scatter(F.col("a")).alias("u"), _scatter(F.col("b")).alias("v")))
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        up = scratch.save(up)
        flat = up
        for _ in range(2):
            step = flat.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            flat = flat.join(step, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        flat = scratch.save(flat)
        moved = scratch.save(label.join(flat, label["at"] == flat["u"], "left").select("node", F.coalesce("p", "at").alias("at")))
        left = flat.select(F.col("u"), F.col("p").alias("pu"))
        right = flat.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        rest = live.join(left, "u").join(right, "v").where("pu <> pv")
        rest = scratch.save(rest.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        scratch.drop(up, flat, label, live)
        label, live = moved, rest
    least = label.groupBy("at").agg(F.min("node").alias("component_id"))
    out = scratch.save(label.join(least, "at").select("node", "component_id"))
    scratch.drop(label, live, raw)
    return out
