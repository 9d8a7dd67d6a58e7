"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``: the root is the smallest node that can be reached.

    Each round joins the links with the least neighbour of each node; a node with very many links has one
    row on the other side of that join, so its partition can be split.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.*").where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            roots = edges.groupBy("u").agg(F.min("v").alias("v"))
            return roots.unionByName(edges.select("v", "v").toDF("u", "v").distinct()).groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        mark = now
