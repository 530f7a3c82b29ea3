"""Connected components of a graph that is given as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweave.operators.hot_keys import hot_keys, look_up
from logweave.session import checkpointed, inner_tables, kept


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable. ``nodes`` (node), ``edges`` (a, b), in either direction.

    Each round every node looks at the grandparents of its neighbours, and both it and its parent move
    to the smallest; parents are shortened on the way, so rounds grow with the logarithm of a chain.
    Minima are formed before the shuffle and no neighbourhood is gathered. A parent that most nodes of a
    component share and a hub with very many edges are looked up in parts. Rounds end when nothing has
    moved; each is written as a table, and only the last stays.
    """
    spark = nodes.sparkSession
    with inner_tables(spark):
        both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
        hubs = hot_keys(both, ["b"])
        parents = checkpointed(nodes.select("node", F.col("node").alias("parent")).distinct())
        while True:
            with inner_tables(spark):
                above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
                grand = checkpointed(look_up(parents, above, ["parent"], F.col("node"), hot_keys(parents, ["parent"])).select("node", "parent", "grand"))
                near = grand.select(F.col("node").alias("b"), F.col("grand").alias("near"))
                seen = look_up(both, near, ["b"], F.col("a"), hubs).groupBy("a").agg(F.min("near").alias("near"))
                offers = seen.join(grand.select(F.col("node").alias("a"), "parent"), "a")
                moves = (
                    offers.select(F.col("parent").alias("node"), F.col("near").alias("parent"))
                    .unionByName(offers.select(F.col("a").alias("node"), F.col("near").alias("parent")))
                    .unionByName(grand.select("node", F.col("grand").alias("parent")))
                )
                moved = kept(moves.groupBy("node").agg(F.min("parent").alias("parent")))
            same = moved.join(parents.withColumnRenamed("parent", "before"), "node").filter("parent <> before").limit(1).count() == 0
            parents = moved
            if same:
                return kept(parents.select("node", F.col("parent").alias("root")))
