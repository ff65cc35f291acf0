"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.operators.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it can reach.

    Each round points every node at the first of its neighbours and itself, follows the pointers once and contracts the links to
    where they lead.  The first round goes by number, which folds links to hubs at once; later rounds go by a hash,
    which takes a share of any chain of links, so that the rounds grow with the logarithm of the nodes.
    """
    edges, named, turn = written(_contracted(links.select("a", "b"))), None, 0
    while not edges.isEmpty():
        order = (lambda c: F.xxhash64(c, F.lit(turn))) if turn else (lambda c: F.col(c))  # noqa: B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("n"))).alias("m"))
        to = first.select(F.col("a").alias("node"), F.least("m", F.struct(order("a").alias("o"), F.col("a").alias("n")))["n"].alias("to"))
        to = written(to.join(to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        for c in ("a", "b"):
            edges = edges.join(to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")), c)
        edges = written(_contracted(edges.select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))))
        # a node that a round makes a root keeps its name in later rounds that don't see it
        step = to.select(F.col("node").alias("root"), "to")
        named = to.select("node", F.col("to").alias("root")) if named is None else named.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        turn += 1
    if named is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    named = written(named)
    return named.join(named.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label")


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
