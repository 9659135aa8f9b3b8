"""Connected components by contraction with priorities drawn anew each round, so that a number of rounds logarithmic in the nodes is enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every node of edges (a, b: long); no node, no row.

    In each round every node goes to the node of least priority among itself and its neighbours, and on to where that one goes;
    edges are rewritten until none is left. Priorities are hashes of the id and the round, so whatever order ids have along a chain,
    a round leaves some two fifths of its nodes. The smallest id of what has come together is found at the end.

    A node with very many neighbours is one group of a partial minimum, and a hot join key, which adaptive joins split. Edges get
    fewer each round, as those within a contracted node vanish and equal ones become one. Each round is written to the shared
    folder, so that lineage stays short and lost executors cost no earlier rounds; at the end they are deleted. Loops and repeated edges do no harm; edges with a
    null end are left out; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    left = scratch.table(_tidy(edges.select("a", "b")))
    rounds: list[DataFrame] = []
    while not rounds or not left.isEmpty():
        rank = lambda c, nth=len(rounds): F.xxhash64(c, F.lit(nth))
        both = left.union(left.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("id")).agg(F.min_by("b", rank("b")).alias("near"))
        nearest = scratch.table(nearest.select("id", F.when(rank("near") < rank("id"), F.col("near")).otherwise(F.col("id")).alias("parent")))
        above = nearest.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
        rounds.append(scratch.table(nearest.join(above, "parent").select("id", F.col("root").alias("parent"))))
        one, other = rounds[-1].select(F.col("id").alias("a"), F.col("parent").alias("x")), rounds[-1].select(F.col("id").alias("b"), F.col("parent").alias("y"))
        left = scratch.table(_tidy(left.join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))))
    found = rounds[-1].select("id", F.col("parent").alias("top"))
    for mapping in reversed(rounds[:-1]):
        later = found.select(F.col("id").alias("parent"), "top")
        found = scratch.table(mapping.join(later, "parent", "left").select("id", F.coalesce("top", "parent").alias("top")))
    least = found.groupBy("top").agg(F.min("id").alias("component"))
    out = materialize(found.join(least, "top").select("id", "component"))
    scratch.clear()
    return out


def _tidy(edges: DataFrame) -> DataFrame:
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered.distinct()
