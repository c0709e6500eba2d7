"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the least node of its component.

    In a round every node takes the least of itself and its neighbours, and that
    one's choice in turn; edges within a choice go, the others join choices, and
    equal ones become one.  So the rounds get smaller quickly, and their choices,
    applied one after another, give the labels.  All tables are stored; nothing
    is collected, and a node with very many edges is no task of its own.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while left.limit(1).count():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = stored(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "choice")
        above = one.select(F.col("node").alias("up"), F.col("up").alias("to"))
        two = stored(one.join(above, "up").select("node", F.col("to").alias("label")), "choice")
        dropped(one)
        rounds.append(two)
        from_a = left.join(two.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
        both = from_a.join(two.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
        fewer = stored(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        dropped(left)
        left = fewer
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[0]
    for choice in rounds[1:]:
        to = choice.select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = stored(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    return labels
