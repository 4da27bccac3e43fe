"""Connected components of a graph given as edges, by label spreading with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label: the smallest label of the component. ``edges``: a, b; ``labels``: node, label to start from.

    Each round gives every label the smallest label that touches it across an
    edge and then follows labels twice, so chains shorten by a factor, not by a
    step. Every round is written, and only the number of changes reaches the
    driver. A label that many nodes share is met through partial minima.
    """
    names, total = ["label", "to"], labels.count()
    while True:
        at = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias("l" + name))
        across = edges.join(at("a"), "a").join(at("b"), "b").filter("la <> lb").select("la", "lb")
        moves = (across.select(F.greatest("la", "lb").alias(names[0]), F.least("la", "lb").alias(names[1]))
                 .groupBy("label").agg(F.min("to").alias("to")))
        moves = written(moves, "moves")
        if moves.isEmpty():
            return labels
        jump = moves.alias("m").join(moves.select(F.col("label").alias("to"), F.col("to").alias("next")), "to", "left")
        jump = jump.select("label", F.coalesce("next", "to").alias("to"))
        # every label with its number of nodes, as one may come to hold a large share of them
        held = labels.groupBy("label").agg(F.count("*").alias("n")).join(jump, "label", "left")
        held = written(held.select("label", "n", F.coalesce("to", "label").alias("to")), "jumps")
        labels = written(lookup(labels, held, "label", "n", total).select("node", F.col("to").alias("label")), "labels")
