"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.scratch import materialize
from seamark.llm.skew import join_groups

#: Narrow rows that one task may take of a node or a label.
HOT_ROWS = 50_000
#: Rows of a table of two keys, some megabytes at most, that are broadcast and not shuffled.
FEW_ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``k``, ``lab``: every node of ``edges`` (``a``, ``b``) with the smallest node it reaches.

    Each round takes the smallest label among the neighbours, then the label
    of the label, until nothing changes. Neighbours are aggregated map-side;
    the rows of a node with a great part of the edges, or of a label with a
    great part of the nodes, stay where they are (``join_groups``). Labels of
    ``FEW_ROWS`` nodes at most are broadcast, so that a round of a small graph
    has one shuffle. Nothing is collected but counts.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    degrees = materialize(both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("c"), F.min("b").alias("m")), "cc-degrees")
    n_edges, n_nodes = both.count(), degrees.count()
    state = degrees.select(F.col("b").alias("k"), F.least("b", "m").alias("lab"), F.lit(None).cast("long").alias("was"))
    while n_nodes <= FEW_ROWS:
        held = F.broadcast(state.select(F.col("k").alias("b"), "lab"))
        near = both.join(held, "b").groupBy(F.col("a").alias("b")).agg(F.min("lab").alias("near"))
        lower = near.join(held, "b").select(F.col("b").alias("k"), F.col("lab").alias("was"), F.least("lab", "near").alias("b"))
        new = materialize(lower.join(held, "b").select("k", F.least("b", "lab").alias("lab"), "was"), "cc-labels")
        moved = new.where("lab <> was").count()
        state = new
        if not moved:
            return state.select("k", "lab")
    while True:
        labels = state.select(F.col("k").alias("b"), "lab").join(degrees.select("b", "c"), "b")
        near = join_groups(both, labels, ["b"], "c", n_edges, True, HOT_ROWS).groupBy(F.col("a").alias("k")).agg(F.min("lab").alias("near"))
        lower = state.select("k", F.col("lab").alias("was")).join(near, "k").select("k", "was", F.least("was", "near").alias("via"))
        # a label is a node itself: its own label may be lower still
        held = lower.groupBy("via").agg(F.count("*").alias("c")).join(state.select(F.col("k").alias("via"), F.col("lab").alias("next")), "via")
        new = materialize(join_groups(lower, held, ["via"], "c", n_nodes, True, HOT_ROWS).select("k", F.least("via", "next").alias("lab"), "was"), "cc-labels")
        moved = new.where("lab <> was").count()
        state = new
        if not moved:
            return state.select("k", "lab")
