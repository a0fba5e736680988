"""Connected components of an edge table by minimum labels with pointer jumping.

Every round a node takes the smallest label among itself and its neighbours, then the label
of its label, so long chains shrink geometrically. A hub costs no more than its edges: minima
are combined before they are shuffled and joins on it can be split. Each round is staged;
only the number of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.llm.scratch import stage


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), any direction, repeats and loops allowed -> (node, component: its smallest node)."""
    both = stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "cc-edges")
    state = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(state, both.v == state.node).groupBy("u").agg(F.min("label").alias("m"))
        low = state.join(near, state.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # a label is a node of the same component, so its own label is at most as large
        up = state.select(F.col("node").alias("p"), F.col("label").alias("p_label"))
        nxt = low.join(up, low.label == up.p).select("node", "old", F.least("label", "p_label").alias("label"))
        nxt = stage(nxt, "cc-labels")
        state = nxt.select("node", "label")
        if nxt.where("label < old").isEmpty():
            return state.withColumnRenamed("label", "component")
