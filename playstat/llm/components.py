"""Connected components by contraction.

Each round hooks every node to its smallest smaller neighbour, follows the hooks to
their ends, and replaces the nodes of all links by those ends. At least half of the
nodes that still have links vanish in a round, so the rounds are logarithmic. All
steps are joins on a unique key and partial aggregations; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playstat.llm.storage import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): its component's smallest node."""
    live = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .where("a < b").distinct(), "cc-links")
    label = None
    while not live.isEmpty():
        hook = materialise(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "cc-hooks")
        while True:
            nxt = hook.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
            longer = materialise(hook.join(nxt, F.col("to") == F.col("n2"), "left")
                                 .select("node", F.coalesce("t2", "to").alias("to"), F.col("t2").isNotNull().alias("moved")),
                                 "cc-jump")
            done = longer.where("moved").isEmpty()
            hook = longer.select("node", "to")
            if done:
                break
        if label is None:
            label = hook
        else:
            step = hook.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
            label = materialise(label.join(step, F.col("to") == F.col("n2"), "left")
                                .select("node", F.coalesce("t2", "to").alias("to"))
                                .unionByName(hook.join(label.select("node"), "node", "left_anti")), "cc-labels")
        ends = hook.select(F.col("node").alias("n"), F.col("to").alias("t"))
        moved = live.join(ends, F.col("a") == F.col("n"), "left").select(F.coalesce("t", "a").alias("a"), "b") \
            .join(ends, F.col("b") == F.col("n"), "left").select("a", F.coalesce("t", "b").alias("b"))
        live = materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                           .where("a < b").distinct(), "cc-links")
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    roots = label.select(F.col("to").alias("node")).distinct().withColumn("to", F.col("node"))
    return label.unionByName(roots).select("node", F.col("to").alias("component"))
