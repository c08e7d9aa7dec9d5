"""Connected components of a table of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import in_few_tasks
from listingloom.session import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``links`` (a, b).

    Each round takes the smallest root among a node's neighbours and then the root of that
    root, so distances halve. Neighbours are combined before the shuffle and never
    gathered; a round is written down before the next one reads it.
    """
    n = 2 * links.count()
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(in_few_tasks(both.filter("a <> b").distinct(), n), "edges")
    lowest = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    roots = stored(in_few_tasks(lowest.withColumnRenamed("a", "node"), n), "roots")
    while True:
        near = (
            edges.join(roots, edges.b == roots.node)
            .groupBy("a")
            .agg(F.min("root").alias("near"))
        )
        hooked = roots.join(near, roots.node == near.a).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        hooked = stored(in_few_tasks(hooked, n), "hooked")
        above = hooked.select(F.col("node").alias("up"), F.col("root").alias("above"))
        jumped = hooked.join(above, hooked.root == above.up).select(
            "node", "old", F.least("root", "above").alias("root")
        )
        made = stored(in_few_tasks(jumped, n), "roots")
        roots = made.select("node", "root")
        if made.filter("old <> root").isEmpty():
            return roots
