"""Connected components of an edge table by alternating min-label joins and pointer jumping, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node that can be reached.

    Each round hooks the label of every node under the smallest label next to it, then shortens label chains;
    a star or a chain of n nodes takes about log(n) rounds. Sums and minima are partial before each shuffle, so
    a node with very many links is no hot task.
    """
    both = links.select("a", "b").where("a <> b")
    both = work.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = work.save(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), f"{name}-0")
    k = 0
    while True:
        there = labels.select(F.col("node").alias("b"), F.col("label").alias("there"))
        near = both.join(there, "b").groupBy(F.col("a").alias("node")).agg(F.min("there").alias("near"))
        # one row for each label, written so that the joins with it are between plain tables, which Spark can split where skewed
        hook = labels.join(near, "node").groupBy(F.col("label").alias("root")).agg(F.min("near").alias("under"))
        hook = work.save(hook.select("root", F.least("root", "under").alias("under")), f"{name}-hook-{k}")
        above = hook.select(F.col("root").alias("under"), F.col("under").alias("top"))
        jump = hook.join(above, "under", "left").select(F.col("root").alias("label"), F.least("under", F.coalesce("top", "under")).alias("to"))
        out = labels.join(jump, "label").select("node", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("changed"))
        out = work.save(out, f"{name}-{k + 1}")
        work.drop(f"{name}-hook-{k}")
        labels, k = out.select("node", "label"), k + 1
        work.drop(f"{name}-{k - 1}")
        if not out.where("changed").limit(1).count():
            return labels
