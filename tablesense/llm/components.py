"""Connected components of a graph of links, by contraction in Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablesense.llm.common import are_few, settle


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it can reach.

    Each round every node hooks to the smallest of its neighbours, the hooks are followed to
    their ends (by doubling), and the links are rewritten between the roots so found; a round at
    least halves the roots of what still hangs together.  Each round is written to the shared folder.  A hub's
    links are combined before they are shuffled; its joins are plain, so AQE can split them.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    links = settle(links, "links")
    few = are_few(links)
    labels = None
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = settle(ends.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("root")), "hooks", few)
        rising = True
        while rising:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = settle(hook.join(up, "root").select("node", "root", "above"), "hooks", few)
            rising = not jumped.where("root <> above").isEmpty()
            hook = jumped.select("node", F.col("above").alias("root"))
        labels = hook if labels is None else settle(
            labels.join(hook.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
            .select("node", F.coalesce("above", "root").alias("root")), "labels", few)
        at_a, at_b = (hook.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        links = settle(
            links.join(at_a, "a").join(at_b, "b").where("root_a <> root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links", few)
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("root").alias("component"))
