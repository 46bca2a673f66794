"""Connected components of links between ids, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scoped, small, written


@scoped
def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id in links (a, b).

    Each round an id takes the least label among its neighbours, then its label's label, so the
    number of rounds grows with the logarithm of the longest path. Labels are summed by id before
    they are shuffled, and tables between rounds are in the shared folder. Links are as they come:
    repeats, either direction and an id with itself are fine.
    """
    sides = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x")).select("x.*")
    both = written(sides.distinct())
    labels = written(both.groupBy("id").agg(F.least("id", F.min("other")).alias("component")))
    while True:
        known = small(labels)
        around = both.join(known.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("least"))
        lowered = around.join(known, "id").select("id", F.col("component").alias("before"), F.least("component", "least").alias("component"))
        roots = known.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = written(lowered.join(roots, "component").select("id", "before", F.least("component", "root").alias("component")))
        labels = jumped.select("id", "component")
        if jumped.where("component != before").isEmpty():
            return labels


@scoped
def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (id, component), or none yet, after further links (a, b).

    Only links between different components count, as links between those components' least ids,
    so what is joined already is not gone through again.
    """
    if labels is None:
        return components(links)
    known = small(labels)
    named = links
    for side in ("a", "b"):
        named = named.join(known.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    between = written(named.where("of_a != of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())
    if between.isEmpty():
        return labels
    step = components(between)
    moved = small(step).select(F.col("id").alias("component"), F.col("component").alias("moved"))
    renamed = labels.join(moved, "component", "left").select("id", F.coalesce("moved", "component").alias("component"))
    return renamed.unionByName(step.join(labels.select("id"), "id", "left_anti"))
