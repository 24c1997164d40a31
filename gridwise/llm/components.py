"""Connected components of a link table, in rounds of joins; no link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.shared import stored


def components(links: DataFrame) -> DataFrame:
    """`links` has longs `a` and `b`; returns `id` and `component`, the smallest id reachable, for every id that occurs.

    Each round every id takes the smallest label around it and then its label's label, so that long chains shrink
    by half a round; rounds end when no label changes.  Sums are taken before rows are dealt out, so an id with very many links does not
    fill a task.
    """
    both = links.filter("a IS NOT NULL AND b IS NOT NULL")
    both = stored(both.select("a", "b").union(both.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        around = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(around, labels.id == around.a).select("id", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("component").alias("further"))
        new = stored(nearer.join(jump, "label", "left").select("id", "old", F.least("label", "further").alias("component")), "labels")
        if new.filter("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
