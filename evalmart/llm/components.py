"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmart.llm.common import forget, kept


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) for every id in ``links`` (a, b).

    Each round takes the smallest label among the neighbours and then the label's own label, so the number of rounds grows
    with the logarithm of a chain's length. Sums per id are combined before the shuffle, so hubs are no hot groups.
    """
    both = kept(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    last = kept(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("label")))
    while True:
        labels = last.select("id", "label")
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        better = labels.join(near, "id").select("id", "label", F.least("label", "_near").alias("_new"))
        of_label = labels.select(F.col("id").alias("_new"), F.col("label").alias("_jump"))
        step = kept(better.join(of_label, "_new", "left").select("id", F.least("_new", "_jump").alias("label"), (F.least("_new", "_jump") < F.col("label")).alias("_moved")))
        forget(last)
        last = step
        if not step.filter("_moved").limit(1).count():
            forget(both)
            return step.select("id", "label")
