"""Connected components over a table of links, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): for each node of the links (a, b), the least node that it reaches.

    Each round gives a node the least label among its neighbours' and then the
    label of that label, so stars end in two rounds and chains in logarithmic
    ones. Every round's labels are a table in the shared folder. A node with
    very many links costs partial minima, not a group on one task.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).where("node <> other").distinct()
    both = stored(both, f"{name}-links")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("comp")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        least = labels.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = least.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        # the label of the label
        new = stored(least.join(up, "comp", "left").select("node", "was", F.least("comp", "up").alias("comp")), f"{name}-{k}")
        if new.where("comp <> was").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
