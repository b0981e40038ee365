"""Connected components of a table of links, as a table; nothing of the graph reaches the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dropped


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that links reach, for each node with a link.

    Nodes take the least label among their neighbours, then the label of their label, until nothing changes; the
    second step halves paths, so long chains need few rounds. Each round is checkpointed. A node with very many
    links is one key of a sort-merge join, which adaptive execution splits. The labels of the round before are deleted.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = checkpointed(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    label = held = checkpointed(edges.groupBy("u").agg(F.min("v").alias("l")).select("u", F.least("u", "l").alias("l")))
    while True:
        near = edges.join(label.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("n"))
        least = label.join(near, "u").select("u", "l", F.least("l", "n").alias("m"))
        up = label.select(F.col("u").alias("m"), F.col("l").alias("lm"))
        new = checkpointed(least.join(up, "m", "left").select("u", "l", F.least("m", F.coalesce("lm", "m")).alias("m")))
        dropped(held)
        label, held = new.select("u", F.col("m").alias("l")), new
        if new.where("l <> m").isEmpty():
            dropped(edges)
            return label.select(F.col("u").alias("node"), F.col("l").alias("root"))
