"""Connected components of a table of links, without gathering any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); label is the component's smallest node.

    Each round points every node at the smallest of itself and its neighbours, follows
    pointers once more, and replaces the links by those between what their ends point at.
    The links shrink from round to round, about by half for a chain and at once for a star.
    """
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        to = written(to, "pointers")
        next_ = to.select(F.col("node").alias("n2"), F.col("to").alias("to2"))
        to = written(to.join(next_, F.col("to") == F.col("n2")).select("node", F.col("to2").alias("to")), "jumped")
        left, right = to.select(F.col("node").alias("a"), F.col("to").alias("ta")), to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        links = written(links.join(left, "a").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct(), "links")
        moved = labels.join(to.select(F.col("node").alias("label"), "to"), "label", "left")
        labels = written(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
    return labels
