"""Connected components of an edge table, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.tables import forget
from passagemill.session import persist_table


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node in ``edges`` (``a``, ``b``: any orderable type).

    Every step of a round writes its table to the scratch folder, which cuts the lineage, and a round deletes those of the one before:
    a written table is read for a join by as many tasks as its files are worth, and its hot keys can be split, without dealing it out
    once more. Only whether a round is the last reaches the driver.
    """
    star = persist_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = persist_table(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")), "least")
        roots = least.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        # Where each node has larger neighbours only, or a single one, all edges lead to the smallest node of their component.
        if least.where("m < u AND m < top").isEmpty():
            forget(star)
            return roots
        large = persist_table(star.join(roots.withColumnsRenamed({"node": "v", "root": "m"}), "v").select("u", F.col("m").alias("v")), "large")
        below = persist_table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, star = star, persist_table(small.unionByName(below.withColumnRenamed("m", "v")).distinct(), "edges")
        forget(before, least, large, below)
