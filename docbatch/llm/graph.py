"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.store import materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to rows (node, comp): comp is one number for all nodes that links connect.

    Each round takes the smallest label of the neighbours, then the label of the
    label; a hub's neighbours are reduced before the shuffle.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("near"))
        new = materialize(labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "near")
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = materialize(new.join(jump, "comp").select("node", "old", F.least("comp", "further").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            return labels
