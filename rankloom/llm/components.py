"""Connected components of a table of links, by hooking and shortcutting labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import run_folder, stored


def components(links: DataFrame) -> DataFrame:
    """Label every node of ``links`` (a, b) with the smallest node it can reach: node, label.

    Each round takes the smallest label among a node and its neighbours, hands it to the
    node that its old label names, and replaces labels by their labels. Rounds grow with
    the logarithm of a component's length. Only the number of changed labels comes to the
    driver. No links give no rows; repeated links and loops change nothing.
    """
    spark = links.sparkSession
    folder = run_folder(spark, "components")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where("a <> b").distinct(), f"{folder}/edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("label")), f"{folder}/0")
    rounds, changed = 0, not labels.isEmpty()
    while changed:
        rounds += 1
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low"))
        lowered = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "label", F.least("label", "low").alias("low"))
        hooks = lowered.select("node", "low").unionByName(lowered.select(F.col("label").alias("node"), "low"))
        hooked = stored(hooks.groupBy("node").agg(F.min("low").alias("low")), f"{folder}/{rounds}-hooked")
        above = hooked.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        shorter = hooked.join(above, "low").join(labels, "node").select(
            "node", F.col("lower").alias("label"), (F.col("lower") != F.col("label")).alias("moved"))
        shorter = stored(shorter, f"{folder}/{rounds}")
        changed = not shorter.where("moved").isEmpty()
        labels = shorter.select("node", "label")
    return labels
