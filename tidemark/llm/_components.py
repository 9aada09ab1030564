"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Steps


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of (a, b): component is the least id that can be reached.

    Each round takes the least label among the neighbours and then that label's own label, so
    labels travel twice as far every round. Nodes without an edge are not listed.
    """
    steps = Steps(edges.sparkSession, "components")
    one = edges.filter("a <> b").select("a", "b")
    both = steps.write(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = steps.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels-0")
    made = 0
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        made += 1
        next_ = steps.write(lower.join(jump, "via", "left").select("id", "old", F.least("via", "far").alias("label")), f"labels-{made}")
        steps.drop(f"labels-{made - 1}")
        if next_.filter("label <> old").isEmpty():
            steps.drop("edges")
            return next_.select("id", F.col("label").alias("component"))
        labels = next_.select("id", "label")
