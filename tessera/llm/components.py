"""Connected components of an edge table by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest vertex reachable from each vertex.

    edges: (a LONG, b LONG), undirected, any order, repeats allowed. Returns (v LONG, component LONG) for the
    vertices of the edges. Each round takes the least label among the neighbours, then that label's own label
    (pointer jumping), so the rounds grow with the logarithm of the longest path. Messages are reduced to one a
    vertex before the shuffle; a vertex with very many edges is a skewed join side, which adaptive execution splits.
    """
    pair = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    both = written(pair.select("u", "v").union(pair.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("component")), "labels")
    for _ in range(most_rounds):
        heard = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("component").alias("m"))
        nearer = labels.join(heard, "v").select("v", F.least("component", "m").alias("near"), F.col("component").alias("old"))
        jump = labels.select(F.col("v").alias("near"), F.col("component").alias("far"))
        step = written(nearer.join(jump, "near").select("v", F.least("near", "far").alias("component"), (F.least("near", "far") != F.col("old")).alias("moved")), "labels")
        labels = step.select("v", "component")
        if step.filter("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
