"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step's minima and edges are written to the shared folder before they are joined, so that both sides of
every join are plain exchanges whose hot keys Spark splits at run time, and no step repeats earlier ones. They end
when all edges are stars, which needs no step beyond the last one.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges: a, b (long); rows: how many, if known. node, component: every node of an edge and the smallest node that it reaches."""
    turned = freeze(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows=rows)
    while (state := _state(turned))[1]:
        n = state[0]
        both = turned.union(turned.select("b", "a"))
        least = freeze(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", rows=n)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = freeze(large, "large", rows=n)
        least = freeze(large.groupBy("a").agg(F.min("b").alias("m")), "least", rows=n)
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        turned = freeze(small.distinct(), "edges", rows=n)
    roots = turned.select(F.col("b").alias("node")).distinct()
    return turned.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple:
    """How many edges (from a larger to a smaller node, each once) there are, and how many nodes keep them from being stars: those with several smaller ones, or with smaller and larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.col("up") + F.col("down") * F.least("up", F.lit(1)) > 1)).first())


def spanning(n: int, a, b, labels=None):
    """Within a task: labels 0..n-1, the smallest of each connected set, after links a[i]-b[i] beside earlier labels."""
    import numpy as np

    labels = np.arange(n) if labels is None else labels
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]
