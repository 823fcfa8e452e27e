"""Connected components by hooking and pointer jumping, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.plans.scratch import materialized


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge components along links.

    ``labels`` (node, root): each node's component, named by its smallest node. ``links`` (a, b).
    Returns labels of the same kind. Each round hooks every root to its smallest neighbouring root
    and halves the chains until they are flat; a round at least halves the number of roots that
    still have links. Minima are combined on the map side; every step is written to shared space.
    """
    a, b = (labels.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    edges = materialized(_between(links.join(a, "a").join(b, "b"), "ra", "rb"))
    while not edges.isEmpty():
        parent = materialized(edges.groupBy(F.col("hi").alias("r")).agg(F.min("lo").alias("p")))
        while True:
            above = parent.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            if parent.join(above, "p", "left_semi").isEmpty():
                break
            parent = materialized(parent.join(above, "p", "left").select("r", F.coalesce("pp", "p").alias("p")))
        up = parent.select(F.col("r").alias("root"), "p")
        labels = materialized(labels.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        lo, hi = (parent.select(F.col("r").alias(x), F.col("p").alias(f"p_{x}")) for x in ("lo", "hi"))
        moved = edges.join(lo, "lo", "left").join(hi, "hi", "left")
        edges = materialized(_between(moved.select(F.coalesce("p_lo", "lo").alias("x"), F.coalesce("p_hi", "hi").alias("y")), "x", "y"))
    return labels


def _between(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
