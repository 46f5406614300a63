"""Connected components of a link table, by contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; component is the smallest id reachable.

    Each round moves every id to the smallest of itself and its neighbours, and links with it;
    the number of ids with links at least halves, so rounds grow with the logarithm of the input.
    A self link gives a component of its own; null ends are ignored.
    """
    with scratch(links.sparkSession):
        links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
        edges = materialize(links.union(links.select("v", "u")).distinct(), "links")
        labels = edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
        while True:
            edges = edges.filter("u <> v")
            moved = materialize(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "moved")
            if moved.isEmpty():
                return materialize(labels, "components", up=1)
            labels = labels.join(moved, F.col("component") == F.col("u"), "left").select("id", F.coalesce("p", "component").alias("component"))
            labels = materialize(labels, "labels")
            to = moved.select(F.col("u").alias("v"), F.col("p").alias("q"))
            edges = materialize(edges.join(moved, "u").join(to, "v").select(F.col("p").alias("u"), F.col("q").alias("v")).filter("u <> v").distinct(), "links")
