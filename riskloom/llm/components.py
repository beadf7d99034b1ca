"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of `links` (u, v).

    Large stars and small stars by turns: every node hangs its neighbours on the smallest id it knows, until nothing
    changes. Each round is written to the shared folder; only a count and a checksum reach the driver.
    """
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges, before = stored(pairs, "stars"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        spread = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = spread.unionByName(small.select("u", F.col("m").alias("v")))
        edges = stored(hung.where("u > v").distinct(), "stars")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = after
