"""Connected components of a large graph by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.llm.common import dropped, stored


def _size_and_sum(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (longs ``a``, ``b``): root is the smallest node it reaches.

    Each round links the larger neighbours of a node to the smallest one (large star),
    then its smaller neighbours (small star). Minima are aggregated before they are
    shuffled, and joins on a node with many neighbours can be split by AQE. Rounds grow
    with the logarithm of the graph. Only a count and a checksum reach the driver.
    Roots themselves are listed only if they have an edge; no edges give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = stored(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    seen = _size_and_sum(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = (
            both.join(least, "a").filter("b > a")
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        before, stars = stars, stored(small.unionByName(least.withColumnRenamed("least", "b")).distinct(), "edges")
        now = _size_and_sum(stars)
        dropped(before)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
