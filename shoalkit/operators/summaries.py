"""Data-set and region summaries, bounds and choice lists."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.operators.metrics import count_samples
from shoalkit.scaling import null_safe_join


def _sample_figures():
    return [
        F.count(F.lit(1)).alias("num_bruvs"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.min("depth_m").alias("min_depth"), F.max("depth_m").alias("max_depth"),
        F.avg("depth_m").alias("average_depth"),
    ]


def overview_stats(deployments: DataFrame, counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for the whole data set: samples, fish, lengths, longest fish, years, depths."""
    parts = [
        count_samples(deployments).agg(*_sample_figures()),
        counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("num_fish")),
        lengths.agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("num_lengths"), F.max("length_mm").alias("biggest_fish")
        ),
    ]
    # Each part fills its own columns, so the maximum over the three rows puts them
    # side by side.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def _per_sample(facts, deployments, *sums):
    # Summed per sample first: the join then meets one row per sample.
    return (
        facts.groupBy("sample_url").agg(*sums)
        .join(deployments.select("sample_url", "bioregion"), "sample_url", "left")
    )


def sample_lengths(lengths: DataFrame) -> DataFrame:
    """Number of lengths and the longest of each sample; the summaries give the same from it as from the lengths."""
    return lengths.groupBy("sample_url").agg(F.sum("count").alias("count"), F.max("length_mm").alias("length_mm"))


def region_sample_stats(deployments: DataFrame) -> DataFrame:
    return count_samples(deployments).groupBy("bioregion").agg(*_sample_figures())


def region_count_stats(counts: DataFrame, deployments: DataFrame) -> DataFrame:
    """Individuals per region; as on the grid, rows without a family are left out."""
    named = counts.where(F.col("family").isNotNull())
    return (
        _per_sample(named, deployments, F.sum("count").alias("n"))
        .groupBy("bioregion").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_fish"))
    )


def region_length_stats(lengths: DataFrame, deployments: DataFrame) -> DataFrame:
    return (
        _per_sample(lengths, deployments, F.sum("count").alias("n"), F.max("length_mm").alias("longest"))
        .groupBy("bioregion")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_lengths"), F.max("longest").alias("biggest_fish"))
    )


def region_stats(deployments: DataFrame, counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per region with successful samples, those without a region as one more; 0 fish where none were seen."""
    parts = [
        region_sample_stats(deployments),
        region_count_stats(counts, deployments),
        region_length_stats(lengths, deployments),
    ]
    joined = reduce(lambda a, b: null_safe_join(a, b, ["bioregion"], "left"), parts)
    return joined.withColumn("num_fish", F.coalesce("num_fish", F.lit(0)))


def bounds(points: DataFrame, by=()) -> DataFrame:
    """Bounding box of the points, per group of ``by``."""
    return points.groupBy(*by).agg(
        F.min("longitude_dd").alias("min_lon"), F.min("latitude_dd").alias("min_lat"),
        F.max("longitude_dd").alias("max_lon"), F.max("latitude_dd").alias("max_lat"),
    )


def map_centre(deployments: DataFrame) -> DataFrame:
    """Mean longitude and middle of the latitude range."""
    return deployments.agg(
        F.avg("longitude_dd").alias("lon"),
        ((F.min("latitude_dd") + F.max("latitude_dd")) / 2).alias("lat"),
    )


def choices(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in ascending order, missing ones left out."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
