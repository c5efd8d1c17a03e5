"""Histograms whose bins are centred on multiples of the width and closed on the right."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Share of a bin width by which bin edges are moved up, against rounding noise.
FUZZ = 1e-8


def histogram(df: DataFrame, value: str, width, by=()) -> DataFrame:
    """Rows per bin centre (column ``bin``) and group; missing values are left out.

    A value on an edge belongs to the bin below, except on the lowest edge of all the
    data: the range starts there, and the value belongs to the bin above.
    """
    # Widths are floats, so an integer width divides like any other.
    w = F.lit(float(width))
    x = F.col(value).cast("double")
    index = F.ceil((x - w / 2) / w - FUZZ).cast("long")
    # After the aggregation the bins are few, so a window over all of them is small.
    first = (
        df.where(x.isNotNull())
        .groupBy(*by, index.alias("index"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("smallest"))
        .withColumn("lowest", F.min("smallest").over(Window.partitionBy()))
    )
    # All rows of the lowest bin sit on its upper edge exactly when the smallest does.
    upper_edge = (F.col("index") + 0.5) * w
    on_lowest_edge = (F.col("smallest") == F.col("lowest")) & (F.abs(F.col("smallest") - upper_edge) <= w * FUZZ)
    moved = F.when(on_lowest_edge, F.col("index") + 1).otherwise(F.col("index"))
    return first.groupBy(*by, (moved * w).alias("bin")).agg(F.sum("n").alias("n"))


def density(df: DataFrame, value: str, width, by) -> DataFrame:
    """The histogram with ``density``, which times the width sums to 1 in every group."""
    total = F.sum("n").over(Window.partitionBy(*by))
    return histogram(df, value, width, by).withColumn("density", F.col("n") / total / F.lit(float(width)))
