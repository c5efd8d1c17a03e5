"""Summaries of one location (a marine park) across two survey methods.

Tables come as a dict of DataFrames. Diver-survey variants carry the suffix
``_diver``; tables that hold both methods have a ``method`` column.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.functions import bubble_radius, slug
from shoalkit.operators.histograms import density, histogram
from shoalkit.operators.taxa import html_label, split_display_name
from shoalkit.scaling import kept_with_maximum, numbered, small_side

TABLES = [
    "deployment_locations", "deployment_locations_diver",
    "metric_bubble_data", "metric_bubble_data_diver",
    "bubble_data", "bubble_data_diver",
    "length_with_jurisdiction", "top_species_location", "years_park", "depth_combined",
]

# Survey method -> suffix of its tables.
SUFFIX = {"video": "", "diver": "_diver"}


def location_bundle(tables, location):
    """Every table of the bundle, filtered to one location."""
    return {name: table.where(F.col("location") == location) for name, table in tables.items()}


def bundle_sizes(bundle) -> DataFrame:
    """Rows per table of a bundle."""
    rows = None
    for name, table in bundle.items():
        part = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def location_deployments(bundle) -> DataFrame:
    """Deployments of both methods."""
    return bundle["deployment_locations"].unionByName(
        bundle["deployment_locations_diver"], allowMissingColumns=True
    )


def of_species(df: DataFrame, species) -> DataFrame:
    """Rows of the chosen species: a list of display names, or a short frame of them."""
    if isinstance(species, DataFrame):
        return df.join(small_side(species.select("display_name")), "display_name", "left_semi")
    return df.where(F.col("display_name").isin(*species))


def default_species(bundle, n=1) -> DataFrame:
    """The picker's default: the first ``n`` names of the ranking."""
    return species_ranking(bundle["top_species_location"]).limit(n)


def species_ranking(top_species_location: DataFrame) -> DataFrame:
    """Total number per display name, largest first."""
    return (
        top_species_location.groupBy("display_name").agg(F.sum("total_number").alias("total_number"))
        .orderBy(F.desc_nulls_last("total_number"), F.asc_nulls_last("display_name"))
    )


def effort_by_year(years: DataFrame) -> DataFrame:
    """Deployments per year and method, with a row for every year in the range."""
    counted = years.groupBy("year", "method").agg(F.sum("n").alias("n"))
    axis = (
        years.agg(F.floor(F.min("year")).alias("low"), F.ceil(F.max("year")).alias("high"))
        .where(F.col("low").isNotNull())
        .select(F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))).alias("year"))
    )
    return (
        axis.join(counted, "year", "left")
        .select("year", "method", F.coalesce("n", F.lit(0)).alias("n"))
    )


def depth_histogram(depths: DataFrame, width=5) -> DataFrame:
    return histogram(depths, "depth_m", width, ["method"])


LENGTH_GROUPS = ["status", "jurisdiction", "method"]


def length_histogram(lengths: DataFrame, species, width) -> DataFrame:
    return histogram(of_species(lengths, species), "length_mm", width, LENGTH_GROUPS)


def length_density(lengths: DataFrame, species, width) -> DataFrame:
    return density(of_species(lengths, species), "length_mm", width, LENGTH_GROUPS)


def species_by_method(top_species_location: DataFrame) -> DataFrame:
    """Species totals with an HTML label and their ascending order inside the method.

    There are two or three methods, so each is ranked by ranges and not in one task.
    """
    labelled = (
        split_display_name(top_species_location).withColumn("label", html_label())
        .select("method", "display_name", "sci", "common", "label", "total_number")
    )
    return numbered(labelled, [F.asc_nulls_last("total_number"), F.asc_nulls_last("label")], "order_index", ["method"])


def _bubbles(points: DataFrame, value: str) -> DataFrame:
    # The largest value is noted while the points are written, so their joins run once.
    # One scan marks zeros instead of splitting the rows in two; other values
    # (missing or negative) are not drawn.
    shown, largest = kept_with_maximum(points.where(F.col(value) >= 0), value)
    return shown.withColumns({
        "is_zero": F.col(value) == 0,
        "radius": bubble_radius(F.col(value), F.lit(largest)),
    })


def metric_bubbles(bundle, metric_label: str, method="video") -> DataFrame:
    """Map points of one metric, named as shown to the user, with radius."""
    points = bundle["metric_bubble_data" + SUFFIX[method]]
    wanted = slug(F.lit(metric_label))
    return _bubbles(points.where(F.col("metric") == wanted), "value")


def species_bubbles(bundle, species, method="video") -> DataFrame:
    """Map points of chosen species at every deployment, 0 where not seen."""
    suffix = SUFFIX[method]
    sites = bundle["deployment_locations" + suffix].select(
        "sample_url", "location", "latitude_dd", "longitude_dd"
    )
    keys = ["sample_url", "location"]
    renamed = sites.withColumnsRenamed({key: f"__{key}" for key in keys})
    # A missing location matches a missing location.
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"__{key}")) for key in keys])
    points = (
        of_species(bundle["bubble_data" + suffix], species).join(renamed, same, "full")
        .withColumns({key: F.coalesce(key, f"__{key}") for key in keys}).drop(*[f"__{key}" for key in keys])
        .withColumn("count", F.coalesce("count", F.lit(0)))
    )
    return _bubbles(points, "count")


def species_pages(pages: DataFrame, species) -> DataFrame:
    """Distinct page address of the chosen species."""
    return of_species(pages, species).select("url").distinct()
