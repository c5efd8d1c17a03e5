"""Parameterised queries over the stored tables, one function per question asked."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalkit.functions import mean_se, plain_number, rescaled, text_or_na, thousands, whole_number
from shoalkit.operators.summaries import bounds, choices
from shoalkit.scaling import small_side
from shoalkit.schemas import require_columns

# Metric names and axis labels shown to users.
METRIC_NAMES = {
    "cti": "Community temperature index (CTI)",
    "species_richness": "Species richness",
    "total_abundance": "Total abundance",
    "alt": "Abundance of large teleosts",
    "blt": "Biomass of large teleosts (BLT)",
}
METRIC_AXES = {
    "species_richness": "Average no. species",
    "total_abundance": "Average no. individuals",
    "cti": "Community temperature index (°C)",
    "alt": "Average no. individuals",
    "blt": "Biomass (kg)",
}
# The metrics that are computed.
SAMPLE_METRICS = ["total_abundance", "species_richness", "cti"]

# Columns looked for, in this order.
STATUS_COLUMNS = ["status", "period", "protection_status", "zone", "mp_zone"]
ID_COLUMNS = ["sample_url", "deployment_id", "sample_id", "sample", "sample_name", "deployment"]


def _regions(value):
    return [value] if isinstance(value, str) else list(value)


def kpis(stats: DataFrame, keep=()) -> DataFrame:
    """Overview or region figures as display text."""
    return stats.select(
        *keep,
        thousands(F.col("num_bruvs")).alias("num_bruvs"),
        thousands(F.col("num_fish")).alias("num_fish"),
        thousands(F.col("num_lengths")).alias("num_lengths"),
        F.concat(text_or_na(F.col("min_year")), F.lit(" - "), text_or_na(F.col("max_year"))).alias("years_included"),
        F.concat(
            text_or_na(plain_number(F.col("min_depth"))), F.lit(" - "),
            text_or_na(plain_number(F.col("max_depth"))), F.lit(" m"),
        ).alias("depths_surveyed"),
        F.concat(text_or_na(whole_number(F.col("average_depth"))), F.lit(" m")).alias("average_depth"),
    )


def overview_kpis(overview_stats: DataFrame) -> DataFrame:
    return kpis(overview_stats.limit(1))


def region_kpis(region_stats: DataFrame, region) -> DataFrame:
    return kpis(region_stats.where(F.col("bioregion").isin(*_regions(region))), ["bioregion"])


def region_deployments(deployments: DataFrame, region=None, method="BRUVs") -> DataFrame:
    """Deployments of a region, or all, with a method column."""
    chosen = deployments if region is None else deployments.where(F.col("bioregion").isin(*_regions(region)))
    return chosen.withColumn("method", F.lit(method))


def region_bounds(deployments: DataFrame, region=None) -> DataFrame:
    return bounds(region_deployments(deployments, region))


def region_choices(region_stats: DataFrame) -> DataFrame:
    return choices(region_stats, "bioregion")


def year_choices(top_species_year: DataFrame, region: str) -> DataFrame:
    return choices(top_species_year.where(F.col("bioregion") == region), "year")


def _ends(mean="average_abundance"):
    return {"lower": F.col(mean) - F.col("se"), "upper": F.col(mean) + F.col("se")}


def top_species_view(top_species: DataFrame, region: str, n=10, by_status=False) -> DataFrame:
    """A region's ``n`` most abundant species, with error bar ends and display order.

    ``order_index`` runs from the least to the most abundant, by the abundance over all
    statuses.
    """
    rows = top_species.where((F.col("group") == "bioregion") & (F.col("bioregion") == region))
    overall = rows.where(~F.col("by_status"))
    taxon = [F.asc_nulls_last(name) for name in ("family", "genus", "species")]
    top = overall.orderBy(F.desc_nulls_last("average_abundance"), *taxon).limit(n).select("display_name").distinct()
    # At most n names, so every frame below holds a handful of rows.
    names = small_side(top)
    rising = Window.orderBy(F.asc_nulls_last("average_abundance"), *taxon)
    order = (
        overall.join(names, "display_name", "left_semi")
        .select("label", F.row_number().over(rising).alias("position"))
        .groupBy("label").agg(F.min("position").alias("position"))
        .select("label", F.row_number().over(Window.orderBy("position")).alias("order_index"))
    )
    shown = rows.where(F.col("by_status")) if by_status else overall
    return (
        shown.join(names, "display_name", "left_semi")
        .join(small_side(order), "label", "left")
        .withColumns(_ends())
        .select("family", "genus", "species", "status", "display_name", "label",
                "average_abundance", "se", "lower", "upper", "order_index")
    )


def top_species_in_year(top_species_year: DataFrame, region: str, year=None, n=10, side="left") -> DataFrame:
    """A region's ``n`` most abundant species of one year, by status.

    Without a year the first one is taken (``side="left"``) or the last one.
    """
    rows = top_species_year.where(F.col("bioregion") == region)
    if year is None:
        pick = {"left": F.min, "right": F.max}[side]
        rows = rows.where(F.col("year") == rows.agg(pick("year")).scalar())
    else:
        rows = rows.where(F.col("year").cast("string") == str(year))
    # Sums of doubles depend on their order, so ranks ignore the last digits.
    summed = F.round(F.coalesce(F.sum("average_abundance"), F.lit(0.0)), 12).alias("summed")
    top = (
        rows.groupBy("display_name").agg(summed)
        .orderBy(F.desc("summed"), F.asc_nulls_last("display_name")).limit(n).select("display_name")
    )
    shown = rows.join(small_side(top), "display_name", "left_semi")
    # At most n labels reach the unpartitioned window.
    order = (
        shown.groupBy("label").agg(summed)
        .select("label", F.row_number().over(Window.orderBy("summed", "label")).alias("order_index"))
    )
    return (
        shown.join(small_side(order), "label", "left")
        .withColumns(_ends())
        .select("year", "status", "family", "genus", "species", "display_name", "label",
                "average_abundance", "se", "lower", "upper", "order_index")
    )


def metric_rows(metrics: DataFrame, region, metric: str) -> DataFrame:
    return metrics.where(F.col("bioregion").isin(*_regions(region)) & (F.col("metric") == metric))


def metric_timeseries(metrics: DataFrame, region, metric: str, column="start_month") -> DataFrame:
    """Mean and standard error per event start month and status."""
    rows = metric_rows(require_columns(metrics, [column, "status", "value"], "metrics"), region, metric)
    month = F.try_to_date(F.concat(column, F.lit("-01")), "yyyy-MM-dd")
    return (
        rows.withColumn(column, month).groupBy(column, "status")
        .agg(*mean_se(F.col("value"), single=0.0)).withColumns(_ends("mean"))
    )


def metric_mean_se(metrics: DataFrame, region, metric: str, columns=STATUS_COLUMNS) -> DataFrame:
    """Mean and standard error per value of the first of ``columns`` that exists."""
    column = next((name for name in columns if name in metrics.columns), "bioregion")
    rows = metric_rows(metrics, region, metric)
    return (
        rows.groupBy(F.col(column).alias("grp")).agg(*mean_se(F.col("value"), single=0.0))
        .withColumns(_ends("mean"))
    )


def sample_page(metrics: DataFrame, deployments: DataFrame, samples) -> DataFrame:
    """Attributes and metrics of the named samples, a row each; a metric without a value is missing.

    On stored tables both scans skip the row groups whose filter on ``sample_url`` holds
    none of the names, whatever regions the samples lie in.
    """
    wanted = F.col("sample_url").isin(*samples)
    values = metrics.where(wanted).groupBy("sample_url").agg(
        *[F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name in SAMPLE_METRICS])
    return (
        deployments.where(wanted).select("sample_url", "campaignid", "bioregion", "status", "date", "depth_m")
        .join(values, "sample_url", "left")
    )


def attach_coordinates(metrics: DataFrame, deployments: DataFrame, ids=ID_COLUMNS) -> DataFrame:
    """Add longitude and latitude by the first identifier both tables have, if missing."""
    wanted = ["longitude_dd", "latitude_dd"]
    if all(name in metrics.columns for name in wanted):
        return metrics
    shared = [name for name in ids if name in metrics.columns and name in deployments.columns]
    if not shared:
        raise ValueError("metrics and deployments share none of " + ", ".join(ids))
    return metrics.join(deployments.select(shared[0], *wanted), shared[0], "left")


def metric_map_bounds(metrics: DataFrame, deployments: DataFrame, region, metric: str) -> DataFrame:
    """Bounding box of the map points of a metric."""
    points = attach_coordinates(metric_rows(metrics, region, metric), deployments)
    return bounds(points.where(F.col("latitude_dd").isNotNull() & F.col("longitude_dd").isNotNull() & F.col("value").isNotNull()))


def metric_map(metrics: DataFrame, deployments: DataFrame, region, metric: str) -> DataFrame:
    """Map points of a metric: value, rounded value, status and a radius from 4 to 14."""
    points = attach_coordinates(metric_rows(metrics, region, metric), deployments).where(
        F.col("latitude_dd").isNotNull() & F.col("longitude_dd").isNotNull() & F.col("value").isNotNull()
    )
    span = points.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"))).scalar()
    return points.select(
        "sample_url", "longitude_dd", "latitude_dd", "value", "status",
        F.bround("value", 2).alias("shown_value"),
        rescaled(F.col("value"), span.low, span.high).alias("radius"),
    )


def metric_labels(metrics: DataFrame) -> DataFrame:
    """Axis label of every metric in the table: the label, else the name, else the id."""
    def looked_up(values):
        pairs = [F.lit(part) for item in values.items() for part in item]
        return F.create_map(*pairs)[F.col("metric")]

    label = F.coalesce(looked_up(METRIC_AXES), looked_up(METRIC_NAMES), F.col("metric"))
    return metrics.select("metric").distinct().withColumn("label", label)
