"""Sampling events: deployments of a campaign separated by more than 14 days."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalkit.functions import text_or_na

GAP_DAYS = 14

# Longest run of event numbers made inside one row, and so in one piece by one task.
_BLOCK = 2_000


def prepare_deployments(deployments: DataFrame) -> DataFrame:
    """Add ``year`` (text) and ``date``."""
    return (
        deployments
        .withColumn("year", F.date_format("date_time", "yyyy"))
        .withColumn("date", F.to_date("date_time"))
    )


def _events(deployments, gap_days):
    """One row per campaign and date with its event and the number ``n`` of deployments.

    Repeated dates have gap 0, so numbering distinct dates gives the same events, and a
    campaign holding most of the rows is no larger than its calendar. Deployments
    without a date share one row that sorts last.
    """
    by_date = Window.partitionBy("campaignid").orderBy(F.asc_nulls_last("date"))
    so_far = by_date.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.datediff("date", F.lag("date").over(by_date))
    started = F.last(F.when(F.col("new_event"), F.col("date")), ignorenulls=True).over(so_far)
    return (
        deployments.groupBy("campaignid", "date").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("days_since_previous", gap)
        .withColumn("new_event", F.coalesce(F.col("days_since_previous") > gap_days, F.lit(True)))
        .withColumn("event_number", F.sum(F.col("new_event").cast("long")).over(so_far))
        .withColumn("start_date", F.when(F.col("date").isNotNull(), started))
    )


def _event_labels():
    started = text_or_na(F.date_format("start_date", "yyyyMMdd"))
    return (
        F.concat("campaignid", F.lit("_"), started).alias("new_campaignid"),
        F.date_format("start_date", "yyyy-MM").alias("start_month"),
    )


def event_starts(deployments: DataFrame, gap_days=GAP_DAYS) -> DataFrame:
    """Number and start of the event of every dated (campaignid, date)."""
    return _events(deployments.where(F.col("date").isNotNull()), gap_days).select(
        "campaignid", "date", "event_number", "start_date"
    )


def event_calendar(deployments: DataFrame, gap_days=GAP_DAYS) -> DataFrame:
    """Event of every dated (campaignid, date): number, start, identifier and month."""
    return event_starts(deployments, gap_days).select("*", *_event_labels())


def with_event_labels(rows: DataFrame) -> DataFrame:
    """Add identifier and month of the event to rows that have its start; both are missing without an event."""
    identifier, month = _event_labels()
    return rows.select("*", F.when(F.col("event_number").isNotNull(), identifier).alias("new_campaignid"), month)


def campaign_lookup(deployments: DataFrame, gap_days=GAP_DAYS) -> DataFrame:
    """The calendar plus one event for every deployment without a date.

    Each undated deployment opens its own event after the dated ones, so the row that
    counts them is repeated with rising numbers. It is first cut into blocks, which are
    dealt to all tasks before they grow, so one campaign may hold most undated rows.
    """
    copies = F.when(F.col("date").isNull(), F.col("n")).otherwise(F.lit(1)).cast("long")
    block = F.lit(_BLOCK).cast("long")
    first = F.col("block") * block
    last = F.least(F.col("copies"), first + block) - 1
    # A number, as the small rows before they grow would be put together again otherwise.
    tasks = int(deployments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        _events(deployments, gap_days)
        .withColumn("copies", copies)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_BLOCK}"))))
        .repartition(tasks, "campaignid", "date", "block")
        .withColumn("offset", F.explode(F.sequence(first, last)))
        .withColumn("event_number", F.col("event_number") + F.col("offset"))
        .select("campaignid", "date", "event_number", "start_date", *_event_labels())
    )


def events_by_session_window(deployments: DataFrame, gap_days=GAP_DAYS) -> DataFrame:
    """One row per dated event, built with Spark's session windows.

    A session closes when the gap exceeds ``gap_days``, so this must agree with
    ``event_calendar``.
    """
    order = Window.partitionBy("campaignid").orderBy("start_date")
    session = F.session_window(F.col("date").cast("timestamp"), f"{gap_days} days")
    return (
        deployments.where(F.col("date").isNotNull()).select("campaignid", "date").distinct()
        .groupBy("campaignid", session)
        .agg(F.min("date").alias("start_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_dates"))
        .withColumn("event_number", F.row_number().over(order).cast("long"))
        .select("campaignid", "event_number", "start_date", "last_date", "n_dates", *_event_labels())
    )


def events_per_region(deployments: DataFrame, gap_days=GAP_DAYS) -> DataFrame:
    """Number of distinct event identifiers per bioregion."""
    seen = deployments.select("bioregion", "campaignid", "date").distinct()
    identifier = F.coalesce("new_campaignid", F.concat("campaignid", F.lit("_NA")))
    return (
        seen.join(event_calendar(deployments, gap_days), ["campaignid", "date"], "left")
        .select("bioregion", identifier.alias("new_campaignid")).distinct()
        .groupBy("bioregion").agg(F.count(F.lit(1)).alias("n"))
    )


def years_per_region(deployments: DataFrame) -> DataFrame:
    """Number of distinct years per bioregion; a missing year counts as one."""
    return (
        deployments.select("bioregion", "year").distinct()
        .groupBy("bioregion").agg(F.count(F.lit(1)).alias("n"))
    )
