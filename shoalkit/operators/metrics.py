"""Per-sample metrics: total abundance, species richness, community temperature index."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.functions import sum_or_missing
from shoalkit.operators.events import GAP_DAYS, event_starts, with_event_labels
from shoalkit.operators.taxa import unique_by_taxon
from shoalkit.scaling import null_safe_join, small_side
from shoalkit.schemas import TAXON

COLUMNS = ["campaignid", "sample", "sample_url", "metric", "value"]


def count_samples(deployments: DataFrame) -> DataFrame:
    """Deployments whose count succeeded; a missing flag counts as failed."""
    return deployments.where(F.col("successful_count"))


def length_samples(deployments: DataFrame) -> DataFrame:
    """Deployments whose lengths succeeded."""
    return deployments.where(F.col("successful_length"))


def in_region(facts: DataFrame, deployments: DataFrame) -> DataFrame:
    """Fact rows of the given deployments."""
    return facts.join(deployments.select("sample_url"), "sample_url", "left_semi")


def _total(column, null_counts):
    return {"poison": sum_or_missing, "skip": F.sum}[null_counts](column)


def _zero_filled(values, deployments, metric):
    # Counts of a sample that is not in the list stay, without campaign and sample.
    samples = count_samples(deployments).select("campaignid", "sample", "sample_url")
    return (
        samples.join(values, "sample_url", "full")
        .withColumn("value", F.coalesce("value", F.lit(0)).cast("double"))
        .withColumn("metric", F.lit(metric))
        .select(*COLUMNS)
    )


def total_abundance(counts: DataFrame, deployments: DataFrame, null_counts="poison") -> DataFrame:
    """Individuals per sample; 0 where nothing was seen or (``poison``) a count is missing."""
    values = counts.groupBy("sample_url").agg(_total(F.col("count"), null_counts).alias("value"))
    return _zero_filled(values, deployments, "total_abundance")


def species_richness(counts: DataFrame, deployments: DataFrame) -> DataFrame:
    """Distinct taxa per sample, a partly named taxon included."""
    values = (
        counts.select("sample_url", *TAXON).distinct()
        .groupBy("sample_url").agg(F.count(F.lit(1)).alias("value"))
    )
    return _zero_filled(values, deployments, "species_richness")


def _cti(niche, weight):
    known = F.when(niche.isNotNull(), weight)
    return F.try_divide(F.sum(known * niche), F.sum(known))


def thermal_niche(life_history: DataFrame) -> DataFrame:
    """Thermal niche per taxon, unique by taxon."""
    return small_side(unique_by_taxon(life_history, "rls_thermal_niche"))


def community_temperature(counts, deployments, life_history, weight="count") -> DataFrame:
    """Abundance-weighted mean thermal niche per sample; samples without one are dropped.

    ``weight`` is ``count`` or ``log`` (log of count + 1). Taxa without a niche do not
    take part. Campaign and sample come from the deployment of the sample.
    """
    count = F.col("count").cast("double")
    weighted = {"count": count, "log": F.log1p(count)}[weight]
    values = (
        null_safe_join(counts, thermal_niche(life_history), TAXON, "left")
        .groupBy("sample_url").agg(_cti(F.col("rls_thermal_niche"), weighted).alias("value"))
        .where(F.col("value").isNotNull())
    )
    return (
        values.join(deployments.select("campaignid", "sample", "sample_url"), "sample_url", "left")
        .withColumn("metric", F.lit("cti")).select(*COLUMNS)
    )


def sample_taxa(counts: DataFrame) -> DataFrame:
    """Sums per sample and taxon: the one pass over the counts that the metrics and the
    abundance rankings share.

    A sample holding a large share of all rows leaves it with one row per taxon, so the
    later shuffles by sample are even. Missing counts add nothing but are flagged.
    """
    count = F.coalesce("count", F.lit(0)).cast("long")
    return counts.groupBy("sample_url", *TAXON).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(count).alias("total"),
        F.sum(count * count).alias("total_sq"),
        F.sum(F.log1p(count.cast("double"))).alias("log_total"),
        F.bool_or(F.col("count").isNull()).alias("has_missing"),
    )


def sample_measures(per_taxon, life_history, null_counts="poison", weight="count") -> DataFrame:
    """All three measures of every sample with counts, from ``sample_taxa``."""
    total = F.sum("total")
    if null_counts == "poison":
        total = F.when(F.bool_or("has_missing"), F.lit(0)).otherwise(total)
    weighted = F.col({"count": "total", "log": "log_total"}[weight]).cast("double")
    return (
        null_safe_join(per_taxon, thermal_niche(life_history), TAXON, "left")
        .groupBy("sample_url")
        .agg(
            total.cast("double").alias("total_abundance"),
            F.count(F.lit(1)).cast("double").alias("species_richness"),
            _cti(F.col("rls_thermal_niche"), weighted).alias("cti"),
        )
    )


def metrics_long(
    per_taxon, deployments, life_history, null_counts="poison", weight="count", gap_days=GAP_DAYS
) -> DataFrame:
    """The three metrics in long form with region, status, date and sampling event.

    Equals the union of ``total_abundance``, ``species_richness`` and
    ``community_temperature`` joined to the sample attributes, but comes from the sums
    of ``sample_taxa`` and one full outer join.
    """
    return metrics_of_samples(per_taxon, samples_with_events(deployments, gap_days), life_history, null_counts, weight)


def samples_with_events(deployments, gap_days=GAP_DAYS, more=(), arrange=lambda rows: rows) -> DataFrame:
    """Every sample with its attributes, sampling event and the columns ``more``; ``ok`` if its count succeeded.

    ``arrange`` deals out the rows. It gets them before the texts that follow from an
    event's start are added, so no shuffle carries these.
    """
    ok = F.coalesce("successful_count", F.lit(False))
    rows = (
        deployments
        .select("sample_url", "campaignid", "sample", "bioregion", "status", "date_time", "date", ok.alias("ok"), *more)
        .join(event_starts(deployments, gap_days), ["campaignid", "date"], "left")
    )
    return with_event_labels(arrange(rows))


def metrics_of_samples(
    per_taxon, samples, life_history, null_counts="poison", weight="count", arrange=lambda rows: rows
) -> DataFrame:
    """``metrics_long`` from ``samples_with_events``, with coordinates if the samples have them.

    Where both tables are stored in buckets by ``sample_url``, sums and join stay inside
    a bucket and no row of them is shuffled. ``arrange`` deals out the rows while there
    is one for each sample, before it becomes one for each metric.
    """
    dated = ["date_time", "date", "event_number", "start_date", "new_campaignid", "start_month"]
    places = [name for name in ("longitude_dd", "latitude_dd") if name in samples.columns]
    joined = arrange(
        samples.join(sample_measures(per_taxon, life_history, null_counts, weight), "sample_url", "full")
        .withColumn("ok", F.coalesce("ok", F.lit(False)))
        .where(F.col("ok") | F.col("species_richness").isNotNull())
        .select("sample_url", "campaignid", "sample", "bioregion", "status", "ok", *dated, *places,
                "total_abundance", "species_richness", "cti")
    )

    def entry(name, value, keep_ids):
        ids = [F.when(keep_ids, F.col(column)).alias(column) for column in ("campaignid", "sample")]
        return F.struct(F.lit(name).alias("metric"), value.alias("value"), *ids)

    entries = F.array(
        entry("total_abundance", F.coalesce("total_abundance", F.lit(0.0)), F.col("ok")),
        entry("species_richness", F.coalesce("species_richness", F.lit(0.0)), F.col("ok")),
        entry("cti", F.col("cti"), F.lit(True)),
    )
    # Dates and events are those of successful samples only.
    return (
        joined.select(
            "sample_url", "bioregion", "status",
            *[F.when(F.col("ok"), F.col(name)).alias(name) for name in dated],
            F.explode(entries).alias("entry"), *places,
        )
        .where((F.col("entry.metric") != "cti") | F.col("entry.value").isNotNull())
        .select("entry.campaignid", "entry.sample", "sample_url", "entry.metric", "entry.value",
                "bioregion", "status", *dated, *places)
    )


def taxa_missing_cti(counts, deployments, life_history) -> DataFrame:
    """Distinct taxa of the samples that have fish but no temperature index."""
    return samples_missing_cti(counts, deployments, life_history).select(*TAXON).distinct()


def samples_missing_cti(counts, deployments, life_history, null_counts="poison", weight="count") -> DataFrame:
    """Count rows of the samples that have fish but no temperature index.

    An anti join against the index rows is not needed: both measures come from one
    pass, so samples without an index are a filter away.
    """
    missing = (
        sample_measures(sample_taxa(counts), life_history, null_counts, weight)
        .where(F.col("cti").isNull() & (F.col("total_abundance") > 0))
        .select("sample_url", F.col("total_abundance").alias("value"))
    )
    ok = F.coalesce("successful_count", F.lit(False))
    samples = deployments.select(
        "sample_url", *[F.when(ok, F.col(name)).alias(name) for name in ("campaignid", "sample")]
    )
    # A positive total implies count rows, so the inner join loses nothing and lets
    # AQE split a sample with very many of them.
    return (
        missing.join(samples, "sample_url")
        .withColumn("metric", F.lit("total_abundance"))
        .join(counts, "sample_url")
        .select("sample_url", "campaignid", "sample", "metric", "value", *TAXON, "count")
    )
