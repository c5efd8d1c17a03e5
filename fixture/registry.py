"""Every query by name: ``(spark, folder) -> DataFrame``, on whole tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixture.bindings import GENUS, OLD_DATUM, POLYGONS, SPECIES, STRIP_RINGS, WIDE_RINGS, Survey
from shoalkit.functions import slug
from shoalkit.functions.datum import shift_datum
from shoalkit.operators import abundance, events, geodesic, grid, locations, metrics, spatial, summaries, taxa
from shoalkit.plans import views
from shoalkit.plans.refresh import campaign_list
from shoalkit.schemas import TAXON
from shoalkit.session import use_own_folder

REGION = "ASIA"
REGIONS = ["ASIA", "EUROPE"]
LOCATION = "NATION_3"
METRIC = "total_abundance"
STRIP = "West"
# Sample pages asked for: samples with and without counts, and one that does not exist.
SAMPLES = ["1", "7", "100", "333", "999", "none"]
SITES = ["deployment_locations", "deployment_locations_diver"]


# Both engines round after adding this. A value such as 3/128 lies on a rounding tie
# but for noise in its last digit; the shift moves it off the tie in the same direction.
OFF_TIE = "1e-10"


def presented(df: DataFrame) -> DataFrame:
    """Plain types for comparison: six decimals, dates as text, whole numbers as long."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind == "double":
            column = F.round(column + float(OFF_TIE), 6)
        elif kind in ("date", "timestamp"):
            column = column.cast("string")
        elif kind == "int" or kind.startswith("decimal"):
            column = column.cast("long")
        columns.append(column.alias(name))
    return df.select(*columns)


def _bundle(s, *names):
    """The named tables (all by default) for one location."""
    return locations.location_bundle({name: s.location_table(name) for name in names or locations.TABLES}, LOCATION)


def _place(s, name):
    return _bundle(s, name)[name]


def _species(s):
    return locations.default_species(_bundle(s, "top_species_location"), 3)


def _shifted(sites):
    moved = shift_datum(F.col("longitude_dd"), F.col("latitude_dd"), OLD_DATUM)
    return sites.select("sample_url", moved.alias("p")).select(
        "sample_url", F.col("p.x").alias("longitude_dd"), F.col("p.y").alias("latitude_dd"))


QUERIES = {
    # Samples and metrics
    "deployments_prepared": lambda s: s.deployments,
    "count_samples": lambda s: metrics.count_samples(s.deployments).select("sample_url", "campaignid", "sample"),
    "length_samples": lambda s: metrics.length_samples(s.deployments).select("sample_url", "campaignid", "sample"),
    "taxon_recode": lambda s: taxa.recode_taxon(s.raw_counts, GENUS, SPECIES),
    "fish_filter": lambda s: s.counts,
    "fish_lengths": lambda s: s.lengths,
    "region_counts": lambda s: metrics.in_region(s.raw_counts, views.region_deployments(s.deployments, REGIONS)),
    "metric_total_abundance": lambda s: metrics.total_abundance(s.counts, s.deployments),
    "metric_species_richness": lambda s: metrics.species_richness(s.counts, s.deployments),
    "metric_cti": lambda s: metrics.community_temperature(s.counts, s.deployments, s.life_history),
    "metric_cti_log": lambda s: metrics.community_temperature(s.counts, s.deployments, s.life_history, "log"),
    "metrics_long": lambda s: s.metrics,
    "samples_missing_cti": lambda s: metrics.samples_missing_cti(s.counts, s.deployments, s.life_history),
    "taxa_missing_cti": lambda s: metrics.taxa_missing_cti(s.counts, s.deployments, s.life_history),
    # Sampling events
    "sampling_events": lambda s: events.campaign_lookup(s.deployments),
    "sampling_events_session": lambda s: events.events_by_session_window(s.deployments),
    "events_per_region": lambda s: events.events_per_region(s.deployments),
    "years_per_region": lambda s: events.years_per_region(s.deployments),
    "campaign_list": lambda s: campaign_list(s.deployments),
    # Zero-filled abundance
    "grid_size": lambda s: abundance.grid_size(s.counts, s.deployments),
    "complete_counts": lambda s: abundance.complete_counts(s.counts, s.deployments),
    "grid_rows": lambda s: grid.grid_rows(
        grid.compress_grid(s.counts, s.deployments), s.counts, REGION, ["Fished", None], s.small_taxa),
    "abundance_overall": lambda s: abundance.mean_abundance(s.rollup, []),
    "abundance_region": lambda s: abundance.mean_abundance(s.rollup, ["bioregion"]),
    "abundance_status": lambda s: abundance.mean_abundance(s.rollup, ["status"]),
    "abundance_region_status": lambda s: abundance.region_top_by(s.cube, s.top_region, ["bioregion", "status"]),
    "abundance_region_status_year": lambda s: abundance.region_top_by(s.cube, s.top_region, ["bioregion", "status", "year"]),
    "top_species_overall": lambda s: abundance.top_overall(s.rollup),
    "top_species_region": lambda s: abundance.top_by_region(s.rollup),
    "top_species_overall_status": lambda s: abundance.top_overall_status(s.rollup, s.top_overall),
    "top_species_region_status": lambda s: abundance.top_by_region_status(s.cube, s.top_region),
    "top_species_year": lambda s: s.top_species_year,
    "top_species": lambda s: s.top_species,
    "top_species_check": lambda s: abundance.rows_per_region(s.top_species),
    "species_labels": lambda s: taxa.add_labels(s.counts.select(*TAXON).distinct(), s.life_history),
    # Summaries
    "overview_stats": lambda s: summaries.overview_stats(s.deployments, s.counts, s.lengths),
    "region_stats": lambda s: summaries.region_stats(s.deployments, s.counts, s.lengths),
    "map_centre": lambda s: summaries.map_centre(s.deployments),
    # Spatial join
    "region_assign": lambda s: spatial.assign_regions(s.points, s.polygons, 0.05),
    "region_assign_geojson": lambda s: spatial.assign_regions(s.points, s.polygons_read(POLYGONS), 0.05),
    "region_assign_sites": lambda s: spatial.assign_regions(s.sites, s.polygons_read(STRIP_RINGS), 1.0),
    "region_assign_geodesic": lambda s: geodesic.assign_regions(s.sites, s.layer_of(WIDE_RINGS), 0.5),
    "region_assign_shapefile": lambda s: geodesic.assign_regions(s.sites, s.shapes_read(WIDE_RINGS), 0.5),
    "region_assign_datum": lambda s: geodesic.assign_regions(s.sites, s.polygons_read(WIDE_RINGS, OLD_DATUM), 0.5),
    "sites_shifted": lambda s: _shifted(s.sites),
    # Views
    "overview_kpis": lambda s: views.overview_kpis(summaries.overview_stats(s.deployments, s.counts, s.lengths)),
    "region_kpis": lambda s: views.region_kpis(summaries.region_stats(s.deployments, s.counts, s.lengths), REGION),
    "region_choices": lambda s: views.region_choices(summaries.region_sample_stats(s.deployments)),
    "year_choices": lambda s: views.year_choices(s.top_species_year, REGION),
    "region_deployments": lambda s: views.region_deployments(s.deployments, REGION),
    "all_deployments": lambda s: views.region_deployments(s.deployments),
    "region_bounds": lambda s: views.region_bounds(s.deployments, REGION),
    "top_species_view": lambda s: views.top_species_view(s.top_species, REGION, 10),
    "top_species_view_status": lambda s: views.top_species_view(s.top_species, REGION, 10, by_status=True),
    "top_species_in_year": lambda s: views.top_species_in_year(s.top_species_year, REGION, "1997", 10),
    "top_species_last_year": lambda s: views.top_species_in_year(s.top_species_year, REGION, n=10, side="right"),
    "metric_timeseries": lambda s: views.metric_timeseries(s.metrics, REGION, METRIC),
    "metric_mean_se": lambda s: views.metric_mean_se(s.metrics, REGION, METRIC),
    "metric_map": lambda s: views.metric_map(s.metrics, s.deployments, REGION, METRIC),
    "metric_map_bounds": lambda s: views.metric_map_bounds(s.metrics, s.deployments, REGION, METRIC),
    "metric_labels": lambda s: views.metric_labels(s.metrics),
    "metric_slug": lambda s: s.deployments.select("bioregion").distinct().withColumn("slug", slug(F.col("bioregion"))),
    # The batch job
    "refresh_tables": lambda s: locations.bundle_sizes(s.served),
    "refresh_deployments": lambda s: s.served_table("deployments"),
    "refresh_metrics": lambda s: s.served_table("metrics"),
    "refresh_top_species": lambda s: s.served_table("top_species"),
    "refresh_top_species_year": lambda s: s.served_table("top_species_year"),
    "refresh_overview_stats": lambda s: s.served_table("overview_stats"),
    "refresh_region_stats": lambda s: s.served_table("bioregion_stats"),
    "refresh_campaign_lookup": lambda s: s.served_table("campaign_lookup"),
    # Views on the tables of the batch job
    "served_metric_timeseries": lambda s: views.metric_timeseries(s.served_table("metrics"), STRIP, METRIC),
    "served_metric_map": lambda s: views.metric_map(s.served_table("metrics"), s.served_table("deployments"), STRIP, METRIC),
    "served_top_species_view": lambda s: views.top_species_view(s.served_table("top_species"), STRIP, 10),
    "served_metrics_long": lambda s: metrics.metrics_of_samples(
        s.served_table("sample_taxa"), s.served_samples.drop("longitude_dd", "latitude_dd"), s.life_history),
    "served_sample_page": lambda s: views.sample_page(s.served_table("metrics"), s.served_table("deployments"), SAMPLES),
    # One location, two survey methods
    "location_bundle": lambda s: locations.bundle_sizes(_bundle(s)),
    "location_bubbles": lambda s: _place(s, "bubble_data"),
    "location_metric_bubbles": lambda s: _place(s, "metric_bubble_data"),
    "location_lengths": lambda s: _place(s, "length_with_jurisdiction"),
    "species_pages": lambda s: locations.species_pages(s.species_pages, _species(s)),
    "location_deployments": lambda s: locations.location_deployments(_bundle(s, *SITES)),
    "location_bounds": lambda s: summaries.bounds(locations.location_deployments(_bundle(s, *SITES))),
    "species_ranking": lambda s: locations.species_ranking(_place(s, "top_species_location")),
    "effort_by_year": lambda s: locations.effort_by_year(_place(s, "years_park")),
    "depth_hist": lambda s: locations.depth_histogram(_place(s, "depth_combined")),
    "length_hist": lambda s: locations.length_histogram(_place(s, "length_with_jurisdiction"), _species(s), 50),
    "length_density": lambda s: locations.length_density(_place(s, "length_with_jurisdiction"), _species(s), 50),
    "species_by_method": lambda s: locations.species_by_method(_place(s, "top_species_location")),
    "bubble_map": lambda s: locations.metric_bubbles(_bundle(s, "metric_bubble_data"), "Total abundance"),
    "bubble_map_diver": lambda s: locations.metric_bubbles(
        _bundle(s, "metric_bubble_data_diver"), "Species richness", "diver"),
    "species_map": lambda s: locations.species_bubbles(_bundle(s, "bubble_data", SITES[0]), _species(s)),
    "species_map_diver": lambda s: locations.species_bubbles(
        _bundle(s, "bubble_data_diver", SITES[1]), _species(s), "diver"),
}


def _runner(build):
    return lambda spark, folder: presented(build(Survey(use_own_folder(spark), folder)))


def queries():
    return {name: _runner(build) for name, build in QUERIES.items()}
