"""The batch job: landed tables in, result bundle out.

Run as ``python -m shoalkit.plans.refresh IN_DIR OUT_DIR REGIONS_GEOJSON [--resume]``.
"""

import hashlib
import json
import os
import sys
import uuid
from datetime import datetime, timezone
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from shoalkit.operators import abundance, events, metrics, spatial, summaries, taxa
from shoalkit.scaling import numbered
from shoalkit.session import build_session
from shoalkit.sources.bucketed import buckets_for, dealt_by_bucket, read_bucketed, write_bucketed
from shoalkit.sources.bundle import files_fingerprint, finished_steps, log_step, log_success, run_folder, unfinished_run
from shoalkit.sources.geojson import read_polygons
from shoalkit.sources.landed import read_landed, write_table


def campaign_list(deployments: DataFrame) -> DataFrame:
    """Campaigns in order, with row numbers."""
    names = deployments.select("campaignid").distinct()
    return numbered(names, ["campaignid"], "row").select("row", "campaignid")


def by_region(df: DataFrame, *more) -> DataFrame:
    """Rows of a region side by side, so that a filter on it skips files and row groups.

    The further columns cut a region that holds most rows into several ranges.
    """
    return df.repartitionByRange("bioregion", *more).sortWithinPartitions("bioregion", *more)


# What the stored samples hold beside their attributes and events.
SAMPLE_COLUMNS = ["year", "successful_count", "longitude_dd", "latitude_dd"]


class Run:
    """One refresh: its steps are declared first, then made; each is logged when its table is whole.

    A step's fingerprint covers its name, its settings and the fingerprints of all it
    reads. A step that the run has logged under the same fingerprint is not written
    again; after a change of an input exactly the steps that depend on it are.
    """

    def __init__(self, spark, in_dir, out_dir, run_id):
        self.spark, self.in_dir, self.out_dir, self.run_id = spark, in_dir, out_dir, run_id
        self.folder = run_folder(out_dir, run_id)
        self._sources, self._steps, self._known = {}, {}, {}

    def source(self, name, path=None) -> None:
        """Declare an input: a landed table, or any other ``path``."""
        self._sources[f"landed {name}"] = name, path

    def _note(self, name, path) -> None:
        """Note the state of an input."""
        if path is None:
            read_landed(self.spark, self.in_dir, name)  # a missing table or column stops the run here
        self._known[f"landed {name}"] = files_fingerprint(self.spark, path or os.path.join(self.in_dir, name))

    def landed(self, name) -> DataFrame:
        return read_landed(self.spark, self.in_dir, name)

    def stored(self, name) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, name))

    def step(self, name, reads, build, settings=(), write=write_table, **layout) -> None:
        """Declare the table ``build()`` as ``name``; ``reads`` names its inputs, declared before.

        ``settings`` may be a function. Nothing is read before the step is made.
        """
        self._steps[name] = reads, build, settings, write, layout

    def needed(self, tables=None) -> tuple:
        """Two lists: the steps that make ``tables`` (all by default), in order, and the inputs these read."""
        unknown = set(tables or ()) - set(self._steps)
        if unknown:
            raise ValueError("the refresh makes no " + ", ".join(sorted(unknown)))
        wanted = set(self._steps if tables is None else tables)
        for name in reversed(self._steps):
            if name in wanted:
                wanted.update(self._steps[name][0])
        return [name for name in self._steps if name in wanted], [name for name in self._sources if name in wanted]

    def make(self, tables=None) -> None:
        """Write ``tables`` (all by default) and what they are made from, but for what is done."""
        steps, sources = self.needed(tables)
        for name in sources:
            self._note(*self._sources[name])
        done = finished_steps(self.spark, self.out_dir, self.run_id)
        for name in steps:
            reads, build, settings, write, layout = self._steps[name]
            settings = settings() if callable(settings) else settings
            text = json.dumps([name, [str(x) for x in settings], [[x, self._known[x]] for x in reads]])
            fingerprint = self._known[name] = hashlib.sha256(text.encode()).hexdigest()
            if done.get(name) != fingerprint:
                write(build(), self.folder, name, **layout)
                log_step(self.spark, self.out_dir, self.run_id, name, fingerprint)


def write_csv(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(os.path.join(folder, name))


def refresh(
    spark: SparkSession, in_dir: str, out_dir: str, regions_path: str, cell_size=0.25, weight="count",
    genus=taxa.MERGED_GENUS, species=taxa.MERGED_SPECIES, name_property="bioregion", resume=False,
    buckets=None, tables=None,
) -> str:
    """Rebuild every result table under a new run folder and log the run; returns its id.

    With ``tables`` only these are written, in whole, with all that they are made from. Inputs
    that they are not made from need not be there. The run is not finished then: readers do
    not see it before a refresh without ``tables`` resumed it and wrote the rest.

    A run that fails leaves no row in the run log, so readers keep using the run before.
    With ``resume`` the newest run goes on if it did not finish: tables that it wrote
    in full from the same inputs and settings stay, all others are written. Only ask for
    it when that run has ended, since two jobs must not write one folder.

    Sums per taxon and samples are stored in ``buckets`` by sample, and metrics and
    rankings join them bucket by bucket. Unless told, their number follows the size of the counts.
    """
    run_id = unfinished_run(spark, out_dir) if resume else None
    run = Run(spark, in_dir, out_dir, run_id or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}")
    declare(run, regions_path, cell_size, weight, genus, species, name_property, buckets)
    run.make(tables)
    if tables is None:
        log_success(spark, out_dir, run.run_id)
    return run.run_id


def inputs_of(*tables) -> list:
    """Names of the inputs that the named tables of a refresh are made from."""
    run = Run(None, "", "", "")
    declare(run, "")
    return [name.removeprefix("landed ") for name in run.needed(tables)[1]]


def declare(
    run: Run, regions_path: str, cell_size=0.25, weight="count", genus=taxa.MERGED_GENUS,
    species=taxa.MERGED_SPECIES, name_property="bioregion", buckets=None,
) -> None:
    """Declare the inputs and steps of a refresh."""
    spark, stored = run.spark, run.stored
    for name in ("deployments", "counts", "lengths", "life_history"):
        run.source(name)
    run.source("regions", regions_path)

    def life_history():
        return run.landed("life_history")

    def deployments():
        return stored("deployments")

    def per_taxon():
        return read_bucketed(spark, run.folder, "sample_taxa")

    def samples():
        return read_bucketed(spark, run.folder, "samples")

    @cache
    def n_buckets():
        return buckets or buckets_for(run.landed("counts"))

    def write_dealt(df, folder, name):
        write_bucketed(df, folder, name, key="sample_url", buckets=n_buckets(), dealt=True)

    def write_dealt_by_join(df, folder, name):
        with dealt_by_bucket(spark, n_buckets()):
            write_dealt(df, folder, name)

    # What lies in a region.
    run.step("bioregions", ["landed regions"], lambda: read_polygons(spark, regions_path, name_property), [name_property])
    run.step(
        "deployments_in_region", ["landed deployments", "bioregions"],
        lambda: spatial.assign_regions(run.landed("deployments"), stored("bioregions"), cell_size), [cell_size])
    # Summed up per sample first, so that neither shuffle nor table holds a row for each length.
    run.step(
        "lengths_in_region", ["landed lengths", "landed life_history", "deployments_in_region"],
        lambda: metrics.in_region(
            summaries.sample_lengths(taxa.fish_lengths(run.landed("lengths"), life_history())),
            stored("deployments_in_region")))
    run.step(
        "deployments", ["deployments_in_region"],
        lambda: by_region(events.prepare_deployments(stored("deployments_in_region")), "sample_url"), lookup=["sample_url"])
    run.step("campaign_lookup", ["deployments"], lambda: events.campaign_lookup(deployments()))

    # Samples: sums per taxon, and the metrics. Counts move once: the join that keeps those
    # of the regions deals them to the buckets.
    def sums_in_region():
        counts = taxa.fish_counts(run.landed("counts"), life_history(), genus, species)
        return metrics.sample_taxa(metrics.in_region(counts, stored("deployments_in_region").hint("merge")))

    run.step(
        "sample_taxa", ["landed counts", "deployments_in_region", "landed life_history"], sums_in_region,
        lambda: [genus, species, n_buckets()], write_dealt_by_join)
    run.step(
        "samples", ["landed counts", "deployments"],  # of the counts, their size
        lambda: metrics.samples_with_events(
            deployments(), more=SAMPLE_COLUMNS, arrange=lambda rows: rows.repartition(n_buckets(), "sample_url")),
        lambda: [n_buckets()], write_dealt)
    run.step(
        "metrics", ["sample_taxa", "samples", "landed life_history"],
        lambda: metrics.metrics_of_samples(
            per_taxon(), samples(), life_history(), weight=weight,
            arrange=lambda rows: rows.repartitionByRange("bioregion", "sample_url"),
        ).sortWithinPartitions("metric", "bioregion", "sample_url"),
        [weight], partition_by=["metric"], lookup=["sample_url"])

    # Rankings: the lists and their splits by status come from one scan of the cube.
    run.step("cube", ["sample_taxa", "samples"], lambda: abundance.cube_rows(per_taxon(), samples()))
    run.step("rollup", ["cube"], lambda: abundance.rollup(stored("cube")))
    run.step("top_lists", ["rollup"], lambda: abundance.top_lists(stored("rollup")))
    run.step(
        "top_species", ["rollup", "top_lists", "landed life_history"],
        lambda: abundance.top_species_of(stored("rollup"), stored("top_lists"), life_history()))
    run.step(
        "top_species_year", ["cube", "top_lists", "landed life_history"],
        lambda: by_region(abundance.top_by_region_status_year(
            stored("cube"), stored("top_lists").where("group = 'bioregion'"), life_history()), "year"))

    # Summaries.
    def summarised(summary):
        summed = per_taxon().withColumnRenamed("total", "count")  # same sums, far fewer rows
        return summary(deployments(), summed, stored("lengths_in_region"))

    facts = ["deployments", "sample_taxa", "lengths_in_region"]
    run.step("overview_stats", facts, lambda: summarised(summaries.overview_stats))
    run.step("bioregion_stats", facts, lambda: summarised(summaries.region_stats))
    run.step("campaigns_csv", ["deployments"], lambda: campaign_list(deployments()).orderBy("row"), write=write_csv)


if __name__ == "__main__":
    paths = [value for value in sys.argv[1:] if value != "--resume"]
    print(refresh(build_session("shoalkit-refresh"), *paths, resume="--resume" in sys.argv))
