"""The driver's Parquet tables read as survey tables (see FIXTURES.md)."""

import json
import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixture.layers import shapefile
from shoalkit.functions.datum import WGS84
from shoalkit.operators import abundance, events, metrics, taxa
from shoalkit.plans.refresh import inputs_of, refresh
from shoalkit.scaling import cut_lineage, temporary_folder
from shoalkit.schemas import DEPLOYMENTS_RAW, TAXON
from shoalkit.sources import bundle
from shoalkit.sources.bucketed import read_bucketed
from shoalkit.sources.geojson import read_polygons
from shoalkit.sources.landed import write_table
from shoalkit.sources.shapefile import read_shapefile

# The genus whose species are merged, in the words of the test data.
GENUS, SPECIES = "gear", "red"

# Declared, so that opening a table runs no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "embeddings": "vec_id long, embedding array<float>, label int",
}

POLYGONS = {
    "Square": [(-0.3, -0.3), (-0.1, -0.3), (-0.1, -0.1), (-0.3, -0.1)],
    "Triangle": [(0.0, 0.05), (0.25, 0.05), (0.1, 0.3)],
    "Concave": [(-0.1, -0.25), (0.3, -0.25), (0.3, 0.0), (0.1, -0.2), (-0.1, 0.0)],
    "Overlap A": [(-0.25, 0.0), (0.05, 0.0), (0.05, 0.25), (-0.25, 0.25)],
    "Overlap B": [(-0.1, 0.05), (0.15, 0.05), (0.15, 0.35), (-0.1, 0.35)],
}


# Two regions of the deployments, as (west, east) longitudes; the rest lies in neither.
# No deployment lies on a border.
STRIPS = {"West": (149.0, 155.005), "East": (155.005, 159.005)}
STRIP_RINGS = {name: [(w, -40), (e, -40), (e, -29), (w, -29)] for name, (w, e) in STRIPS.items()}

# Regions with long edges, whose arcs leave the chords by up to a fifth of a degree.
WIDE_RINGS = {
    "Box": [(149.003, -36.007), (161.003, -36.007), (161.003, -31.003), (149.003, -31.003)],
    "Wedge": [(148.003, -38.507), (162.507, -33.503), (150.503, -30.001)],
    "Needle": [(155.0031, -38.003), (155.0137, -30.003), (155.0633, -34.001)],
}
# The datum, by its EPSG code, from which the sites are shifted.
OLD_DATUM = 4202

# For a session and folder: where its refresh lies, what is landed there, the run's id, and which tables are made.
_RUNS = {}


class Survey:
    """Survey tables over one directory of test data; everything is built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(os.path.join(self.folder, f"{name}.parquet"))

    @cached_property
    def _orders(self):
        # Customers first, so that each join has one plainly smaller side.
        return (
            self.table("orders")
            .join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation").select("n_nationkey", "n_name", "n_regionkey"),
                  F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        )

    @cached_property
    def _raw_deployments(self):
        key = F.col("o_orderkey")
        return self._orders.select(
            key.cast("string").alias("sample_url"),
            F.col("o_custkey").cast("string").alias("campaignid"),
            (key % 100).cast("string").alias("sample"),
            F.col("o_orderdate").cast("timestamp").alias("date_time"),
            (150 + (key % 1000) / 100).alias("longitude_dd"),
            (-38 + (key % 777) / 100).alias("latitude_dd"),
            F.when(F.col("o_orderstatus") == "F", "Fished").when(F.col("o_orderstatus") == "O", "No-Take").alias("status"),
            (F.col("o_orderpriority") != "5-LOW").alias("successful_count"),
            (~F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED")).alias("successful_length"),
            (F.col("o_totalprice") / 10000).alias("depth_m"),
            F.col("r_name").alias("bioregion"),
            F.col("n_name").alias("location"),
            F.when(key % 3 == 0, "UVC").otherwise("stereo-BRUVs").alias("method"),
        )

    @cached_property
    def deployments(self):
        return events.prepare_deployments(self._raw_deployments).drop("location", "method")

    @cached_property
    def _lines(self):
        words = F.split("p_name", " ")
        # The taxon is worked out once per part, not once per line.
        parts = self.table("part").select(
            "p_partkey", F.col("p_type").alias("family"), words[1].alias("genus"), words[0].alias("species")
        )
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"
        )
        return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").cast("string").alias("sample_url"), *TAXON,
            F.col("l_quantity").cast("long").alias("count"),
            (F.col("l_extendedprice") / 100).alias("length_mm"),
            "l_returnflag", "l_linestatus",
        )

    @cached_property
    def raw_counts(self):
        return self._lines.select("sample_url", *TAXON, "count")

    @cached_property
    def raw_lengths(self):
        return self._lines.select("sample_url", *TAXON, "length_mm", "count")

    @cached_property
    def life_history(self):
        words = F.split("p_name", " ")
        first = F.col("first")
        return (
            self.table("part")
            .groupBy(F.col("p_type").alias("family"), words[1].alias("genus"), words[0].alias("species"))
            .agg(F.min("p_partkey").alias("first"), F.min("p_brand").alias("brand"))
            .select(
                *TAXON,
                F.when(F.col("family") == "PROMO", "Mammalia").when(F.col("family") == "SMALL", "Elasmobranchii")
                .otherwise("Actinopterygii").alias("class"),
                F.when(first % 11 != 0, 10.0 + first % 20).alias("rls_thermal_niche"),
                F.when(first % 13 != 0, F.col("brand")).alias("australian_common_name"),
            )
        )

    def land(self, folder, name) -> None:
        """Write an input of a refresh below ``folder``."""
        if name == "regions":
            self._layer(os.path.join(folder, name), STRIP_RINGS)
        elif name == "deployments":
            write_table(self._raw_deployments.select(*DEPLOYMENTS_RAW.names), folder, name)
        else:
            write_table({"counts": self.raw_counts, "lengths": self.raw_lengths, "life_history": self.life_history}[name], folder, name)

    def _layer(self, path, rings) -> str:
        """Write polygons as GeoJSON, a feature per line; returns the path."""
        lines = [
            (json.dumps({"type": "Feature", "properties": {"Bioregion": name},
                         "geometry": {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}}),)
            for name, ring in rings.items()
        ]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
        return path

    def polygons_read(self, rings, crs=WGS84):
        """Polygons that went through a GeoJSON layer and its reader."""
        return read_polygons(self.spark, self._layer(temporary_folder(self.spark, "layer"), rings), crs=crs)

    def shapes_read(self, rings):
        """Polygons that went through a shapefile of several parts and its reader."""
        path = os.path.join(temporary_folder(self.spark, "layer"), "regions")
        files = shapefile([((name,), [[*ring, ring[0]]]) for name, ring in rings.items()])
        for suffix, content in files.items():
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path + suffix)
            stream = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(target)
            stream.write(bytearray(content))
            stream.close()
        return read_shapefile(self.spark, path + ".shp", partition_bytes=200)

    def _refreshed(self, *tables):
        """Output folder and run id of a refresh over this folder that has made ``tables``, or all if none is named.

        One run serves all queries of a session: each resumes it for what it reads and
        nobody made before. A refresh that made all of them is finished.
        """
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _RUNS:
            _RUNS[key] = {"folder": temporary_folder(self.spark, "refresh"), "landed": set(), "run": None, "made": set(), "whole": False}
        state = _RUNS[key]
        folder, out = state["folder"], os.path.join(state["folder"], "out")
        if not state["whole"] and not (tables and state["made"].issuperset(tables)):
            for name in inputs_of(*tables) if tables else ["deployments", "counts", "lengths", "life_history", "regions"]:
                if name not in state["landed"]:
                    self.land(folder, name)
                    state["landed"].add(name)
            state["run"] = refresh(
                self.spark, folder, out, os.path.join(folder, "regions"), cell_size=1.0, genus=GENUS, species=SPECIES,
                resume=True, tables=tables or None)
            state["made"].update(tables)
            state["whole"] = not tables
        return out, state["run"]

    def served_table(self, name) -> DataFrame:
        """One table of a refresh over this folder."""
        out, run = self._refreshed(name)
        run_dir = bundle.run_folder(out, run)
        if name in ("sample_taxa", "samples"):
            return read_bucketed(self.spark, run_dir, name)
        return self.spark.read.parquet(os.path.join(run_dir, name))

    @property
    def served(self):
        """Tables of a whole refresh over this folder."""
        out, run = self._refreshed()
        tables = dict(bundle.read_bundle(self.spark, out, run))
        run_dir = bundle.run_folder(out, run)
        for name in ("campaign_lookup", "sample_taxa"):
            tables[name] = self.served_table(name)
        tables["campaigns_csv"] = self.spark.read.option("header", True).csv(os.path.join(run_dir, "campaigns_csv"))
        tables["run_log"] = bundle.read_run_log(self.spark, out)
        return tables

    @property
    def served_samples(self):
        """Samples with their events as the refresh stored them, in buckets."""
        return self.served_table("samples")

    @cached_property
    def counts(self):
        return taxa.fish_counts(self.raw_counts, self.life_history, GENUS, SPECIES)

    @cached_property
    def small_taxa(self):
        return self.life_history.where(F.col("family") == "SMALL").select(*TAXON)

    @cached_property
    def lengths(self):
        return taxa.fish_lengths(self.raw_lengths, self.life_history)

    @cached_property
    def per_taxon(self):
        return metrics.sample_taxa(self.counts)

    @cached_property
    def metrics(self):
        return metrics.metrics_long(self.per_taxon, self.deployments, self.life_history)

    @cached_property
    def cube(self):
        return abundance.grid_cube(self.per_taxon, self.deployments)

    @cached_property
    def rollup(self):
        return cut_lineage(abundance.rollup(abundance.cube_rows(self.per_taxon, self.deployments)))

    @cached_property
    def top_overall(self):
        return cut_lineage(abundance.top_overall(self.rollup))

    @cached_property
    def top_region(self):
        return cut_lineage(abundance.top_by_region(self.cube))

    @cached_property
    def top_species(self):
        return abundance.top_species_of(self.rollup, cut_lineage(abundance.top_lists(self.rollup)), self.life_history)

    @cached_property
    def top_species_year(self):
        return abundance.top_by_region_status_year(self.cube, self.top_region, self.life_history)

    @cached_property
    def points(self):
        vector = F.col("embedding")
        return self.table("embeddings").select(
            "vec_id", vector[0].cast("double").alias("longitude_dd"), vector[1].cast("double").alias("latitude_dd")
        )

    @cached_property
    def sites(self):
        return self._raw_deployments.select("sample_url", "longitude_dd", "latitude_dd")

    @cached_property
    def species_pages(self):
        """Page address of every species, by its display name."""
        named = taxa.add_common_names(self.life_history.select(*TAXON), self.life_history)
        return named.select(taxa.display_name().alias("display_name"), F.concat_ws("/", F.lit("pages"), "family", "genus").alias("url"))

    @property
    def polygons(self):
        return self.layer_of(POLYGONS)

    def layer_of(self, rings):
        rows = [
            (i, name, [[(float(x), float(y)) for x, y in ring + ring[:1]]])
            for i, (name, ring) in enumerate(rings.items())
        ]
        return self.spark.createDataFrame(
            rows, "feature long, bioregion string, rings array<array<struct<x:double,y:double>>>"
        )

    # Tables by location (the nation) for the two survey methods.

    @cached_property
    def _sites(self):
        return self._raw_deployments.select("sample_url", "location", "method", "longitude_dd", "latitude_dd")

    @cached_property
    def _seen(self):
        # Names and sums come after the join, so that a filter on the location leaves few rows to them.
        sites = self._sites.select("sample_url", "location", "method")
        named = taxa.add_common_names(self.counts.join(sites, "sample_url"), self.life_history)
        return (
            named.groupBy("sample_url", "location", "method", taxa.display_name().alias("display_name"))
            .agg(F.sum("count").alias("count"))
        )

    def _by_method(self, df, name):
        return df.where(F.col("method") == ("UVC" if name.endswith("_diver") else "stereo-BRUVs"))

    def _lengths_by_place(self):
        named = taxa.add_common_names(taxa.keep_fish(self._lines, taxa.fish_taxa(self.life_history)), self.life_history)
        lengths = named.select(
            "sample_url", taxa.display_name().alias("display_name"), "length_mm",
            F.when(F.col("l_returnflag") == "R", "UVC").otherwise("stereo-BRUVs").alias("method"),
            F.when(F.col("l_linestatus") == "F", "Commonwealth").otherwise("State").alias("jurisdiction"),
        )
        places = self._raw_deployments.select("sample_url", "location", "status")
        return lengths.join(places, "sample_url").drop("sample_url")

    def location_table(self, name) -> DataFrame:
        kind = name.removesuffix("_diver")
        if kind == "deployment_locations":
            return self._by_method(self._sites, name)
        if kind == "metric_bubble_data":
            values = self.metrics.select("sample_url", "metric", "value")
            return self._by_method(values.join(self._sites, "sample_url"), name)
        if kind == "bubble_data":
            return self._by_method(self._seen, name)
        if kind == "length_with_jurisdiction":
            return self._lengths_by_place()
        if kind == "top_species_location":
            return self._seen.groupBy("location", "method", "display_name").agg(F.sum("count").alias("total_number"))
        if kind == "years_park":
            year = F.year("date_time").alias("year")
            return self._raw_deployments.groupBy("location", year, "method").agg(F.count(F.lit(1)).alias("n"))
        return self._raw_deployments.select("location", "depth_m", "method")
