import json
import os

import pytest
from pyspark.sql import functions as F

from shoalkit.operators import abundance, events, metrics, spatial, summaries, taxa
from shoalkit.plans import views
from shoalkit.plans.refresh import inputs_of, refresh
from shoalkit.sources import bundle, geojson, landed
from tests.conftest import COUNTS, DEPLOYMENTS, LENGTHS, LIFE, deployment, rows

BOX = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]
EAST = [[[20, 0], [30, 0], [30, 10], [20, 10], [20, 0]]]


def collection():
    def feature(name, kind, coordinates):
        return {"type": "Feature", "properties": {"BIOREGION": name, "FID": 1}, "geometry": {"type": kind, "coordinates": coordinates}}

    return {"type": "FeatureCollection", "features": [feature("West", "Polygon", BOX), feature("East", "MultiPolygon", [EAST])]}


def land(make, folder):
    items = [
        deployment("s1", "C1", "2020-01-01", lon=5.0, lat=5.0), deployment("s2", "C1", "2020-03-01", lon=25.0, lat=5.0),
        deployment("s3", "C2", "2020-01-01", lon=50.0, lat=5.0), deployment("s4", "C2", None, lon=5.0, lat=6.0, status=None),
    ]
    counts = [("s1", "F", "G", "a", 3), ("s2", "F", "G", "b", 2), ("s3", "F", "G", "a", 9), ("s1", "M", "W", "w", 7)]
    lengths = [("s1", "F", "G", "a", 100.0, 1), ("s3", "F", "G", "a", 900.0, 1), ("s1", "M", "W", "w", 800.0, 1)]
    life = [("F", "G", "a", "Actinopterygii", 10.0, "Alpha"), ("F", "G", "b", "Actinopterygii", None, None),
            ("M", "W", "w", "Mammalia", 1.0, "Whale")]
    make(items, DEPLOYMENTS).drop("bioregion").write.parquet(os.path.join(folder, "deployments"))
    make(counts, COUNTS).write.parquet(os.path.join(folder, "counts"))
    make(lengths, LENGTHS).write.parquet(os.path.join(folder, "lengths"))
    make(life, LIFE).write.parquet(os.path.join(folder, "life_history"))
    path = os.path.join(folder, "regions.geojson")
    with open(path, "w") as out:
        json.dump(collection(), out, indent=1)
    return path


def test_refresh_writes_a_readable_bundle(spark, make, folder):
    regions = land(make, folder)
    out = os.path.join(folder, "out")
    run = refresh(spark, folder, out, regions, cell_size=1.0)
    assert bundle.latest_run(spark, out) == run
    tables = bundle.read_bundle(spark, out)
    assert set(tables) == set(bundle.TABLES)
    assert rows(tables["deployments"], "sample_url", "bioregion") == [("s1", "West"), ("s2", "East"), ("s4", "West")]
    assert rows(tables["overview_stats"], "num_bruvs", "num_fish", "num_lengths", "biggest_fish") == [(3, 5, 1, 100.0)]
    assert rows(tables["bioregion_stats"], "bioregion", "num_fish", "num_lengths") == [("East", 2, None), ("West", 3, 1)]
    assert rows(tables["bioregions"], "bioregion") == [("East",), ("West",)]

    # Each table equals the operators run straight on the restricted inputs.
    deployments = tables["deployments"]
    life = landed.read_landed(spark, folder, "life_history")
    counts = taxa.fish_counts(metrics.in_region(landed.read_landed(spark, folder, "counts"), deployments), life)
    per_taxon = metrics.sample_taxa(counts)
    direct = metrics.metrics_long(per_taxon, deployments, life)
    assert rows(tables["metrics"], *direct.columns) == rows(direct)
    cube = abundance.grid_cube(per_taxon, deployments)
    top = abundance.top_species(cube, abundance.top_overall(cube), abundance.top_by_region(cube), life)
    assert rows(tables["top_species"], *top.columns) == rows(top)
    assert views.top_species_view(tables["top_species"], "West", 1).first()["species"] == "a"
    listed = spark.read.option("header", True).csv(os.path.join(bundle.run_folder(out, run), "campaigns_csv"))
    assert rows(listed) == [("1", "C1"), ("2", "C2")]

    # A second run takes over; a failing one does not.
    second = refresh(spark, folder, out, regions, cell_size=1.0)
    assert bundle.latest_run(spark, out) == second != run
    with pytest.raises(Exception):
        refresh(spark, os.path.join(folder, "nowhere"), out, regions)
    assert bundle.latest_run(spark, out) == second
    assert bundle.read_run_log(spark, out).count() == 2


def written_at(spark, out, run):
    """Time of the last writing of every table of a run."""
    folder = bundle.run_folder(out, run)
    return {name: os.path.getmtime(os.path.join(folder, name, "_SUCCESS")) for name in os.listdir(folder)
            if os.path.exists(os.path.join(folder, name, "_SUCCESS")) and not name.endswith("_layout")}


def test_failed_refresh_goes_on_from_the_last_written_table(spark, make, folder, monkeypatch):
    regions = land(make, folder)
    out = os.path.join(folder, "out")

    def broken(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(metrics, "metrics_of_samples", broken)
        with pytest.raises(RuntimeError, match="lost"):
            refresh(spark, folder, out, regions, cell_size=1.0)
    run = bundle.unfinished_run(spark, out)
    before = written_at(spark, out, run)
    assert "sample_taxa" in before and "metrics" not in before and "cube" not in before
    assert set(bundle.finished_steps(spark, out, run)) == set(before)

    # What was written stays; the same values come out as of a run from the start.
    with monkeypatch.context() as patch:
        patch.setattr(metrics, "sample_taxa", broken)
        patch.setattr(spatial, "assign_regions", broken)
        assert refresh(spark, folder, out, regions, cell_size=1.0, resume=True) == run
    after = written_at(spark, out, run)
    assert {name: after[name] for name in before} == before
    assert bundle.latest_run(spark, out) == run and bundle.unfinished_run(spark, out) is None
    whole = refresh(spark, folder, out, regions, cell_size=1.0, resume=True)
    assert whole != run
    resumed, direct = bundle.read_bundle(spark, out, run), bundle.read_bundle(spark, out, whole)
    for name in set(bundle.TABLES) - {"bioregions"}:
        assert rows(resumed[name], *direct[name].columns) == rows(direct[name])


def test_resumed_refresh_writes_what_a_changed_input_reaches(spark, make, folder, monkeypatch):
    regions = land(make, folder)
    out = os.path.join(folder, "out")

    def broken(*args, **options):
        raise RuntimeError("lost")

    monkeypatch.setattr(summaries, "region_stats", broken)
    with pytest.raises(RuntimeError, match="lost"):
        refresh(spark, folder, out, regions, cell_size=1.0)
    run = bundle.unfinished_run(spark, out)
    before = written_at(spark, out, run)
    monkeypatch.undo()
    make([("s1", "F", "G", "a", 250.0, 1)], LENGTHS).write.mode("append").parquet(os.path.join(folder, "lengths"))
    assert refresh(spark, folder, out, regions, cell_size=1.0, weight="log", resume=True) == run
    after = written_at(spark, out, run)
    # The lengths and the weight of the index changed: their tables, the summaries and the index are new.
    again = {name for name in before if after[name] != before[name]}
    assert again == {"lengths_in_region", "metrics", "overview_stats"}
    assert set(after) - set(before) == {"bioregion_stats", "campaigns_csv"}
    assert bundle.read_bundle(spark, out)["overview_stats"].first()["biggest_fish"] == 250.0


def rows_read(df):
    """Rows that the scans of a query handed on."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_lookup_of_one_key_skips_row_groups_by_bloom_filter(spark, folder):
    # Keys lie in no order, so that least and greatest key of a row group tell nothing.
    keys = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("sample_url"), F.col("id").alias("value"))
    path = landed.write_table(keys.repartition(8, "value"), folder, "samples", lookup=["sample_url"])
    wanted = keys.where("value = 777").first()["sample_url"]
    read = spark.read.option("parquet.filter.columnindex.enabled", False)
    with_filter = read.parquet(path).where(F.col("sample_url") == wanted)
    without = read.option("parquet.filter.bloom.enabled", False).parquet(path).where(F.col("sample_url") == wanted)
    assert rows(with_filter, "value") == rows(without, "value") == [(777,)]
    assert rows_read(without) == 40_000 and rows_read(with_filter) < 15_000


def test_missing_landed_column(spark, make, folder):
    make([("s1",)], "sample_url string").write.parquet(os.path.join(folder, "counts"))
    with pytest.raises(ValueError, match="counts has no column family"):
        landed.read_landed(spark, folder, "counts")


def test_metric_filter_prunes_partitions(spark, make, folder):
    data = make([("cti", 1.0, "North"), ("other", 2.0, "North")], "metric string, value double, bioregion string")
    path = landed.write_table(data, folder, "metrics", ["metric"])
    plan = views.metric_rows(spark.read.parquet(path), "North", "cti")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(metric" in plan and "PushedFilters: [IsNotNull(bioregion), EqualTo(bioregion,North)]" in plan


def test_geojson_lines_and_bbox(spark, folder):
    path = os.path.join(folder, "regions.geojsonl")
    with open(path, "w") as out:
        for feature in collection()["features"]:
            out.write(json.dumps(feature) + "\n")
    layer = geojson.read_polygons(spark, path)
    assert rows(layer, "bioregion", "bbox.minx", "bbox.maxy") == [("East", 20.0, 10.0), ("West", 0.0, 10.0)]


def test_life_history_from_csv(spark, folder):
    path = os.path.join(folder, "life.csv")
    with open(path, "w") as out:
        out.write("family,genus,species,class,rls_thermal_niche,australian_common_name\nF,G,a,Actinopterygii,10.5,NA\n")
    assert rows(landed.read_life_history_csv(spark, path)) == [("F", "G", "a", "Actinopterygii", 10.5, None)]


def feature(name, coordinates=BOX, **more):
    return {"type": "Feature", "properties": {"BIOREGION": name, **more}, "geometry": {"type": "Polygon", "coordinates": coordinates}}


def written(folder, **files):
    for name, text in files.items():
        with open(os.path.join(folder, name), "w") as out:
            out.write(text)
    return folder


def test_geojson_is_read_by_the_content_of_each_file(spark, folder):
    lines = "\n".join(json.dumps(feature(n, note='a "FeatureCollection" here')) for n in "ABC")
    pretty = json.dumps(feature("D"), indent=1).replace('{\n "type"', '{ "type"', 1)
    whole = json.dumps({"type": "FeatureCollection", "features": [feature("E"), feature("E")]}, indent=2)
    path = written(folder, one=lines, two=pretty, three=whole, four=json.dumps(collection()) + "\n\n",
                   five='{\n"type": "FeatureCollection",\n"features": [\n' + ",\n".join(json.dumps(feature(n)) for n in "FG") + "\n]\n}\n")
    layer = geojson.read_polygons(spark, path)
    assert rows(layer, "bioregion") == [(n,) for n in ("A", "B", "C", "D", "E", "E", "East", "F", "G", "West")]
    assert layer.select("feature").distinct().count() == 10
    assert pretty.startswith('{ "type": "Feature",')
    for name, n in (("one", 3), ("two", 1), ("three", 2), ("four", 2), ("five", 2)):
        assert geojson.read_polygons(spark, os.path.join(path, name)).count() == n


@pytest.mark.parametrize("text", [
    json.dumps({"type": "Feature", "properties": {"bioregion": "A"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}),
    json.dumps(feature("A")) + "\n{broken", json.dumps(feature("A"), indent=1) * 2, "not JSON", "{}", json.dumps({"type": "FeatureCollection", "features": []}),
])
def test_geojson_that_cannot_be_read_is_an_error(spark, folder, text):
    path = written(folder, good=json.dumps(feature("B")), bad=text)
    with pytest.raises(ValueError, match="give no polygon"):
        geojson.read_polygons(spark, path)


def test_geojson_without_the_name_is_an_error(spark, make, folder):
    regions = land(make, folder)
    with pytest.raises(ValueError, match="no feature has the property zone"):
        geojson.read_polygons(spark, regions, "zone")
    out = os.path.join(folder, "out")
    with pytest.raises(ValueError, match="no feature has the property zone"):
        refresh(spark, folder, out, regions, name_property="zone")
    assert not os.path.exists(os.path.join(out, bundle.RUN_LOG))
    # A feature without a name keeps its polygon; its deployments are in no region.
    path = written(folder, mixed=json.dumps(feature("A")) + "\n" + json.dumps(feature(None, EAST)))
    assert rows(geojson.read_polygons(spark, os.path.join(path, "mixed")), "bioregion") == [("A",), (None,)]


def test_lengths_are_stored_summed_up_per_sample(spark, make, folder):
    regions = land(make, folder)
    more = [("s1", "F", "G", "b", 120.0, None), ("s1", "F", "G", "a", None, 4), ("s2", "F", "G", "a", 50.0, None), (None, "F", "G", "a", 990.0, 1)]
    make(more, LENGTHS).write.mode("append").parquet(os.path.join(folder, "lengths"))
    out = os.path.join(folder, "out")
    run = refresh(spark, folder, out, regions, cell_size=1.0)
    stored = spark.read.parquet(os.path.join(bundle.run_folder(out, run), "lengths_in_region"))
    assert rows(stored) == [("s1", 5, 120.0), ("s2", None, 50.0)]
    # The summaries equal those of the single lengths.
    tables, life = bundle.read_bundle(spark, out), landed.read_landed(spark, folder, "life_history")
    single = metrics.in_region(taxa.fish_lengths(landed.read_landed(spark, folder, "lengths"), life), tables["deployments"])
    counts = taxa.fish_counts(metrics.in_region(landed.read_landed(spark, folder, "counts"), tables["deployments"]), life)
    assert rows(tables["bioregion_stats"]) == rows(summaries.region_stats(tables["deployments"], counts, single))
    assert rows(tables["overview_stats"]) == rows(summaries.overview_stats(tables["deployments"], counts, single))


def test_named_tables_are_made_with_what_they_need_and_no_more(spark, make, folder):
    regions = land(make, folder)
    out = os.path.join(folder, "out")
    assert inputs_of("campaign_lookup") == ["deployments", "regions"]
    assert inputs_of("metrics") == ["deployments", "counts", "life_history", "regions"]
    run = refresh(spark, folder, out, regions, cell_size=1.0, tables=["campaign_lookup"])
    before = written_at(spark, out, run)
    assert set(before) == {"bioregions", "deployments_in_region", "deployments", "campaign_lookup"}
    # Readers do not see the run before it is whole.
    with pytest.raises(Exception):
        bundle.latest_run(spark, out)
    assert refresh(spark, folder, out, regions, cell_size=1.0, resume=True, tables=["metrics", "campaign_lookup"]) == run
    assert set(written_at(spark, out, run)) == set(before) | {"sample_taxa", "samples", "metrics"}
    assert refresh(spark, folder, out, regions, cell_size=1.0, resume=True) == run == bundle.latest_run(spark, out)
    after = written_at(spark, out, run)
    assert {name: after[name] for name in before} == before
    whole = refresh(spark, folder, out, regions, cell_size=1.0)
    assert set(written_at(spark, out, whole)) == set(after)
    some, direct = bundle.read_bundle(spark, out, run), bundle.read_bundle(spark, out, whole)
    for name in set(bundle.TABLES) - {"bioregions"}:
        assert rows(some[name], *direct[name].columns) == rows(direct[name])
    with pytest.raises(ValueError, match="makes no such"):
        refresh(spark, folder, out, regions, cell_size=1.0, tables=["such"])
