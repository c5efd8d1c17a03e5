from datetime import date

import pytest

from shoalkit.operators import locations, summaries
from shoalkit.operators.events import prepare_deployments
from shoalkit.plans import views
from shoalkit.schemas import require_columns
from tests.conftest import COUNTS, DEPLOYMENTS, LENGTHS, deployment, rows

METRICS = ("sample_url string, sample string, metric string, value double, bioregion string, status string, "
           "start_month string")


def test_mean_and_error_of_small_groups(make):
    data = make([
        ("s1", "1", "cti", 2.0, "North", "Fished", "2020-01"), ("s2", "2", "cti", 4.0, "North", "Fished", "2020-01"),
        ("s3", "3", "cti", 5.0, "North", "No-Take", "2020-01"), ("s4", "4", "cti", None, "North", None, None),
        ("s5", "5", "cti", 9.0, "South", "Fished", "2020-01"),
    ], METRICS)
    assert rows(views.metric_timeseries(data, "North", "cti")) == [
        (date(2020, 1, 1), "Fished", 2, 3.0, 1.0, 2.0, 4.0),
        (date(2020, 1, 1), "No-Take", 1, 5.0, 0.0, 5.0, 5.0),
        (None, None, 0, None, 0.0, None, None),
    ]
    by_status = views.metric_mean_se(data, ["North"], "cti", ["zone", "status"])
    assert rows(by_status, "grp", "n", "mean", "se") == [("Fished", 2, 3.0, 1.0), ("No-Take", 1, 5.0, 0.0), (None, 0, None, 0.0)]
    fallback = views.metric_mean_se(data, ["North", "South"], "cti", ["zone"])
    assert rows(fallback, "grp", "n") == [("North", 3), ("South", 1)]


def test_missing_column_and_empty_result(make):
    data = make([], METRICS)
    with pytest.raises(ValueError, match="no column period"):
        views.metric_timeseries(data, "North", "cti", "period")
    with pytest.raises(ValueError, match="metrics has no column"):
        require_columns(data, ["x"], "metrics")
    assert views.metric_timeseries(data, "North", "cti").count() == 0


def test_map_points(make):
    sites = prepare_deployments(make(
        [deployment("s1", lon=1.0, lat=2.0), deployment("s2", lon=3.0, lat=4.0), deployment("s3", lon=None)], DEPLOYMENTS))
    data = make([
        ("s1", "x", "cti", 10.0, "North", "Fished", None), ("s2", "x", "cti", 20.125, "North", "Fished", None),
        ("s3", "x", "cti", 30.0, "North", "Fished", None), ("s1", "x", "cti", None, "North", "Fished", None),
    ], METRICS)
    points = views.metric_map(data, sites, "North", "cti")
    assert rows(points, "sample_url", "longitude_dd", "shown_value", "radius") == [
        ("s1", 1.0, 10.0, 4.0), ("s2", 3.0, 20.12, 14.0)]
    one = views.metric_map(data.where("sample_url = 's1'"), sites, "North", "cti")
    assert rows(one, "radius") == [(8.0,)]


def test_coordinates_by_first_shared_identifier(make):
    located = make([("s1", 1.0, 2.0)], "sample_url string, longitude_dd double, latitude_dd double")
    assert views.attach_coordinates(located, located) is located
    by_sample = views.attach_coordinates(
        make([("7", 1.0)], "sample string, value double"),
        make([("u", "7", 5.0, 6.0)], "sample_url string, sample string, longitude_dd double, latitude_dd double"))
    assert rows(by_sample, "sample", "longitude_dd") == [("7", 5.0)]
    with pytest.raises(ValueError, match="share none"):
        views.attach_coordinates(make([(1.0,)], "value double"), located)


def test_figures_as_text(make):
    stats = make([("North", 1234, 1234567, 5, "1999", "2020", 0.5, 120.0, 10.5)],
                 "bioregion string, num_bruvs long, num_fish long, num_lengths long, min_year string, max_year string, "
                 "min_depth double, max_depth double, average_depth double")
    assert rows(views.overview_kpis(stats)) == [("1,234", "1,234,567", "5", "1999 - 2020", "0.5 - 120 m", "10 m")]
    assert rows(views.region_kpis(stats, "North"), "bioregion", "average_depth") == [("North", "10 m")]


def test_overview_and_regions(make):
    sites = prepare_deployments(make([
        deployment("s1", date="2019-01-01", depth=4.0), deployment("s2", date="2020-01-01", depth=8.0),
        deployment("s3", region="South", depth=6.0), deployment("s4", ok=False, depth=99.0)], DEPLOYMENTS))
    counts = make([("s1", "F", "G", "a", 3), ("s1", "F", "G", "b", None), ("s4", "F", "G", "a", 2), ("s1", None, "G", "a", 50)], COUNTS)
    lengths = make([("s1", "F", "G", "a", 120.0, 2), ("s2", "F", "G", "a", None, None)], LENGTHS)
    overall = summaries.overview_stats(sites, counts, lengths)
    assert rows(overall, "num_bruvs", "num_fish", "num_lengths", "biggest_fish", "min_year", "max_depth", "average_depth") == [
        (3, 55, 2, 120.0, "2019", 8.0, 6.0)]
    regions = summaries.region_stats(sites, counts, lengths)
    assert rows(regions, "bioregion", "num_bruvs", "num_fish", "num_lengths", "biggest_fish") == [
        ("North", 2, 5, 2, 120.0), ("South", 1, 0, None, None)]


TOP = ("bioregion string, status string, family string, genus string, species string, average_abundance double, "
       "se double, `group` string, by_status boolean, display_name string, label string")


def test_top_species_view_orders_by_overall_abundance(make):
    def entry(name, mean, status=None, by_status=False, family="F"):
        return ("North", status, family, "G", name, mean, 0.5, "bioregion", by_status, f"G {name}", f"*{name}*")

    top = make([entry("a", 3.0), entry("b", 1.0), entry("c", 2.0), entry("d", None),
                entry("a", 9.0, "Fished", True), entry("c", 8.0, "Fished", True), entry("b", 7.0, "Fished", True)], TOP)
    view = views.top_species_view(top, "North", 2)
    assert rows(view, "species", "lower", "upper", "order_index") == [("a", 2.5, 3.5, 2), ("c", 1.5, 2.5, 1)]
    split = views.top_species_view(top, "North", 2, by_status=True)
    assert rows(split, "species", "status", "order_index") == [("a", "Fished", 2), ("c", "Fished", 1)]


def test_top_species_in_a_year(make):
    rows_in = [("North", s, y, "F", "G", n, m, 0.1, f"G {n}", f"*{n}*") for s, y, n, m in [
        ("Fished", "2019", "a", 1.0), ("No-Take", "2019", "a", 1.0), ("Fished", "2019", "b", 3.0),
        ("Fished", "2019", "c", 0.5), ("Fished", "2021", "c", 1.0), ("Fished", None, "c", 9.0)]]
    top = make(rows_in, "bioregion string, status string, year string, family string, genus string, species string, "
                        "average_abundance double, se double, display_name string, label string")
    assert rows(views.top_species_in_year(top, "North", 2019, 2), "species", "status", "order_index") == [
        ("a", "Fished", 1), ("a", "No-Take", 1), ("b", "Fished", 2)]
    assert rows(views.top_species_in_year(top, "North", n=5), "year").count(("2019",)) == 4
    assert rows(views.top_species_in_year(top, "North", n=5, side="right"), "year", "species") == [("2021", "c")]
    assert rows(views.year_choices(top, "North")) == [("2019",), ("2021",)]


def test_metric_labels_fall_back(make):
    data = make([("cti",), ("other",)], "metric string")
    assert rows(views.metric_labels(data)) == [("cti", "Community temperature index (°C)"), ("other", "other")]


def test_region_deployments(make):
    sites = make([deployment("s1"), deployment("s2", region="South")], DEPLOYMENTS)
    assert rows(views.region_deployments(sites, "South"), "sample_url", "method") == [("s2", "BRUVs")]
    assert views.region_deployments(sites).count() == 2


def bundle(make):
    where = "location string, longitude_dd double, latitude_dd double"
    return {
        "deployment_locations": make([("s1", "P", 1.0, 2.0, "video"), ("s2", "P", 3.0, 4.0, "video"), ("s9", "Q", 0.0, 0.0, "video")],
                                     f"sample_url string, {where}, method string"),
        "deployment_locations_diver": make([("d1", "P", 5.0, 6.0)], f"sample_url string, {where}"),
        "bubble_data": make([("s1", "P", "G a (A)", 4), ("s1", "P", "G b (B)", 7)],
                            "sample_url string, location string, display_name string, count long"),
        "metric_bubble_data": make([("P", "total_abundance", 10.0), ("P", "total_abundance", 5.0), ("P", "total_abundance", 0.0),
                                    ("P", "total_abundance", None), ("P", "cti", 50.0)],
                                   "location string, metric string, value double"),
        "top_species_location": make([("P", "video", "G a (A)", 5), ("P", "diver", "G a (A)", 2), ("P", "video", "G b (B)", 7),
                                      ("P", "video", "C c (C)", 7)],
                                     "location string, method string, display_name string, total_number long"),
        "years_park": make([("P", 2018, 3, "video"), ("P", 2020, 1, "diver")], "location string, year int, n long, method string"),
    }


def test_location_views(make):
    park = locations.location_bundle(bundle(make), "P")
    assert ("deployment_locations_diver", 1) in rows(locations.bundle_sizes(park), "table_name", "n")
    assert park["deployment_locations"].count() == 2
    assert rows(locations.location_deployments(park), "sample_url", "method") == [("d1", None), ("s1", "video"), ("s2", "video")]
    ranked = [tuple(r) for r in locations.species_ranking(park["top_species_location"]).collect()]
    assert ranked == [("C c (C)", 7), ("G a (A)", 7), ("G b (B)", 7)]
    assert rows(locations.effort_by_year(park["years_park"])) == [(2018, "video", 3), (2019, None, 0), (2020, "diver", 1)]
    by_method = locations.species_by_method(park["top_species_location"])
    assert rows(by_method, "method", "order_index", "label") == [
        ("diver", 1, "<i>G a</i><span> (A)</span>"), ("video", 1, "<i>G a</i><span> (A)</span>"),
        ("video", 2, "<i>C c</i><span> (C)</span>"), ("video", 3, "<i>G b</i><span> (B)</span>")]


def test_bubbles(make):
    park = locations.location_bundle(bundle(make), "P")
    assert rows(locations.metric_bubbles(park, "Total abundance"), "value", "is_zero", "radius") == [
        (0.0, True, 5.0), (5.0, False, 35.0), (10.0, False, 60.0)]
    species = locations.species_bubbles(park, ["G a (A)"])
    assert rows(species, "sample_url", "display_name", "count", "radius") == [("s1", "G a (A)", 4, 60.0), ("s2", None, 0, 5.0)]
    nowhere = locations.location_bundle(bundle(make), "Z")
    assert rows(locations.metric_bubbles(nowhere, "Total abundance")) == []
    assert rows(locations.species_bubbles(nowhere, ["G a (A)"])) == []
    picked = locations.default_species(park, 1)
    assert rows(locations.species_bubbles(park, picked), "sample_url", "count") == [("s1", 0), ("s2", 0)]


def test_species_pages(make):
    pages = make([("G a (A)", "u1"), ("G a (A)", "u1"), ("G b (B)", "u2")], "display_name string, url string")
    assert rows(locations.species_pages(pages, ["G a (A)"])) == [("u1",)]
