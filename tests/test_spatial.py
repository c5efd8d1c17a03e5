import math
import random

import pytest

from shoalkit.operators import events, locations, spatial, summaries
from tests.conftest import COUNTS, DEPLOYMENTS, LENGTHS, deployment, rows

SHAPES = "feature long, bioregion string, rings array<array<struct<x:double,y:double>>>"
POINTS = "id string, longitude_dd double, latitude_dd double"


def ring(*points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


SQUARE = (1, "Square", [ring((0, 0), (2, 0), (2, 2), (0, 2))])
CONCAVE = (2, "Concave", [ring((3, 0), (7, 0), (7, 4), (5, 1), (3, 4))])
HOLED = (3, "Holed", [ring((-5, -5), (-1, -5), (-1, -1), (-5, -1)), ring((-4, -4), (-2, -4), (-2, -2), (-4, -2))])
OVER = (4, "Over", [ring((1, 1), (3, 1), (3, 3), (1, 3))])


@pytest.mark.parametrize("cell_size", [0.3, 1.0, 50.0])
def test_inside_edges_corners_holes(make, cell_size):
    polygons = make([SQUARE, CONCAVE, HOLED], SHAPES)
    expected = {
        "inside": (0.5, 0.5, "Square"), "outside": (2.5, 0.5, None), "left edge": (0.0, 1.0, "Square"),
        "right edge": (2.0, 1.0, "Square"), "bottom edge": (1.0, 0.0, "Square"), "top edge": (1.0, 2.0, "Square"),
        "corner": (2.0, 2.0, "Square"), "notch": (5.0, 2.0, None), "arm": (3.2, 3.0, "Concave"),
        "hole": (-3.0, -3.0, None), "rim": (-4.5, -3.0, "Holed"), "hole edge": (-4.0, -3.0, "Holed"),
        "no longitude": (None, 1.0, None), "no latitude": (1.0, None, None), "far": (170.0, -45.0, None),
    }
    points = make([(k, x, y) for k, (x, y, _) in expected.items()], POINTS)
    found = rows(spatial.assign_regions(points, polygons, cell_size), "id", "bioregion")
    assert found == sorted((k, region) for k, (_, _, region) in expected.items() if region)


def test_point_in_two_polygons_gives_two_rows(make):
    found = spatial.assign_regions(make([("p", 1.5, 1.5)], POINTS), make([SQUARE, OVER], SHAPES), 0.4)
    assert rows(found, "id", "bioregion") == [("p", "Over"), ("p", "Square")]


def inside(x, y, rings):
    odd = False
    for points in rings:
        for (x1, y1), (x2, y2) in zip(points, points[1:]):
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                odd = not odd
    return odd


@pytest.mark.parametrize("max_rows", [10**6, 1])
def test_both_join_ways_equal_a_test_of_every_pair(make, max_rows):
    rng = random.Random(7)
    shapes = [SQUARE, CONCAVE, HOLED, OVER]
    data = [(str(i), rng.uniform(-6, 8), rng.uniform(-6, 5)) for i in range(400)]
    expected = sorted((k, name) for k, x, y in data for _, name, rings in shapes if inside(x, y, rings))
    found = spatial.assign_regions(make(data, POINTS), make(shapes, SHAPES), 0.5, max_rows=max_rows)
    assert rows(found, "id", "bioregion") == expected


def test_bounds_and_centre(make):
    points = make([("a", 1.0, -2.0), ("b", 4.0, 6.0), ("c", None, None)], POINTS)
    assert rows(summaries.bounds(points)) == [(1.0, -2.0, 4.0, 6.0)]
    assert rows(summaries.map_centre(points)) == [(2.5, 2.0)]


def test_polygon_listed_twice_and_polygon_without_a_name(make):
    again = (9, *SQUARE[1:])
    points = make([("in", 0.5, 0.5), ("out", 2.5, 0.5)], POINTS)
    found = spatial.assign_regions(points, make([SQUARE, again, (5, None, SQUARE[2])], SHAPES), 0.7)
    assert rows(found, "id", "bioregion") == [("in", "Square"), ("in", "Square")]


def coast(n):
    """A ring of ``n`` vertices that winds in and out."""
    points = []
    for i in range(n):
        angle, radius = 2 * math.pi * i / n, 3 + 0.4 * math.sin(17 * 2 * math.pi * i / n) + 0.01 * (i % 7)
        points.append((radius * math.cos(angle), radius * math.sin(angle)))
    return ring(*points)


@pytest.mark.parametrize("cell_size", [0.25, 0.6])
def test_edges_of_a_long_ring_stay_in_their_cells(make, cell_size):
    shape = (1, "Coast", [coast(20_000)])
    index = spatial.cell_index(make([shape], SHAPES), cell_size).collect()
    tested = sum(len(r.edges or []) + len(r.turns) for r in index)
    # Every edge is listed in the few cells it passes through, and long chains leave few turns.
    assert tested < 1.5 * 20_000 and max(len(r.turns) for r in index) < 200
    rng = random.Random(3)
    data = [(str(i), rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(300)]
    data += [("on a corner", *shape[2][0][77]), ("cell corner", 0.0, 0.0), ("cell edge", 3 * cell_size, 0.1)]
    expected = sorted(k for k, x, y in data if inside(x, y, shape[2]) or (x, y) in shape[2][0])
    found = spatial.assign_regions(make(data, POINTS), make([shape], SHAPES), cell_size)
    assert [r[0] for r in rows(found, "id")] == expected


def test_a_missing_region_is_a_region_of_its_own(make):
    sites = events.prepare_deployments(make(
        [deployment("s1", region=None, date="2020-01-01"), deployment("s2", date="2020-01-01")], DEPLOYMENTS))
    counts = make([("s1", "F", "G", "a", 5), ("s2", "F", "G", "a", 2)], COUNTS)
    lengths = make([("s1", "F", "G", "a", 90.0, 5)], LENGTHS)
    stats = summaries.region_stats(sites, counts, lengths)
    assert rows(stats, "bioregion", "num_bruvs", "num_fish", "num_lengths", "biggest_fish") == [
        ("North", 1, 2, None, None), (None, 1, 5, 5, 90.0)]


def test_a_missing_location_meets_itself_on_the_species_map(make):
    seen = make([("s1", None, "X", 3, "stereo-BRUVs")], "sample_url string, location string, display_name string, count long, method string")
    sites = make([("s1", None, 1.0, 2.0), ("s2", "P", 3.0, 4.0)], "sample_url string, location string, latitude_dd double, longitude_dd double")
    found = locations.species_bubbles({"bubble_data": seen, "deployment_locations": sites}, ["X"])
    assert rows(found, "sample_url", "location", "count", "latitude_dd") == [("s1", None, 3, 1.0), ("s2", "P", 0, 3.0)]
