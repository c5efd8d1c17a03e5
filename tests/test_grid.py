import itertools
import random

import pytest

from shoalkit.operators import grid
from tests.conftest import COUNTS, DEPLOYMENTS, deployment, rows
from shoalkit.operators.events import prepare_deployments

TAXA = [("F1", "G1", "a"), ("F1", "G1", None), ("F1", None, None), ("F2", "G2", "b"), ("F2", "G3", "c"), (None, "G9", "z")]


def survey(make, n=40):
    draw = random.Random(n)
    sites = [
        deployment(f"s{i:03d}", date="2020-01-01", ok=draw.choice([True, True, False, None]),
                   region=draw.choice(["North", "South", None]), status=draw.choice(["Fished", "No-Take", None]))
        for i in range(n)]
    counts = [(f"s{draw.randrange(n + 3):03d}", *draw.choice(TAXA), draw.choice([1, 2, 5, 0, None])) for _ in range(3 * n)]
    return sites, counts, prepare_deployments(make(sites, DEPLOYMENTS)), make(counts, COUNTS)


def plain(sites, counts, regions=None, statuses=None, taxa=None):
    """The grid with all its rows, by loops."""
    strata = {s[0]: (s[10], s[6]) for s in sites}
    samples = {s[0] for s in sites if s[7]} | {c[0] for c in counts}
    found = []
    for sample, taxon in itertools.product(samples, {c[1:4] for c in counts if c[1] is not None}):
        region, status = strata.get(sample, (None, None))
        if (regions is None or region in regions) and (statuses is None or status in statuses) and (taxa is None or taxon in taxa):
            values = [c[4] or 0 for c in counts if c[0] == sample and c[1:4] == taxon] or [0]
            found += [(sample, region, status, *taxon, v) for v in values]
    return sorted(found, key=repr)


@pytest.mark.parametrize("regions,statuses,taxa", [
    (None, None, None), (["North"], None, None), (["North", None], ["Fished"], None), (None, [None], TAXA[1:4]),
    (["South"], ["Fished", "No-Take"], [TAXA[0], ("F7", "G", "x")]), (["West"], None, None)])
def test_rows_on_demand_equal_the_whole_grid(make, regions, statuses, taxa):
    sites, counts, deployments, frame = survey(make)
    stored = grid.compress_grid(frame, deployments)
    listed = make(taxa, "family string, genus string, species string") if taxa else None
    found = grid.grid_rows(stored, frame, regions, statuses, listed)
    assert sorted((tuple(r) for r in found.select("sample_url", "bioregion", "status", "family", "genus", "species", "count").collect()), key=repr) == plain(
        sites, counts, regions, statuses, taxa)


def test_bits_and_size(make):
    """Taxa in several blocks; a bitmap takes a byte for eight taxa."""
    taxa = [("F", "G", f"{i:05d}") for i in range(40_000)]
    seen = [0, 1, 7, 8, 32_766, 32_767, 32_768, 39_999]
    counts = make([("s1", *taxa[i], 1) for i in seen] + [("s2", *taxa[9], 1)] + [("s3", *t, 1) for t in taxa], COUNTS)
    stored = grid.compress_grid(counts, prepare_deployments(make([deployment("s1", date="2020-01-01")], DEPLOYMENTS)))
    sizes = {r.sample_url: {k: len(v) for k, v in r.observed.items()} for r in stored.samples.collect()}
    assert sizes["s2"] == {1: 2} and sizes["s1"] == {1: 4096, 2: (40_000 - 32_768 + 7) // 8}
    one = stored.samples.where("sample_url = 's1'").crossJoin(stored.taxa)
    found = rows(one.where(grid.is_observed(one.observed, one.taxon)), "species")
    assert found == [(taxa[i][2],) for i in seen]


def test_empty_tables(make):
    nothing = make([], COUNTS)
    stored = grid.compress_grid(nothing, prepare_deployments(make([deployment("s1", date="2020-01-01")], DEPLOYMENTS)))
    assert stored.samples.count() == 1 and grid.grid_rows(stored, nothing).collect() == []
    assert grid.compress_grid(nothing, prepare_deployments(make([], DEPLOYMENTS))).samples.count() == 0
