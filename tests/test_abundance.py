import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shoalkit import scaling
from shoalkit.operators import abundance, events
from shoalkit.operators.metrics import sample_taxa
from tests.conftest import COUNTS, DEPLOYMENTS, LIFE, deployment, rows

TAXA = [("F", "G", "a"), ("F", "G", "b"), ("F", "H", None), ("E", "K", "k")]


def survey(make, seed=1, n=60):
    rng = random.Random(seed)
    items, counts = [], []
    for i in range(n):
        ok = rng.random() < 0.8
        region = rng.choice(["North", "South", "West"])
        date = rng.choice(["2019-05-01", "2020-05-01", None])
        items.append(deployment(f"s{i}", date=date, ok=ok, region=region, status=rng.choice(["Fished", "No-Take", None])))
        for taxon in TAXA:
            for _ in range(rng.choice([0, 0, 1, 2])):
                if taxon[0] != "E" or region == "North":
                    counts.append((f"s{i}", *taxon, rng.choice([None, 1, 2, 30])))
    counts.append(("s0", None, "G", "a", 5))  # no family: outside the grid
    return events.prepare_deployments(make(items, DEPLOYMENTS)), make(counts, COUNTS), items, counts


def cube_of(counts, deployments):
    return abundance.grid_cube(sample_taxa(counts), deployments)


def grid(items, counts):
    """The whole grid by brute force: (sample attributes, taxon, count)."""
    by_url = {r[0]: r for r in items}
    urls = {r[0] for r in items if r[7]} | {c[0] for c in counts}
    seen = {}
    for url, *taxon, count in counts:
        if taxon[0] is not None:
            seen.setdefault((url, tuple(taxon)), []).append(count or 0)
    for url in urls:
        r = by_url[url]
        year = str(r[3].year) if r[7] and r[3] else None
        for taxon in {t for _, t in seen}:
            for count in seen.get((url, taxon), [0]):
                yield {"bioregion": r[10], "status": r[6], "year": year}, taxon, count


@pytest.mark.parametrize("keys", [[], ["bioregion"], ["status"], ["bioregion", "status"], ["bioregion", "status", "year"]])
def test_moments_equal_the_grid(make, keys):
    deployments, counts, items, raw = survey(make)
    expected = {}
    for group, taxon, count in grid(items, raw):
        expected.setdefault((*[group[k] for k in keys], *taxon), []).append(count)
    result = abundance.mean_abundance(cube_of(counts, deployments), keys).collect()
    assert len(result) == len(expected)
    for row in result:
        values = expected[tuple(row[: len(keys) + 3])]
        assert row["n"] == len(values)
        assert row["average_abundance"] == pytest.approx(statistics.mean(values), abs=1e-12)
        if len(values) == 1:
            assert row["se"] is None
        else:
            assert row["se"] == pytest.approx(statistics.stdev(values) / math.sqrt(len(values)), abs=1e-12)


@pytest.mark.parametrize("keys", abundance.LEVELS)
def test_rollup_gives_the_means_of_the_cube(make, keys):
    deployments, counts, _, _ = survey(make, 6)
    cube = cube_of(counts, deployments)
    assert rows(abundance.mean_abundance(abundance.rollup(cube), keys)) == rows(abundance.mean_abundance(cube, keys))


def test_rollup_keeps_a_missing_region_apart_from_all(make):
    deployments = events.prepare_deployments(
        make([deployment("s1", region=None), deployment("s2"), deployment("s3", status=None)], DEPLOYMENTS))
    rolled = abundance.rollup(cube_of(make([("s1", "F", "G", "a", 6)], COUNTS), deployments))
    means = abundance.mean_abundance(rolled, ["bioregion"])
    assert rows(means, "bioregion", "average_abundance", "n") == [("North", 0.0, 2), (None, 6.0, 1)]
    assert rows(abundance.mean_abundance(rolled, []), "average_abundance", "n") == [(2.0, 3)]
    assert rows(abundance.top_lists(rolled, 1), "group", "bioregion", "average_abundance") == [
        ("bioregion", "North", 0.0), ("bioregion", None, 6.0), ("overall", None, 2.0)]
    with pytest.raises(ValueError, match="no grouping"):
        abundance.mean_abundance(rolled, ["year"])


def test_lists_of_a_rollup_equal_those_of_the_cube_in_one_scan(make):
    deployments, counts, _, _ = survey(make, 7)
    life = make([(*t, "Actinopterygii", 1.0, "Name") for t in TAXA], LIFE)
    cube = cube_of(counts, deployments)
    rolled = abundance.rollup(cube)
    assert rolled._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    expected = abundance.top_species(cube, abundance.top_overall(cube, 2), abundance.top_by_region(cube, 2), life)
    found = abundance.top_species_of(rolled, abundance.top_lists(rolled, 2), life)
    assert rows(found, *expected.columns) == rows(expected)


def test_frequencies_without_counts_or_deployments(make):
    none, no_sites = make([], COUNTS), events.prepare_deployments(make([], DEPLOYMENTS))
    sites = events.prepare_deployments(make([deployment("s1")], DEPLOYMENTS))
    assert rows(abundance.complete_counts(none, sites)) == []
    stray = make([("x", "F", "G", "a", 2)], COUNTS)
    assert rows(abundance.complete_counts(stray, no_sites)) == [(None, None, "F", "G", "a", 2, 1)]
    assert rows(abundance.rollup(cube_of(none, no_sites))) == []


def test_frequency_table_equals_the_grid(make):
    deployments, counts, items, raw = survey(make, 2)
    expected = {}
    for group, taxon, count in grid(items, raw):
        key = (group["bioregion"], group["status"], *taxon, count)
        expected[key] = expected.get(key, 0) + 1
    table = abundance.complete_counts(counts, deployments)
    assert {tuple(r[:6]): r[6] for r in table.collect()} == expected


def test_grid_size_and_rows(make):
    deployments, counts, items, raw = survey(make, 3)
    size = abundance.grid_size(counts, deployments).first()
    assert size["n_samples"] == sum(bool(r[7]) for r in items)
    assert size["n_taxa"] == len({c[1:4] for c in raw})
    assert size["n_rows"] == size["n_samples"] * size["n_taxa"]


def test_every_group_is_paired_with_every_taxon(make):
    taxa = make([(i,) for i in range(7)], "taxon int")
    groups = make([(None if i == 0 else f"g{i}", i) for i in range(23)], "name string, size int")
    pairs = rows(scaling.pair_with_groups(taxa, groups))
    assert len(pairs) == len(set(pairs)) == 7 * 23


def test_ties_are_ranked_by_taxon(make):
    deployments = events.prepare_deployments(make([deployment("s1"), deployment("s2")], DEPLOYMENTS))
    counts = make([("s1", "F", "G", s, 2) for s in "dcba"], COUNTS)
    cube = cube_of(counts, deployments)
    assert rows(abundance.top_overall(cube, 2), "species") == [("a",), ("b",)]
    assert rows(abundance.top_by_region(cube, 3), "species") == [("a",), ("b",), ("c",)]


def test_lists_by_status_keep_absent_taxa(make):
    deployments = events.prepare_deployments(
        make([deployment("s1"), deployment("s2", status="No-Take"), deployment("s3", region="South")], DEPLOYMENTS)
    )
    counts = make([("s1", "F", "G", "a", 2), ("s1", "F", "G", "b", 1)], COUNTS)
    cube = cube_of(counts, deployments)
    by_status = abundance.top_overall_status(cube, abundance.top_overall(cube, 1))
    assert rows(by_status, "status", "species", "average_abundance") == [("Fished", "a", 1.0), ("No-Take", "a", 0.0)]
    by_region = abundance.top_by_region_status(cube, abundance.top_by_region(cube, 2))
    assert rows(by_region, "bioregion", "status", "species", "average_abundance") == [
        ("North", "Fished", "a", 2.0), ("North", "Fished", "b", 1.0),
        ("North", "No-Take", "a", 0.0), ("North", "No-Take", "b", 0.0),
        ("South", "Fished", "a", 0.0), ("South", "Fished", "b", 0.0),
    ]


def test_union_of_lists(make):
    deployments, counts, _, _ = survey(make, 4)
    life = make([(*t, "Actinopterygii", 1.0, "Name") for t in TAXA], LIFE)
    cube = cube_of(counts, deployments)
    top = abundance.top_species(cube, abundance.top_overall(cube, 2), abundance.top_by_region(cube, 2), life)
    assert rows(top.select("group", "by_status").distinct()) == [
        ("bioregion", False), ("bioregion", True), ("overall", False), ("overall", True)]
    per_region = abundance.rows_per_region(top).where(~F.col("by_status"))
    assert all(r["n"] <= 2 for r in per_region.collect())
    assert top.where("label is null").count() == 0


def test_hot_sample_and_large_sums_stay_exact(make):
    deployments = events.prepare_deployments(make([deployment("s1"), deployment("s2")], DEPLOYMENTS))
    big = 3_000_000_000
    counts = make([("s1", "F", "G", "a", big)] + [("s2", "F", "G", "a", 1)] * 500, COUNTS)
    row = abundance.mean_abundance(cube_of(counts, deployments), []).first()
    values = [big] + [1] * 500
    assert row["n"] == 501
    assert row["se"] == pytest.approx(statistics.stdev(values) / math.sqrt(501), rel=1e-12)
