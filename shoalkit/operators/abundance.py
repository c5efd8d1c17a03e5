"""Mean abundance per taxon on the zero-filled sample x taxon grid.

The grid itself is never built. A group of S samples holds, for each taxon, the rows
present plus one zero for every sample without the taxon, so counts, sums and sums of
squares of the rows present give the mean and standard error exactly.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalkit.operators.taxa import add_labels
from shoalkit.scaling import cut_lineage, null_safe_join, pair_with_groups, small_side
from shoalkit.schemas import TAXON

STRATA = ["bioregion", "status", "year"]
SUMS = ["n_rows", "n_with", "total", "total_sq"]
# Groupings of the ranked lists and of their splits.
SPLITS = ["bioregion", "status"]
LEVELS = [[], ["bioregion"], ["status"], ["bioregion", "status"]]


def _strata(deployments):
    ok = F.coalesce("successful_count", F.lit(False))
    # The year is known for successful samples only.
    return deployments.select(
        "sample_url", "bioregion", "status", F.when(ok, F.col("year")).alias("year"), ok.alias("ok")
    )


def grid_cube(per_taxon: DataFrame, deployments: DataFrame) -> DataFrame:
    """``cube_rows``, checkpointed for the rankings that read it."""
    return cut_lineage(cube_rows(per_taxon, deployments))


def cube_rows(per_taxon: DataFrame, deployments: DataFrame) -> DataFrame:
    """Sums per (bioregion, status, year, taxon) out of ``sample_taxa``.

    ``n_rows``, ``total`` and ``total_sq`` describe the rows present (a missing count is
    0), ``n_with`` the samples they come from, and ``n_samples`` adds up over the taxa
    of a stratum to its number of samples: the successful ones and any with counts.
    The result has one row per stratum and observed taxon, so it is small whatever
    the number of samples, and every ranking reads it instead of the counts.
    """
    # The first row of each sample carries the sample itself, so each is counted once.
    first = F.row_number().over(Window.partitionBy("sample_url").orderBy(*TAXON)) == 1
    rows = per_taxon.select("sample_url", *TAXON, "n_rows", "total", "total_sq", first.cast("int").alias("once"))
    return (
        _strata(deployments).join(rows, "sample_url", "full")
        .where(F.col("ok") | F.col("n_rows").isNotNull())
        .groupBy(*STRATA, *TAXON)
        .agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
            F.count("n_rows").alias("n_with"),
            F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
            # A decimal: sums of squares outgrow a long, and stay exact here.
            F.coalesce(F.sum(F.col("total_sq").cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias("total_sq"),
            # A sample without counts has one row here.
            F.sum(F.coalesce("once", F.lit(1))).alias("n_samples"),
        )
    )


def rollup(cube: DataFrame) -> DataFrame:
    """Sums of ``cube_rows`` at every grouping of the ranked lists, from one scan of the cube.

    ``by_bioregion`` and ``by_status`` tell the grouping of a row, so that a missing
    region is not taken for all regions. Every function here that reads a cube also
    reads a rollup, and then only the rows of its grouping.
    """
    grouped = cube.groupingSets([[*keys, *TAXON] for keys in LEVELS], *SPLITS, *TAXON)
    return grouped.agg(
        *[(F.grouping(name) == 0).alias(f"by_{name}") for name in SPLITS],
        *[F.sum(name).alias(name) for name in [*SUMS, "n_samples"]],
    )


def level(cube: DataFrame, keys) -> DataFrame:
    """The rows of a rollup for one of its groupings; a cube as it is, since its sums add up to any."""
    flags = [f"by_{name}" for name in SPLITS]
    if not set(flags) <= set(cube.columns):
        return cube
    if list(keys) not in LEVELS:
        raise ValueError(f"the rollup has no grouping by {keys}")
    for name, flag in zip(SPLITS, flags):
        cube = cube.where(F.col(flag) == F.lit(name in keys))
    return cube.drop(*flags)


def _observed(cube):
    return cube.where(F.col("family").isNotNull())


def grid_taxa(cube: DataFrame) -> DataFrame:
    """Taxa of the grid; rows without a family are left out of it."""
    return _observed(cube).select(*TAXON).distinct()


def group_sizes(cube: DataFrame, keys) -> DataFrame:
    """Samples per group."""
    return cube.groupBy(*keys).agg(F.sum("n_samples").alias("n_samples"))


def grid_sums(cube: DataFrame, keys, cells=None) -> DataFrame:
    """Sums per group and taxon, absent taxa included, with the group's sample count.

    ``cells`` limits the taxa: a frame of taxa, with those of ``keys`` that it is
    specific to. Without it every taxon of the grid is listed in every group.
    """
    cube = level(cube, keys)
    groups = group_sizes(cube, keys)
    observed = _observed(cube)
    shared = []
    if cells is None:
        listed = pair_with_groups(grid_taxa(cube), groups)
    else:
        shared = [key for key in keys if key in cells.columns]
        observed = null_safe_join(observed, small_side(cells), shared + TAXON, "left_semi")
        if shared:
            listed = null_safe_join(cells, groups, shared, "inner")
        else:
            listed = pair_with_groups(cells, groups)
    zero = listed.select(*keys, *TAXON, *[F.lit(0).alias(name) for name in SUMS], "n_samples")
    present = observed.select(*keys, *TAXON, *SUMS, F.lit(0).cast("long").alias("n_samples"))
    sums = [F.sum(name).cast("decimal(38,0)").alias(name) for name in [*SUMS, "n_samples"]]
    return zero.unionByName(present).groupBy(*keys, *TAXON).agg(*sums)


def mean_abundance(cube: DataFrame, keys, cells=None) -> DataFrame:
    """``average_abundance`` and ``se`` per group and taxon on the zero-filled grid."""
    n = (F.col("n_rows") + F.col("n_samples") - F.col("n_with")).cast("decimal(18,0)")
    total = F.col("total")
    spread = (n * F.col("total_sq") - total * total).cast("double")
    size = n.cast("double")
    return grid_sums(cube, keys, cells).select(
        *keys, *TAXON,
        F.try_divide(total.cast("double"), size).alias("average_abundance"),
        F.sqrt(F.try_divide(spread, size * size * (size - 1))).alias("se"),
        n.cast("long").alias("n"),
    )


def _ranking():
    return [F.desc_nulls_last("average_abundance"), *[F.asc_nulls_last(name) for name in TAXON]]


def top_lists(cube: DataFrame, n=50) -> DataFrame:
    """``top_overall`` and ``top_by_region`` in one table, ranked in one window."""
    overall = _tagged(mean_abundance(cube, []), "overall", False)
    region = _tagged(mean_abundance(cube, ["bioregion"]), "bioregion", False)
    rows = region.unionByName(overall, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("group", "bioregion").orderBy(*_ranking()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def top_overall(cube: DataFrame, n=50) -> DataFrame:
    """The ``n`` most abundant taxa."""
    return _tagged(mean_abundance(cube, []).orderBy(*_ranking()).limit(n), "overall", False)


def top_by_region(cube: DataFrame, n=50) -> DataFrame:
    """The ``n`` most abundant taxa of every bioregion."""
    rank = F.row_number().over(Window.partitionBy("bioregion").orderBy(*_ranking()))
    ranked = mean_abundance(cube, ["bioregion"]).withColumn("rank", rank).where(F.col("rank") <= n)
    return _tagged(ranked.drop("rank"), "bioregion", False)


def _tagged(df, group, by_status):
    return df.drop("n").withColumns({"group": F.lit(group), "by_status": F.lit(by_status)})


def top_overall_status(cube: DataFrame, top: DataFrame) -> DataFrame:
    """The taxa of ``top_overall``, by status."""
    return _tagged(mean_abundance(cube, ["status"], top.select(*TAXON)), "overall", True)


def top_by_region_status(cube: DataFrame, top: DataFrame) -> DataFrame:
    """The taxa of ``top_by_region``, by status."""
    cells = top.select("bioregion", *TAXON)
    return _tagged(mean_abundance(cube, ["bioregion", "status"], cells), "bioregion", True)


def region_top_by(cube: DataFrame, top: DataFrame, keys) -> DataFrame:
    """Means of the taxa of ``top_by_region`` on a finer grouping that has the region in it."""
    return mean_abundance(cube, keys, top.select("bioregion", *TAXON))


def top_by_region_status_year(cube: DataFrame, top: DataFrame, life_history: DataFrame) -> DataFrame:
    """The taxa of ``top_by_region``, by status and year, with labels."""
    cells = top.select("bioregion", *TAXON)
    rows = _tagged(mean_abundance(cube, ["bioregion", "status", "year"], cells), "bioregion", True)
    return add_labels(rows, life_history)


def top_species(cube: DataFrame, overall: DataFrame, region: DataFrame, life_history: DataFrame) -> DataFrame:
    """The two ranked lists and their splits by status in one table, with labels."""
    return _with_splits(cube, overall.unionByName(region, allowMissingColumns=True), overall, region, life_history)


def top_species_of(cube: DataFrame, lists: DataFrame, life_history: DataFrame) -> DataFrame:
    """``top_species`` from ``top_lists``."""
    overall, region = (lists.where(F.col("group") == name) for name in ("overall", "bioregion"))
    return _with_splits(cube, lists, overall, region, life_history)


def _with_splits(cube, lists, overall, region, life_history):
    for part in (top_overall_status(cube, overall), top_by_region_status(cube, region)):
        lists = lists.unionByName(part, allowMissingColumns=True)
    return add_labels(lists, life_history)


def rows_per_region(top: DataFrame) -> DataFrame:
    """Rows per bioregion and kind of list."""
    return top.where(F.col("group") == "bioregion").groupBy("bioregion", "by_status").agg(F.count(F.lit(1)).alias("n"))


def count_frequencies(counts: DataFrame, deployments: DataFrame) -> DataFrame:
    """Rows present per region, status, taxon and count, from one pass over the counts.

    ``n_with`` adds up over the counts of a taxon to the samples that have it, and
    ``n_samples`` over all rows of a group to its samples, those without counts
    included. Counts are summed up per sample before they meet the deployments.
    """
    value = F.coalesce("count", F.lit(0)).cast("long").alias("count")
    per_sample = counts.groupBy("sample_url", *TAXON, value).agg(F.count(F.lit(1)).alias("n_rows"))
    # The first row of a sample carries the sample, the first of a taxon in it the presence.
    inside = Window.partitionBy("sample_url").orderBy(*TAXON, "count")
    taxon = F.struct(*TAXON)
    rows = per_sample.withColumns({
        "once": (F.row_number().over(inside) == 1).cast("int"),
        "first": (~F.lag(taxon).over(inside).eqNullSafe(taxon)).cast("int"),
    })
    return (
        _strata(deployments).drop("year").join(rows, "sample_url", "full")
        .where(F.col("ok") | F.col("n_rows").isNotNull())
        .groupBy(*SPLITS, *TAXON, "count")
        .agg(
            F.sum("n_rows").alias("n_rows"), F.sum("first").alias("n_with"),
            F.sum(F.coalesce("once", F.lit(1))).alias("n_samples"),
        )
    )


def complete_counts(counts: DataFrame, deployments: DataFrame) -> DataFrame:
    """The zero-filled grid as a frequency table: grid rows per region, status, taxon and count.

    Equal grid rows are counted instead of repeated, so zeros cost one row per group
    and taxon. The frequencies of the rows present are checkpointed, and zeros and
    result both come from them.
    """
    seen = cut_lineage(count_frequencies(counts, deployments))
    absent = (F.col("n_samples") - F.col("n_with")).cast("long")
    none = F.lit(0).cast("long")
    zeros = (
        grid_sums(seen.withColumns({"total": none, "total_sq": none}), SPLITS)
        .select(*SPLITS, *TAXON, none.alias("count"), absent.alias("n_rows"))
        .where(F.col("n_rows") > 0)
    )
    present = _observed(seen).select(*SPLITS, *TAXON, "count", "n_rows")
    return present.unionByName(zeros).groupBy(*SPLITS, *TAXON, "count").agg(F.sum("n_rows").alias("n_rows"))


def grid_size(counts: DataFrame, deployments: DataFrame) -> DataFrame:
    """Samples, taxa and their product: the rows a full grid would have."""
    samples = deployments.where(F.col("successful_count")).agg(F.count(F.lit(1)).alias("n_samples"))
    taxa = counts.select(*TAXON).distinct().agg(F.count(F.lit(1)).alias("n_taxa"))
    return (
        samples.unionByName(taxa, allowMissingColumns=True)
        .agg(F.sum("n_samples").alias("n_samples"), F.sum("n_taxa").alias("n_taxa"))
        .withColumn("n_rows", F.col("n_samples") * F.col("n_taxa"))
    )
