"""The sample x taxon grid in compressed form, with rows made only where they are asked for.

Taxa are numbered and every sample keeps one bit for each taxon seen in it. The zeros of
the grid are the bits that are not set, so the stored grid grows with the samples, and a
request makes the rows of its own region, status and taxa.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.operators.abundance import _strata
from shoalkit.scaling import null_safe_join, numbered, pair_with_groups, small_side
from shoalkit.schemas import TAXON


@dataclass
class CompressedGrid:
    """``samples``: sample_url, bioregion, status, year, observed (block of taxa -> bits);
    ``taxa``: the taxon and its number."""

    samples: DataFrame
    taxa: DataFrame


def compress_grid(counts: DataFrame, deployments: DataFrame) -> CompressedGrid:
    """Bits of the observed taxa of every sample of the grid.

    The samples are the successful ones and any with counts; taxa without a family are
    left out of the grid, as in ``complete_counts``. A taxon is counted once per sample
    before bits are set, and a bitmap is cut after its last bit, so it takes one byte for
    eight taxa and not the block that it was built in.
    """
    taxa = numbered(counts.where(F.col("family").isNotNull()).select(*TAXON).distinct(), TAXON, "taxon")
    seen = counts.select("sample_url", *TAXON).distinct()
    bit = F.bitmap_bit_position("taxon")
    bits = (
        null_safe_join(seen.where(F.col("family").isNotNull()), small_side(taxa), TAXON, "inner")
        .groupBy("sample_url", F.bitmap_bucket_number("taxon").alias("block"))
        .agg(F.bitmap_construct_agg(bit).alias("bits"), F.max(bit).alias("top"))
        .select("sample_url", F.struct("block", F.expr("substring(bits, 1, cast(top div 8 as int) + 1)").alias("bits")).alias("entry"))
    )
    # A sample has as many entries as there are blocks of 32,768 taxa; one without any has fish of no family.
    observed = (
        bits.unionByName(seen.select("sample_url").distinct(), allowMissingColumns=True)
        .groupBy("sample_url").agg(F.map_from_entries(F.collect_list("entry")).alias("observed"))
    )
    samples = (
        _strata(deployments).join(observed, "sample_url", "full")
        .where(F.col("ok") | F.col("observed").isNotNull())
        .select("sample_url", "bioregion", "status", "year", "observed")
    )
    return CompressedGrid(samples, taxa)


def is_observed(observed, taxon):
    """Whether the bit of a taxon number is set."""
    place = F.bitmap_bit_position(taxon)
    bits = F.try_element_at(observed, F.bitmap_bucket_number(taxon))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def _only(df, column, values):
    if values is None:
        return df
    values = [values] if isinstance(values, str) else list(values)
    return df.where(F.col(column).isin(*[v for v in values if v is not None]) | (F.col(column).isNull() if None in values else F.lit(False)))


def grid_rows(grid: CompressedGrid, counts: DataFrame, regions=None, statuses=None, taxa: DataFrame = None) -> DataFrame:
    """Rows of the completed grid: every requested sample with every requested taxon, 0 where it was not seen.

    ``regions`` and ``statuses`` are a value or a list, in which None is a missing one;
    ``taxa`` a frame of taxa. What is not given is not limited. A taxon with several
    count rows in a sample keeps them, a missing count is 0. Taxa outside the grid give no rows.
    """
    samples = _only(_only(grid.samples, "bioregion", regions), "status", statuses)
    listed, rows = grid.taxa, counts.where(F.col("family").isNotNull())
    if taxa is not None:
        wanted = small_side(taxa.select(*TAXON).distinct())
        listed, rows = (null_safe_join(df, wanted, TAXON, "left_semi") for df in (listed, rows))
    keys = ["sample_url", "bioregion", "status"]
    zeros = (
        pair_with_groups(samples, listed).where(~is_observed(F.col("observed"), F.col("taxon")))
        .select(*keys, *TAXON, F.lit(0).cast("long").alias("count"))
    )
    value = F.coalesce("count", F.lit(0)).cast("long").alias("count")
    return rows.join(samples.select(*keys), "sample_url").select(*keys, *TAXON, value).unionByName(zeros)
