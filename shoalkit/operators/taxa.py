"""Taxon filters, the genus recode, common names and labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.functions import group_or_null, text_or_na
from shoalkit.scaling import null_safe_join, small_side
from shoalkit.schemas import TAXON

# The classes kept as fish, and the genus whose species are merged.
FISH_CLASSES = ("Actinopterygii", "Elasmobranchii")
MERGED_GENUS, MERGED_SPECIES = "Pseudocaranx", "georgianus"

# Fixed values: "Genus species (common name)", its two parts, and the two forms of label below.
NAME_PARTS = r"^(.*?)\s*\((.*?)\)$"


def recode_taxon(df: DataFrame, genus=MERGED_GENUS, species=MERGED_SPECIES) -> DataFrame:
    """Give every row of one genus the same species; rows without a genus keep theirs."""
    is_genus = F.coalesce(F.col("genus") == genus, F.lit(False))
    return df.withColumn("species", F.when(is_genus, F.lit(species)).otherwise(F.col("species")))


def fish_taxa(life_history: DataFrame, classes=FISH_CLASSES) -> DataFrame:
    """Life-history rows of the fish classes."""
    return life_history.where(F.col("class").isin(*classes)).select(
        *TAXON, "rls_thermal_niche", "australian_common_name"
    )


def keep_fish(df: DataFrame, fishes: DataFrame) -> DataFrame:
    """Rows whose taxon is in the fish list; missing parts match missing parts."""
    return null_safe_join(df, small_side(fishes.select(*TAXON)), TAXON, "left_semi")


def fish_counts(counts, life_history, genus=MERGED_GENUS, species=MERGED_SPECIES, classes=FISH_CLASSES):
    """Recoded counts of fish taxa."""
    return keep_fish(recode_taxon(counts, genus, species), fish_taxa(life_history, classes))


def fish_lengths(lengths: DataFrame, life_history: DataFrame, classes=FISH_CLASSES) -> DataFrame:
    """Lengths of fish taxa."""
    return keep_fish(lengths, fish_taxa(life_history, classes))


def unique_by_taxon(dimension: DataFrame, column: str) -> DataFrame:
    """``column`` per taxon; running the query fails if a taxon appears twice."""
    twice = F.raise_error(F.concat(F.lit("taxon listed twice: "), F.concat_ws(" ", *TAXON)))
    return dimension.groupBy(*TAXON).agg(
        F.when(F.count(F.lit(1)) > 1, twice.cast(dimension.schema[column].dataType))
        .otherwise(F.any_value(column)).alias(column)
    )


def add_common_names(df: DataFrame, life_history: DataFrame) -> DataFrame:
    """Left join of the common name; the dimension must be unique by taxon."""
    names = unique_by_taxon(life_history, "australian_common_name")
    return null_safe_join(df, small_side(names), TAXON, "left")


def display_name(genus="genus", species="species", common="australian_common_name"):
    parts = [text_or_na(F.col(name)) for name in (genus, species, common)]
    return F.concat(parts[0], F.lit(" "), parts[1], F.lit(" ("), parts[2], F.lit(")"))


def split_display_name(df: DataFrame) -> DataFrame:
    """``sci`` and ``common`` out of ``display_name``; NULL where it has no brackets."""
    name = F.col("display_name")
    return df.withColumns({
        "sci": group_or_null(name, NAME_PARTS, 1),
        "common": group_or_null(name, NAME_PARTS, 2),
    })


def markdown_label():
    return F.concat(F.lit("*"), text_or_na(F.col("sci")), F.lit("*<br>("), text_or_na(F.col("common")), F.lit(")"))


def html_label():
    return F.concat(
        F.lit("<i>"), text_or_na(F.col("sci")), F.lit("</i><span> ("), text_or_na(F.col("common")), F.lit(")</span>")
    )


def add_labels(df: DataFrame, life_history: DataFrame) -> DataFrame:
    """Common name, display name, its parts and the markdown label."""
    named = add_common_names(df, life_history).withColumn("display_name", display_name())
    return split_display_name(named).withColumn("label", markdown_label())
