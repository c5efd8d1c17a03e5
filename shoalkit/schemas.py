"""Declared schemas of the landed tables, and the required-column check."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TAXON = ["family", "genus", "species"]


def _struct(text):
    # "name type, ..." of simple types; fromDDL would need a running session.
    schema = T.StructType()
    for field in text.split(","):
        name, kind = field.split()
        schema.add(name, kind)
    return schema


DEPLOYMENTS_RAW = _struct(
    "sample_url string, campaignid string, sample string, date_time timestamp, "
    "longitude_dd double, latitude_dd double, status string, "
    "successful_count boolean, successful_length boolean, depth_m double"
)
COUNTS = _struct("sample_url string, family string, genus string, species string, count long")
LENGTHS = _struct(
    "sample_url string, family string, genus string, species string, "
    "length_mm double, count long"
)
LIFE_HISTORY = _struct(
    "family string, genus string, species string, class string, "
    "rls_thermal_niche double, australian_common_name string"
)
LANDED = {
    "deployments": DEPLOYMENTS_RAW,
    "counts": COUNTS,
    "lengths": LENGTHS,
    "life_history": LIFE_HISTORY,
}


def require_columns(df: DataFrame, columns, what="table") -> DataFrame:
    """Raise ``ValueError`` naming the columns that ``df`` lacks."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"{what} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df
