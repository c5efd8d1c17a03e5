"""Landed input tables: one Parquet directory per table, read as declared schemas."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalkit.schemas import LANDED, require_columns


def read_landed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One landed table, with the columns of its schema, in order and of its types.

    The files' own schema decides whether a column is missing, which is an error and not
    a column of NULLs. Casts to a type the files already have vanish from the plan.
    """
    found = spark.read.parquet(os.path.join(folder, name))
    schema = LANDED[name]
    require_columns(found, schema.names, name)
    return found.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema])


def read_life_history_csv(spark: SparkSession, path: str) -> DataFrame:
    """The taxon dimension from CSV with a header; empty cells and ``NA`` are missing."""
    return (
        spark.read.schema(LANDED["life_history"]).option("header", True)
        .option("nullValue", "NA").option("enforceSchema", False).csv(path)
        .select(*[F.col(name) for name in LANDED["life_history"].names])
    )


def write_table(df: DataFrame, folder: str, name: str, partition_by=(), lookup=()) -> str:
    """Write one table as a Parquet directory, replacing it.

    Columns in ``lookup`` hold keys that single rows are looked up by. They get a Bloom
    filter for each row group and no dictionary, which nearly unique keys outgrow (and
    beside which Parquet writes no filter).
    """
    path = os.path.join(folder, name)
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    for column in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True).option(f"parquet.enable.dictionary#{column}", False)
    writer.parquet(path)
    return path
