"""Parquet tables cut into buckets by a key, so that joins and groupings on it need no shuffle.

Two tables with the same key and number of buckets join bucket by bucket. Spark keeps
the layout in its catalog and not with the files. So it is written beside them, and the
session that reads a table enters it in its catalog as an external one.
"""

import hashlib
import math
import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalkit.scaling import planned_bytes

# Buckets of a table unless told otherwise, and where the size of its input is not known.
# One bucket is one task of a join; tables that meet need the same number.
BUCKETS = 64
# Bytes of Parquet that a bucket is made of, some million rows, and the least and most
# buckets; the planner takes no more.
BUCKET_BYTES = 8 * 1024 * 1024
LEAST_BUCKETS, MOST_BUCKETS = 8, 50_000


def buckets_for(table: DataFrame) -> int:
    """Buckets for what is made from a stored table, so that one fits a task whatever the table's size."""
    size = planned_bytes(table)
    if size is None:
        return BUCKETS
    return min(max(math.ceil(size / BUCKET_BYTES), LEAST_BUCKETS), MOST_BUCKETS)


@contextmanager
def dealt_by_bucket(spark: SparkSession, buckets: int):
    """Joins and groupings run inside deal their rows to as many partitions as there are buckets.

    A join on the key of a table then leaves every bucket in one task, and no second
    shuffle is needed to write it. A key that holds very many rows is still split, and
    shuffled once more, by the planner.
    """
    settings = {
        "spark.sql.shuffle.partitions": str(buckets),
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _absolute(spark, path) -> str:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def _entry(path) -> str:
    return "by_bucket_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _columns(schema) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)


def write_bucketed(df: DataFrame, folder: str, name: str, key: str, buckets=BUCKETS, dealt=False) -> str:
    """Write one table in ``buckets`` files by the hash of ``key``, each sorted by it, replacing it.

    Rows without a key share a bucket. A key's rows lie in one bucket, so a fact table
    is summed up per key before it is written this way. A table without rows has a
    layout and no files. ``dealt`` tells that the rows of a bucket lie in one partition
    already, so they are not shuffled; a bucket dealt to several has a file from each.
    """
    spark, path = df.sparkSession, _absolute(df.sparkSession, os.path.join(folder, name))
    entry = _entry(path)
    spark.sql(f"DROP TABLE IF EXISTS {entry}")
    (
        (df if dealt else df.repartition(buckets, key)).write.format("parquet").mode("overwrite")
        .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(entry)
    )
    spark.sql(f"DROP TABLE {entry}")  # the files stay
    layout = spark.range(1).select(
        F.lit(key).alias("key"), F.lit(buckets).alias("buckets"), F.lit(_columns(df.schema)).alias("columns"))
    layout.write.mode("overwrite").parquet(path + "_layout")
    return path


def read_bucketed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``write_bucketed``, with its layout known to the planner."""
    path = _absolute(spark, os.path.join(folder, name))
    layout = spark.read.parquet(path + "_layout").first()
    entry = _entry(path)
    spark.sql(f"DROP TABLE IF EXISTS {entry}")
    spark.sql(
        f"CREATE TABLE {entry} ({layout['columns']}) USING parquet CLUSTERED BY (`{layout['key']}`) "
        f"SORTED BY (`{layout['key']}`) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(entry)
