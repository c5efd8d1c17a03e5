"""Helpers that keep plans safe when tables grow: checked broadcasts, lineage cuts,
row numbers and products without a single hot task."""

import os
import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

# A join side is broadcast only below this bound, an index of polygons or of parts below that many entries.
BROADCAST_BYTES = 10 * 1024 * 1024
BROADCAST_ROWS = 200_000


def planned_bytes(df: DataFrame):
    """Catalyst's size estimate, or None where the session does not expose it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def small_side(df: DataFrame, max_bytes=BROADCAST_BYTES) -> DataFrame:
    """Mark a join side for broadcast if the planner's estimate of its size allows it.

    A side above the bound, or of unknown size, is returned unmarked: Spark then
    shuffles both sides, and AQE still broadcasts one that turns out small and splits
    skewed keys. No job runs for the check.
    """
    size = planned_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df


def shared_folder(spark) -> str:
    """The folder every executor reaches, named in ``spark.checkpoint.dir`` or set on the context."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def temporary_folder(spark, label) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def kept_with_maximum(df: DataFrame, name):
    """``df`` written to the checkpoint folder and the largest value of a column, in one run.

    The maximum is observed by the job that writes, so neither is computed twice;
    it is None without rows or values.
    """
    seen = Observation()
    kept = cut_lineage(df.observe(seen, F.max(name).alias("largest")))
    return kept, seen.get.get("largest")


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    """Equi-join in which a missing key matches a missing key.

    ``left``, ``left_semi``, ``left_anti`` and ``inner`` keep the left keys.
    """
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__{key}")
    condition = None
    for key in keys:
        same = F.col(key).eqNullSafe(F.col(f"__{key}"))
        condition = same if condition is None else condition & same
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__{key}" for key in keys])


def numbered(df: DataFrame, order, name="row", within=()) -> DataFrame:
    """Add 1-based row numbers in ``order``, over all rows or inside each group of ``within``.

    Rows are range-partitioned and sorted by group and order and fixed by a checkpoint
    with their place in the partition; the place of a group's first row there and the
    sizes of the group's parts before give the number. No task sees more than one range
    and rows move once, so a group that holds most rows is dealt to most tasks. ``order``
    has unique keys inside a group.

    The list of parts is broadcast up to ``BROADCAST_ROWS`` entries, so that rows stay in
    their ranges. There are more only with many groups, which then are dealt by group.
    """
    keys = [*within, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fixed = cut_lineage(ranged.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}))
    # One row per partition and group in it, so the window below stays tiny.
    running = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        fixed.groupBy(*within, "__part").agg(F.count(F.lit(1)).alias("size"), F.min("__place").alias("first"))
        .select(*within, "__part", (F.coalesce(F.sum("size").over(running), F.lit(0)) + 1 - F.col("first")).alias("__shift"))
    )
    few = parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (
        null_safe_join(fixed, F.broadcast(parts) if few else parts, ["__part", *within], "inner")
        .withColumn(name, F.col("__place") + F.col("__shift"))
        .drop("__part", "__place", "__shift")
    )


def pair_with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Give every row of ``rows`` one copy per row of ``groups``.

    Used only where the result itself has a row per group and taxon, and the groups are
    the regions or statuses of a survey. Both inputs are summaries, never fact tables;
    the list of groups travels as an array held by a scalar subquery.
    """
    listed = groups.agg(F.collect_list(F.struct(*[F.col(name) for name in groups.columns]))).scalar()
    return rows.select("*", F.explode(listed).alias("__group")).select(*rows.columns, "__group.*")
