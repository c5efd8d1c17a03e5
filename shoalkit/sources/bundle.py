"""The result bundle: named Parquet tables of one refresh, found through a run log."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["deployments", "overview_stats", "bioregion_stats", "top_species", "top_species_year", "metrics", "bioregions"]
RUN_LOG = "run_log"
RUN_LOG_SCHEMA = "run_id string, finished_at timestamp, status string"
STEP_LOG = "step_log"
STEP_LOG_SCHEMA = "run_id string, step string, fingerprint string, finished_at timestamp"

# Tasks that hash a listing of files.
LISTING_TASKS = 64


def run_folder(out_dir: str, run_id: str) -> str:
    return os.path.join(out_dir, "runs", run_id)


def _append(spark, out_dir, log, **values) -> None:
    row = spark.range(1).select(*[F.lit(value).alias(name) for name, value in values.items()], F.current_timestamp().alias("finished_at"))
    row.write.mode("append").parquet(os.path.join(out_dir, log))


def _logged(spark, out_dir, log, schema) -> DataFrame:
    """A log's rows; a log that was never written has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(out_dir, log))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(os.path.join(out_dir, log))


def log_success(spark: SparkSession, out_dir: str, run_id: str) -> None:
    """Append the marker of a finished run; readers only see runs that have one."""
    _append(spark, out_dir, RUN_LOG, run_id=run_id, status="ok")


def log_step(spark: SparkSession, out_dir: str, run_id: str, step: str, fingerprint: str) -> None:
    """Append the marker of a table written in full."""
    _append(spark, out_dir, STEP_LOG, run_id=run_id, step=step, fingerprint=fingerprint)


def finished_steps(spark: SparkSession, out_dir: str, run_id: str) -> dict:
    """Fingerprint of the last writing of each step of a run; a run has some dozen steps."""
    steps = _logged(spark, out_dir, STEP_LOG, STEP_LOG_SCHEMA).where(F.col("run_id") == run_id)
    last = steps.groupBy("step").agg(F.max_by("fingerprint", "finished_at").alias("fingerprint"))
    return {row["step"]: row["fingerprint"] for row in last.collect()}


def unfinished_run(spark: SparkSession, out_dir: str):
    """Identifier of the newest run, if it wrote a table and did not finish, else None."""
    steps = _logged(spark, out_dir, STEP_LOG, STEP_LOG_SCHEMA).select("run_id")
    done = _logged(spark, out_dir, RUN_LOG, RUN_LOG_SCHEMA).select("run_id", F.lit(True).alias("done"))
    newest = steps.unionByName(done, allowMissingColumns=True).groupBy("run_id").agg(F.max("done").alias("done"))
    row = newest.orderBy(F.desc("run_id")).first()
    return row["run_id"] if row and not row["done"] else None


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of all files below ``path`` in one text; no file is opened.

    Executors hash the listing, many files to a task, and the sums do not depend on its
    order, so the driver keeps two numbers however many files there are.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).coalesce(LISTING_TASKS)
    file = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    row = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(file).alias("total")).first()
    return f"{row['n']}:{row['total']}"


def read_run_log(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(os.path.join(out_dir, RUN_LOG))


def latest_run(spark: SparkSession, out_dir: str) -> str:
    """Identifier of the last finished run."""
    last = read_run_log(spark, out_dir).orderBy(F.desc("finished_at"), F.desc("run_id")).first()
    if last is None:
        raise ValueError(f"no finished run under {out_dir}")
    return last["run_id"]


def read_bundle(spark: SparkSession, out_dir: str, run_id=None) -> dict:
    """Every table of a run (the last finished one by default) by name."""
    folder = run_folder(out_dir, run_id or latest_run(spark, out_dir))
    return {name: spark.read.parquet(os.path.join(folder, name)) for name in TABLES}
