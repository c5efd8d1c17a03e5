"""Session settings the jobs rely on."""

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates and timestamps are compared in UTC throughout.
    "spark.sql.session.timeZone": "UTC",
    # Run-time coalescing, skew splitting and join re-planning.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Two aggregation passes over one shuffled frame share the shuffle.
    "spark.sql.exchange.reuse": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name="shoalkit", master=None, extra=None):
    """A session with the settings above; the cluster's own settings are kept."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_own_folder(spark):
    """Give a local session a checkpoint folder if none is set, as tests and trials need.

    On a cluster the folder must be one that all executors share, so it is never chosen here.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shoalkit-"))
    return spark
