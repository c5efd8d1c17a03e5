"""What the operators of this subpackage share."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalkit.scaling import temporary_folder

# Setting that removes the shuffle files of a job once the job has ended.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# ASCII bytes lower-cased; all that are neither letters nor digits become spaces. Bytes of
# other characters stay, so they are part of words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Folders of tables written inside each open ``scratch`` block.
_OPEN = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read on from there.

    A lost executor then costs the tasks it ran, not the steps before this table. The
    shuffle files of the writing job are released when it ends, the table when it is
    ``dropped``, when the ``scratch`` block around it ends, or else with the session.
    """
    spark = df.sparkSession
    folder = temporary_folder(spark, label)
    before = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(RELEASE, before)
    for made in _OPEN:
        made.append(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table.stored_in = folder
    return table


def _remove(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame):
    """Remove ``stored`` tables that nothing will read again."""
    for one in tables:
        _remove(one.sparkSession, one.stored_in)


@contextmanager
def scratch(spark: SparkSession):
    """Tables ``stored`` inside the block go when it ends, but for those taken off the list it gives."""
    made = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        # By identity: an inner block has the same folders.
        _OPEN[:] = [other for other in _OPEN if other is not made]
        for folder in made:
            _remove(spark, folder)


def fold(buckets: int):
    """``crc32`` of the document id as text, modulo ``buckets``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets


def in_fold(buckets: int, remainder: int):
    """Whether a document is held out. A null id is not."""
    return F.coalesce(fold(buckets) == remainder, F.lit(False))


def learnable(buckets: int, remainder: int):
    """Whether a document may be learned from. A null id may not."""
    return F.coalesce(fold(buckets) != remainder, F.lit(False))


def key_columns():
    """Two columns that tell documents apart: the id and a hash of id and text.

    Rows that agree in both hold the same id and text and get the same result.
    """
    return [
        F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long").alias("key_id"),
        F.xxhash64("doc_id", "text").alias("key_hash"),
    ]


def normal_words(text: bytes) -> list:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


def known_labels(labels: DataFrame, column: str, buckets: int, remainder: int) -> DataFrame:
    """Learnable documents and their label: ``doc_id, label``. Those labelled both ways, or not at all, are left out."""
    return (
        labels.filter(learnable(buckets, remainder) & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(column).cast("int").alias("label"), F.max(column).cast("int").alias("other"))
        .filter("label = other").drop("other")
    )


def smallest_hashes(known: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label, those whose ids have the smallest hashes."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(
        known.filter("label = 1").orderBy(*order).limit(per_class))


def labelled_sample(labels: DataFrame, column: str, buckets: int, remainder: int, per_class: int) -> DataFrame:
    """At most ``per_class`` learnable documents of each label: ``doc_id, label``.

    The ids with the smallest hashes are taken, so the choice does not depend on the
    order of rows. A document labelled both ways, or not at all, is not taken.
    """
    return smallest_hashes(known_labels(labels, column, buckets, remainder), per_class)
