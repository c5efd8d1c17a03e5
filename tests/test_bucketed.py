from pyspark.sql import functions as F

from shoalkit.operators import abundance
from shoalkit.sources.bucketed import read_bucketed, write_bucketed
from tests.conftest import SMALL, rows


def nodes(plan):
    """Every node of a physical plan but those of broadcast sides, with its name."""
    name = plan.nodeName()
    if name.startswith("Broadcast") and "Join" not in name:
        return
    yield name, plan
    if name == "AdaptiveSparkPlan":
        yield from nodes(plan.executedPlan())
    if name.endswith("QueryStage"):
        yield from nodes(plan.plan())
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def below_join(df):
    """Names of the nodes at and below the topmost join on the sample, but for broadcast sides."""
    for name, plan in nodes(df._jdf.queryExecution().executedPlan()):
        if name in ("SortMergeJoin", "ShuffledHashJoin"):
            return [name for name, _ in nodes(plan)]
    raise AssertionError("no join of both sides")


def test_metrics_of_stored_samples_shuffle_no_sample(spark):
    from fixture.registry import queries

    found = queries()["served_metrics_long"](spark, SMALL)
    assert not [name for name in below_join(found) if "Exchange" in name]
    found.collect()
    assert not [name for name in below_join(found) if "Exchange" in name]
    # Without buckets both sides are shuffled.
    assert [name for name in below_join(queries()["metrics_long"](spark, SMALL)) if "Exchange" in name]


def test_cube_of_stored_samples_shuffles_no_sample(spark):
    from fixture.bindings import Survey

    survey = Survey(spark, SMALL)
    cube = abundance.cube_rows(survey.served["sample_taxa"], survey.served_samples)
    assert not [name for name in below_join(cube) if "Exchange" in name]


def test_round_trip_with_missing_keys_and_repeated_rows(spark, make, folder):
    data = make([(f"k{i % 7}" if i % 5 else None, i % 3) for i in range(200)], "k string, n int")
    write_bucketed(data, folder, "t", "k", 4)
    back = read_bucketed(spark, folder, "t")
    assert rows(back) == rows(data) == rows(spark.read.parquet(f"{folder}/t"))
    counted = back.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    assert not [name for name, _ in nodes(counted._jdf.queryExecution().executedPlan()) if "Exchange" in name]
    # Writing again replaces; a reader that was there before has to read anew.
    write_bucketed(data.where("n = 1"), folder, "t", "k", 4)
    assert rows(read_bucketed(spark, folder, "t")) == rows(data.where("n = 1"))


def test_empty_table(spark, make, folder):
    write_bucketed(make([], "k string, n int"), folder, "t", "k", 4)
    assert rows(read_bucketed(spark, folder, "t")) == []


def test_counts_move_once_into_the_buckets(spark, make, folder, monkeypatch):
    """The sums of a refresh are written as the join with the regions dealt them, one file a bucket."""
    from shoalkit.plans import refresh as job
    from tests.test_refresh import land

    regions, seen = land(make, folder), {}

    def kept(df, where, name, **layout):
        seen[name] = [n for n, _ in nodes(df._jdf.queryExecution().executedPlan())], layout
        return write_bucketed(df, where, name, **layout)

    monkeypatch.setattr(job, "write_bucketed", kept)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    run = job.refresh(spark, folder, f"{folder}/out", regions, cell_size=1.0, buckets=4)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    names, layout = seen["sample_taxa"]
    assert layout["dealt"] and "SortMergeJoin" in names and names.count("Exchange") == 2  # a side each
    sums = read_bucketed(spark, f"{folder}/out/runs/{run}", "sample_taxa")
    assert rows(sums, "sample_url", "species", "total") == [("s1", "a", 3), ("s2", "b", 2)]
    in_files = sums.select(F.pmod(F.hash("sample_url"), F.lit(4)).alias("b"), F.input_file_name().alias("file")).distinct()
    assert in_files.count() == in_files.select("b").distinct().count() == in_files.select("file").distinct().count()
    # Samples are dealt out before the texts that follow from their event are added.
    assert seen["samples"][1]["dealt"]
    assert rows(read_bucketed(spark, f"{folder}/out/runs/{run}", "samples"), "sample_url", "new_campaignid", "start_month") == [
        ("s1", "C1_20200101", "2020-01"), ("s2", "C1_20200301", "2020-03"), ("s4", None, None)]


def test_a_hot_sample_is_split_and_whole(spark, make, folder):
    """A sample that holds most rows is dealt to several tasks; its bucket has several files and reads whole."""
    from shoalkit.operators import metrics
    from shoalkit.sources.bucketed import dealt_by_bucket

    counts = spark.range(0, 60_000, 1, 12).select(
        F.when(F.col("id") % 4 != 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("sample_url"),
        F.lit("F").alias("family"), F.lit("G").alias("genus"), (F.col("id") % 700).cast("string").alias("species"), F.col("id").alias("count"))
    sites = make([("hot",), *[(f"s{i}",) for i in range(0, 50, 2)], (None,)], "sample_url string")
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    kept = {name: spark.conf.get(name) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        with dealt_by_bucket(spark, 4):
            sums = metrics.sample_taxa(metrics.in_region(counts, sites.hint("merge")))
            sums.collect()
            assert "skew=true" in sums._jdf.queryExecution().executedPlan().toString()
            write_bucketed(sums, folder, "t", "sample_url", 4, dealt=True)
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    back = read_bucketed(spark, folder, "t")
    expected = metrics.sample_taxa(counts.where("sample_url = 'hot' or int(substr(sample_url, 2)) % 2 = 0"))
    assert rows(back, "sample_url", "species", "n_rows", "total") == rows(expected, "sample_url", "species", "n_rows", "total")
    per_sample = lambda df: rows(df.groupBy("sample_url").agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("m")))
    assert per_sample(back) == per_sample(expected)


def test_buckets_follow_the_size_of_the_table(spark, folder, monkeypatch):
    from shoalkit.sources import bucketed

    spark.range(100_000).write.parquet(f"{folder}/t")
    table = spark.read.parquet(f"{folder}/t")
    assert bucketed.buckets_for(table) == bucketed.LEAST_BUCKETS
    monkeypatch.setattr(bucketed, "BUCKET_BYTES", 1024)
    assert bucketed.buckets_for(table) > 100
    monkeypatch.setattr(bucketed, "planned_bytes", lambda df: None)
    assert bucketed.buckets_for(table) == bucketed.BUCKETS


def test_metrics_are_dealt_out_with_one_row_a_sample(spark, make):
    from shoalkit.operators import events, metrics
    from tests.conftest import COUNTS, DEPLOYMENTS, LIFE, deployment

    sites = events.prepare_deployments(make([deployment(f"s{i}", "C1", "2020-01-01") for i in range(9)], DEPLOYMENTS))
    life = make([("F", "G", "a", "Actinopterygii", 10.0, None)], LIFE)
    sums, samples = metrics.sample_taxa(make([("s1", "F", "G", "a", 3)], COUNTS)), metrics.samples_with_events(sites)
    dealt = []
    found = metrics.metrics_of_samples(sums, samples, life, arrange=lambda df: dealt.append(df) or df.repartitionByRange("bioregion", "sample_url"))
    assert dealt[0].count() == 9 and rows(found) == rows(metrics.metrics_of_samples(sums, samples, life))
    assert found.count() == 19
