"""A third of all rows under one key: whole results, and joins that split the key."""

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from lodestone.operators import threads
from lodestone.session import overridden
from lodestone.sources.schemas import Table
from lodestone.sources.tables import ChunkStore
from lodestone.streaming import sync

N = 6000
ROWS = {"rows": Table("""item bigint,
    n bigint,
    note string""", "bucket int", "item")}


@pytest.fixture
def small_partitions(spark):
    """Thresholds scaled down so that a few kilobytes count as skewed, and no broadcasts."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark):
    """Rows of which a third belong to item 0."""
    return spark.range(N, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("item"), F.col("id").alias("n"),
        F.sha2(F.col("id").cast("string"), 512).alias("note"))


def test_comments_of_a_hot_issue(spark, small_partitions):
    comments = hot(spark).select(F.col("item").alias("number"), F.col("note").alias("body"),
                                 F.lit("a").alias("author"), F.lit("").alias("created_at"))
    none = F.lit(None).cast("string")
    issues = spark.range(N).select(
        F.col("id").alias("number"), F.lit("t").alias("title"), F.lit("b").alias("body"), F.lit("open").alias("state"),
        F.lit("x").alias("author"), F.array(F.lit("l")).alias("labels"), none.alias("milestone"),
        F.lit("").alias("created_at"), none.alias("closed_at"))
    out = threads.attach_comments(issues, comments).where("is_comment")
    rows = out.collect()
    assert len(rows) == N and sum(r.number == 0 for r in rows) == N // 3
    assert "skew=true" in plan_of(out)


def test_upsert_with_a_hot_id(spark, small_partitions):
    store = ChunkStore.scratch(spark, tables=ROWS, buckets=4)
    store.write("rows", hot(spark))
    new = spark.createDataFrame([(0, -1, "new"), (1, -1, "new")], "item long, n long, note string")
    assert store.replace_by_id("rows", new) == 2
    rows = store.read("rows").groupBy("item").count().collect()
    assert {r["item"]: r["count"] for r in rows} == {0: 1, 1: 1} | {i: 1 for i in range(N) if i % 3}
    assert store.read("rows").where("note = 'new'").count() == 2


def test_latest_of_a_hot_id(spark):
    store = ChunkStore.scratch(spark, tables=ROWS, buckets=4)
    store.create("rows")
    for _ in range(2):
        sync.upsert_latest(store, "rows", hot(spark), [-F.col("n")])
        got = {r.item: r.n for r in store.read("rows").collect()}
        assert got == {0: N - 3} | {i: i for i in range(N) if i % 3}


def test_hot_partition_is_written_by_several_tasks(spark, small_partitions):
    """One bucket holds a third of the rows; the rebalance splits it."""
    store = ChunkStore.scratch(spark, tables=ROWS, buckets=4)
    store.create("rows")
    with overridden(spark, "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true"):
        store.write("rows", hot(spark))
    files = spark.table(store.full_name("rows")).select("bucket", F.input_file_name().alias("f")).distinct() \
        .groupBy("bucket").count().collect()
    assert max(r["count"] for r in files) > 1
