"""Joins on a key that most rows share are split by Spark."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import cochange, text
from riskloom.runtime import below_warehouse, store

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.files.maxPartitionBytes": "16k",
    "spark.sql.files.openCostInBytes": "1k",
}


@pytest.fixture
def small_parts(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def split(df):
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark, name):
    """20,000 rows, nine tenths of them with the key 0."""
    key = F.when(F.col("id") % 10 > 0, F.lit(0)).otherwise(F.col("id") % 97 + 1)
    return store(spark.range(20_000).repartition(8).select(F.col("id").alias("file_id"), key.cast("bigint").alias(name)))


def test_hot_word(small_parts):
    spark = small_parts
    tf = store(hot_rows(spark, "w").select("file_id", F.col("w").cast("string").alias("word"), F.lit(1).cast("bigint").alias("tf")))
    n = F.lit(20_000)
    vectors = spark.range(98).select(F.col("id").cast("string").alias("token"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vec"))
    files = tf.select("file_id")
    assert split(text.doc_vectors(tf, vectors, 2, files, text.idf(tf, n), n))
    assert split(text.tfidf_l2(tf, n))


def test_hot_commit(small_parts):
    touched = hot_rows(small_parts, "commit").select("commit", "file_id")
    assert split(cochange.cochange_degree(touched))


def test_no_machine_local_folder_on_a_cluster():
    assert below_warehouse("local[8]", "file:/tmp/w") == "file:/tmp/w/_checkpoints"
    assert below_warehouse("yarn", "hdfs://store/w") == "hdfs://store/w/_checkpoints"
    for master, folder in (("yarn", "file:/tmp/w"), ("spark://host:7077", "/tmp/w"), ("local-cluster[2,1,1024]", "file:///tmp/w")):
        with pytest.raises(ValueError):
            below_warehouse(master, folder)
