"""No side whose rows its bytes on disk do not tell is broadcast."""

from pyspark.sql import functions as F

from riskloom.operators import quality, text


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_labels_of_many_k_are_not_broadcast(spark, tmp_path):
    spark.range(1, 41).select(F.col("id").alias("file_id"), F.lit(3).cast("bigint").alias("loc")).write.parquet(str(tmp_path / "loc"))
    loc = spark.read.parquet(str(tmp_path / "loc"))
    labels = loc.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12)))).select(F.col("k").cast("bigint").alias("k"), "file_id").withColumn("label", F.col("file_id") % F.col("k"))
    touched = loc.select((F.col("file_id") % 7).alias("commit"), "file_id")
    inner = quality.inner_changes(labels, touched)
    assert "Broadcast" not in plan(inner)
    assert "Broadcast" not in plan(quality.label_loc(labels, loc))
    assert "Broadcast" not in plan(quality.cluster_data(labels, loc, touched=touched))
    assert inner.filter("k = 1").first().in_change == sum(m * (m - 1) // 2 for m in [6, 6, 6, 6, 6, 5, 5])


def test_document_counts_are_not_broadcast(spark):
    tf = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "file_id bigint, word string, tf bigint")
    weights = text.tfidf_l2(tf, F.lit(2))
    assert "Broadcast" not in plan(weights)
    assert weights.count() == 3
