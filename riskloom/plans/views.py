"""The version-control tables as views over the star-schema test tables.

Files are parts, commits are orders, changed files are line items, vectors are embeddings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import cochange, hotspots, text
from riskloom.operators.history import release_diff
from riskloom.runtime import spread

V1_END, V2_START = "1999-01-01", "1997-01-01"
SWEEP = 12  # number of cuts in labels_k


class Tables:
    """Tables of one data folder; every attribute call is a lazy scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # files and history ------------------------------------------------------------------

    def files(self) -> DataFrame:
        path = F.concat(
            F.lit("/root/src/"), "p_type", F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")),
            F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".java"),
        )
        return self("part").select(
            F.col("p_partkey").alias("file_id"), path.alias("path"), F.col("p_size").cast("bigint").alias("loc")
        )

    def loc(self) -> DataFrame:
        return self("part").select(F.col("p_partkey").alias("file_id"), F.col("p_size").cast("bigint").alias("loc"))

    @staticmethod
    def project(file_id: Column) -> Column:
        """Name of a file's project: one has half of all files, five have the others."""
        return F.when(file_id % 2 == 0, "core").otherwise(F.concat(F.lit("team-"), (file_id % 10).cast("string")))

    def commits(self) -> DataFrame:
        return spread(self("orders")).select(
            F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("commiter"), F.col("o_orderdate").alias("date"),
            F.concat(F.lit("Fix "), "o_orderpriority", F.lit(" for Customer#"), F.col("o_custkey").cast("string")).alias("message"),
        )

    def issues(self) -> DataFrame:
        """Keys of customers: ``customer-17`` matches ``Customer#17`` and ``Customer#170``."""
        return self("customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("issue_key"))

    def changes(self) -> DataFrame:
        line = self("lineitem").select(
            F.col("l_orderkey").alias("commit"),
            F.col("l_linenumber").alias("pos"),
            F.col("l_quantity").cast("bigint").alias("insertions"),
            F.round(F.col("l_discount") * 100).cast("bigint").alias("deletions"),
            F.col("l_partkey").alias("file_id"),
        )
        return hotspots.with_churn(line)

    def touches(self) -> DataFrame:
        return cochange.touches(self.changes())

    def fix_commits(self) -> DataFrame:
        return self("orders").filter(
            (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
        ).select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("date"))

    def fixes(self, commits: DataFrame | None = None) -> DataFrame:
        """Changed files of bug-fix commits."""
        chosen = (self.fix_commits() if commits is None else commits).select("commit")
        return self.changes().join(chosen, "commit", "left_semi")

    def fixes_v1(self) -> DataFrame:
        return self.fixes(self.fix_commits().filter(F.col("date") < F.lit(V1_END).cast("timestamp_ntz")))

    def fixes_next(self) -> DataFrame:
        """Changed files of the fixes that only the newer release has."""
        dated = self.fix_commits()
        new = dated.filter(F.col("date") >= F.lit(V2_START).cast("timestamp_ntz"))
        old = dated.filter(F.col("date") < F.lit(V1_END).cast("timestamp_ntz"))
        return self.fixes(release_diff(new, old))

    # labels -----------------------------------------------------------------------------

    def labels(self) -> DataFrame:
        """25 clusters: the brand number from 0."""
        return self("part").select(
            F.col("p_partkey").alias("file_id"), (F.substring_index("p_brand", "#", -1).cast("int") - 1).alias("label")
        )

    def labels_k(self) -> DataFrame:
        """Labels of twelve k with skewed cluster sizes."""
        part = self("part").select(F.col("p_partkey").alias("file_id"))
        n = part.agg(F.count(F.lit(1)).alias("n")).scalar()
        spread = part.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(SWEEP))))
        return spread.withColumn("k", F.expr("n * i div 40")).select(
            "k", "file_id", F.expr("((file_id * file_id) div n) * k div n").alias("label")
        )

    # texts and vectors ------------------------------------------------------------------

    def documents(self) -> DataFrame:
        return spread(self("documents"))

    def n_documents(self) -> Column:
        return self("documents").agg(F.count(F.lit(1)).alias("n")).scalar()

    def tf(self) -> DataFrame:
        return text.text_words(self.documents(), "doc_id", "text", split_identifiers=True)

    def token_vectors(self, tf: DataFrame) -> DataFrame:
        """A vector for most words, rare ones as well, chosen by a hash of the word; one in sixteen is unknown."""
        known = tf.select("word").distinct().filter(F.substring(F.md5("word"), 9, 1) != "0")
        n = self("embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
        slot = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % n
        vectors = self("embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").cast("array<double>").alias("vec"))
        return known.select(F.col("word").alias("token"), slot.alias("slot")).join(vectors, "slot").select("token", "vec")

    def vectors(self) -> DataFrame:
        return self("embeddings").select(F.col("vec_id").alias("file_id"), F.col("embedding").cast("array<double>").alias("vec"))

    def tokens(self) -> DataFrame:
        """Text lines as lexer tokens."""
        lines = self("documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        kind = F.when(F.col("text").rlike("[0-9]"), "Literal").when(F.length("text") > 40, "Comment").otherwise("Identifier")
        return lines.withColumn("token_type", kind)

    # comparison -------------------------------------------------------------------------

    def metrics(self) -> DataFrame:
        """Mean account balance per nation (project) and market segment (method)."""
        nation = self("nation").select("n_nationkey", F.col("n_name").alias("project"))
        mean = self("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("value"))
        return mean.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "project", F.col("c_mktsegment").alias("method"), "value"
        )

    def dependencies(self) -> DataFrame:
        """Customer orders supplier; names are made after the counts, which hold numbers."""
        owner = self("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        counts = self("lineitem").select("l_orderkey", "l_suppkey").join(owner, "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("w"))
        return counts.select(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"),
            "w",
        )

    def dependency_labels(self) -> DataFrame:
        c = self("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_nationkey").alias("label"))
        s = self("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_nationkey").alias("label"))
        return c.unionByName(s)

    def smells(self) -> DataFrame:
        """Smell rows of every supplier nation (cluster)."""
        part = self("part").select("p_partkey", "p_brand", "p_type", "p_name")
        supplier = self("supplier").select("s_suppkey", "s_nationkey")
        joined = self("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(
            supplier, F.col("l_suppkey") == F.col("s_suppkey")
        )
        return joined.select(
            F.col("s_nationkey").cast("string").alias("project"),
            F.col("p_brand").alias("package"),
            F.col("p_type").alias("type"),
            F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("smell"),
            F.col("p_name").alias("cause"),
            F.col("s_nationkey").alias("cluster"),
            F.col("l_orderkey").alias("pos"),
            "l_linestatus",
        )
