"""Named queries: every operator over the test tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import (
    assignment, cochange, compare, hierarchy, history, hotspots, increments, kmeans, paths, quality, scoring, similarity, splitting, text,
)
from riskloom.operators.history import history_summary, release_diff
from riskloom.plans import pipelines
from riskloom.plans.views import V1_END, V2_START, Tables
from riskloom.runtime import new_path, settle, spread, store
from riskloom.sources import scans, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EMBEDDING_DIM = 64
KMEANS_KS = [5, 10, 20]
KMEANS_STARTS = 10
PIECE_BLOCK = 4096  # vectors of a block where only pieces of the distance matrix are wanted
CUT_KS = [5, 10, 20, 50, 100]


def query(fn: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def _r(column: str, decimals: int = 8):
    return F.round(F.col(column), decimals).alias(column)


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# ---- sources and sinks ---------------------------------------------------------------------


@query
def line_count(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", C.line_count(F.col("text")).alias("loc"))


@query
def token_filter(t: Tables) -> DataFrame:
    kept = text.keep_tokens(t.tokens())
    return kept.select("file_id", F.col("pos").cast("bigint").alias("pos"), "text", "token_type")


@query
def union_parts(t: Tables) -> DataFrame:
    parts = [
        t("customer").select(F.col("c_name").alias("issue_key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("component")),
        t("supplier").select(F.col("s_name").alias("issue_key"), F.col("s_nationkey").alias("nation")),
    ]
    return scans.union_parts(parts, ["issue_key", "nation", "component"])


@query
def smell_concat(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_tax")
    return scans.concat_first_columns([rows.filter(F.col("l_linestatus") == s) for s in ("F", "O")], 5)


@query
def top_list_parse(t: Tables) -> DataFrame:
    stored = t("part").select(
        F.col("p_partkey").alias("file_id"),
        F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", "), F.col("p_partkey").cast("string"), F.lit("]")).alias("stored"),
    )
    labels = C.top_list(F.col("stored"))
    return stored.select(
        "file_id", F.size(labels).cast("bigint").alias("n"), labels[0].cast("bigint").alias("first"),
        F.element_at(labels, -1).cast("bigint").alias("last"),
    )


@query
def add_columns(t: Tables) -> DataFrame:
    stored = t("supplier").select("s_suppkey", "s_name", "s_acctbal")
    return sinks.add_columns(stored, {"version": F.lit("1.2.0"), "s_name": F.upper("s_name")})


@query
def matrix_dense(t: Tables) -> DataFrame:
    """Nation x nation order flow as a dense matrix, read back as cells."""
    flow = compare.cluster_deps(t.dependencies(), t.dependency_labels())
    both = flow.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum("w").cast("bigint").alias("w")
    )
    dense = sinks.densify(both, t("nation").select(F.col("n_nationkey").alias("file_id")))
    return sinks.matrix_cells(dense).select(
        F.col("id").cast("bigint").alias("row_id"), F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("bigint").alias("w")
    )


@query
def cluster_layout(t: Tables) -> DataFrame:
    named = t("part").select(
        F.col("p_partkey").alias("file_id"),
        F.concat(F.lit("src/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit(".java")).alias("path"),
    )
    return compare.cluster_layout(named.join(t.labels(), "file_id")).select(
        "file_id", F.col("label").cast("bigint").alias("label"), "target"
    )


# Files are written to the shared folder in the layout of the inputs, and read back.


@query
def project_list(t: Tables) -> DataFrame:
    """Nations as the projects of a run."""
    path = new_path(t.spark)
    name = F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("-")))
    rows = t("nation").select(
        name.alias("project"), F.lit("1.2.0").alias("exp_version"), F.concat(F.lit("branch-"), F.col("n_regionkey").cast("string")).alias("exp_branch"),
        F.lit("2.3.0").alias("new_version"), F.lit("main").alias("new_branch"), F.upper(name).alias("jira_key"), F.col("n_nationkey").alias("jira_bugs_amount"),
    )
    sinks.write_table(rows, path)
    return scans.read_projects(t.spark, path)


@query
def log_blocks(t: Tables) -> DataFrame:
    """The log as one text, split at its separator and parsed; every tenth block lacks a field and is dropped."""
    path = new_path(t.spark)
    date = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")
    person = F.when(F.col("commit") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("commiter:c"), F.col("commiter").cast("string"), F.lit("||")))
    block = F.concat(
        F.lit("commit-hash:"), F.col("commit").cast("string"), F.lit("||message:"), "message",
        F.lit("||__unique-date-mark:"), date, F.lit("+08:00||"), person, F.lit("\n\n1\t2\tsrc/A.java\n"),
    )
    t.commits().select(block.alias("value")).write.option("lineSep", "commit-block:").text(path)
    commits = history.parse_blocks(scans.read_log_blocks(t.spark, path))
    return commits.select("commit", "commiter", "message", F.size("paths").cast("bigint").alias("n_paths"))


@query
def commit_records(t: Tables) -> DataFrame:
    """Commits with their changed files as JSON records."""
    path = new_path(t.spark)
    files = t.changes().select(
        "commit", F.struct(F.col("pos"), F.col("insertions").cast("string").alias("insertions"), F.col("deletions").cast("string").alias("deletions"),
                           F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("path")).alias("p"))
    paths = files.groupBy("commit").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.dropFields("pos")).alias("paths"))
    rows = t.commits().join(paths, "commit").select(
        F.col("commit").cast("string").alias("commit"), F.col("commiter").cast("string").alias("commiter"), F.col("date").cast("string").alias("date"), "message", "paths"
    )
    sinks.write_records(rows, path)
    back = scans.read_commit_lines(t.spark, path)
    return back.select("commit", "commiter", "message", F.posexplode("paths").alias("pos", "p")).select(
        "commit", "commiter", "message", F.col("pos").cast("bigint").alias("pos"), "p.insertions", "p.deletions", "p.path"
    )


@query
def label_list(t: Tables) -> DataFrame:
    path = new_path(t.spark)
    sinks.write_table(t.files().join(t.labels(), "file_id").select("path", "label"), path, header=False)
    return scans.read_labels(t.spark, path).select("path", F.col("label").cast("bigint").alias("label"))


@query
def loc_list(t: Tables) -> DataFrame:
    """Lines of code per path; parts of one line have no count and are dropped."""
    path = new_path(t.spark)
    counted = F.when(F.col("loc") > 1, F.col("loc"))
    sinks.write_table(t.files().select(F.col("path").alias("Name"), counted.alias("CountLineCode")), path)
    return scans.read_loc(t.spark, path)


@query
def file_list(t: Tables) -> DataFrame:
    """Paths in the order of their files; the row number is the id."""
    path = new_path(t.spark)
    sinks.write_table(t.files().orderBy("file_id").select("path"), path, header=False)
    return scans.read_file_list(t.spark, path)


@query
def matrix_file(t: Tables) -> DataFrame:
    """Nation x nation order flow as a dense file, read back as its non-zero upper cells."""
    path = new_path(t.spark)
    flow = compare.cluster_deps(t.dependencies(), t.dependency_labels())
    both = flow.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").cast("bigint").alias("w"))
    sinks.write_matrix(both, t("nation").select(F.col("n_nationkey").alias("file_id")), path)
    return scans.read_matrix(t.spark, path).select("a", "b", F.col("w").cast("bigint").alias("w"))


@query
def token_vector_file(t: Tables) -> DataFrame:
    path = new_path(t.spark)
    numbers = F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), " ")
    t("embeddings").select(F.concat(F.lit("tok"), F.col("vec_id").cast("string"), F.lit(" "), numbers).alias("value")).write.text(path)
    return scans.read_token_vectors(t.spark, path).select("token", F.posexplode("vec").alias("dim", "value")).select(
        "token", F.col("dim").cast("bigint").alias("dim"), "value"
    )


@query
def issue_export(t: Tables) -> DataFrame:
    """Two parts of an issue export under the fixed columns."""
    parts = []
    for name, prefix in (("customer", "c"), ("supplier", "s")):
        rows = t(name)
        values = {"Issue Type": F.lit("Bug"), "Issue key": F.col(f"{prefix}_name"), "Summary": F.concat(F.lit('a "b", '), F.col(f"{prefix}_name"))}
        parts.append(new_path(t.spark))
        sinks.write_table(rows.select(*[values.get(c, F.lit("")).alias(c) for c in scans.ISSUE_COLUMNS]), parts[-1])
    merged = scans.merge_issue_parts(t.spark, parts)
    return merged.select(F.col("`Issue Type`").alias("issue_type"), F.col("`Issue key`").alias("issue_key"))


@query
def issue_list(t: Tables) -> DataFrame:
    path = new_path(t.spark)
    sinks.write_table(t.issues().select(F.col("issue_key").alias("Issue key"), F.lit("x\ny").alias("Summary")), path)
    return scans.read_issues(t.spark, path).select("issue_key")


@query
def dependency_list(t: Tables) -> DataFrame:
    path = new_path(t.spark)
    sinks.write_table(t.dependencies().select(F.col("src").alias("From File"), F.col("dst").alias("To File"), F.col("w").alias("References"), F.lit(1).alias("Other")), path)
    return scans.read_dependencies(t.spark, path)


@query
def rsf_file(t: Tables) -> DataFrame:
    path = new_path(t.spark)
    named = t.files().join(t.labels(), "file_id").withColumn("member", F.replace(C.dotted_path(F.col("path"), "/root/src/"), F.lit(" "), F.lit("_")))
    sinks.write_rsf(sinks.rsf_rows(named, F.col("label"), F.col("member")), path)
    return t.spark.read.csv(path, sep=" ", schema="relation STRING, grp STRING, member STRING")


@query
def result_append(t: Tables) -> DataFrame:
    """Result rows of two runs in one table, lists included."""
    path = new_path(t.spark)
    rows = t("nation").select(F.col("n_name").alias("project"), F.array("n_nationkey", "n_regionkey").alias("top_buggy_cluster"))
    for region in ("n_regionkey < 2", "n_regionkey >= 2"):
        sinks.append_result(t("nation").filter(region).join(rows.withColumnRenamed("project", "n_name"), "n_name").select(F.col("n_name").alias("project"), "top_buggy_cluster"), path)
    back = scans.read_results(t.spark, path)
    return back.select("project", F.posexplode("top_buggy_cluster").alias("pos", "label")).select(
        "project", F.col("pos").cast("bigint").alias("pos"), F.col("label").cast("bigint").alias("label")
    )


# ---- history -------------------------------------------------------------------------------


@query
def log_parse(t: Tables) -> DataFrame:
    """Log text made from the tables, one block per changed line, and parsed back.

    Messages hold characters that are line ends to some readers, but not to the log.
    """
    made = (
        spread(t("lineitem"))
        .join(t.commits().withColumnRenamed("commit", "l_orderkey"), "l_orderkey")
        .join(t.files().withColumnRenamed("file_id", "l_partkey"), "l_partkey")
    )
    date = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")
    header = F.concat(
        F.lit("commit-hash:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
        F.lit("||message:"), "message", F.lit(" a\rb\u0085c\u2028d"), F.lit("||__unique-date-mark:"), date, F.lit("+08:00||commiter:c"),
        F.col("commiter").cast("string"), F.lit("||"),
    )
    changed = F.concat_ws("\t", F.col("l_quantity").cast("bigint").cast("string"), F.lit("0"), C.backslashes(F.col("path")))
    block = F.concat(header, F.lit("\n\n"), changed, F.lit("\n-\t-\tdocs\\logo.png\n"))
    blocks = made.select(block.alias("block"), F.lit(0).alias("pos"))
    commits = history.parse_blocks(blocks)
    head = commits.select("commit", "commiter", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "message", F.explode("paths").alias("p"))
    return head.select("commit", "commiter", "date", "message", "p.insertions", "p.deletions", "p.path")


@query
def path_norm(t: Tables) -> DataFrame:
    stored = C.backslashes(F.col("path"))
    return t.files().select("file_id", stored.alias("stored"), C.slashes(stored).alias("path"))


@query
def java_filter(t: Tables) -> DataFrame:
    kinds = F.when(F.col("loc") > 40, F.lit(None)).when(F.col("loc") > 30, F.replace(F.col("path"), F.lit(".java"), F.lit(".md"))).when(
        F.col("loc") > 20, F.replace(F.col("path"), F.lit(".java"), F.lit("-java.txt"))
    ).otherwise(F.col("path"))
    mixed = t.files().select("file_id", kinds.alias("path"))
    return mixed.select(
        "file_id",
        F.coalesce(C.is_java_strict(F.col("path")).cast("int"), F.lit(-1)).alias("strict"),
        C.is_java_loose(F.col("path")).cast("int").alias("loose")
    )


@query
def issue_match(t: Tables) -> DataFrame:
    return history.match_issues(t.commits(), t.issues()).select("commit", "commiter", "message")


@query
def issue_match_exact(t: Tables) -> DataFrame:
    return history.match_issues(t.commits(), t.issues(), exact=True).select("commit", "commiter", "message")


@query
def issue_counts(t: Tables) -> DataFrame:
    return history.issue_counts(t.commits(), t.issues())


@query
def release_increment(t: Tables) -> DataFrame:
    """Changed lines whose commit occurs once in the newer release and not in the older one."""
    line = t("lineitem").select(
        F.col("l_orderkey").alias("commit"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("file_id"), "l_shipdate"
    )
    new = line.filter(F.col("l_shipdate") >= _ts(V2_START)).drop("l_shipdate")
    old = line.filter(F.col("l_shipdate") < _ts(V2_START)).drop("l_shipdate")
    return release_diff(new, old)


@query
def release_commits(t: Tables) -> DataFrame:
    commits = t("orders").select(
        F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("commiter"), F.col("o_orderdate").alias("date")
    )
    newer = release_diff(commits.filter(F.col("date") >= _ts(V2_START)), commits.filter(F.col("date") < _ts(V1_END)))
    return newer.select("commit", "commiter")


@query
def history_counts(t: Tables) -> DataFrame:
    commits = t("orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("date"))
    fixes = t.fix_commits()
    v2, v1 = (lambda d: d.filter(F.col("date") >= _ts(V2_START))), (lambda d: d.filter(F.col("date") < _ts(V1_END)))
    return history_summary(v2(commits), v1(commits), v2(fixes), v1(fixes))


@query
def report_counts(t: Tables) -> DataFrame:
    printed = F.concat(
        F.lit("Analysis 3 done\nTotal classes: "), F.col("p_size").cast("string"), F.lit("\nSmells found: "),
        F.col("p_partkey").cast("string"), F.lit("; skipped 7\n"),
    )
    numbers = C.printed_numbers(printed)
    return t("part").select(
        F.col("p_partkey").alias("file_id"), F.size(numbers).cast("bigint").alias("n"), F.array_join(numbers.cast("array<string>"), ",").alias("numbers")
    )


# ---- paths and co-change -------------------------------------------------------------------


@query
def path_resolve(t: Tables) -> DataFrame:
    """Log paths below the checkout folder."""
    files = t.files()
    logged = files.select(F.replace(F.col("path"), F.lit("/root/"), F.lit("")).alias("log_path"))
    return paths.resolve_paths(logged, files)


@query
def path_ambiguous(t: Tables) -> DataFrame:
    """File names without their ending, which longer names contain as well."""
    files = t.files()
    logged = files.select(F.replace(C.basename(F.col("path")), F.lit(".java"), F.lit("")).alias("log_path"))
    return paths.ambiguous_paths(logged, files)


@query
def cochange_matrix(t: Tables) -> DataFrame:
    return cochange.cochange(t.touches())


@query
def cochange_increment(t: Tables) -> DataFrame:
    """Co-change of the newer release, from a stored matrix of the older one and what is added and dropped."""
    dates = t("orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("date"))
    touched = store(t.touches().join(dates, "commit"))
    old, new = touched.filter(F.col("date") < _ts(V1_END)).drop("date"), touched.filter(F.col("date") >= _ts(V2_START)).drop("date")
    path = new_path(t.spark)
    increments.put(increments.delta(old), path, 0)
    increments.put(increments.delta(*increments.changes_between(old, new)), path, 1)
    return increments.matrix(t.spark, path)


@query
def cochange_degree(t: Tables) -> DataFrame:
    return cochange.cochange_degree(t.touches())


# ---- text and vectors ----------------------------------------------------------------------


@query
def doc_tokens(t: Tables) -> DataFrame:
    words = text.clean_words(F.col("text"))
    return t.documents().select("doc_id", F.size(words).cast("bigint").alias("n"), F.array_join(words, " ").alias("words"))


@query
def split_identifiers(t: Tables) -> DataFrame:
    camel = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("XML"), F.initcap("p_type"), F.lit("_"), "p_brand")
    return t("part").select(F.col("p_partkey").alias("file_id"), F.array_join(C.split_identifier(camel), " ").alias("words"))


@query
def split_glued(t: Tables) -> DataFrame:
    """Every distinct word of the documents, cut into words that the documents use."""
    tf = store(t.tf())
    found = splitting.splits(tf, splitting.unigrams(tf))
    return found.select("word", F.array_join("parts", " ").alias("words"))


@query
def idf(t: Tables) -> DataFrame:
    return text.idf(t.tf(), t.n_documents()).select("word", "df", _r("idf"))


def _long(vectors: DataFrame, decimals: int = 7) -> DataFrame:
    cells = vectors.select("file_id", "known", F.posexplode("vec").alias("dim", "value"))
    return cells.select("file_id", "known", F.col("dim").cast("bigint").alias("dim"), (F.round("value", decimals) + 0.0).alias("value"))


@query
def doc_vector(t: Tables) -> DataFrame:
    n = t.n_documents()
    tf = store(t.tf())
    files = t("documents").select(F.col("doc_id").alias("file_id"))
    return _long(text.doc_vectors(tf, t.token_vectors(tf), EMBEDDING_DIM, files, text.idf(tf, n), n))


@query
def doc_vector_plain(t: Tables) -> DataFrame:
    tf = store(t.tf())
    files = t("documents").select(F.col("doc_id").alias("file_id"))
    return _long(text.doc_vectors(tf, t.token_vectors(tf), EMBEDDING_DIM, files))


@query
def file_vectors(t: Tables) -> DataFrame:
    """The default vectoriser by name: split identifiers, weights, weighted means."""
    vectors = pipelines.file_vectors(t.documents(), "doc_id", "text", "c2v_tfidf", t.token_vectors(store(t.tf())), EMBEDDING_DIM)
    return vectors.select("file_id", F.posexplode("vec").alias("dim", "value")).select(
        "file_id", F.col("dim").cast("bigint").alias("dim"), (F.round("value", 7) + 0.0).alias("value")
    )


@query
def tfidf_l2(t: Tables) -> DataFrame:
    """Count-vector tf-idf of the file paths."""
    files = t.files()
    terms = files.select("file_id", F.explode(text.vectorizer_terms(F.col("path"))).alias("word"))
    n = files.agg(F.count(F.lit(1)).alias("n")).scalar()
    return text.tfidf_l2(text.count_words(terms), n).select("file_id", "word", _r("weight"))


@query
def lsa(t: Tables) -> DataFrame:
    return text.lsa(text.tfidf_l2(t.tf(), t.n_documents()))


@query
def doc_embed(t: Tables) -> DataFrame:
    return text.doc_embed(t.documents(), "doc_id", text.clean_words(F.col("text")))


@query
def cosine_matrix(t: Tables) -> DataFrame:
    pairs = similarity.cosine_pairs(t.vectors())
    return pairs.select("a", "b", "sim", F.round(1 - F.col("sim"), 2).alias("dist"))


# ---- clustering ----------------------------------------------------------------------------


def _tree(t: Tables) -> pipelines.Dendrogram:
    return pipelines.dendrogram(t.vectors(), t.loc(), t.touches())


@query
def ahc_merges(t: Tables) -> DataFrame:
    return _tree(t).merges.select("step", "a", "b", _r("height", 10), "files", "loc", "degree", "in_change")


@query
def ahc_labels(t: Tables) -> DataFrame:
    tree = _tree(t)
    labels = hierarchy.cut(tree.merges, tree.leaves, CUT_KS)
    return labels.select(F.col("k").cast("bigint").alias("k"), "file_id", "root", F.col("label").cast("bigint").alias("label"))


@query
def ahc_sweep(t: Tables) -> DataFrame:
    tree = _tree(t)
    return hierarchy.sweep_criteria(tree.merges, tree.leaves).select("k", *[_r(c) for c in quality.CRITERIA])


@query
def cluster_selection(t: Tables) -> DataFrame:
    return pipelines.select_clusters(_tree(t)).select("files", "iteration", "f_optimal", _r("score"))


def _trees(t: Tables) -> tuple[pipelines.Dendrogram, DataFrame]:
    """Dendrograms of all projects, and the best cut of each."""
    tree = pipelines.dendrogram(t.vectors().withColumn("project", t.project(F.col("file_id"))), t.loc(), t.touches(), by=["project"])
    return tree, pipelines.select_clusters(tree, by=["project"])


@query
def project_selection(t: Tables) -> DataFrame:
    """Best cut of each project, all in the same rounds; one project has half of all files."""
    return _trees(t)[1].select("project", "files", "iteration", "f_optimal", _r("score"))


@query
def project_labels(t: Tables) -> DataFrame:
    """Labels of the best cut of each project."""
    tree, best = _trees(t)
    labels = pipelines.chosen_labels(tree, settle(best), ["project"])
    return labels.select("project", "file_id", F.col("label").cast("bigint").alias("label"))


@query
def kmeans_labels(t: Tables) -> DataFrame:
    return kmeans.kmeans_labels(settle(similarity.distance_rows(t.vectors())), KMEANS_KS)


@query
def kmeans_restarts(t: Tables) -> DataFrame:
    return kmeans.kmeans_labels(settle(similarity.distance_rows(t.vectors())), KMEANS_KS, restarts=5)


@query
def kmeans_selection(t: Tables) -> DataFrame:
    """Best k of k-means over all k from 2 to the number of distinct rows."""
    loc = t.vectors().select("file_id").join(t.loc(), "file_id", "left").select("file_id", F.coalesce("loc", F.lit(0)).alias("loc"))
    touched = settle(t.touches().join(loc.select("file_id"), "file_id", "left_semi"))
    best = pipelines.select_kmeans(settle(similarity.distance_rows(t.vectors())), settle(loc), touched, restarts=KMEANS_STARTS)
    return best.select("files", "iteration", "f_optimal", _r("score"))


@query
def kmeans_sweep_limit(t: Tables) -> DataFrame:
    return kmeans.sweep_limit(similarity.distance_pieces(t.vectors(), block=PIECE_BLOCK))


# ---- quality and scoring -------------------------------------------------------------------

_BASE = ["in_change", "out_change", "in_file", "out_file", "in_loc", "out_loc"]
_RATES = quality.CRITERIA[:4]


@query
def label_loc(t: Tables) -> DataFrame:
    return quality.label_loc(t.labels(), t.loc()).select("file_id", F.col("label").cast("bigint").alias("label"), "loc")


def _clusters(t: Tables) -> DataFrame:
    return quality.cluster_data(t.labels_k(), t.loc(), touched=t.touches())


@query
def cluster_data(t: Tables) -> DataFrame:
    return _clusters(t).select("k", "label", *_BASE, *[_r(c, 10) for c in _RATES])


@query
def cluster_data_matrix(t: Tables) -> DataFrame:
    """The same from a stored co-change matrix, for one label table."""
    labels = t.labels().select(F.lit(25).cast("bigint").alias("k"), "file_id", F.col("label").cast("bigint").alias("label"))
    return quality.cluster_data(labels, t.loc(), edges=store(cochange.cochange(t.touches()))).select("k", "label", *_BASE, *[_r(c, 10) for c in _RATES])


@query
def cluster_rates(t: Tables) -> DataFrame:
    """Rates of a stored base table."""
    base = _clusters(t).select("k", "label", *_BASE)
    return quality.with_rates(base, zero_safe=False).select("k", "label", *[_r(c, 10) for c in _RATES])


@query
def ned(t: Tables) -> DataFrame:
    return quality.ned(t.labels_k()).select("k", _r("ned"))


def _criteria(t: Tables) -> DataFrame:
    return pipelines.labelled_criteria(t.labels_k(), t.loc(), t.touches())


@query
def k_criteria(t: Tables) -> DataFrame:
    return _criteria(t).select("k", *[_r(c, 10) for c in [*_RATES, "change_file_rate", "change_loc_rate", "ned"]])


@query
def minmax_scale(t: Tables) -> DataFrame:
    rows = t("customer").select("c_custkey", F.col("c_acctbal").alias("gain"), (F.col("c_acctbal") * F.col("c_acctbal")).alias("cost"))
    return scoring.minmax_scale(rows, {"gain": "pos", "cost": "neg"}).select("c_custkey", _r("gain"), _r("cost"))


@query
def entropy_weights(t: Tables) -> DataFrame:
    rows = t("part").select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    scaled = scoring.minmax_scale(rows, {"size": "pos", "price": "neg"})
    return scoring.entropy_weights(scaled, ["size", "price"]).select("criterion", _r("weight"))


@query
def k_score(t: Tables) -> DataFrame:
    return pipelines.score_cuts(_criteria(t)).select("k", *[_r(c) for c in quality.CRITERIA], _r("score"))


@query
def f_optimal(t: Tables) -> DataFrame:
    return scoring.best_k(pipelines.score_cuts(_criteria(t))).select("k", _r("score"))


# ---- bug concentration ---------------------------------------------------------------------


def _risk(t: Tables, fixes: DataFrame) -> pipelines.RiskRanking:
    return pipelines.rank_risk(fixes, t.labels(), t.loc())


def _label(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("label").cast("bigint").alias("label"), *columns)


@query
def bug_space(t: Tables) -> DataFrame:
    return _label(hotspots.bug_space(t.fixes(), t.labels()), "file_id", "bugs")


@query
def bug_decision(t: Tables) -> DataFrame:
    return _label(_risk(t, t.fixes()).decision, *[_r(c) for c in hotspots.BUG_CRITERIA], "bug_files")


@query
def bug_cluster_rank(t: Tables) -> DataFrame:
    """Clusters ranked by bug concentration."""
    ranked = _risk(t, t.fixes()).ranked
    return _label(ranked, *[_r(c) for c in hotspots.BUG_CRITERIA], _r("score")).orderBy(F.col("score").desc(), "label")


@query
def top_clusters(t: Tables) -> DataFrame:
    return _label(_risk(t, t.fixes()).top, "rank", "running", "threshold", "bug_space_files")


def _risk_by_project(t: Tables) -> pipelines.RiskRanking:
    """Part types as projects, ranked in one go."""
    project = t("part").select(F.col("p_partkey").alias("file_id"), F.col("p_type").alias("project"))
    keyed = lambda df: df.join(project, "file_id")
    return pipelines.rank_risk(keyed(t.fixes()), keyed(t.labels()), keyed(t.loc()), by=["project"])


@query
def project_cluster_rank(t: Tables) -> DataFrame:
    ranked = _risk_by_project(t).ranked
    return ranked.select("project", F.col("label").cast("bigint").alias("label"), *[_r(c) for c in hotspots.BUG_CRITERIA], _r("score"))


@query
def project_top_clusters(t: Tables) -> DataFrame:
    return _risk_by_project(t).top.select("project", F.col("label").cast("bigint").alias("label"), "rank", "running", "threshold", "bug_space_files")


@query
def fix_locality(t: Tables) -> DataFrame:
    return _label(hotspots.fix_locality(t.fixes(), t.labels()), "bf", "bf_in", "bf_out")


@query
def churn_by_cluster(t: Tables) -> DataFrame:
    return _label(hotspots.churn_by_cluster(t.fixes(), t.labels()), "churn")


def _shown(report: DataFrame) -> DataFrame:
    """The report with rounded rates and its list of clusters as text."""
    doubles = [c for c, kind in report.dtypes if kind == "double"]
    return report.select(
        *[_r(c) if c in doubles else F.col(c) for c in report.columns[:-1]],
        F.array_join(F.col("top_buggy_cluster").cast("array<string>"), ",").alias("top_buggy_cluster"),
    )


@query
def risk_report(t: Tables) -> DataFrame:
    fixes = t.fixes_v1()
    risk = _risk(t, fixes)
    return _shown(hotspots.risk_report(fixes, t.labels(), t.loc(), risk.decision, risk.top, "parts"))


@query
def project_risk_report(t: Tables) -> DataFrame:
    """The same for all projects in one go; one project has half of all files."""
    keyed = lambda df: df.withColumn("project", t.project(F.col("file_id")))
    fixes, labels, loc = keyed(t.fixes_v1()), keyed(t.labels()), keyed(t.loc())
    risk = pipelines.rank_risk(fixes, labels, loc, by=["project"])
    return _shown(hotspots.risk_reports(fixes, labels, loc, risk.decision, risk.top, ["project"]))


@query
def next_release_report(t: Tables) -> DataFrame:
    report = hotspots.next_release_report(t.fixes_next(), t.labels(), _risk(t, t.fixes_v1()).top, "parts")
    return report.select(*[_r(c) if kind == "double" else F.col(c) for c, kind in report.dtypes])


@query
def project_next_release(t: Tables) -> DataFrame:
    """The same for all projects in one go; one project has half of all files."""
    keyed = lambda df: df.withColumn("project", t.project(F.col("file_id")))
    labels = keyed(t.labels())
    top = pipelines.rank_risk(keyed(t.fixes_v1()), labels, keyed(t.loc()), by=["project"]).top
    report = hotspots.next_release_reports(keyed(t.fixes_next()), labels, top, by=["project"])
    return report.select(*[_r(c) if kind == "double" else F.col(c) for c, kind in report.dtypes])


# ---- comparison ----------------------------------------------------------------------------

METHODS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query
def size_split(t: Tables) -> DataFrame:
    customers = t("customer").select(F.col("c_name").alias("project"), "c_acctbal", "c_custkey")
    placed = compare.size_split(customers, [F.col("c_acctbal").desc(), F.col("c_custkey")])
    return placed.select("project", "position", "size")


@query
def metric_gather(t: Tables) -> DataFrame:
    listed = t("nation").filter("n_regionkey <= 1").select(F.col("n_name").alias("project"))
    return compare.metric_gather(t.metrics().filter(F.col("method") == METHODS[0]), listed, "value").select("project", _r("value", 6))


@query
def metric_pivot(t: Tables) -> DataFrame:
    return compare.metric_pivot(t.metrics(), METHODS)


@query
def cliffs_delta(t: Tables) -> DataFrame:
    """Effect size of one method against the others over the metric table with its Average row."""
    table = settle(compare.metric_pivot(t.metrics(), METHODS))
    deltas = compare.cliffs_delta(compare.delta_samples(table, METHODS[0], METHODS[1:]))
    return deltas.select("method", _r("delta"), "magnitude", "report")


@query
def cliffs_delta_orders(t: Tables) -> DataFrame:
    """Effect size over all order prices: urgent orders against each other priority."""
    others = F.array(*[F.lit(p) for p in PRIORITIES])
    urgent = F.col("o_orderpriority") == "1-URGENT"
    samples = t("orders").select(
        F.col("o_totalprice").alias("value"),
        F.when(urgent, "a").otherwise("b").alias("side"),
        F.explode(F.when(urgent, others).otherwise(F.array("o_orderpriority"))).alias("method"),
    )
    return compare.cliffs_delta(samples).select("method", _r("delta"), "magnitude", "report")


@query
def cluster_deps(t: Tables) -> DataFrame:
    flow = compare.cluster_deps(t.dependencies(), t.dependency_labels())
    return flow.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "w")


@query
def mq(t: Tables) -> DataFrame:
    return compare.mq(compare.cluster_deps(t.dependencies(), t.dependency_labels())).select(_r("mq"))


@query
def smell_jaccard(t: Tables) -> DataFrame:
    smells = t.smells()
    chosen = t("nation").filter("n_regionkey <= 1").select(F.col("n_nationkey").cast("string").alias("project"))
    report = compare.smell_jaccard(smells.filter(F.col("l_linestatus") == "F"), smells, chosen)
    return report.select("in_whole", "in_chosen", "shared", "all_smells", _r("jaccard"))


@query
def dir_group(t: Tables) -> DataFrame:
    """Directory groups of page addresses and file paths."""
    stored = t.files().select("path").unionByName(t("pages").select(F.col("url").alias("path")))
    return stored.select(C.directory_group(F.col("path"), "/root/").alias("grp"), C.dotted_path(F.col("path"), "/root/").alias("member"))


@query
def cluster_rsf(t: Tables) -> DataFrame:
    labelled = t.files().join(t.labels(), "file_id")
    return sinks.rsf_rows(labelled, F.col("label"), C.dotted_path(F.col("path"), "/root/src/"))


def _groupings(t: Tables) -> tuple[DataFrame, DataFrame]:
    brands = t.labels().select("file_id", F.col("label").cast("string").alias("grp"))
    types = t("part").select(F.col("p_partkey").alias("file_id"), F.col("p_type").alias("grp"))
    return brands, types


@query
def grouping_overlap(t: Tables) -> DataFrame:
    return compare.grouping_overlap(*_groupings(t), on="file_id")


@query
def group_assignment(t: Tables) -> DataFrame:
    """Agreement of the two groupings by the best pairing of their groups."""
    a, b = _groupings(t)
    found = assignment.agreement(a, b, compare.grouping_overlap(a, b, on="file_id"), on="file_id")
    return found.select("a_groups", "b_groups", "shared", "kept", "changes", _r("a2a"))


@query
def mojofm(t: Tables) -> DataFrame:
    return compare.mojofm(compare.grouping_overlap(*_groupings(t), on="file_id"))
