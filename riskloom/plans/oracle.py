"""The registered queries as plain SQL over the same tables, written for DuckDB.

These are independent statements of the expected results: for instance co-change quality
is computed here from all file pairs, and running sums from window functions.
"""

from __future__ import annotations

from riskloom.functions.stopwords import ENGLISH

_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + "]"

def _base(labels: str) -> str:
    """Counts per cluster of a label table."""
    return f"""SELECT g.k, g.label,
        CAST(coalesce(i.w, 0) AS BIGINT) AS in_change,
        CAST(g.all_change - 2 * coalesce(i.w, 0) AS BIGINT) AS out_change,
        g.in_file, (SELECT count(*) FROM files) - g.in_file AS out_file,
        CAST(g.in_loc AS BIGINT) AS in_loc, CAST((SELECT sum(loc) FROM files) - g.in_loc AS BIGINT) AS out_loc
        FROM (SELECT l.k, l.label, count(*) AS in_file, sum(f.loc) AS in_loc, coalesce(sum(d.degree), 0) AS all_change
              FROM {labels} l JOIN files f USING (file_id) LEFT JOIN degree d USING (file_id) GROUP BY 1, 2) g
        LEFT JOIN (SELECT la.k, la.label, sum(e.w) AS w FROM edges e JOIN {labels} la ON la.file_id = e.a
              JOIN {labels} lb ON lb.file_id = e.b AND lb.k = la.k AND lb.label = la.label GROUP BY 1, 2) i
        ON i.k = g.k AND i.label = g.label"""


def _rates(base: str) -> str:
    return f"""SELECT *, in_change / (in_file * in_file) AS in_change_file_r,
        CASE WHEN in_file * out_file <> 0 THEN out_change / (in_file * out_file) END AS out_change_file_r,
        CASE WHEN in_loc <> 0 THEN in_change / (CAST(in_loc AS DOUBLE) * in_loc) ELSE in_change END AS in_change_loc_r,
        CASE WHEN in_loc * out_loc <> 0 THEN out_change / (CAST(in_loc AS DOUBLE) * out_loc) ELSE out_change END AS out_change_loc_r
        FROM {base}"""


# name -> (names it needs, body); kept in dependency order
_CTES: dict[str, tuple[str, str]] = {
    "files": ("", """SELECT p_partkey AS file_id,
        '/root/src/' || p_type || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.java' AS path,
        CAST(p_size AS BIGINT) AS loc FROM part"""),
    "commits": ("", """SELECT o_orderkey AS "commit", o_custkey AS commiter, o_orderdate AS date,
        'Fix ' || o_orderpriority || ' for Customer#' || o_custkey AS message FROM orders"""),
    "issues": ("", """SELECT 'customer-' || c_custkey AS issue_key FROM customer"""),
    "changes": ("", """SELECT l_orderkey AS "commit", l_linenumber AS pos,
        CAST(l_quantity AS BIGINT) + CAST(round(l_discount * 100) AS BIGINT) AS churn, l_partkey AS file_id FROM lineitem"""),
    "touches": ("changes", """SELECT DISTINCT "commit", file_id FROM changes"""),
    "fix_commits": ("", """SELECT o_orderkey AS "commit", o_orderdate AS date FROM orders
        WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"""),
    "fixes": ("changes fix_commits", """SELECT c.* FROM changes c WHERE c."commit" IN (SELECT "commit" FROM fix_commits)"""),
    "fixes_v1": ("changes fix_commits", """SELECT c.* FROM changes c
        WHERE c."commit" IN (SELECT "commit" FROM fix_commits WHERE date < TIMESTAMP '1999-01-01')"""),
    "fixes_next": ("changes fix_commits", """SELECT c.* FROM changes c
        WHERE c."commit" IN (SELECT "commit" FROM fix_commits WHERE date >= TIMESTAMP '1997-01-01')
          AND c."commit" NOT IN (SELECT "commit" FROM fix_commits WHERE date < TIMESTAMP '1999-01-01')"""),
    "labels": ("", """SELECT p_partkey AS file_id, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) - 1 AS label FROM part"""),
    "labels_k": ("", """SELECT n * i // 40 AS k, p_partkey AS file_id, ((p_partkey * p_partkey) // n) * (n * i // 40) // n AS label
        FROM part, (SELECT count(*) AS n FROM part), (SELECT unnest(range(1, 13)) AS i)"""),
    "edges": ("touches", """SELECT x.file_id AS a, y.file_id AS b, count(*) AS w FROM touches x JOIN touches y
        ON x."commit" = y."commit" AND x.file_id < y.file_id GROUP BY 1, 2"""),
    "degree": ("edges", """SELECT file_id, CAST(sum(w) AS BIGINT) AS degree FROM
        (SELECT a AS file_id, w FROM edges UNION ALL SELECT b, w FROM edges) GROUP BY 1"""),
    "base": ("files labels_k edges degree", _base("labels_k")),
    "clusters": ("base", _rates("base")),
    "ned_k": ("labels_k", """SELECT k, CAST(sum(CASE WHEN n BETWEEN 5 AND 20 THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS ned
        FROM (SELECT k, label, count(*) AS n FROM labels_k GROUP BY 1, 2) GROUP BY 1"""),
    "criteria": ("clusters ned_k", """SELECT k, i AS in_change_file_r, o AS out_change_file_r, il AS in_change_loc_r, ol AS out_change_loc_r,
        i / o AS change_file_rate, il / ol AS change_loc_rate, ned
        FROM (SELECT k, avg(in_change_file_r) AS i, avg(out_change_file_r) AS o, avg(in_change_loc_r) AS il,
              avg(out_change_loc_r) AS ol FROM clusters GROUP BY 1) JOIN ned_k USING (k)
        WHERE i <> 0 AND o <> 0 AND il <> 0 AND ol <> 0 AND ned <> 0"""),
    "scaled": ("criteria", "SELECT k, " + ", ".join(
        f"0.994 * ({expr}) / (max({c}) OVER () - min({c}) OVER ()) + 0.002 AS {c}"
        for c, expr in [
            ("in_change_file_r", "in_change_file_r - min(in_change_file_r) OVER ()"),
            ("out_change_file_r", "max(out_change_file_r) OVER () - out_change_file_r"),
            ("in_change_loc_r", "in_change_loc_r - min(in_change_loc_r) OVER ()"),
            ("out_change_loc_r", "max(out_change_loc_r) OVER () - out_change_loc_r"),
            ("ned", "ned - min(ned) OVER ()"),
        ]) + " FROM criteria"),
    "scaled_long": ("scaled", "UNPIVOT scaled ON in_change_file_r, out_change_file_r, in_change_loc_r, out_change_loc_r, ned INTO NAME criterion VALUE x"),
    "weights": ("scaled_long", """SELECT criterion, d / sum(d) OVER () AS weight FROM
        (SELECT criterion, 1 + sum(p * ln(p)) / ln(count(*)) AS d FROM
          (SELECT criterion, x / sum(x) OVER (PARTITION BY criterion) AS p FROM scaled_long) GROUP BY 1)"""),
    "scores": ("scaled_long weights", """SELECT k, sum(CASE WHEN criterion LIKE 'out%' THEN -x ELSE x END * weight) AS score
        FROM scaled_long JOIN weights USING (criterion) GROUP BY 1"""),
}


def _risk(suffix: str, fixes: str) -> None:
    s = suffix
    _CTES[f"space{s}"] = (f"{fixes} labels", f"""SELECT file_id, label, count(*) AS bugs FROM {fixes} JOIN labels USING (file_id)
        GROUP BY 1, 2 HAVING count(*) >= 2""")
    _CTES[f"decision{s}"] = (f"space{s} files labels", f"""SELECT b.label,
        CAST(b.bugs AS DOUBLE) / (SELECT sum(bugs) FROM space{s}) AS bug_weight,
        CAST(b.bugs AS DOUBLE) / c.in_file AS bug_density_file, CAST(b.bugs AS DOUBLE) / c.in_loc AS bug_density_loc, b.bug_files
        FROM (SELECT label, sum(bugs) AS bugs, count(*) AS bug_files FROM space{s} GROUP BY 1) b
        JOIN (SELECT label, count(*) AS in_file, sum(loc) AS in_loc FROM labels JOIN files USING (file_id) GROUP BY 1) c USING (label)""")
    columns = ["bug_weight", "bug_density_file", "bug_density_loc"]
    _CTES[f"bscaled{s}"] = (f"decision{s}", "SELECT label, bug_files, " + ", ".join(
        f"0.994 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) + 0.002 AS {c}" for c in columns
    ) + f" FROM decision{s}")
    _CTES[f"blong{s}"] = (f"bscaled{s}", f"UNPIVOT (SELECT label, {', '.join(columns)} FROM bscaled{s}) ON {', '.join(columns)} INTO NAME criterion VALUE x")
    _CTES[f"bweights{s}"] = (f"blong{s}", f"""SELECT criterion, d / sum(d) OVER () AS weight FROM
        (SELECT criterion, 1 + sum(p * ln(p)) / ln(count(*)) AS d FROM
          (SELECT criterion, x / sum(x) OVER (PARTITION BY criterion) AS p FROM blong{s}) GROUP BY 1)""")
    _CTES[f"ranked{s}"] = (f"bscaled{s} blong{s} bweights{s}", f"""SELECT b.*, s.score FROM bscaled{s} b JOIN
        (SELECT label, sum(x * weight) AS score FROM blong{s} JOIN bweights{s} USING (criterion) GROUP BY 1) s USING (label)""")
    _CTES[f"top{s}"] = (f"ranked{s} space{s}", f"""SELECT label, "rank", CAST(running AS BIGINT) AS running, threshold, bug_space_files FROM
        (SELECT label, bug_files, row_number() OVER (ORDER BY score DESC, label) AS "rank",
                sum(bug_files) OVER (ORDER BY score DESC, label) AS running,
                (SELECT count(*) FROM space{s}) AS bug_space_files,
                CAST(round((SELECT count(*) FROM space{s}) * 0.8) AS BIGINT) AS threshold FROM ranked{s})
        WHERE running - bug_files < threshold""")


_risk("", "fixes")
_risk("_v1", "fixes_v1")

for _s, _f in (("", "fixes"), ("_v1", "fixes_v1"), ("_next", "fixes_next")):
    _CTES[f"percl{_s}"] = (f"{_f} labels", f"""SELECT "commit", label, CAST(sum(churn) AS BIGINT) AS churn
        FROM {_f} JOIN labels USING (file_id) GROUP BY 1, 2""")
    _CTES[f"perfix{_s}"] = (f"percl{_s}", f"""SELECT "commit", count(*) AS clusters, min(label) AS label, CAST(sum(churn) AS BIGINT) AS churn
        FROM percl{_s} GROUP BY 1""")

_CTES.update({
    "words": ("", f"""SELECT doc_id, list_transform(list_filter(
        string_split(trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' '),
        lambda x: NOT list_contains({_STOPS}, x) AND length(x) > 1), lambda x: lower(x)) AS ws FROM documents"""),
    "parted": ("", f"""SELECT doc_id, list_transform(flatten(list_transform(list_filter(
        string_split(trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' '),
        lambda x: NOT list_contains({_STOPS}, x) AND length(x) > 1),
        lambda x: string_split(regexp_replace(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), ' '))),
        lambda x: lower(x)) AS ws FROM documents"""),
    "tf": ("parted", "SELECT doc_id AS file_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS word FROM parted) GROUP BY 1, 2"),
    "idfs": ("tf", "SELECT word, count(*) AS df, ln((SELECT count(*) FROM documents) / (1.0::DOUBLE + count(*))) AS idf FROM tf GROUP BY 1"),
    "tokvec": ("idfs", """SELECT i.word, i.idf, e.embedding FROM idfs i JOIN embeddings e
        ON e.vec_id = ('0x' || substr(md5(i.word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) WHERE substr(md5(i.word), 9, 1) <> '0'"""),
    "vecdims": ("tokvec", "SELECT word, idf, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM tokvec"),
    "known": ("tf tokvec", "SELECT file_id, CAST(sum(tf) AS BIGINT) AS known FROM tf JOIN tokvec USING (word) GROUP BY 1"),
    "metric": ("", """SELECT n_name AS project, c_mktsegment AS method, avg(c_acctbal) AS value
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""),
    "pivoted": ("metric", "SELECT project, " + ", ".join(
        f"max(value) FILTER (method = '{m}') AS \"{m}\"" for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    ) + " FROM metric GROUP BY 1"),
    "table_avg": ("pivoted", "SELECT * FROM pivoted UNION ALL SELECT 'Average', " + ", ".join(
        f'avg("{m}")' for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM pivoted"),
    "table2": ("table_avg", "SELECT project, " + ", ".join(
        f'round_even("{m}" * 100, 0) / 100 AS "{m}"' for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM table_avg"),
    "deps": ("", """SELECT c.c_nationkey AS src, s.s_nationkey AS dst, count(*) AS w FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2"""),
    "smells": ("", """SELECT CAST(s_nationkey AS VARCHAR) AS project, p_brand AS package, p_type AS type, 'S' || l_linenumber AS smell,
        p_name AS cause, s_nationkey AS cluster, l_orderkey AS pos, l_linestatus
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""),
    "first_smells": ("smells", """SELECT cause, type, package, smell, project FROM
        (SELECT *, row_number() OVER (PARTITION BY cause, type, package, smell ORDER BY cluster, pos) AS rn FROM smells) WHERE rn = 1"""),
    "overlap": ("labels", """SELECT CAST(label AS VARCHAR) AS a_group, p_type AS b_group, count(*) AS n
        FROM labels JOIN part ON p_partkey = file_id GROUP BY 1, 2"""),
})


def sql(needs: str, body: str) -> str:
    """``body`` behind the common table expressions it needs."""
    wanted: set[str] = set()

    def visit(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for n in _CTES[name][0].split():
                visit(n)

    for name in needs.split():
        visit(name)
    done: list[str] = []

    def place(name: str) -> None:
        if name not in done:
            for n in _CTES[name][0].split():
                place(n)
            done.append(name)

    for name in _CTES:
        if name in wanted:
            place(name)
    head = ",\n".join(f"{name} AS ({_CTES[name][1]})" for name in done)
    recursive = "RECURSIVE " if {"tree", "forest"} & set(done) else ""
    return f"WITH {recursive}{head}\n{body}" if head else body


def _rounded(columns: list[str], decimals: int) -> str:
    return ", ".join(f"round({c}, {decimals}) AS {c}" for c in columns)


_RATES = ["in_change_file_r", "out_change_file_r", "in_change_loc_r", "out_change_loc_r"]
_BUG = ["bug_weight", "bug_density_file", "bug_density_loc"]
# The one character between the parts of a key is # in all messages of the test tables.
_MESSAGE_HIT = "contains(replace(lower(c.message), '#', '-'), i.issue_key)"
_DELTA_WORD = """CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small'
    WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END"""
_DELTA_REPORT = f"""round(delta, 8) AS delta, {_DELTA_WORD} AS magnitude,
    CAST(round_even(delta * 100, 0) / 100 AS VARCHAR) || '(' || substr({_DELTA_WORD}, 1, 1) || ')' AS report"""

_VECTOR = """g.dim, round(coalesce(s.v / k.known, 0), 7) + 0.0::DOUBLE AS value
        FROM documents d CROSS JOIN (SELECT unnest(range(0, 64)) AS dim) g LEFT JOIN known k ON k.file_id = d.doc_id
        LEFT JOIN (SELECT file_id, dim, sum(tf * idf * v) AS v FROM tf JOIN vecdims USING (word) GROUP BY 1, 2) s
        ON s.file_id = d.doc_id AND s.dim = g.dim"""

ORACLE: dict[str, str] = {
    "line_count": sql("", """SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)),
        lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(//|\\*|/\\*)'))) AS BIGINT) AS loc FROM documents"""),
    "token_filter": sql("", """SELECT file_id, pos, text, token_type FROM (SELECT doc_id AS file_id, pos - 1 AS pos, text,
        CASE WHEN regexp_matches(text, '[0-9]') THEN 'Literal' WHEN length(text) > 40 THEN 'Comment' ELSE 'Identifier' END AS token_type
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents))
        WHERE pos >= 2 AND token_type IN ('Comment', 'Identifier')"""),
    "union_parts": sql("", """SELECT c_name AS issue_key, c_nationkey AS nation, c_mktsegment AS component FROM customer
        UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier"""),
    "smell_concat": sql("", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linestatus = 'F'
        UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linestatus = 'O'"""),
    "top_list_parse": sql("", """SELECT p_partkey AS file_id, CAST(2 AS BIGINT) AS n, CAST(p_size AS BIGINT) AS "first", p_partkey AS "last" FROM part"""),
    "add_columns": sql("", """SELECT s_suppkey, upper(s_name) AS s_name, s_acctbal, '1.2.0' AS version FROM supplier"""),
    "matrix_dense": sql("deps", """SELECT CAST(a.n_nationkey AS BIGINT) AS row_id, CAST(b.n_nationkey AS BIGINT) AS pos,
        CAST(coalesce(sum(d.w), 0) AS BIGINT) AS w FROM nation a CROSS JOIN nation b
        LEFT JOIN deps d ON a.n_nationkey <> b.n_nationkey AND
          ((d.src = a.n_nationkey AND d.dst = b.n_nationkey) OR (d.src = b.n_nationkey AND d.dst = a.n_nationkey)) GROUP BY 1, 2"""),
    "cluster_layout": sql("labels", """SELECT file_id, label,
        CASE WHEN rn = 0 THEN stem || '.java' ELSE stem || '_' || rn || '.java' END AS target FROM
        (SELECT file_id, label, replace(p_name, ' ', '-') AS stem,
                row_number() OVER (PARTITION BY label, p_name ORDER BY file_id) - 1 AS rn
         FROM labels JOIN part ON p_partkey = file_id)"""),
    "log_parse": sql("commits files", """SELECT l_orderkey || '-' || l_linenumber AS "commit", 'c' || commiter AS commiter,
        strftime(date, '%Y-%m-%d %H:%M:%S') AS date, message || ' a' || chr(13) || 'b' || chr(133) || 'c' || chr(8232) || 'd' AS message, s.insertions, s.deletions, s.path
        FROM (SELECT l.*, c.*, unnest([{'insertions': CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 'deletions': '0', 'path': f.path},
                                       {'insertions': '-', 'deletions': '-', 'path': 'docs/logo.png'}]) AS s
              FROM lineitem l JOIN commits c ON c."commit" = l_orderkey JOIN files f ON f.file_id = l_partkey)"""),
    "path_norm": sql("files", """SELECT file_id, replace(path, '/', '\\') AS stored, path FROM files"""),
    "java_filter": sql("files", """SELECT file_id, coalesce(CAST(regexp_matches(p, '\\.java') AS INTEGER), -1) AS strict,
        CAST(coalesce(regexp_matches(p, '.java'), true) AS INTEGER) AS loose FROM
        (SELECT file_id, CASE WHEN loc > 40 THEN NULL WHEN loc > 30 THEN replace(path, '.java', '.md')
                WHEN loc > 20 THEN replace(path, '.java', '-java.txt') ELSE path END AS p FROM files)"""),
    "issue_match": sql("commits issues", f"""SELECT "commit", commiter, message FROM commits c
        WHERE EXISTS (SELECT 1 FROM issues i WHERE {_MESSAGE_HIT})"""),
    "issue_match_exact": sql("commits issues", """SELECT "commit", commiter, message FROM commits c WHERE 'customer-' ||
        regexp_extract(lower(c.message), '(?:^|[^a-z0-9])customer.([0-9]+)(?:$|[^a-z0-9])', 1) IN (SELECT issue_key FROM issues)"""),
    "issue_counts": sql("commits issues", f"""SELECT count(DISTINCT i.issue_key) AS issues_matched, count(DISTINCT c."commit") AS fix_commits
        FROM commits c JOIN issues i ON {_MESSAGE_HIT}"""),
    "release_increment": sql("", """SELECT l_orderkey AS "commit", l_linenumber AS pos, l_partkey AS file_id FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01'
          AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')
          AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1 HAVING count(*) = 1)"""),
    "release_commits": sql("commits", """SELECT "commit", commiter FROM commits WHERE date >= TIMESTAMP '1999-01-01'"""),
    "history_counts": sql("fix_commits", """SELECT
        count(*) FILTER (d >= TIMESTAMP '1997-01-01') AS v2_commits, count(*) FILTER (d < TIMESTAMP '1999-01-01') AS v1_commits,
        count(*) FILTER (d >= TIMESTAMP '1999-01-01') AS inc_commits,
        count(*) FILTER (fix AND d >= TIMESTAMP '1997-01-01') AS v2_bug_commits,
        count(*) FILTER (fix AND d < TIMESTAMP '1999-01-01') AS v1_bug_commits,
        count(*) FILTER (fix AND d >= TIMESTAMP '1999-01-01') AS inc_bug_commits
        FROM (SELECT o_orderdate AS d, o_orderkey IN (SELECT "commit" FROM fix_commits) AS fix FROM orders)"""),
    "report_counts": sql("", """SELECT p_partkey AS file_id, CAST(2 AS BIGINT) AS n, p_size || ',' || p_partkey AS numbers FROM part"""),
    "path_resolve": sql("files", """SELECT l.log_path, min(f.file_id) AS file_id, count(*) AS candidates
        FROM (SELECT DISTINCT replace(path, '/root/', '') AS log_path FROM files) l JOIN files f ON contains(f.path, l.log_path) GROUP BY 1"""),
    "path_ambiguous": sql("files", """SELECT l.log_path, min(f.file_id) AS file_id, count(*) AS candidates
        FROM (SELECT DISTINCT replace(regexp_extract(path, '[^/]*$'), '.java', '') AS log_path FROM files) l
        JOIN files f ON contains(f.path, l.log_path) GROUP BY 1 HAVING count(*) > 1"""),
    "cochange_matrix": sql("edges", "SELECT a, b, w FROM edges"),
    "cochange_degree": sql("degree", "SELECT file_id, degree FROM degree"),
    "doc_tokens": sql("words", "SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, array_to_string(ws, ' ') AS words FROM words"),
    "split_identifiers": sql("", r"""SELECT p_partkey AS file_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') || 'XML' || p_type[1] || lower(p_type[2:]) || '_' || p_brand,
        '[^A-Za-z0-9]+', ' ', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'),
        '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')) AS words FROM part"""),
    "idf": sql("idfs", "SELECT word, df, round(idf, 8) AS idf FROM idfs"),
    "doc_vector": sql("tf vecdims known", f"SELECT d.doc_id AS file_id, coalesce(k.known, 0) AS known, {_VECTOR}"),
    "file_vectors": sql("tf vecdims known", f"SELECT d.doc_id AS file_id, {_VECTOR}"),
    "doc_vector_plain": sql("tf vecdims known", """SELECT d.doc_id AS file_id, coalesce(k.known, 0) AS known, g.dim,
        round(coalesce(s.v / k.known, 0), 7) + 0.0::DOUBLE AS value
        FROM documents d CROSS JOIN (SELECT unnest(range(0, 64)) AS dim) g LEFT JOIN known k ON k.file_id = d.doc_id
        LEFT JOIN (SELECT file_id, dim, sum(tf * v) AS v FROM tf JOIN vecdims USING (word) GROUP BY 1, 2) s
        ON s.file_id = d.doc_id AND s.dim = g.dim"""),
    "tfidf_l2": sql("files", """SELECT file_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY file_id)), 8) AS weight FROM
        (SELECT file_id, word, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM files)) / (1 + count(*) OVER (PARTITION BY word))) + 1) AS w FROM
          (SELECT file_id, word, count(*) AS tf FROM
            (SELECT file_id, unnest(regexp_extract_all(lower(path), '\\b\\w\\w+\\b')) AS word FROM files) GROUP BY 1, 2))"""),
    "cosine_matrix": sql("", """SELECT a, b, sim, round(1 - sim, 2) AS dist FROM (SELECT x.vec_id AS a, y.vec_id AS b,
        round_even(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) * 100, 0) / 100 + 0.0::DOUBLE AS sim
        FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"""),
    "kmeans_sweep_limit": sql("", """SELECT count(*) AS files, count(DISTINCT r) AS points, least(count(*), count(DISTINCT r)) AS iteration FROM
        (SELECT x.vec_id, list(round_even(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) * 100, 0) ORDER BY y.vec_id) AS r
         FROM embeddings x CROSS JOIN embeddings y GROUP BY 1)"""),
    "label_loc": sql("labels files", "SELECT file_id, label, loc FROM labels JOIN files USING (file_id)"),
    "cluster_data": sql("clusters", f"""SELECT k, label, in_change, out_change, in_file, out_file, in_loc, out_loc, {_rounded(_RATES, 10)} FROM clusters"""),
    "cluster_rates": sql("base", """SELECT k, label, round(in_change / (in_file * in_file), 10) AS in_change_file_r,
        round(CASE WHEN in_file * out_file <> 0 THEN out_change / (in_file * out_file) END, 10) AS out_change_file_r,
        round(CASE WHEN in_loc <> 0 THEN in_change / (CAST(in_loc AS DOUBLE) * in_loc) END, 10) AS in_change_loc_r,
        round(CASE WHEN in_loc * out_loc <> 0 THEN out_change / (CAST(in_loc AS DOUBLE) * out_loc) END, 10) AS out_change_loc_r FROM base"""),
    "ned": sql("ned_k", "SELECT k, round(ned, 8) AS ned FROM ned_k"),
    "k_criteria": sql("criteria", f"SELECT k, {_rounded([*_RATES, 'change_file_rate', 'change_loc_rate', 'ned'], 10)} FROM criteria"),
    "minmax_scale": sql("", """SELECT c_custkey,
        round(0.994 * (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) + 0.002, 8) AS gain,
        round(0.994 * (max(c_acctbal * c_acctbal) OVER () - c_acctbal * c_acctbal)
              / (max(c_acctbal * c_acctbal) OVER () - min(c_acctbal * c_acctbal) OVER ()) + 0.002, 8) AS cost FROM customer"""),
    "entropy_weights": sql("", """SELECT criterion, round(d / sum(d) OVER (), 8) AS weight FROM
        (SELECT criterion, 1 + sum(p * ln(p)) / ln(count(*)) AS d FROM
          (SELECT criterion, x / sum(x) OVER (PARTITION BY criterion) AS p FROM
            (SELECT 'size' AS criterion, 0.994 * (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) + 0.002 AS x FROM part
             UNION ALL
             SELECT 'price', 0.994 * (max(p_retailprice) OVER () - p_retailprice) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) + 0.002 FROM part))
         GROUP BY 1)"""),
    "k_score": sql("scaled scores", f"SELECT k, {_rounded([*_RATES, 'ned', 'score'], 8)} FROM scaled JOIN scores USING (k)"),
    "f_optimal": sql("scores", "SELECT k, round(score, 8) AS score FROM scores ORDER BY scores.score DESC, k LIMIT 1"),
    "bug_space": sql("space", "SELECT label, file_id, bugs FROM space"),
    "bug_decision": sql("decision", f"SELECT label, {_rounded(_BUG, 8)}, bug_files FROM decision"),
    "bug_cluster_rank": sql("ranked", f"SELECT label, {_rounded([*_BUG, 'score'], 8)} FROM ranked"),
    "top_clusters": sql("top", 'SELECT label, "rank", running, threshold, bug_space_files FROM top'),
    "fix_locality": sql("perfix", """SELECT label, count(*) AS bf, (SELECT count(*) FROM perfix WHERE clusters = 1) AS bf_in,
        (SELECT count(*) FROM perfix WHERE clusters > 1) AS bf_out FROM perfix WHERE clusters = 1 GROUP BY 1"""),
    "churn_by_cluster": sql("percl", "SELECT label, CAST(sum(churn) AS BIGINT) AS churn FROM percl GROUP BY 1"),
    "risk_report": sql("top_v1 decision_v1 perfix_v1 percl_v1 labels files", """
        SELECT 'parts' AS project, cluster_sum, file_bs, file_sum, round(file_bs / file_sum, 8) AS file_bs_share, bf_in, bf_out,
          round(file_top / file_sum, 8) AS fr, round(loc_top / loc_sum, 8) AS loc, round(bc_top / bc_sum, 8) AS bc,
          round(bf_top / (bf_in + bf_out), 8) AS bfr, round(dens_file, 8) AS bug_density_file_average,
          round(dens_loc, 8) AS bug_density_loc_average, round(bf_top / file_top, 8) AS density_bf_file,
          round(bf_top / loc_top, 8) AS density_bf_loc, round(bf_top / bf_in, 8) AS bfin_bfr,
          threshold AS buggy_file_threshold, reached AS current_accumulate_file, file_top AS file_in_top_cluster, top_buggy_cluster
        FROM (SELECT
          (SELECT max(label) + 1 FROM labels) AS cluster_sum, (SELECT max(bug_space_files) FROM top_v1) AS file_bs,
          (SELECT count(*) FROM labels) AS file_sum,
          (SELECT count(*) FROM perfix_v1 WHERE clusters = 1) AS bf_in, (SELECT count(*) FROM perfix_v1 WHERE clusters > 1) AS bf_out,
          (SELECT count(*) FROM labels WHERE label IN (SELECT label FROM top_v1)) AS file_top,
          (SELECT CAST(sum(loc) AS BIGINT) FROM labels JOIN files USING (file_id) WHERE label IN (SELECT label FROM top_v1)) AS loc_top,
          (SELECT CAST(sum(loc) AS BIGINT) FROM files) AS loc_sum,
          (SELECT CAST(sum(churn) AS BIGINT) FROM percl_v1 WHERE label IN (SELECT label FROM top_v1)) AS bc_top,
          (SELECT CAST(sum(churn) AS BIGINT) FROM percl_v1) AS bc_sum,
          (SELECT count(*) FROM perfix_v1 WHERE clusters = 1 AND label IN (SELECT label FROM top_v1)) AS bf_top,
          (SELECT avg(bug_density_file) FROM decision_v1 WHERE label IN (SELECT label FROM top_v1)) AS dens_file,
          (SELECT avg(bug_density_loc) FROM decision_v1 WHERE label IN (SELECT label FROM top_v1)) AS dens_loc,
          (SELECT max(threshold) FROM top_v1) AS threshold, (SELECT max(running) FROM top_v1) AS reached,
          (SELECT string_agg(CAST(label AS VARCHAR), ',' ORDER BY "rank") FROM top_v1) AS top_buggy_cluster)"""),
    "next_release_report": sql("top_v1 perfix_next labels", """
        SELECT 'parts' AS project, cluster_sum, file_sum, bf_in, bf_out, round(bc_in_top / bc, 8) AS bc_top, round(bc_in / bc, 8) AS bc_all,
          round(bf_top / (bf_in + bf_out), 8) AS bfr_top, round(bf_in / (bf_in + bf_out), 8) AS bfr_all, round(bf_top / bf_in, 8) AS bftop_in_bfin
        FROM (SELECT (SELECT max(label) + 1 FROM labels) AS cluster_sum, (SELECT count(*) FROM labels) AS file_sum,
          count(*) FILTER (clusters = 1) AS bf_in, count(*) FILTER (clusters > 1) AS bf_out,
          count(*) FILTER (clusters = 1 AND label IN (SELECT label FROM top_v1)) AS bf_top,
          CAST(coalesce(sum(churn) FILTER (clusters = 1), 0) AS BIGINT) AS bc_in,
          CAST(coalesce(sum(churn) FILTER (clusters = 1 AND label IN (SELECT label FROM top_v1)), 0) AS BIGINT) AS bc_in_top,
          CAST(sum(churn) AS BIGINT) AS bc FROM perfix_next)"""),
    "size_split": sql("", """SELECT project, position, CASE WHEN position <= 10 THEN 'small' ELSE 'large' END AS size FROM
        (SELECT c_name AS project, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer)"""),
    "metric_gather": sql("metric", """SELECT project, round(value, 6) AS value FROM metric JOIN nation ON n_name = project
        WHERE method = 'AUTOMOBILE' AND n_regionkey <= 1"""),
    "metric_pivot": sql("table2", "SELECT * FROM table2"),
    "cliffs_delta": sql("table2", f"""SELECT method, {_DELTA_REPORT} FROM
        (SELECT method, CAST(sum(CASE WHEN x > y THEN 1 WHEN x < y THEN -1 ELSE 0 END) AS DOUBLE) / count(*) AS delta FROM
          (SELECT b.method, a."AUTOMOBILE" AS x, b.v AS y FROM table2 a,
             (SELECT method, v FROM (UNPIVOT (SELECT "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY" FROM table2)
              ON "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY" INTO NAME method VALUE v)) b WHERE a."AUTOMOBILE" IS NOT NULL) GROUP BY 1)"""),
    "cluster_deps": sql("deps", "SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, w FROM deps"),
    "mq": sql("deps", """SELECT round(sum(CASE WHEN a = 0 THEN 0 ELSE a / (a + 0.5::DOUBLE * (r + c - 2 * a)) END), 8) AS mq FROM
        (SELECT n_nationkey, coalesce((SELECT sum(w) FROM deps WHERE src = n_nationkey AND dst = n_nationkey), 0)::DOUBLE AS a,
           coalesce((SELECT sum(w) FROM deps WHERE src = n_nationkey), 0)::DOUBLE AS r,
           coalesce((SELECT sum(w) FROM deps WHERE dst = n_nationkey), 0)::DOUBLE AS c FROM nation)"""),
    "dir_group": sql("files", """SELECT CASE WHEN regexp_matches(m, '\\S*(\\.src|org\\.)') THEN regexp_extract(m, '(\\S*)(\\.src|org\\.)', 1) ELSE 'root' END AS grp, m AS member
        FROM (SELECT replace(replace(path, '/root/', ''), '/', '.') AS m FROM (SELECT path FROM files UNION ALL SELECT replace(url, '\\', '/') FROM pages))"""),
    "cluster_rsf": sql("files labels", """SELECT 'contain' AS relation, CAST(label AS VARCHAR) AS grp,
        replace(replace(path, '/root/src/', ''), '/', '.') AS member FROM files JOIN labels USING (file_id)"""),
    "grouping_overlap": sql("overlap", "SELECT a_group, b_group, n FROM overlap"),
    "mojofm": sql("overlap", """SELECT n, moves, joins, n - apart AS max_distance,
        round_even(1000 * (1 - (moves + joins) / (n - apart)::DOUBLE), 0) / 10 AS mojofm FROM
        (SELECT CAST(sum(n) AS BIGINT) AS n,
           CAST(sum(n) - (SELECT sum(best) FROM (SELECT max(n) AS best FROM overlap GROUP BY a_group)) AS BIGINT) AS moves,
           count(DISTINCT a_group) - (SELECT count(DISTINCT b_group) FROM
             (SELECT b_group, row_number() OVER (PARTITION BY a_group ORDER BY n DESC, b_group) AS rn FROM overlap) WHERE rn = 1) AS joins,
           least((SELECT count(DISTINCT b_group) FROM overlap),
             (SELECT min(c + l - rn) FROM (SELECT sum(n) AS c, count(*) OVER () AS l, row_number() OVER (ORDER BY sum(n)) AS rn FROM overlap GROUP BY b_group)))::BIGINT AS apart
         FROM overlap)"""),
}

_CTES["whole"] = ("smells", "SELECT DISTINCT cause, type, package, smell FROM smells WHERE l_linestatus = 'F'")
_CTES["chosen"] = ("first_smells", """SELECT f.* FROM first_smells f
    WHERE project IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey <= 1)""")
ORACLE["smell_jaccard"] = sql("whole chosen", """SELECT CAST(sum(l) AS BIGINT) AS in_whole, CAST(sum(r) AS BIGINT) AS in_chosen,
    count(*) FILTER (l = 1 AND r = 1) AS shared, count(*) AS all_smells,
    round(count(*) FILTER (l = 1 AND r = 1) / count(*)::DOUBLE, 8) AS jaccard
    FROM (SELECT CASE WHEN w.smell IS NULL THEN 0 ELSE 1 END AS l, CASE WHEN c.smell IS NULL THEN 0 ELSE 1 END AS r
          FROM whole w FULL OUTER JOIN chosen c USING (cause, type, package, smell))""")
_CTES["sides"] = ("", """SELECT p.method, 'a' AS side, o_totalprice AS v FROM orders,
      (SELECT DISTINCT o_orderpriority AS method FROM orders WHERE o_orderpriority <> '1-URGENT') p WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderpriority, 'b', o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'""")
_CTES["placed"] = ("sides", """SELECT method, side, count(*) FILTER (side = 'b') OVER (PARTITION BY method ORDER BY v) AS upto,
    count(*) FILTER (side = 'b') OVER (PARTITION BY method, v) AS same, count(*) FILTER (side = 'b') OVER (PARTITION BY method) AS n,
    count(*) FILTER (side = 'a') OVER (PARTITION BY method) AS m FROM sides""")
ORACLE["cliffs_delta_orders"] = sql("placed", f"""SELECT method, {_DELTA_REPORT} FROM
    (SELECT method, CAST(sum((upto - same) - (n - upto)) AS DOUBLE) / (max(m)::DOUBLE * max(n)) AS delta FROM placed WHERE side = 'a' GROUP BY 1)""")


_CTES["labels_25"] = ("labels", "SELECT CAST(25 AS BIGINT) AS k, file_id, label FROM labels")
_CTES["base_25"] = ("files labels_25 edges degree", _base("labels_25"))
_CTES["clusters_25"] = ("base_25", _rates("base_25"))
ORACLE["cluster_data_matrix"] = sql(
    "clusters_25",
    f"SELECT k, label, in_change, out_change, in_file, out_file, in_loc, out_loc, {_rounded(_RATES, 10)} FROM clusters_25",
)

# Average linkage, one merge per step: all rows of a step are pairs of nodes (a < b), and nodes (a = b) with their measures.
_CTES["tree_files"] = ("files", "SELECT e.vec_id AS file_id, coalesce(f.loc, 0) AS loc FROM embeddings e LEFT JOIN files f ON f.file_id = e.vec_id")
_CTES["tree_edges"] = ("edges tree_files", """SELECT e.* FROM edges e WHERE e.a IN (SELECT file_id FROM tree_files)
    AND e.b IN (SELECT file_id FROM tree_files)""")
_CTES["tree_start"] = ("tree_files tree_edges", """SELECT p.a, p.b, p.s, 1::BIGINT AS c, coalesce(e.w, 0)::BIGINT AS w, 0::BIGINT AS files, 0::BIGINT AS loc, 0::BIGINT AS degree
    FROM (SELECT x.vec_id AS a, y.vec_id AS b,
            (100 - round_even(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) * 100, 0))::BIGINT AS s
          FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id
          WHERE x.vec_id IN (SELECT file_id FROM tree_files) AND y.vec_id IN (SELECT file_id FROM tree_files)) p
    LEFT JOIN tree_edges e ON e.a = p.a AND e.b = p.b
    UNION ALL SELECT file_id, file_id, 0, 0, 0, 1, loc, coalesce(d.degree, 0)::BIGINT FROM tree_files LEFT JOIN
      (SELECT file_id, sum(w) AS degree FROM (SELECT a AS file_id, w FROM tree_edges UNION ALL SELECT b, w FROM tree_edges) GROUP BY 1) d USING (file_id)""")
_CTES["tree"] = ("tree_start", """SELECT 0 AS step, a, b, s, c, w, files, loc, degree FROM tree_start
    UNION ALL
    SELECT step + 1, na, nb, (CASE WHEN na = nb THEN 0 ELSE sum(s) END)::BIGINT, (CASE WHEN na = nb THEN 0 ELSE sum(c) END)::BIGINT,
      sum(w)::BIGINT, sum(files)::BIGINT, sum(loc)::BIGINT, sum(degree)::BIGINT
    FROM (SELECT step, s, c, w, files, loc, degree, least(x, y) AS na, greatest(x, y) AS nb FROM
            (SELECT t.step, t.s, t.c, t.w, t.files, t.loc, t.degree, CASE WHEN t.a = m.m.b THEN m.m.a ELSE t.a END AS x,
                    CASE WHEN t.b = m.m.b THEN m.m.a ELSE t.b END AS y
             FROM tree t, (SELECT min({'h': s / c, 'a': a, 'b': b}) AS m FROM tree WHERE a < b) m WHERE m.m IS NOT NULL))
    GROUP BY step, na, nb""")
_CTES["tree_merges"] = ("tree", """SELECT m.step + 1 AS step, m.m.a AS a, m.m.b AS b, m.m.h AS height, n.files, n.loc, n.degree, n.w AS in_change
    FROM (SELECT step, min({'h': s / c, 'a': a, 'b': b}) AS m FROM tree WHERE a < b GROUP BY 1) m
    JOIN tree n ON n.step = m.step + 1 AND n.a = m.m.a AND n.b = m.m.a""")
_CTES["tree_cuts"] = ("tree_files", "SELECT unnest([5, 10, 20, 50, 100])::BIGINT AS k, (SELECT count(*) FROM tree_files) AS n")
_CTES["tree_roots"] = ("tree_cuts tree_merges", """SELECT k, n, file_id, file_id AS root FROM tree_cuts, tree_files
    UNION ALL SELECT r.k, r.n, r.file_id, m.a FROM tree_roots r JOIN tree_merges m ON m.b = r.root AND m.step <= r.n - r.k""")
_CTES["tree_base"] = ("tree tree_files", """SELECT (SELECT count(*) FROM tree_files) - step AS k, w AS in_change, degree - 2 * w AS out_change, files AS in_file,
    (SELECT count(*) FROM tree_files) - files AS out_file, loc AS in_loc, (SELECT sum(loc) FROM tree_files)::BIGINT - loc AS out_loc
    FROM tree WHERE a = b""")
_CTES["tree_rates"] = ("tree_base", _rates("tree_base"))
_CTES["tree_sweep"] = ("tree_rates", "SELECT k, " + ", ".join(f"coalesce(sum({c}), 0) / k AS {c}" for c in _RATES) + """,
    CAST(sum(CASE WHEN in_file BETWEEN 5 AND 20 THEN in_file ELSE 0 END) AS DOUBLE) / sum(in_file) AS ned FROM tree_rates WHERE k >= 2 GROUP BY k""")
_CTES["tree_eligible"] = ("tree_sweep", "SELECT * FROM tree_sweep WHERE " + " AND ".join(f"{c} <> 0" for c in [*_RATES, "ned"]))
_CTES["tree_scaled"] = ("tree_eligible", _CTES["scaled"][1].replace("FROM criteria", "FROM tree_eligible"))
_CTES["tree_long"] = ("tree_scaled", _CTES["scaled_long"][1].replace("UNPIVOT scaled", "UNPIVOT tree_scaled"))
_CTES["tree_weights"] = ("tree_long", _CTES["weights"][1].replace("FROM scaled_long", "FROM tree_long"))
ORACLE["ahc_merges"] = sql("tree_merges", "SELECT step::BIGINT AS step, a, b, round(height, 10) AS height, files, loc, degree, in_change FROM tree_merges")
ORACLE["ahc_labels"] = sql("tree_roots", """SELECT k, file_id, root, dense_rank() OVER (PARTITION BY k ORDER BY root) - 1 AS label
    FROM (SELECT k, file_id, min(root) AS root FROM tree_roots GROUP BY 1, 2)""")
ORACLE["ahc_sweep"] = sql("tree_sweep", f"SELECT k::BIGINT AS k, {_rounded([*_RATES, 'ned'], 8)} FROM tree_sweep")
ORACLE["cluster_selection"] = sql("tree_weights", """SELECT (SELECT count(*) FROM tree_files) AS files, (SELECT count(*) FROM tree_files) AS iteration,
    k::BIGINT AS f_optimal, round(score, 8) AS score FROM (SELECT k, sum(CASE WHEN criterion LIKE 'out%' THEN -x ELSE x END * weight) AS score
      FROM tree_long JOIN tree_weights USING (criterion) GROUP BY 1) ORDER BY score DESC, k LIMIT 1""")

# Files written and read back.
ORACLE["project_list"] = sql("", """SELECT lower(replace(n_name, ' ', '-')) AS project, '1.2.0' AS exp_version, 'branch-' || n_regionkey AS exp_branch,
    '2.3.0' AS new_version, 'main' AS new_branch, upper(replace(n_name, ' ', '-')) AS jira_key, n_nationkey::INTEGER AS jira_bugs_amount FROM nation""")
ORACLE["log_blocks"] = sql("commits", """SELECT "commit"::VARCHAR AS "commit", 'c' || commiter AS commiter, message, 1::BIGINT AS n_paths FROM commits WHERE "commit" % 10 <> 0""")
ORACLE["commit_records"] = sql("commits", """SELECT l_orderkey::VARCHAR AS "commit", commiter::VARCHAR AS commiter, message,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, ins::VARCHAR, del::VARCHAR, 'f' || l_partkey) - 1 AS pos,
    ins::VARCHAR AS insertions, del::VARCHAR AS deletions, 'f' || l_partkey AS path FROM
    (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS ins, CAST(round(l_discount * 100) AS BIGINT) AS del FROM lineitem)
    JOIN commits ON "commit" = l_orderkey""")
ORACLE["label_list"] = sql("files labels", "SELECT path, label FROM files JOIN labels USING (file_id)")
ORACLE["loc_list"] = sql("files", "SELECT path, loc FROM files WHERE loc > 1")
ORACLE["file_list"] = sql("files", "SELECT row_number() OVER (ORDER BY file_id) - 1 AS file_id, path FROM files")
ORACLE["matrix_file"] = sql("deps", """SELECT least(src, dst)::BIGINT AS a, greatest(src, dst)::BIGINT AS b, CAST(sum(w) AS BIGINT) AS w
    FROM deps WHERE src <> dst GROUP BY 1, 2""")
ORACLE["token_vector_file"] = sql("", """SELECT 'tok' || vec_id AS token, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings""")
ORACLE["issue_export"] = sql("", "SELECT 'Bug' AS issue_type, c_name AS issue_key FROM customer UNION ALL SELECT 'Bug', s_name FROM supplier")
ORACLE["issue_list"] = sql("issues", "SELECT issue_key FROM issues")
ORACLE["dependency_list"] = sql("", """SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
ORACLE["rsf_file"] = sql("files labels", """SELECT 'contain' AS relation, CAST(label AS VARCHAR) AS grp,
    replace(replace(replace(path, '/root/src/', ''), '/', '.'), ' ', '_') AS member FROM files JOIN labels USING (file_id)""")
ORACLE["result_append"] = sql("", """SELECT n_name AS project, unnest([0, 1])::BIGINT AS pos, unnest([n_nationkey, n_regionkey])::BIGINT AS label FROM nation""")

# Several projects at once: part types as projects.
_CTES["p_space"] = ("fixes labels", """SELECT p_type AS project, file_id, label, count(*) AS bugs FROM fixes JOIN labels USING (file_id)
    JOIN part ON p_partkey = file_id GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
_CTES["p_decision"] = ("p_space files labels", """SELECT b.project, b.label,
    CAST(b.bugs AS DOUBLE) / sum(b.bugs) OVER (PARTITION BY b.project) AS bug_weight,
    CAST(b.bugs AS DOUBLE) / c.in_file AS bug_density_file, CAST(b.bugs AS DOUBLE) / c.in_loc AS bug_density_loc, b.bug_files
    FROM (SELECT project, label, sum(bugs) AS bugs, count(*) AS bug_files FROM p_space GROUP BY 1, 2) b
    JOIN (SELECT p_type AS project, label, count(*) AS in_file, sum(loc) AS in_loc FROM labels JOIN files USING (file_id)
          JOIN part ON p_partkey = file_id GROUP BY 1, 2) c ON c.project = b.project AND c.label = b.label""")
_CTES["p_scaled"] = ("p_decision", "SELECT project, label, bug_files, " + ", ".join(
    f"""CASE WHEN max({c}) OVER w > min({c}) OVER w THEN 0.994 * ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) + 0.002 END AS {c}""" for c in _BUG
) + " FROM p_decision WINDOW w AS (PARTITION BY project)")
_CTES["p_long"] = ("p_scaled", " UNION ALL ".join(f"SELECT project, label, '{c}' AS criterion, {c} AS x FROM p_scaled" for c in _BUG))
_CTES["p_weights"] = ("p_long", """SELECT project, criterion, CASE WHEN n <= 1 THEN 1.0::DOUBLE / 3 WHEN sum(d) OVER (PARTITION BY project) <> 0
      THEN d / sum(d) OVER (PARTITION BY project) END AS weight FROM
    (SELECT project, criterion, count(*) AS n, coalesce(1 + CASE WHEN count(*) > 1 THEN sum(p * ln(p)) / ln(count(*)) END, 0) AS d FROM
      (SELECT project, criterion, x / sum(x) OVER (PARTITION BY project, criterion) AS p FROM p_long) GROUP BY 1, 2)""")
_CTES["p_ranked"] = ("p_scaled p_long p_weights", """SELECT b.*, s.score FROM p_scaled b JOIN
    (SELECT l.project, l.label, sum(coalesce(x * weight, 0)) AS score FROM p_long l
     JOIN p_weights w ON w.project = l.project AND w.criterion = l.criterion GROUP BY 1, 2) s ON s.project = b.project AND s.label = b.label""")
ORACLE["project_cluster_rank"] = sql("p_ranked", f"SELECT project, label, {_rounded([*_BUG, 'score'], 8)} FROM p_ranked")
ORACLE["project_top_clusters"] = sql("p_ranked", """SELECT project, label, "rank", running::BIGINT AS running, threshold, bug_space_files FROM
    (SELECT *, row_number() OVER w AS "rank", sum(bug_files) OVER w AS running, sum(bug_files) OVER (PARTITION BY project)::BIGINT AS bug_space_files,
       CAST(round(sum(bug_files) OVER (PARTITION BY project) * 0.8) AS BIGINT) AS threshold FROM p_ranked
     WINDOW w AS (PARTITION BY project ORDER BY round(score, 12) DESC, label))
    WHERE running - bug_files < threshold OR "rank" = 1""")

# Several projects with a dendrogram each: one merge per project and step.
_PROJECT = "CASE WHEN {0} % 2 = 0 THEN 'core' ELSE 'team-' || ({0} % 10) END"
_CTES["forest_files"] = ("tree_files", f"SELECT {_PROJECT.format('file_id')} AS project, file_id, loc FROM tree_files")
_CTES["forest_edges"] = ("tree_edges", f"""SELECT * FROM tree_edges WHERE {_PROJECT.format('a')} = {_PROJECT.format('b')}""")
_CTES["forest_start"] = ("forest_files forest_edges", f"""SELECT p.project, p.a, p.b, p.s, 1::BIGINT AS c, coalesce(e.w, 0)::BIGINT AS w, 0::BIGINT AS files, 0::BIGINT AS loc, 0::BIGINT AS degree
    FROM (SELECT {_PROJECT.format('x.vec_id')} AS project, x.vec_id AS a, y.vec_id AS b,
            (100 - round_even(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) * 100, 0))::BIGINT AS s
          FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND {_PROJECT.format('x.vec_id')} = {_PROJECT.format('y.vec_id')}) p
    LEFT JOIN forest_edges e ON e.a = p.a AND e.b = p.b
    UNION ALL SELECT project, file_id, file_id, 0, 0, 0, 1, loc, coalesce(d.degree, 0)::BIGINT FROM forest_files LEFT JOIN
      (SELECT file_id, sum(w) AS degree FROM (SELECT a AS file_id, w FROM forest_edges UNION ALL SELECT b, w FROM forest_edges) GROUP BY 1) d USING (file_id)""")
_CTES["forest"] = ("forest_start", """SELECT 0 AS step, project, a, b, s, c, w, files, loc, degree FROM forest_start
    UNION ALL
    SELECT step + 1, project, na, nb, (CASE WHEN na = nb THEN 0 ELSE sum(s) END)::BIGINT, (CASE WHEN na = nb THEN 0 ELSE sum(c) END)::BIGINT,
      sum(w)::BIGINT, sum(files)::BIGINT, sum(loc)::BIGINT, sum(degree)::BIGINT
    FROM (SELECT step, project, s, c, w, files, loc, degree, least(x, y) AS na, greatest(x, y) AS nb FROM
            (SELECT t.step, t.project, t.s, t.c, t.w, t.files, t.loc, t.degree, CASE WHEN t.a = m.m.b THEN m.m.a ELSE t.a END AS x,
                    CASE WHEN t.b = m.m.b THEN m.m.a ELSE t.b END AS y
             FROM forest t JOIN (SELECT project, min({'h': s / c, 'a': a, 'b': b}) AS m FROM forest WHERE a < b GROUP BY 1) m ON m.project = t.project))
    GROUP BY step, project, na, nb""")
_CTES["forest_sizes"] = ("forest_files", "SELECT project, count(*) AS n, sum(loc)::BIGINT AS loc FROM forest_files GROUP BY 1")
_CTES["forest_base"] = ("forest forest_sizes", """SELECT f.project, z.n - step AS k, w AS in_change, degree - 2 * w AS out_change, files AS in_file,
    z.n - files AS out_file, f.loc AS in_loc, z.loc - f.loc AS out_loc FROM forest f JOIN forest_sizes z ON z.project = f.project WHERE a = b""")
_CTES["forest_rates"] = ("forest_base", _rates("forest_base"))
_CTES["forest_sweep"] = ("forest_rates", "SELECT project, k, " + ", ".join(f"coalesce(sum({c}), 0) / k AS {c}" for c in _RATES) + """,
    CAST(sum(CASE WHEN in_file BETWEEN 5 AND 20 THEN in_file ELSE 0 END) AS DOUBLE) / sum(in_file) AS ned FROM forest_rates WHERE k >= 2 GROUP BY 1, 2""")
_CRITERIA = [*_RATES, "ned"]
_CTES["forest_eligible"] = ("forest_sweep", "SELECT * FROM forest_sweep WHERE " + " AND ".join(f"{c} <> 0" for c in _CRITERIA))
_CTES["forest_scaled"] = ("forest_eligible", "SELECT project, k, " + ", ".join(
    f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN 0.994 * ({f'max({c}) OVER w - {c}' if c.startswith('out') else f'{c} - min({c}) OVER w'})"
    f" / (max({c}) OVER w - min({c}) OVER w) + 0.002 END AS {c}" for c in _CRITERIA) + " FROM forest_eligible WINDOW w AS (PARTITION BY project)")
_CTES["forest_long"] = ("forest_scaled", " UNION ALL ".join(f"SELECT project, k, '{c}' AS criterion, {c} AS x FROM forest_scaled" for c in _CRITERIA))
_CTES["forest_weights"] = ("forest_long", _CTES["p_weights"][1].replace("p_long", "forest_long").replace("1.0::DOUBLE / 3", "1.0::DOUBLE / 5"))
_CTES["forest_best"] = ("forest_long forest_weights forest_sizes", """SELECT s.project, z.n AS files, s.k, s.score FROM
    (SELECT l.project, l.k, sum(coalesce(CASE WHEN l.criterion LIKE 'out%' THEN -x ELSE x END * weight, 0)) AS score FROM forest_long l
     JOIN forest_weights w ON w.project = l.project AND w.criterion = l.criterion GROUP BY 1, 2) s JOIN forest_sizes z ON z.project = s.project
    QUALIFY row_number() OVER (PARTITION BY s.project ORDER BY s.score DESC, s.k) = 1""")
ORACLE["project_selection"] = sql("forest_best", "SELECT project, files, files AS iteration, k::BIGINT AS f_optimal, round(score, 8) AS score FROM forest_best")
_CTES["forest_merges"] = ("forest", "SELECT project, step + 1 AS step, m.a AS a, m.b AS b FROM (SELECT project, step, min({'h': s / c, 'a': a, 'b': b}) AS m FROM forest WHERE a < b GROUP BY 1, 2)")
_CTES["forest_roots"] = ("forest_best forest_files forest_merges", """SELECT f.project, b.files - b.k AS last, file_id, file_id AS root FROM forest_files f JOIN forest_best b ON b.project = f.project
    UNION ALL SELECT r.project, r.last, r.file_id, m.a FROM forest_roots r JOIN forest_merges m ON m.project = r.project AND m.b = r.root AND m.step <= r.last""")
ORACLE["project_labels"] = sql("forest_roots", """SELECT project, file_id, dense_rank() OVER (PARTITION BY project ORDER BY root) - 1 AS label
    FROM (SELECT project, file_id, min(root) AS root FROM forest_roots GROUP BY 1, 2)""")

for _name in ("space", "decision", "scaled", "long", "weights", "ranked"):
    _needs, _text = _CTES[f"p_{_name}"]
    _turn = lambda x: x.replace("p_type", _PROJECT.format("p_partkey")).replace("p_", "v_").replace("v_partkey", "p_partkey").replace("fixes", "fixes_v1")
    _CTES[f"v_{_name}"] = (_turn(_needs), _turn(_text).replace("exv_", "exp_"))
_CTES["v_top"] = ("v_ranked", """SELECT project, label, "rank", running, threshold, files FROM (SELECT *, sum(bug_files) OVER (PARTITION BY project)::BIGINT AS files, row_number() OVER w AS "rank", sum(bug_files) OVER w AS running,
      CAST(round(sum(bug_files) OVER (PARTITION BY project) * 0.8) AS BIGINT) AS threshold FROM v_ranked
      WINDOW w AS (PARTITION BY project ORDER BY round(score, 12) DESC, label))
    WHERE running - bug_files < threshold OR "rank" = 1""")
_CTES["v_perfix"] = ("fixes_next labels", f"""SELECT project, "commit", count(*) AS clusters, min(label) AS label, CAST(sum(churn) AS BIGINT) AS churn FROM
    (SELECT {_PROJECT.format('file_id')} AS project, "commit", label, sum(churn) AS churn FROM fixes_next JOIN labels USING (file_id) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
ORACLE["project_next_release"] = sql("v_top v_perfix labels", f"""SELECT z.project, z.cluster_sum, z.file_sum, coalesce(bf_in, 0) AS bf_in, coalesce(bf_out, 0) AS bf_out,
      round(CASE WHEN bc <> 0 THEN bc_in_top / bc END, 8) AS bc_top, round(CASE WHEN bc <> 0 THEN bc_in / bc END, 8) AS bc_all,
      round(CASE WHEN bf_in + bf_out > 0 THEN bf_top / (bf_in + bf_out) END, 8) AS bfr_top, round(CASE WHEN bf_in + bf_out > 0 THEN bf_in / (bf_in + bf_out) END, 8) AS bfr_all,
      round(CASE WHEN bf_in > 0 THEN bf_top / bf_in END, 8) AS bftop_in_bfin
    FROM (SELECT {_PROJECT.format('file_id')} AS project, max(label) + 1 AS cluster_sum, count(*) AS file_sum FROM labels GROUP BY 1) z
    LEFT JOIN (SELECT f.project, count(*) FILTER (clusters = 1) AS bf_in, count(*) FILTER (clusters > 1) AS bf_out,
        count(*) FILTER (clusters = 1 AND t.label IS NOT NULL) AS bf_top, CAST(coalesce(sum(churn) FILTER (clusters = 1), 0) AS BIGINT) AS bc_in,
        CAST(coalesce(sum(churn) FILTER (clusters = 1 AND t.label IS NOT NULL), 0) AS BIGINT) AS bc_in_top, CAST(sum(churn) AS BIGINT) AS bc
      FROM v_perfix f LEFT JOIN v_top t ON t.project = f.project AND t.label = f.label GROUP BY 1) s ON s.project = z.project""")

ORACLE["cochange_increment"] = sql("touches", """SELECT x.file_id AS a, y.file_id AS b, count(*) AS w FROM touches x JOIN touches y
    ON x."commit" = y."commit" AND x.file_id < y.file_id JOIN orders ON o_orderkey = x."commit" WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2""")
_CTES["v_percl_v1"] = ("fixes_v1 labels", f"""SELECT {_PROJECT.format('file_id')} AS project, "commit", label, CAST(sum(churn) AS BIGINT) AS churn
    FROM fixes_v1 JOIN labels USING (file_id) GROUP BY 1, 2, 3""")
_CTES["v_perfix_v1"] = ("v_percl_v1", """SELECT project, "commit", count(*) AS clusters, min(label) AS label, CAST(sum(churn) AS BIGINT) AS churn FROM v_percl_v1 GROUP BY 1, 2""")
_CTES["v_clusters"] = ("files labels v_top v_decision v_percl_v1 v_perfix_v1", f"""SELECT z.project, z.label, z.files, z.loc, b.bf, c.bc, d.bug_density_file, d.bug_density_loc,
      t."rank", t.running, t.threshold, t.files AS space
    FROM (SELECT {_PROJECT.format('file_id')} AS project, label, count(*) AS files, sum(loc)::BIGINT AS loc FROM labels JOIN files USING (file_id) GROUP BY 1, 2) z
    LEFT JOIN (SELECT project, label, count(*) AS bf FROM v_perfix_v1 WHERE clusters = 1 GROUP BY 1, 2) b ON b.project = z.project AND b.label = z.label
    LEFT JOIN (SELECT project, label, sum(churn)::BIGINT AS bc FROM v_percl_v1 GROUP BY 1, 2) c ON c.project = z.project AND c.label = z.label
    LEFT JOIN v_decision d ON d.project = z.project AND d.label = z.label LEFT JOIN v_top t ON t.project = z.project AND t.label = z.label""")
ORACLE["project_risk_report"] = sql("v_clusters", """SELECT s.project, cluster_sum, file_bs, file_sum, round(file_bs / file_sum, 8) AS file_bs_share,
      coalesce(bf_in, 0) AS bf_in, coalesce(bf_out, 0) AS bf_out, round(file_top / file_sum, 8) AS fr, round(loc_top / loc_sum, 8) AS loc, round(bc_top / churn, 8) AS bc,
      round(CASE WHEN bf_in + bf_out > 0 THEN bf_top / (bf_in + bf_out) END, 8) AS bfr, round(dens_file, 8) AS bug_density_file_average,
      round(dens_loc, 8) AS bug_density_loc_average, round(bf_top / file_top, 8) AS density_bf_file, round(bf_top / loc_top, 8) AS density_bf_loc,
      round(CASE WHEN bf_in > 0 THEN bf_top / bf_in END, 8) AS bfin_bfr, threshold AS buggy_file_threshold, reached AS current_accumulate_file,
      file_top AS file_in_top_cluster, listed AS top_buggy_cluster
    FROM (SELECT project, max(label) + 1 AS cluster_sum, sum(files)::BIGINT AS file_sum, sum(loc)::BIGINT AS loc_sum, max(space) AS file_bs, max(threshold) AS threshold,
        max(running)::BIGINT AS reached, (sum(files) FILTER ("rank" IS NOT NULL))::BIGINT AS file_top, (sum(loc) FILTER ("rank" IS NOT NULL))::BIGINT AS loc_top,
        coalesce(sum(bf) FILTER ("rank" IS NOT NULL), 0)::BIGINT AS bf_top, coalesce(sum(bc) FILTER ("rank" IS NOT NULL), 0)::BIGINT AS bc_top,
        avg(bug_density_file) FILTER ("rank" IS NOT NULL) AS dens_file, avg(bug_density_loc) FILTER ("rank" IS NOT NULL) AS dens_loc,
        string_agg(label::VARCHAR, ',' ORDER BY "rank") FILTER ("rank" IS NOT NULL) AS listed FROM v_clusters GROUP BY 1) s
    LEFT JOIN (SELECT project, count(*) FILTER (clusters = 1) AS bf_in, count(*) FILTER (clusters > 1) AS bf_out, sum(churn)::BIGINT AS churn FROM v_perfix_v1 GROUP BY 1) f
      ON f.project = s.project""")
