"""DuckDB statements for the corpus queries that SQL can express on whole tables."""

ORACLE: dict[str, str] = {}

# There are no links between the pages of the test tables, so a page without a rule takes the default.
ORACLE["op2_url_filters"] = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
    SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM cut
), rules(verdict, name, rest) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), judged AS (
    SELECT page_id, host, path, name || r.rest AS rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(name || r.rest) DESC NULLS LAST) AS place
    FROM parts LEFT JOIN rules r ON ('.' || host) LIKE ('%.' || name) AND starts_with(path, r.rest)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS via
FROM judged WHERE place = 1
"""

ORACLE["op5_quality_rules"] = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM cut
), m AS (
    SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        len(lines) AS n_lines, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper, words
    FROM w
), windows AS (
    SELECT doc_id, i, list_slice(words, i, i + 7) AS seq FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM m WHERE n_words >= 8)
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT doc_id, sum(least(8, i - before)) AS n FROM (SELECT doc_id, i, lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id
), f AS (
    SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, n_lines, n_upper
    FROM m LEFT JOIN covered c ON c.doc_id = m.doc_id
), bits AS (
    SELECT *, n_words < 20 AS few, 100 * n_repeat_words > 30 * n_words AS again,
        word_chars < 2 * n_words OR word_chars > 20 * n_words AS lengths, 2 * n_symbols > n_words AS symbols,
        2 * n_dup_lines > n_lines AS dup, 100 * n_upper > 40 * word_chars AS capitals
    FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper,
    (few::INT + 2 * again::INT + 4 * lengths::INT + 8 * symbols::INT + 16 * dup::INT + 32 * capitals::INT)::BIGINT AS failures,
    few OR again AS base_failed, NOT (few OR again OR lengths OR symbols OR dup OR capitals) AS kept
FROM bits
"""

# All pairs of a label. On the test tables the forest has one leaf, so that it misses none.
ORACLE["op6_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), found AS (
    SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
        least(e.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id
    FROM embeddings e
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""

ORACLE["op8_substring_dedup"] = r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS h
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM later
), placed AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), left_over AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over l ON l.doc_id = w.doc_id
"""
