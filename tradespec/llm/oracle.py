"""DuckDB SQL for the queries that SQL can express; the others are tested by brute force."""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL = {
    "op2_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (
            SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)
        ),
        f AS (SELECT g, min(doc_id) AS first_id FROM s GROUP BY g),
        c AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
            FROM s JOIN f USING (g) WHERE first_id < doc_id
        ),
        r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
        k AS (
            SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS g,
                coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1)
                    IF gone IS NULL OR NOT list_contains(gone, i)], ' '), '') AS kept
            FROM d LEFT JOIN r USING (doc_id)
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed,
            sha256(kept) AS kept_sha256
        FROM k
    """,
    "op7_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
            count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
            sha256(t) AS text_sha256
        FROM d
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, o.vec_id AS vec_id, a.label = o.label AS same,
                CAST(list_inner_product(a.q, o.q) AS BIGINT) AS score
            FROM v AS a JOIN v AS o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id
        ),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank,
            n.vec_id AS negative_id, positive_score, n.score AS negative_score
        FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same
            AND 100 * n.score BETWEEN 30 * positive_score AND 90 * positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
        QUALIFY row_number() OVER w <= 10
    """,
}
