"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op6_top_k": """
        WITH vectors AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]) AS BIGINT) AS score
            FROM vectors AS q JOIN vectors AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
    "op13_phrases": """
        WITH lowered AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents WHERE text IS NOT NULL
        ),
        pieces AS (
            SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM lowered
        ),
        parted AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM pieces
        ),
        sized AS (SELECT lang, words, size FROM parted, range(1, 6) AS sizes(size) WHERE len(words) >= size),
        phrases AS (
            SELECT lang, size, array_to_string(list_slice(words, start, start + size - 1), ' ') AS phrase
            FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS start FROM sized)
        ),
        counted AS (SELECT lang, size, phrase, count(*) AS a FROM phrases GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang),
        frequent AS (SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE a >= 100),
        inner_parts AS (
            SELECT DISTINCT lang, a, array_to_string(list_slice(words, start, start + part - 1), ' ') AS phrase
            FROM (
                SELECT lang, a, words, part, unnest(range(1, size - part + 2)) AS start
                FROM frequent, range(2, 5) AS parts(part) WHERE part < size
            )
        ),
        longest AS (SELECT lang, phrase, max(a) AS inside FROM inner_parts GROUP BY ALL),
        kept AS (
            SELECT f.* FROM frequent AS f LEFT JOIN longest AS g ON f.lang = g.lang AND f.phrase = g.phrase
            WHERE f.size > 1 AND (g.inside IS NULL OR 100 * g.inside < 100 * f.a)
        ),
        cuts AS (SELECT *, unnest(range(1, size)) AS cut FROM kept),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, t.n,
                   CAST((1000 * CAST(c.a AS HUGEINT) * t.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
            FROM cuts AS c
            JOIN frequent AS l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.words, 1, c.cut), ' ')
            JOIN frequent AS r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.words, c.cut + 1, c.size), ' ')
            JOIN totals AS t ON t.lang = c.lang
        ),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored
        ),
        ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
                   phrase, a, l, r, n, score
            FROM best WHERE place = 1
        )
        SELECT * FROM ranked WHERE rank <= 2000
    """,
}
