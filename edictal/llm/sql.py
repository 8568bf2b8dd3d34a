"""DuckDB SQL of the numbered queries that SQL can express."""

SQL = {
    "op1_url_filter": r"""
        WITH rules(rh, rp, verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), cut AS (
            SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), urls AS (
            SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), fits AS (
            SELECT r, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
            FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM urls LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)
    """,
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
    "op6_preference_format": """
        WITH said AS (
            SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), ends AS (
            SELECT conv_id, max(turn) AS last, max({'turn': turn, 'text': text}) FILTER (role = 'assistant') AS reply FROM said GROUP BY conv_id
        ), cuts AS (
            SELECT conv_id, coalesce(reply.turn, last + 1) AS cut FROM ends
        ), sides AS (
            SELECT conv_id AS pair_id, 0 AS side, turn, {'role': role, 'text': text} AS m FROM said
            UNION ALL SELECT conv_id, 1, turn, {'role': role, 'text': text} FROM said JOIN cuts USING (conv_id) WHERE turn < cut
            UNION ALL SELECT c.conv_id, 1, cut, {'role': 'assistant', 'text': reply.text} FROM cuts c JOIN ends e ON e.conv_id = c.conv_id + 1 WHERE reply IS NOT NULL
        ), beside AS (
            SELECT pair_id, turn, list_sort(coalesce(list(m) FILTER (side = 0), [])) AS c, list_sort(coalesce(list(m) FILTER (side = 1), [])) AS r
            FROM sides GROUP BY ALL
        ), forks AS (
            SELECT *, coalesce(turn < min(CASE WHEN c <> r THEN turn END) OVER (PARTITION BY pair_id), true) AS common FROM beside
        ), parts AS (
            SELECT pair_id, greatest(turn // 64, 0) AS piece,
                   flatten(coalesce(list(c ORDER BY turn) FILTER (common), [])) AS p, flatten(coalesce(list(c ORDER BY turn) FILTER (NOT common), [])) AS c,
                   flatten(coalesce(list(r ORDER BY turn) FILTER (NOT common), [])) AS r, CAST(count(*) FILTER (common) AS INTEGER) AS prefix_turns
            FROM forks GROUP BY ALL
        )
        SELECT pair_id, piece, prefix_turns,
               coalesce(list_aggregate(list_transform(p, lambda m: '<|im_start|>' || m.role || chr(10) || m.text || '<|im_end|>' || chr(10)), 'string_agg', ''), '') AS prompt,
               coalesce(list_aggregate(list_transform(c, lambda m: '<|im_start|>' || m.role || chr(10) || m.text || '<|im_end|>' || chr(10)), 'string_agg', ''), '') AS chosen,
               coalesce(list_aggregate(list_transform(r, lambda m: '<|im_start|>' || m.role || chr(10) || m.text || '<|im_end|>' || chr(10)), 'string_agg', ''), '') AS rejected,
               coalesce(list_aggregate(list_transform(c, lambda m: (length(m.role) + 13) || ':0 ' || (length(m.text) + 10) || CASE WHEN m.role = 'assistant' THEN ':1 ' ELSE ':0 ' END || '1:0'), 'string_agg', ' '), '') AS chosen_mask,
               coalesce(list_aggregate(list_transform(r, lambda m: (length(m.role) + 13) || ':0 ' || (length(m.text) + 10) || CASE WHEN m.role = 'assistant' THEN ':1 ' ELSE ':0 ' END || '1:0'), 'string_agg', ' '), '') AS rejected_mask
        FROM parts
    """,
    "op8_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
    "op13_quality_rules": r"""
        WITH cut AS (
            SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), windows AS (
            SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
            FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM cut WHERE len(w) > 2))
        ), repeated AS (
            SELECT r, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) AS k(k) WHERE n > 1 GROUP BY r
        ), counted AS (
            SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
            FROM cut LEFT JOIN repeated USING (r)
        ), measured AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   [CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END, CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END,
                    CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END] AS m
            FROM counted
        ), bits AS (
            SELECT lang, source, rule, v, greatest(length(bin(v)) - 7, 0) AS s
            FROM (SELECT lang, source, unnest(range(1, 5)) AS rule, unnest(m) AS v FROM measured WHERE NOT base_failed)
        ), levels AS (
            SELECT grouping(lang) + grouping(source) AS level, lang, source, rule, (v >> s) << s AS bucket, count(*) AS n
            FROM bits GROUP BY GROUPING SETS ((lang, source, rule, (v >> s) << s), (lang, rule, (v >> s) << s), (rule, (v >> s) << s))
        ), below AS (
            SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM levels
        ), quartiles AS (
            SELECT level, lang, source, rule, max(total) AS total, min(bucket) FILTER (4 * below >= total) AS low, min(bucket) FILTER (4 * below >= 3 * total) AS high
            FROM below GROUP BY level, lang, source, rule
        ), limits AS (
            SELECT level, lang, source, rule, total, CASE WHEN rule = 1 THEN low - 5 * greatest(high - low, 100) ELSE -1 END AS least,
                   high + 5 * greatest(high - low, [100, 100, 1000, 1000][rule]) AS most
            FROM quartiles
        ), chosen AS (
            SELECT o.lang, o.source, o.rule,
                   CASE WHEN o.total >= 200 THEN o.least WHEN l.total >= 200 THEN l.least ELSE a.least END AS least,
                   CASE WHEN o.total >= 200 THEN o.most WHEN l.total >= 200 THEN l.most ELSE a.most END AS most
            FROM limits o JOIN limits l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM o.lang AND l.rule = o.rule JOIN limits a ON a.level = 2 AND a.rule = o.rule
            WHERE o.level = 0
        ), failing AS (
            SELECT r, min(rule) AS rule FROM measured JOIN chosen c ON c.lang IS NOT DISTINCT FROM measured.lang AND c.source IS NOT DISTINCT FROM measured.source
            WHERE NOT base_failed AND m[rule] NOT BETWEEN least AND most GROUP BY r
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rule IS NULL AS kept,
               CASE WHEN base_failed THEN 'base' ELSE ['mean_word', 'symbol_share', 'duplicate_share', 'repeat_share'][rule] END AS failed
        FROM measured LEFT JOIN failing USING (r)
    """,
}
