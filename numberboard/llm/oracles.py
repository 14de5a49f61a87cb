"""DuckDB statements for the operators SQL can express. Constants are restated, not imported."""

from __future__ import annotations


OP1 = r"""
WITH RECURSIVE page AS (
    SELECT page_id, html, instr(coalesce(url, ''), '://') AS sep,
           substr(url, instr(url, '://') + 3) AS rest FROM pages
), parts AS (
    SELECT page_id, html,
           CASE WHEN sep > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
           CASE WHEN sep > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
           CASE WHEN sep > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS node
    FROM page
), tag AS (
    SELECT node, host, path, regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target
    FROM (SELECT node, host, path, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>')) AS t FROM parts)
    WHERE regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')
    UNION ALL
    SELECT node, host, path, regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) AS target
    FROM (SELECT node, host, path, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*>')) AS t FROM parts)
    WHERE regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')
), link AS (
    SELECT node AS a, CASE WHEN instr(u, '://') > 0 THEN u WHEN starts_with(u, '//') THEN 'http:' || u
           WHEN starts_with(u, '/') THEN 'http://' || host || u
           ELSE 'http://' || host || coalesce(nullif(regexp_extract(path, '^.*/'), ''), '/') || u END AS url
    FROM (SELECT node, host, path, replace(target, '&amp;', '&') AS u FROM tag WHERE target <> '' AND node IS NOT NULL)
), target AS (
    SELECT a, substr(url, instr(url, '://') + 3) AS rest FROM link
), edge AS (
    SELECT DISTINCT a, b FROM (
        SELECT a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                  || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b FROM target)
    WHERE a <> b
), both_ways AS (
    SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach AS (
    SELECT a AS id, b AS other FROM both_ways
    UNION
    SELECT r.id, e.b FROM reach AS r JOIN both_ways AS e ON r.other = e.a
), address AS (
    SELECT host, path FROM parts
    UNION
    SELECT regexp_extract(other, '^[^/?#]*'), regexp_extract(other, '^[^/?#]*([^?#]*)', 1) FROM reach
), rule(rule_host, rule_path, rule_verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), own AS (
    SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
    FROM address JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
), passed AS (
    SELECT id, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
    FROM reach JOIN own ON own.host = regexp_extract(other, '^[^/?#]*') AND own.path = regexp_extract(other, '^[^/?#]*([^?#]*)', 1)
    GROUP BY id
)
SELECT page_id, parts.host, parts.path, own.rule, coalesce(own.verdict, passed.verdict, 'allow') AS verdict
FROM parts LEFT JOIN own ON own.host = parts.host AND own.path = parts.path LEFT JOIN passed ON passed.id = parts.node
"""

OP3 = """
WITH page AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), known AS (
    SELECT page_id, octet_length(payload) AS size, sha1(payload) AS hex, payload,
           max(page_id) OVER (PARTITION BY payload) AS holder FROM page
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(hex, 1 + 5 * CAST(floor(k / 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INT), 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM known
"""

OP4 = r"""
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), base AS (
    SELECT doc_id, text, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
           len(list_filter(words, lambda x: list_contains(string_split('STOP', ' '), lower(x)))) AS n_stop_words
    FROM doc
), place AS (
    SELECT doc_id, unnest(range(1, n_words - 1)) AS i, words FROM base WHERE n_words >= 3
), window3 AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS met FROM place
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM window3, (SELECT unnest([0, 1, 2]) AS k) WHERE met > 1 GROUP BY doc_id
), measured AS (
    SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, n_stop_words
    FROM base LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND CASE WHEN n_words > 0 THEN word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.25
                AND n_stop_words / n_words >= 0.03 ELSE false END
       AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines <= 0.5 AND n_words / n_lines >= 2 ELSE false END AS kept
FROM measured
""".replace(
    "STOP",
    "the of and to in is that it for on as with was by are this be from at or an a "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par sur au plus pas avec il elle "
    "el los las y del se por con no su para lo como al más o sus le ha me si sin sobre",
)

OP8 = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), token AS (
    SELECT r, i, words[i] AS c, CASE WHEN i > 1 THEN words[i - 1] END AS b, CASE WHEN i > 2 THEN words[i - 2] END AS a
    FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM doc)
), one AS (
    SELECT c, count(*) AS n FROM token GROUP BY c
), two AS (
    SELECT b, c, count(*) AS n FROM token WHERE b IS NOT NULL GROUP BY b, c
), three AS (
    SELECT a, b, c, count(*) AS n FROM token WHERE a IS NOT NULL GROUP BY a, b, c
), scored AS (
    SELECT r, CASE WHEN three.n >= 2 THEN ln(three.n / context.n)
                   WHEN two.n >= 2 THEN ln(two.n / before.n) + CASE WHEN t.a IS NOT NULL THEN ln(0.4) ELSE 0 END
                   ELSE ln(one.n / (SELECT count(*) FROM token)) + CASE WHEN t.a IS NOT NULL THEN 2 WHEN t.b IS NOT NULL THEN 1 ELSE 0 END * ln(0.4)
              END AS s
    FROM token AS t JOIN one ON one.c = t.c LEFT JOIN one AS before ON before.c = t.b
    LEFT JOIN two ON two.b = t.b AND two.c = t.c LEFT JOIN two AS context ON context.b = t.a AND context.c = t.b
    LEFT JOIN three ON three.a = t.a AND three.b = t.b AND three.c = t.c
), total AS (
    SELECT r, sum(s) AS s FROM scored GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(round(s, 4), 0.0) AS log_score FROM doc LEFT JOIN total USING (r)
"""


def _op12(rounds: int = 3) -> str:
    """The rounds of OP12, one pair of common tables each."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""apart{k} AS MATERIALIZED (
    SELECT r, c, CAST(sum((comp.x - cent{k}.x) * (comp.x - cent{k}.x)) AS BIGINT) AS distance
    FROM comp JOIN cent{k} USING (d) GROUP BY r, c
), near{k} AS MATERIALIZED (
    SELECT r, c, distance FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, c) AS place FROM apart{k}) WHERE place = 1
)""")
        if k < rounds:
            steps.append(f"""moved{k} AS MATERIALIZED (
    SELECT c, d, sum(x) AS s, count(*) AS n FROM near{k} JOIN comp USING (r) GROUP BY c, d
), cent{k + 1} AS MATERIALIZED (
    SELECT c, d, CAST(CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) / n END AS BIGINT) AS x FROM cent{k} LEFT JOIN moved{k} USING (c, d)
)""")
    return ",\n".join(steps)


OP12 = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), comp AS MATERIALIZED (
    SELECT r, unnest(range(1, 65)) AS d, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept
), cent0 AS MATERIALIZED (
    SELECT c, d, x FROM (SELECT r, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), embedding) - 1 AS c FROM kept)
    JOIN comp USING (r) WHERE c < 16
), {_op12()}, inertia AS (
    SELECT c, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM near3 GROUP BY c
), digest AS (
    SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM cent3 GROUP BY c
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, cluster_inertia,
       (SELECT CAST(sum(distance) AS BIGINT) FROM near3) AS inertia, centroid_sha256
FROM near3 JOIN kept USING (r) JOIN inertia USING (c) JOIN digest USING (c)
"""

OP11 = r"""
WITH piece AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS words FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), place AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM piece
), total AS (
    SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM piece GROUP BY lang
), met AS MATERIALIZED (
    SELECT lang, m, phrase, count(*) AS f FROM (
        SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase
        FROM place, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(words))
    GROUP BY lang, m, phrase HAVING count(*) >= 30
), cut AS (
    SELECT lang, phrase, m, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head,
           array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') AS rest
    FROM met, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m
), rated AS (
    SELECT cut.lang, cut.phrase, m, a, k, x.f AS l, y.f AS r,
           CAST((2000000::HUGEINT * a - (2000000::HUGEINT * a) % (x.f + y.f)) / (x.f + y.f) AS BIGINT) AS score
    FROM cut JOIN (SELECT lang, phrase, f FROM met) AS x ON x.lang = cut.lang AND x.phrase = head
    JOIN (SELECT lang, phrase, f FROM met) AS y ON y.lang = cut.lang AND y.phrase = rest
), candidate AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM rated) WHERE nth = 1
), inner_part AS (
    SELECT lang, array_to_string(string_split(phrase, ' ')[b : b + size - 1], ' ') AS phrase, max(a) AS f
    FROM candidate, (SELECT unnest([1, 2, 3]) AS b), (SELECT unnest([2, 3]) AS size)
    WHERE size < m AND b + size - 1 <= m GROUP BY ALL
), kept AS (
    SELECT c.* FROM candidate AS c LEFT JOIN inner_part AS p ON p.lang = c.lang AND p.phrase = c.phrase
    WHERE p.f IS NULL OR 100 * p.f < 80 * c.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
WHERE rank <= 2000
"""
