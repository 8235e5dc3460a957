"""DuckDB SQL for the queries, or for those of their columns that SQL can say."""

from __future__ import annotations

_SPACE = r"[ \t-\r]+"
_WORD = r"[^ \t-\r]+"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DEDUP = rf"""
    WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g"""

_JOIN = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORD}') AS words FROM documents),
    p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM w),
    g AS (SELECT doc_id, i, n, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS shingle FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    e AS MATERIALIZED (SELECT DISTINCT doc_id, md5(shingle) AS shingle FROM g WHERE i <= n - 3 OR (n < 4 AND i = 1)),
    z AS MATERIALIZED (SELECT doc_id, count(*) AS n_shingles, string_agg(shingle, '' ORDER BY shingle) AS whole FROM e GROUP BY doc_id),
    c AS (SELECT doc_id, n_shingles, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM z),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
    r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
    m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
    k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT d.doc_id, coalesce(c.n_shingles, 0) AS n_shingles, m.component_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links
    FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""


def _spans(k: int, kind: str, pattern: str, least: int, group: int) -> str:
    """A row per match of a document: what stands before it since the match before, the match, and the part whose length counts."""
    found = f"regexp_extract_all(text, '{pattern}')"
    return f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, unnest({found}) AS f, unnest(string_split_regex(text, '{pattern}')[:len({found})]) AS b,
        unnest(regexp_extract_all(text, '{pattern}', {group})) AS v, generate_subscripts({found}, 1) AS i FROM t"""


_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_SECRETS = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    m AS ({_spans(0, "assign", rf'''({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)''', 8, 2)}
          UNION ALL {_spans(1, "access", "AKIA[A-Z0-9]+", 16, 0)} UNION ALL {_spans(2, "hex", "[0-9a-f]+", 32, 0)}),
    s AS (SELECT *, sum(length(b) + length(f)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM m),
    g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                 string_agg(kind || ':' || (stop - length(f)) || ':' || stop, ',' ORDER BY stop - length(f), k) AS spans
          FROM s WHERE length(v) >= least GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
    FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""

#: crc32 of a doc_id as text (d), folded over its bits, the lowest of each byte first.
_BITS = "list_transform(range(8 * length(d)), lambda j: (ascii(d[j // 8 + 1]) >> (j % 8)::INTEGER) & 1)"
_CRC = f"xor(list_reduce({_BITS}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295)"

_UNIGRAMS = rf"""
    WITH t AS (SELECT doc_id, doc_id::VARCHAR AS d, regexp_extract_all({_FOLDED}, '{_WORD}') AS words FROM documents),
    h AS MATERIALIZED (SELECT doc_id, words, {_CRC} % 7 = 2 AS held_out FROM t),
    w AS MATERIALIZED (SELECT doc_id, held_out, unnest(words) AS word FROM h UNION ALL SELECT doc_id, held_out, ' ' FROM h),
    c AS MATERIALIZED (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word),
    n AS (SELECT coalesce(sum(c), 0)::BIGINT AS tokens, count(*) AS words FROM c)
    SELECT w.doc_id, w.held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.tokens) AS train_tokens,
           round(sum(log10((coalesce(c.c, 0) + 1) / (n.tokens + 1 * (n.words + 1)))), 6) AS base_score
    FROM w CROSS JOIN n LEFT JOIN c ON c.word = w.word GROUP BY w.doc_id, w.held_out"""

_QUALITY = rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS words FROM t),
    p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM w),
    g AS (SELECT doc_id, i, CASE WHEN i <= n - 4 THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS five
          FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    f AS (SELECT doc_id, i, five IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, five) > 1 AS again FROM g),
    a AS (SELECT doc_id, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM f),
    r AS (SELECT doc_id, sum(inside)::BIGINT AS n_repeat_words FROM a GROUP BY doc_id),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
    d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
    o AS (SELECT t.doc_id, len(w.words) AS n_words, length(regexp_replace(t.text, '{_SPACE}', '', 'g')) AS word_chars, length(regexp_replace(t.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                 coalesce(d.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words
          FROM t JOIN w ON w.doc_id = t.doc_id LEFT JOIN d ON d.doc_id = t.doc_id LEFT JOIN r ON r.doc_id = t.doc_id)
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o"""

_TARGETS = rf"""
    WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM t GROUP BY source),
    -- sources in the order in which they stop at three times their size; the level is what a unit of weight gets when those before have stopped
    q AS (SELECT *, 3.0 * source_size AS most, row_number() OVER o AS place,
                 (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
          FROM s WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST), before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    v AS (SELECT arg_min(level, place) AS level FROM q WHERE level * weight <= most)
    SELECT t.doc_id, t.size, q.source_size, round(least(q.most, q.weight * coalesce(v.level, 1e300)), 6) AS target FROM t JOIN q ON q.source IS NOT DISTINCT FROM t.source CROSS JOIN v"""

#: crc32 is linear: each byte adds what it leaves after the bytes behind it, and the start value, here byte 256, what it leaves after all.
_IMPORTANCE = rf"""
    WITH RECURSIVE b AS (SELECT i::INTEGER AS byte, list_reduce(list_concat([i], range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(i)),
    t AS MATERIALIZED (SELECT 'd' AS kind, doc_id AS k, {_FOLDED} AS text FROM documents UNION ALL SELECT 'b', item_id, {_FOLDED} FROM benchmark),
    w AS (SELECT kind, k, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t),
    p AS (SELECT kind, k, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
    q AS (SELECT *, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY kind, k ORDER BY i)),
    f AS (SELECT kind, k, a AS f, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT kind, k, a || ' ' || b, count(*) FROM q WHERE b IS NOT NULL GROUP BY ALL
          UNION ALL SELECT kind, k, a || ' ' || b || ' ' || c, count(*) FROM q WHERE c IS NOT NULL GROUP BY ALL),
    u AS MATERIALIZED (SELECT f, hex(f) AS h, octet_length(encode(f)) AS size FROM (SELECT DISTINCT f FROM f)),
    z AS (SELECT 0 AS behind, byte, v FROM b UNION ALL SELECT 0, 256, 4294967295
          UNION ALL SELECT behind + 1, z.byte, xor(b.v, z.v >> 8) FROM z JOIN b ON b.byte = z.v & 255 WHERE behind < (SELECT max(size) FROM u)),
    l AS (SELECT f, size - i - 1 AS behind, ('0x' || substring(h, 2 * i + 1, 2))::INTEGER AS byte FROM (SELECT *, unnest(range(size)) AS i FROM u) UNION ALL SELECT f, size, 256 FROM u),
    c AS (SELECT f, xor(bit_xor(v), 4294967295) % 10000 AS bucket FROM l JOIN z USING (behind, byte) GROUP BY f),
    g AS MATERIALIZED (SELECT kind, k, bucket, n FROM f JOIN c USING (f)),
    s AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM g GROUP BY bucket),
    m AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM s),
    e AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN m USING (bucket) WHERE kind = 'd' GROUP BY k),
    r AS (SELECT w.k AS doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('42:' || w.k), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
          FROM w LEFT JOIN e ON e.k = w.k WHERE kind = 'd'),
    o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE n_words >= 20)
    SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM r LEFT JOIN o ON o.doc_id = r.doc_id"""

_TRIE = rf"""
    WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
               FROM conversations WHERE conv_id IS NOT NULL),
    k AS (SELECT c, c::VARCHAR AS d, count(*) AS n FROM t GROUP BY c),
    v AS MATERIALIZED (SELECT k.c, k.n, {_CRC} % 4 AS h, least({_CRC} % 4, coalesce(o.n, 0)) AS got FROM (SELECT c, d, n FROM k) k LEFT JOIN (SELECT c AS donor, n FROM k) o ON o.donor = k.c - k.c % 20),
    r AS MATERIALIZED (SELECT v.c, p + 1 AS depth, role, text FROM v JOIN t ON t.c = v.c - v.c % 20 AND p < h UNION ALL SELECT v.c, got + p - h + 1, role, text FROM v JOIN t ON t.c = v.c AND p >= h),
    s AS MATERIALIZED (SELECT c, depth, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY depth)) AS path, len(regexp_extract_all(text, '{_WORD}')) AS w FROM r
                       UNION ALL SELECT c, 0, '', 0 FROM v),
    l AS (SELECT c, max(depth) AS stop FROM s GROUP BY c),
    n AS MATERIALIZED (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = stop) AS ends FROM s JOIN l USING (c) GROUP BY depth, path),
    u AS MATERIALIZED (SELECT n.*, a.path AS above FROM n LEFT JOIN s a ON a.c = n.conv_id AND a.depth = n.depth - 1),
    g AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
    f AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN g ON g.depth = u.depth AND g.path = u.path),
    z AS (SELECT a.depth, a.path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * f.w)::BIGINT AS saved_tokens FROM f JOIN s a ON a.c = f.conv_id AND a.depth <= f.depth GROUP BY ALL)
    SELECT f.conv_id, f.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
    FROM f JOIN z ON z.depth = f.depth AND z.path = f.path LEFT JOIN n o ON o.depth = f.depth - 1 AND o.path = f.above"""

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": _DEDUP,
    "op3_ngram_jaccard_join": _JOIN,
    "op11_importance": _IMPORTANCE,
    "op13_prefix_trie": _TRIE,
    "secret_base": _SECRETS,
    "lm_base": _UNIGRAMS,
    "quality_base": _QUALITY,
    "mixing_targets": _TARGETS,
}
