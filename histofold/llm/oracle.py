"""DuckDB SQL of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op10_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS k,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

SQL["op3_line_frequency"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
tri AS (
  SELECT r, i, words[i] AS a, words[i+1] AS b, words[i+2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY r),
raw AS (
  SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (
  SELECT r, host, line,
         translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r),
hosts AS (
  SELECT host, count(*) AS n FROM d GROUP BY host),
freq AS (
  SELECT l.host, l.norm FROM (SELECT host, norm, count(DISTINCT r) AS n FROM ln GROUP BY host, norm) l
  JOIN hosts h ON h.host = l.host WHERE l.n > 20 AND l.n > 0.001 * h.n),
gone AS (
  SELECT ln.r, count(*) AS lines, sum(length(ln.norm) - length(replace(ln.norm, ' ', '')) + 1) AS words
  FROM ln JOIN freq USING (host, norm) GROUP BY ln.r),
s AS (
  SELECT d.r, d.doc_id, len(w.words) AS n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         coalesce(gone.lines, 0) AS n_lines_removed, len(w.words) - coalesce(gone.words, 0) AS words_left
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN gone USING (r)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND words_left >= 0.3 * n_words AS kept, n_lines_removed,
       CAST(words_left AS BIGINT) AS words_left
FROM b
"""

SQL["op7_url_filter"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS fetched,
         lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''),
                              '(:\d*)?$|\.(:\d*)?$', '', 'g')) AS host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)) AS seg
  FROM pages),
l AS (SELECT r, fetched, seg, string_split(host, '.') AS labels FROM p WHERE host <> ''),
d AS (
  SELECT r, fetched, seg, array_to_string(labels[i:], '.') AS dom
  FROM (SELECT *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM l)),
k AS (
  SELECT DISTINCT r, fetched, pat FROM (
    SELECT r, fetched, dom AS pat FROM d UNION ALL SELECT r, fetched, dom || '/' || seg FROM d WHERE seg <> '')
  WHERE pat <> '' AND pat NOT LIKE '/%'),
h AS (
  SELECT pat, 'list' || (CAST('0x' || substr(md5(pat), 1, 4) AS INT) % 3) AS list, CAST('0x' || substr(md5(pat), 5, 4) AS INT) % 4 AS last
  FROM (SELECT DISTINCT pat FROM k)),
e AS (
  SELECT list, rtrim(lower(pat), '.') AS entry, n % 2 = 0 AS active,
         DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(pat || '#' || n), 9, 4) AS INT) % 60 + n * 90 AS INT) AS t
  FROM (SELECT *, unnest(range(0, last + 1)) AS n FROM h)),
g AS (SELECT list, entry, t, bool_or(active) AS active FROM e GROUP BY ALL),
v AS (SELECT *, lead(t) OVER (PARTITION BY list, entry ORDER BY t) AS until FROM g),
m AS (
  SELECT k.r, v.list, v.entry FROM k JOIN v ON k.pat = v.entry AND v.active AND k.fetched >= v.t
    AND (v.until IS NULL OR k.fetched < v.until)),
a AS (
  SELECT r, list_sort(list(DISTINCT list)) AS lists, arg_max(entry, (length(entry), entry)) AS matched FROM m GROUP BY r)
SELECT p.page_id, p.fetched, a.r IS NOT NULL AS blocked, coalesce(len(a.lists), 0) AS n_lists, a.matched,
       coalesce(array_to_string(a.lists, ','), '') AS lists
FROM p LEFT JOIN a USING (r)
"""

SQL["op9_preference_format"] = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, turn,
         max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last
  FROM (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
        WHERE conv_id IS NOT NULL)),
b AS (
  SELECT *, CASE WHEN role = 'assistant' AND turn = last THEN array_to_string(list_reverse(string_split(text, ' ')), ' ')
                 ELSE text END AS other
  FROM t),
k AS (SELECT conv_id, coalesce(min(CASE WHEN text <> other THEN pos END) - 1, max(pos)) AS n FROM b GROUP BY conv_id),
f AS (
  SELECT b.*, k.n, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS x,
         '<|' || role || '|>' || chr(10) || other || chr(10) || '<|end|>' || chr(10) AS y
  FROM b JOIN k USING (conv_id))
SELECT conv_id, max(n) AS prompt_turns,
       coalesce(string_agg(x, '' ORDER BY pos) FILTER (WHERE pos <= n), '') AS prompt,
       coalesce(string_agg(x, '' ORDER BY pos) FILTER (WHERE pos > n), '') AS chosen,
       coalesce(string_agg(y, '' ORDER BY pos) FILTER (WHERE pos > n), '') AS rejected,
       CAST(coalesce(sum(length(text)) FILTER (WHERE pos > n AND role = 'assistant'), 0) AS BIGINT) AS chosen_trained,
       CAST(coalesce(sum(length(other)) FILTER (WHERE pos > n AND role = 'assistant'), 0) AS BIGINT) AS rejected_trained,
       count(*) FILTER (WHERE pos > n AND role = 'assistant') AS chosen_spans
FROM f GROUP BY conv_id
"""

# crc32 of a text's UTF-8 bytes: the usual table of 256 entries, then one step a byte.
_CRC32 = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8),
"""


def _crc32(text: str) -> str:
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * b + 1, 2) AS BIGINT)"
    return (f"xor(list_reduce(list_transform(range(strlen({text})), lambda b: {byte}), "
            "lambda c, b: xor(tab[xor(c, b) % 256 + 1], c >> 8), 4294967295::BIGINT), 4294967295)")


SQL["op12_importance_resampling"] = _CRC32 + r"""
texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM texts),
counted AS (SELECT side, r, w, count(*) AS n FROM words GROUP BY ALL),
hashed AS (SELECT w, """ + _crc32("w") + r""" % 10000 AS bucket FROM (SELECT DISTINCT w FROM counted), crc_table),
held AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t
  FROM counted JOIN hashed USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1.0::DOUBLE) * (total_s + 10000)) / ((s + 1.0::DOUBLE) * (total_t + 10000)))) AS BIGINT) AS gain
  FROM held, (SELECT coalesce(sum(s), 0) AS total_s, coalesce(sum(t), 0) AS total_t FROM held)),
weighed AS (
  SELECT r, sum(n) AS n_features, sum(n * gain) AS weight
  FROM counted JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
              / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE side = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                  count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM placed
"""
