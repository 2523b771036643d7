"""DuckDB SQL of importance resampling, contamination and fill-in-the-middle, by plain means: lists of words, joins of windows, CRC-32 bit by bit."""

from __future__ import annotations

from .fill_middle import MARKS

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def hexed(prefix: str, at: int) -> str:
    """Eight hex digits of a document's hash as a number."""
    return f"CAST('0x' || substr(sha256('{prefix}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {at}, 8) AS BIGINT)"


#: The table of CRC-32 comes from its polynomial; h is a word's bytes in hex.
CRC = """crc AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
 hashed AS (SELECT w, xor(list_reduce(list_transform(range(strlen(w)), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), crc)"""

RESAMPLING = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
 dw AS (SELECT r, unnest(words) AS w FROM d), bw AS (SELECT unnest({WORDS}) AS w FROM benchmark), {CRC},
 s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket),
 g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
 m AS (SELECT r, sum(gain) AS total FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY r),
 x AS (SELECT r, doc_id, len(words) AS n_features, CAST(floor(coalesce(total, 0)::DOUBLE / greatest(len(words), 1)) AS BIGINT) AS weight, {hexed("2024", 1)} AS h FROM d LEFT JOIN m USING (r)),
 y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
 z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, 10 * count(*) FILTER (WHERE n_features >= 20) OVER () // 100 AS k FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= k THEN place END AS rank FROM z"""

#: Windows as texts of joined words; the lengths are 10 and those of shorter items.
CONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
 b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {WORDS} AS words FROM benchmark), i AS (SELECT *, least(len(words), 10) AS size FROM b WHERE len(words) > 0),
 iw AS (SELECT DISTINCT item_id, size, array_to_string(words[p : p + size - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS p FROM i)),
 dw AS (SELECT r, p, size, array_to_string(words[p : p + size - 1], ' ') AS w FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT size FROM i) WHERE len(words) >= size)),
 hits AS (SELECT r, p, size, item_id FROM dw JOIN iw USING (size, w)),
 n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT r, p, size FROM hits)) GROUP BY r),
 o AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN o USING (r)"""

P, S, M = (f"'{m}'" for m in MARKS)
FILL_MIDDLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS t, {", ".join(f"{hexed('42', 8 * k + 1)} AS h{k + 1}" for k in range(4))} FROM documents),
 c AS (SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b, CASE WHEN text = '' OR contains(text, {P}) OR contains(text, {S}) OR contains(text, {M}) OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
 x AS (SELECT *, array_to_string(t[1 : a], '') AS pre, array_to_string(t[a + 1 : b], '') AS mid, array_to_string(t[b + 1 :], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {P} || pre || {S} || suf || {M} || mid ELSE {S} || suf || {P} || pre || {M} || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM x"""
