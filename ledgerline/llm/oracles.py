"""DuckDB SQL for those of the queries whose results SQL can state."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[ \x09-\x0D]", "[#*$%&|<>]")


def _count(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


def _divergence(p: str, q: str) -> str:
    """The terms of one value, in bits; its halved sum is the divergence."""
    m = f"(({p} + {q}) / 2)"
    return f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END"


OP3 = r"""WITH item AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w, least(5, len(w)) AS width FROM benchmark),
shingled AS (SELECT i, item_id, width, unnest(list_distinct(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' ')))) AS s FROM item WHERE width > 0),
sizes AS (SELECT i, count(*) AS n FROM shingled GROUP BY i),
doc AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
held AS (SELECT d, doc_id, width, unnest(list_distinct(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' ')))) AS s
  FROM doc, (SELECT DISTINCT width FROM item WHERE width > 0) WHERE len(w) >= width)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item_shingles, count(*) / any_value(n) AS containment
FROM held JOIN shingled USING (width, s) JOIN sizes USING (i) GROUP BY d, doc_id, i, item_id HAVING count(*) >= 0.8 * any_value(n)"""

OP5 = rf"""WITH langs AS (SELECT coalesce(lang, '') AS lang, CASE WHEN count(*) * 1024 < sum(count(*)) OVER () THEN chr(1) || 'rare' ELSE coalesce(lang, '') END AS named FROM documents GROUP BY coalesce(lang, '')),
doc AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t, named AS lang, {WORDS} AS w FROM documents JOIN langs ON langs.lang = coalesce(documents.lang, '')),
wins AS (SELECT d, k, array_to_string(w[k:k + 7], chr(1)) AS s FROM (SELECT d, w, unnest(range(1, len(w) - 6)) AS k FROM doc WHERE len(w) >= 8)),
twice AS (SELECT d, k FROM (SELECT d, k, count(*) OVER (PARTITION BY d, s) AS c FROM wins) WHERE c > 1),
repeated AS (SELECT d, count(DISTINCT p) AS n FROM (SELECT d, unnest(range(k, k + 8)) AS p FROM twice) GROUP BY d),
lines AS (SELECT d, count(*) - count(DISTINCT l) AS n FROM (SELECT d, unnest(string_split(t, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '[^ \x09-\x0D]') GROUP BY d),
classes AS (SELECT d, lang, k, n FROM (SELECT d, lang, unnest([0, 1, 2, 3, 4, 5, 6]) AS k, unnest([{", ".join(_count(c) for c in CLASSES)}, 0, {_count("[^" + chr(92) + "x00-" + chr(92) + "x7F]")}]) AS n, length(t) AS size FROM doc)),
whole AS (SELECT d, lang, k, CASE WHEN k = 5 THEN size - known ELSE n END AS n, size FROM (
  SELECT c.*, length(doc.t) AS size, sum(c.n) OVER (PARTITION BY c.d) AS known FROM classes c JOIN doc USING (d))),
pooled AS (SELECT k, sum(n) AS pn, sum(sum(n)) OVER () AS pt, sum(sum(CASE WHEN k IN (0, 1, 6) THEN n ELSE 0 END)) OVER () AS pl FROM whole GROUP BY k),
class_sum AS (SELECT lang, k, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total, sum(sum(CASE WHEN k IN (0, 1, 6) THEN n ELSE 0 END)) OVER (PARTITION BY lang) AS letters FROM whole GROUP BY lang, k),
class_ref AS (SELECT lang, k, total + 30000 AS total, n + 30000 * CASE WHEN k IN (0, 1, 6) AND letters > 0 THEN pl / pt * n / letters ELSE pn / pt END AS n FROM class_sum JOIN pooled USING (k)),
class_d AS (SELECT d, any_value(size) AS size, sqrt(greatest(sum({_divergence("p", "q")}) / 2, 0)) AS v
  FROM (SELECT d, size, x.n / size AS p, r.n / r.total AS q FROM whole x JOIN class_ref r USING (lang, k) WHERE size > 0) GROUP BY d),
word AS (SELECT d, lang, {LOWER.format("unnest(w)")} AS x FROM doc),
totals AS (SELECT lang, count(*) AS total FROM word GROUP BY lang),
common AS (SELECT lang, x, n FROM (SELECT lang, x, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) AS r FROM word GROUP BY lang, x) WHERE r <= 48),
parts AS (SELECT lang, x, n FROM common UNION ALL SELECT lang, NULL, any_value(total) - sum(n) FROM common JOIN totals USING (lang) GROUP BY lang),
own AS (SELECT d, c.x, count(*) AS n FROM word JOIN common c USING (lang, x) GROUP BY d, c.x),
rest AS (SELECT doc.d, len(w) - coalesce(sum(own.n), 0) AS n FROM doc LEFT JOIN own USING (d) GROUP BY doc.d, w),
word_d AS (SELECT d, sqrt(greatest(sum({_divergence("p", "q")}) / 2, 0)) AS v FROM (
  SELECT doc.d, CASE WHEN parts.x IS NULL THEN rest.n ELSE coalesce(own.n, 0) END / len(w) AS p, parts.n / total AS q
  FROM doc JOIN parts USING (lang) JOIN totals USING (lang) JOIN rest USING (d) LEFT JOIN own ON own.d = doc.d AND own.x = parts.x WHERE len(w) > 0) GROUP BY d),
judged AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(repeated.n, 0) > 30 * len(w) AS base_failed,
    CASE WHEN length(t) >= 200 THEN class_d.v END AS cd, CASE WHEN len(w) >= 40 THEN word_d.v END AS wd, totals.total
  FROM doc LEFT JOIN lines USING (d) LEFT JOIN repeated USING (d) LEFT JOIN class_d USING (d) LEFT JOIN word_d USING (d) LEFT JOIN totals USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(cd > 0.33, false) AND NOT coalesce(wd > 0.36 + 0.9 / sqrt(n_words) + 0.9 / sqrt(total), false) AS kept,
  coalesce(CAST(round(cd * 1000000) AS BIGINT), -1) AS class_distance_ppm, coalesce(CAST(round(wd * 1000000) AS BIGINT), -1) AS word_distance_ppm FROM judged"""

OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS largest, count(*) AS n FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN n > 1 AND page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM p LEFT JOIN g USING (h)"""

#: The table of CRC-32 (reflected polynomial 0xEDB88320), as a one-row relation.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab"


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; needs tab of CRC_TABLE."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT"
    return f"(4294967295 - list_reduce(list_transform(range(strlen({text})), lambda k: {byte}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295))"


OP11 = f"""WITH crc AS ({CRC_TABLE}),
found AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, {LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents WHERE text IS NOT NULL),
runs AS (SELECT id, run, count(*) AS k FROM found WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (SELECT run, k, {_crc32("id || ':' || run")} AS h FROM runs, crc),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING sum(k) >= 2 AND length(word) >= 7),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.v = b.word UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON b.v = a.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (WITH RECURSIVE s AS (SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM s JOIN forms f ON f.word = s.root AND f.form IS NOT NULL) SELECT * FROM s)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s USING (word) JOIN forms r ON r.word = s.root AND r.form IS NULL"""

OP13 = f"""WITH crc AS ({CRC_TABLE}),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS ts FROM t GROUP BY conv_id),
hashed AS (SELECT conv_id, ts, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM own, crc),
built AS (SELECT a.conv_id, list_concat(coalesce(b.ts[1:h], []), a.ts[h + 1:]) AS ts FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefix AS (SELECT conv_id, d, ts[1:d] AS node, len(ts) = d AS ends FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM built)),
node AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended FROM prefix GROUP BY node, d),
child AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
valued AS (SELECT node.*, coalesce(child.n, 0) AS n_children, (n_convs - 1) * CASE WHEN node.d > 0 THEN strlen(node.node[node.d].text) ELSE 0 END AS own FROM node LEFT JOIN child USING (node, d)),
above AS (SELECT node[1:u] AS node, u AS d, n_children, own FROM (SELECT node, n_children, own, unnest(range(0, d + 1)) AS u FROM valued)),
summed AS (SELECT node, d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM above GROUP BY node, d)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(v.ended) AS ends_sha256
FROM valued v JOIN summed s USING (node, d) LEFT JOIN node p ON p.d = v.d - 1 AND p.node = v.node[1:v.d - 1]"""

ORACLES = {"op11_spelling_variants": OP11, "op13_conversation_trie": OP13, "op3_decontamination": OP3, "op5_quality": OP5, "op6_warc": OP6}
