"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tideline.llm import licenses
from tideline.llm.sharding import MULTIPLIER

WORD = "[^\\x20\\x09-\\x0D]+"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS number FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
      sum(source_size) OVER () * 1.5::DOUBLE AS total, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / weight AS ratio,
      (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, ratio) AS level FROM f WHERE level < ratio),
t AS (SELECT f.source, f.source_size, CASE WHEN l.level IS NULL THEN cap ELSE least(cap, l.level * weight) END AS target FROM f CROSS JOIN l),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, round(r.target, 6) AS target,
  (d.size * (floor(rate) + CASE WHEN ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.digest || CASE WHEN d.number > 1 THEN '|' || d.number ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, row_number() OVER (PARTITION BY sha1(html) ORDER BY page_id NULLS LAST) AS nth, min(page_id) OVER (PARTITION BY sha1(html)) AS owner FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth = 1 THEN NULL ELSE owner END AS refers_to
FROM h
"""

def licenses_sql() -> str:
    """Stretches of whole lines or parts of them, between two ends of sentences, whose words are those of a known sentence. The
    sentences and rules are cut from the texts here, in SQL; § stands for the names of holders."""
    from tideline.llm import license_texts as table

    rows = [(name, table.ENOUGH.get(name, 1000), 0 if name in table.CLOSE else 2, 0, 1, text.strip()) for name, text in table.TEXTS.items()]
    rows += [(name, 1000, 2, 0, 0, "\n\n".join(parts)) for name, parts in table.PASSAGES.items()]
    rows += [(name, 1000, 2, mark, 0, text) for mark, notices in ((0, table.NOTICES), (1, table.MARKS)) for name, texts in notices.items() for text in texts]
    listed = ", ".join("({0!r}, {1}, {2}, {3}, {4}, '{5}')".format(*r[:5], r[5].replace("<holder>", "§").replace("'", "''")) for r in rows)
    return rf"""
WITH RECURSIVE src(name, enough, gap, mark, cut, text) AS (VALUES {listed}),
cuts AS (SELECT name, enough, gap, mark, row_number() OVER () AS rule, CASE WHEN cut = 1 THEN flatten(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_split_to_array(regexp_replace(p, '^\s*([0-9]+[.)]|[*-])\s+', ''), '[.!?]+\s+|[.!?]+$'))) ELSE regexp_split_to_array(text, '\n\s*\n') END AS parts FROM src),
rules AS MATERIALIZED (SELECT rule, name, gap, mark, (list_filter(list_transform(parts, lambda p: trim(regexp_replace(lower(p), '[^a-z0-9§]+', ' ', 'g'))), lambda p: p <> ''))[1:enough] AS ids, list_filter(list_transform(parts, lambda p: trim(regexp_replace(lower(p), '[^a-z0-9§]+', ' ', 'g'))), lambda p: p <> '') AS every FROM cuts),
known AS MATERIALIZED (SELECT sentence, contains(sentence, '§') AS slot, string_split(sentence, '§')[1] AS head, string_split(sentence, '§')[-1] AS tail, replace(sentence, '§', '[a-z0-9]+( [a-z0-9]+){{0,11}}') AS pattern FROM (SELECT DISTINCT unnest(every) AS sentence FROM rules)),
longest AS (SELECT max(len(string_split(sentence, ' ')) + 12 * len(string_split(sentence, '§'))) AS most FROM known),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, generate_subscripts(p, 1) AS si, unnest(p) AS part FROM (SELECT r, regexp_split_to_array(text, '[.!?]+[ \t\r\n]+') AS p FROM d)),
l AS (SELECT r, si, generate_subscripts(p, 1) AS li, unnest(p) AS line FROM (SELECT r, si, regexp_split_to_array(part, '[\r\n]+') AS p FROM s)),
w AS (SELECT r, si, li, array_to_string(regexp_extract_all(lower(line), '[a-z0-9]+'), ' ') AS words FROM l),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r, si ORDER BY li) AS k FROM w WHERE words <> ''),
a AS MATERIALIZED (SELECT n.* FROM n WHERE EXISTS (SELECT 1 FROM known WHERE starts_with(sentence, n.words) OR (slot AND starts_with(n.words, head)))),
c AS (SELECT a.r, a.si, a.k AS k1, b.k AS k2 FROM a JOIN n b ON a.r = b.r AND a.si = b.si AND b.k >= a.k AND b.k <= a.k + (SELECT most FROM longest)),
t AS (SELECT c.r, c.si, k1, k2, string_agg(n.words, ' ' ORDER BY n.k) AS sentence FROM c JOIN n ON n.r = c.r AND n.si = c.si AND n.k BETWEEN k1 AND k2 GROUP BY ALL),
m AS MATERIALIZED (SELECT t.r, t.si, t.k1, t.k2, known.sentence AS sid FROM t JOIN known ON t.sentence = known.sentence WHERE NOT slot
  UNION ALL SELECT t.r, t.si, t.k1, t.k2, known.sentence FROM t JOIN known ON slot AND starts_with(t.sentence, head) AND ends_with(t.sentence, tail) AND regexp_full_match(t.sentence, pattern)),
f AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.r = m.r AND o.si = m.si AND o.k1 <= m.k1 AND o.k2 >= m.k2 AND o.k2 - o.k1 > m.k2 - m.k1)),
i AS MATERIALIZED (SELECT r, sid, row_number() OVER (PARTITION BY r ORDER BY si, k1) AS pos FROM f),
go AS (SELECT i.r, rule, name, gap, mark, ids, 1 AS step, pos FROM i JOIN rules ON i.sid = ids[1]
  UNION SELECT g.r, g.rule, g.name, g.gap, g.mark, g.ids, g.step + 1, i.pos FROM go g JOIN i ON i.r = g.r AND i.sid = g.ids[g.step + 1] AND i.pos BETWEEN g.pos + 1 AND g.pos + 1 + g.gap),
h AS (SELECT r, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (mark = 0), string_agg(DISTINCT name, ',' ORDER BY name) FILTER (mark = 1)) AS licenses FROM go WHERE step = len(ids) GROUP BY r),
q AS (SELECT r, count(*) AS n FROM i GROUP BY r)
SELECT d.doc_id, coalesce(q.n, 0)::BIGINT AS n_known, coalesce(h.licenses, '') AS licenses FROM d LEFT JOIN q ON d.r = q.r LEFT JOIN h ON d.r = h.r
"""


def url_sql(entries, start: str) -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in entries)
    return f"""
WITH e(list, kind, key, action, effective) AS (SELECT col0, col1, col2, col3, col4::TIMESTAMP FROM (VALUES {rows})),
iv AS (SELECT *, lead(effective) OVER (PARTITION BY list, kind, key ORDER BY effective) AS until FROM e),
p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) AS path,
      TIMESTAMP '{start}' + to_minutes(page_id) AS fetched FROM pages),
hit AS (SELECT p.page_id, iv.* FROM p JOIN iv ON fetched >= iv.effective AND (iv.until IS NULL OR fetched < iv.until) AND iv.action = 'add' AND host <> ''
  AND CASE iv.kind WHEN 'host' THEN host = iv.key WHEN 'domain' THEN host = iv.key OR ends_with(host, '.' || iv.key) ELSE starts_with(host || path, iv.key) END),
b AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, kind, list) AS best FROM hit)
SELECT p.page_id, coalesce(b.n, 0)::BIGINT AS n_active, b.n IS NOT NULL AS blocked, b.list, b.kind, b.key AS entry FROM p LEFT JOIN b ON p.page_id = b.page_id AND b.best = 1
"""


def crc32(hex_digits: str) -> str:
    """Unsigned CRC-32 of bytes that are given by their hexadecimal digits."""
    table = ", ".join(str(x) for x in _crc_table())
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({hex_digits}, '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, b: xor(c >> 8, ([{table}][(xor(c, b) & 255) + 1])::BIGINT)), 4294967295::BIGINT)"""


def trie_sql() -> str:
    return f"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, {crc32("hex(conv_id::VARCHAR)")} % 4 AS h FROM own GROUP BY conv_id),
r AS (SELECT c.conv_id, o.pos, o.role, o.text FROM c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)), o.role, o.text FROM c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN c b ON b.conv_id = c.base),
p AS MATERIALIZED (SELECT conv_id, pos AS depth, len(regexp_extract_all(text, '{WORD}')) AS words, md5(string_agg(md5(length(role) || ':' || role || text), '' ) OVER (PARTITION BY conv_id ORDER BY pos)) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
node AS MATERIALIZED (SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE l.len = depth), '')) AS ends_sha256 FROM p JOIN l ON p.conv_id = l.conv_id GROUP BY path, depth),
up AS MATERIALIZED (SELECT n.path, n.depth, q.path AS above, q.depth AS above_depth FROM node n JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth),
kids AS (SELECT above AS path, count(*) AS n_children FROM up WHERE above_depth = depth - 1 GROUP BY above),
sums AS (SELECT above AS path, sum((n_convs - 1) * words)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves FROM up JOIN node n ON up.path = n.path LEFT JOIN kids k ON up.path = k.path GROUP BY above)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM node n JOIN sums s ON n.path = s.path LEFT JOIN kids k ON n.path = k.path LEFT JOIN up ON up.path = n.path AND up.above_depth = n.depth - 1 LEFT JOIN node a ON a.path = up.above
"""


def periods_sql() -> str:
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, {crc32("hex(doc_id::VARCHAR)")} AS h FROM documents),
k AS (SELECT *, h % 10 = 0 AND len(ws) > 0 AS planted, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM d),
m AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM k),
i AS (SELECT *, unnest(range(0, n)) AS i FROM m),
w AS MATERIALIZED (SELECT r, i, n, ws[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM i),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island),
f AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1),
t AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM f GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM f),
c AS (SELECT w.r, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN gone ON w.r = gone.r AND w.i = gone.i GROUP BY w.r)
SELECT d.doc_id, coalesce(t.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
  sha256(coalesce(t.runs, '')) AS runs_sha256, sha256(coalesce(c.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t ON d.r = t.r LEFT JOIN b ON d.r = b.r LEFT JOIN c ON d.r = c.r
"""


def near_sql(words: int, num: int, den: int, kept: str = "") -> str:
    """Links by counting the shingles that two different sets share, components by walking along links."""
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - {words - 1}, 1) + 1), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')))) AS shingles FROM d WHERE len(ws) > 0),
k AS MATERIALIZED (SELECT r, doc_id, shingles, len(shingles) AS n, min(r) OVER (PARTITION BY md5(array_to_string(shingles, chr(10)))) AS node FROM s),
c AS MATERIALIZED (SELECT node, any_value(n) AS n, unnest(any_value(shingles)) AS shingle FROM k GROUP BY node),
p AS (SELECT x.node AS a, y.node AS b FROM c x JOIN c y ON x.shingle = y.shingle AND x.node < y.node AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) GROUP BY x.node, y.node, x.n, y.n HAVING {den} * count(*) >= {num} * (x.n + y.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT DISTINCT node, node AS other FROM k UNION SELECT reach.node, l.b FROM reach JOIN l ON reach.other = l.a),
ids AS (SELECT node, min(doc_id) AS doc_id FROM k GROUP BY node),
g AS (SELECT reach.node, min(ids.doc_id) AS component_id FROM reach JOIN ids ON ids.node = reach.other GROUP BY reach.node),
o AS (SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, CASE WHEN k.r IS NULL THEN d.doc_id ELSE g.component_id END AS component_id FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN g ON k.node = g.node)
SELECT doc_id, n_shingles, component_id{kept} FROM o
"""


def sharding_sql() -> str:
    low = 18446744073709551615
    crc = ", ".join(str(x) for x in _crc_table())
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT doc_id, text, xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT),
  lambda c, b: xor(c >> 8, ([{crc}][(xor(c, b) & 255) + 1])::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d),
j AS (SELECT doc_id, coalesce(doc_id, 0)::HUGEINT AS k, 0::BIGINT AS cand, 0::BIGINT AS shard, 0::BIGINT AS grown FROM (SELECT DISTINCT doc_id FROM d)
  UNION ALL
  SELECT doc_id, nk, floor((cand + 1) * (2147483648.0::DOUBLE / ((nk >> 33) + 1)::DOUBLE))::BIGINT, CASE WHEN cand < 24 THEN cand ELSE shard END, cand
  FROM (SELECT *, ((((k >> 32) * {MULTIPLIER}::HUGEINT) & 4294967295::HUGEINT) * 4294967296::HUGEINT + (k & 4294967295::HUGEINT) * {MULTIPLIER}::HUGEINT + 1) & {low}::HUGEINT AS nk FROM j WHERE cand < 25)),
s AS (SELECT doc_id, arg_max(shard, cand) AS shard, arg_max(grown, cand) AS grown FROM j GROUP BY doc_id),
a AS (SELECT crc.doc_id, (octet_length(encode(text)) + 8)::BIGINT AS size, text_crc32, s.shard, s.grown FROM crc JOIN s ON crc.doc_id IS NOT DISTINCT FROM s.doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws('|', coalesce(doc_id, 0), size, text_crc32)), 1, 2), coalesce(doc_id, 0), size, text_crc32, doc_id NULLS LAST) - 1)::BIGINT AS slot, grown::INT AS grown_shard FROM a
"""


SPACE = "[\\x20\\x09-\\x0D]+"
QUALITY = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1)::BIGINT AS i, unnest(ws) AS w FROM (SELECT r, regexp_extract_all(text, '{WORD}') AS ws FROM d)),
g AS (SELECT r, i, array_to_string([w, lead(w, 1) OVER v, lead(w, 2) OVER v, lead(w, 3) OVER v, lead(w, 4) OVER v, lead(w, 5) OVER v, lead(w, 6) OVER v, lead(w, 7) OVER v], ' ') AS g, lead(w, 7) OVER v IS NOT NULL AS whole FROM w WINDOW v AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g WHERE whole),
m AS (SELECT w.r, count(*) AS n FROM (SELECT w.r, w.i, max(t.i) OVER (PARTITION BY w.r ORDER BY w.i) AS last FROM w LEFT JOIN t ON w.r = t.r AND w.i = t.i AND t.c > 1) w WHERE w.last > w.i - 8 GROUP BY w.r),
l AS (SELECT r, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)),
p AS (SELECT l.r, l.i, d.host, line, len(regexp_extract_all(line, '{WORD}'))::BIGINT AS n, md5(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}', ' ', 'g'), ' ')) AS h FROM l JOIN d ON l.r = d.r WHERE regexp_matches(line, '{WORD}')),
u AS (SELECT r, count(*) - count(DISTINCT line) AS dups FROM p GROUP BY r),
f AS (SELECT d.r, d.doc_id, d.host, md5(d.text) AS digest, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(u.dups, 0)::BIGINT AS n_dup_lines, coalesce(m.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN u ON d.r = u.r LEFT JOIN m ON d.r = m.r),
most AS (SELECT host, greatest(50, count(*) * 0.01) AS most FROM d GROUP BY host),
x AS (SELECT p.host, p.h FROM p JOIN f ON p.r = f.r JOIN most ON p.host IS NOT DISTINCT FROM most.host GROUP BY p.host, p.h, most HAVING count(DISTINCT f.digest) > most),
z AS (SELECT p.r, sum(p.n) AS gone FROM p JOIN x ON p.host IS NOT DISTINCT FROM x.host AND p.h = x.h GROUP BY p.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words - coalesce(gone, 0))::BIGINT AS n_left, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - coalesce(gone, 0) >= 0.3 * n_words AS kept FROM f LEFT JOIN z ON f.r = z.r
"""


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def sql(entries, start: str) -> dict[str, str]:
    return {"op1_ngram_jaccard_join": near_sql(3, 90, 100), "op3_url_filter": url_sql(entries, start), "op4_source_mixing": MIXING, "op5_warc_archive": WARC, "op7_license_scan": licenses_sql(), "op9_sharding": sharding_sql(), "op10_quality_rules": QUALITY, "op11_conversation_trie": trie_sql(), "op12_period_runs": periods_sql(), "op13_minmax_dedup": near_sql(2, 80, 100, ", doc_id IS NOT DISTINCT FROM component_id AS kept")}
