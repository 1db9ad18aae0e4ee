"""SQL counterparts of the operators that SQL can express, for DuckDB over the driver's tables."""

from __future__ import annotations

from airloom.llm.licences import MARKS, RULES, SENTENCES

_KEY = "CAST('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 15) AS BIGINT)"
_BIN = "(({0} >> greatest(length(bin({0})) - 6, 0)) << greatest(length(bin({0})) - 6, 0))"

_OP1 = f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS i
  FROM (SELECT id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)
),
windows AS (
  SELECT id, i, w, lead(w) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM words
  WINDOW d AS (PARTITION BY id ORDER BY i)
),
starts AS (
  SELECT id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY id, w, w2, w3) > 1 AS again FROM windows
),
covered AS (
  SELECT id, again OR coalesce(lag(again) OVER d, FALSE) OR coalesce(lag(again, 2) OVER d, FALSE) AS c
  FROM starts WINDOW d AS (PARTITION BY id ORDER BY i)
),
per_word AS (SELECT id, count(*) AS n_words, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY id),
per_line AS (
  SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT id, unnest(string_split(t, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY id
),
counted AS (
  SELECT docs.*, coalesce(n_words, 0) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM docs LEFT JOIN per_word USING (id) LEFT JOIN per_line USING (id)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // greatest(word_chars, 1) AS s1, 1000 * n_dup_lines // greatest(n_lines, 1) AS s2,
    1000 * n_repeat_words // greatest(n_words, 1) AS s3, 100 * word_chars // greatest(n_words, 1) AS s4
  FROM counted
),
binned AS (
  SELECT * REPLACE ({", ".join(_BIN.format(f"s{i}") + f" AS s{i}" for i in (1, 2, 3, 4))}) FROM judged
),
good AS (SELECT * FROM binned WHERE NOT base_failed),
-- Each level as (language known?, blogger known?) with the quartiles of its sorted values.
quartiles AS (
  SELECT lang, source, grouping(lang, source) AS level, count(*) AS n,
    {", ".join(f"list_sort(list(s{i}))[CAST(ceil(count(*) / 4.0) AS BIGINT)] AS a{i}, list_sort(list(s{i}))[CAST(ceil(count(*) * 3 / 4.0) AS BIGINT)] AS b{i}" for i in (1, 2, 3, 4))}
  FROM good GROUP BY GROUPING SETS ((lang, source), (lang), ())
),
limits AS (
  SELECT g.lang, g.source, q.* EXCLUDE (lang, source),
    row_number() OVER (PARTITION BY g.lang, g.source ORDER BY q.level) AS choice
  FROM (SELECT DISTINCT lang, source FROM good) g JOIN quartiles q
    ON (q.level = 0 AND q.lang IS NOT DISTINCT FROM g.lang AND q.source IS NOT DISTINCT FROM g.source AND q.n >= 200)
    OR (q.level = 1 AND q.lang IS NOT DISTINCT FROM g.lang AND q.n >= 200) OR q.level = 3
)
SELECT b.doc_id, b.n_words, CAST(b.word_chars AS BIGINT) AS word_chars, CAST(b.n_symbols AS BIGINT) AS n_symbols,
  b.n_dup_lines, b.n_repeat_words, b.base_failed,
  NOT b.base_failed AND coalesce(
    s1 <= b1 + 3 * greatest(b1 - a1, 10) AND s2 <= b2 + 3 * greatest(b2 - a2, 50)
    AND s3 <= b3 + 3 * greatest(b3 - a3, 50) AND s4 <= b4 + 3 * greatest(b4 - a4, 40)
    AND s4 >= a4 - 3 * greatest(b4 - a4, 40), TRUE) AS kept
FROM binned b LEFT JOIN limits l
  ON l.choice = 1 AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source
"""

_OP3 = f"""
WITH keyed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, text, source, {_KEY.format(seed="shards")} AS key
  FROM documents
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size) AS r,
    count(*) OVER (PARTITION BY source) AS n
  FROM keyed
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * r - 1 AS DOUBLE) / (2 * n),
    coalesce('=' || source, ''), r) - 1 AS p, count(*) OVER () AS total
  FROM ranked
),
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(0 AS UBIGINT) FOR _ IN range(8)]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c
    FROM range(256) AS g(i))
),
crc AS (
  SELECT h.x, CAST(xor(list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), [CAST('0x' || substr(h.x, 2 * j + 1, 2) AS UBIGINT) FOR j IN range(length(h.x) // 2)]),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32
  FROM (SELECT DISTINCT hex(encode(coalesce(text, ''))) AS x FROM documents) h, crc_table
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * 8 // total AS INTEGER) AS shard,
  p - (p * 8 // total * total + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed JOIN crc ON crc.x = hex(encode(coalesce(text, '')))
"""

_TERMS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP4 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, {_TERMS.format("text")} AS w FROM documents
),
items AS (SELECT item_id, {_TERMS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM items WHERE len(w) > 0)
),
-- All runs of words in the documents that are as long as some window.
words AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS s FROM docs),
ahead AS (
  SELECT id, s, list(w) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM words
),
runs AS (
  SELECT id, s, n, array_to_string(l[1:n], ' ') AS t FROM ahead, (SELECT DISTINCT n FROM windows) WHERE len(l) >= n
),
found AS (SELECT id, s, runs.n, item_id FROM runs JOIN windows USING (n, t)),
hits AS (
  SELECT id, count(DISTINCT p) AS n_hit
  FROM (SELECT id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT id, s, n FROM found)) GROUP BY id
),
named AS (
  -- An item without an id is hit, but not named.
  SELECT id, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (id) LEFT JOIN named USING (id)
"""

_OP11 = """
WITH vectors AS (
  SELECT row_number() OVER () AS k, vec_id,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(
    range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.k <> c.k WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""

def _licence_sql() -> str:
    known = ", ".join(f"('{sentence}', '{name}')" for sentence, name in SENTENCES.items())
    steps, left = [], "r"
    for number, (licence, parts) in enumerate(RULES):
        sequence = "".join(f"|{part}|" for part in parts)
        steps.append(
            f"s{number} AS (SELECT * EXCLUDE ({left}, f), replace({left}, '{sequence}', '#') AS r, "
            f"CASE WHEN contains({left}, '{sequence}') THEN list_append(f, '{licence}') ELSE f END AS f "
            f"FROM {'sequences' if not number else f's{number - 1}'})"
        )
    # RE2 has no look-behind: an end mark is set after each sentence instead.
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
cuts AS (
  SELECT id, way, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
    SELECT id, way, string_split_regex(regexp_replace(
      CASE way WHEN 1 THEN replace(t, chr(10), chr(1)) ELSE regexp_replace(t, '\\n[\\x20\\t\\r]*\\n', chr(1), 'g') END,
      '([.;:!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts
    FROM docs, (VALUES (1), (2)) w(way) WHERE regexp_matches(t, '{MARKS}'))
),
named AS (
  SELECT id, way, i, name FROM cuts JOIN known
    ON sentence = trim(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))
),
sequences AS (
  SELECT id, way, count(*) AS n, string_agg(name, ',' ORDER BY i) AS sentences,
    '|' || string_agg(name, '||' ORDER BY i) || '|' AS r, CAST([] AS VARCHAR[]) AS f
  FROM named GROUP BY id, way
),
{", ".join(steps)},
best AS (
  SELECT id, arg_max(sentences, n * 2 - way) AS sentences,
    array_to_string(list_sort(list_distinct(flatten(list(f)))), ',') AS licences
  FROM s{len(RULES) - 1} GROUP BY id
)
SELECT doc_id, coalesce(sentences, '') AS sentences, coalesce(licences, '') AS licences
FROM docs LEFT JOIN best USING (id)
"""


_OP9 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    {_KEY.format(seed="mix")} AS key
  FROM documents
),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 3 AS cap,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sources
),
-- Stop the sources that would go above their cap, one after the other, until none does.
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
    / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS rate
  FROM weighed
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
common AS (
  SELECT arg_min(rate, CAST(cap AS DOUBLE) / weight) AS rate FROM levels WHERE rate * weight <= cap
),
targets AS (
  SELECT source, source_size, least(common.rate * weight, CAST(cap AS DOUBLE)) AS target FROM levels, common
),
running AS (
  SELECT s.*, t.source_size, t.target,
    CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS epochs,
    sum(size) OVER (PARTITION BY s.source ORDER BY key) AS upto,
    sum(size) OVER (PARTITION BY s.source, key) AS peers
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * (epochs + CASE WHEN 2 * upto - peers <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS taken
FROM running
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": _OP1,
    "op3_stratified_shards": _OP3,
    "op4_decontamination": _OP4,
    "op6_licence_scan": _licence_sql(),
    "op9_mix_sources": _OP9,
    "op11_related_by_features": _OP11,
}
