"""The SQL that queries are checked with."""
from __future__ import annotations

from .license_scan import PERCENT, PHRASES, TEMPLATES
from .line_quality import MAX_DOCS, MIN_LEFT, MIN_WORDS

BLANKS = "[ \\t-\\r]+"
AZ, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, strlen(body) AS bytes, min(page_id) OVER (PARTITION BY digest) AS least FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM q
"""

QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rn, doc_id, source, t, list_filter(string_split_regex(t, '{BLANKS}'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: len(regexp_replace(x, '{BLANKS}', '', 'g')) > 0) AS ls FROM d),
grams AS (SELECT rn, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
repeated AS (SELECT rn, i FROM grams QUALIFY count(*) OVER (PARTITION BY rn, g) > 1),
covered AS (SELECT rn, count(DISTINCT i + k) AS n FROM repeated, unnest([0, 1, 2, 3, 4]) AS u(k) GROUP BY rn),
lines AS (SELECT rn, source, t, trim(regexp_replace(regexp_replace(translate(l, {AZ}, {LOW}), '[0-9]', '0', 'g'), '{BLANKS}', ' ', 'g')) AS line
          FROM w, unnest(ls) AS u(l)),
hot AS (SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT rn) > {MAX_DOCS}),
gone AS (SELECT rn, sum(len(string_split(line, ' '))) AS n FROM lines JOIN hot USING (line)
         WHERE lines.source IS NOT DISTINCT FROM hot.source GROUP BY rn),
m AS (SELECT w.rn, doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '{BLANKS}', '', 'g'))::BIGINT AS word_chars,
             len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0) AS gone
      FROM w LEFT JOIN covered USING (rn) LEFT JOIN gone USING (rn)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - gone >= {MIN_WORDS} AND n_words - gone >= {MIN_LEFT} * n_words AS kept
FROM f
"""

URL_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {AZ}, {LOW}) AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
             list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'),
                                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS fields FROM u),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '')
                     || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS canonical FROM p),
listed AS (SELECT DISTINCT canonical FROM c
           WHERE list_has_any(string_split_regex(host, '[.-]'), ['adult', 'ads', 'bets', 'casino', 'pills', 'spam']) AND canonical IS NOT NULL),
rules(rule, verdict, h, s) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
    ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
fits AS (SELECT page_id, max_by(rule, len(rule)) AS rule, max_by(verdict, len(rule)) AS verdict
         FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT c.page_id, host, path, fits.rule, coalesce(fits.verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fits USING (page_id) LEFT JOIN listed ON listed.canonical = c.canonical
"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rn, doc_id,
                            list_filter(string_split_regex(translate(coalesce(text, ''), {AZ}, {LOW}), '{BLANKS}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT rn, array_to_string(ws[i:i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS u(i) WHERE len(ws) > 0),
z AS (SELECT rn, count(*) AS n FROM s GROUP BY rn),
pairs AS (SELECT a.rn AS x, b.rn AS y, count(*) AS shared FROM s AS a JOIN s AS b ON a.g = b.g AND a.rn < b.rn GROUP BY a.rn, b.rn),
links AS (SELECT x, y FROM pairs JOIN z AS p ON p.rn = x JOIN z AS q ON q.rn = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rn AS a, rn AS b FROM z UNION SELECT reach.a, edges.y FROM reach JOIN edges ON reach.b = edges.x),
least AS (SELECT a AS rn, min(w.doc_id) AS component_id FROM reach JOIN w ON w.rn = reach.b GROUP BY a)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, CASE WHEN z.n IS NULL THEN w.doc_id ELSE component_id END AS component_id
FROM w LEFT JOIN z USING (rn) LEFT JOIN least USING (rn)
"""


def _license_sql() -> str:
    words = "list_filter(string_split_regex({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    low = f"translate(t, {AZ}, {LOW})"
    hits = []
    for phrase, label in PHRASES:
        size = len(phrase.split())
        hits.append(f"SELECT rn, i - 1 AS pos, '{label}' AS label FROM w, unnest(range(1, len(ws) - {size - 2})) AS u(i) "
                    f"WHERE array_to_string(ws[i:i + {size - 1}], ' ') = '{phrase}'")
    rows = ", ".join(f"({i}, '{label}', list_distinct(string_split('{text}', ' ')))" for i, (label, text) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rn, doc_id, {words.format(low)} AS ws FROM d),
base AS (SELECT rn, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS found
         FROM ({' UNION ALL '.join(hits)}) GROUP BY rn),
templates(id, label, tw) AS (VALUES {rows}),
lines AS (SELECT rn, {words.format('l')} AS lw FROM (SELECT rn, unnest(string_split({low}, chr(10))) AS l FROM d)),
met AS (SELECT rn, label, len(list_intersect(list_distinct(lw), tw)) / len(tw) AS contained, len(list_intersect(list_distinct(lw), tw)) AS o, len(tw) AS n
        FROM lines, templates WHERE list_has_any(lw, tw)),
more AS (SELECT rn, list(DISTINCT label) AS labels, max(contained) AS best FROM met WHERE 100 * o >= {PERCENT} * n GROUP BY rn)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(coalesce(found, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (rn) LEFT JOIN more USING (rn)
"""


LICENSE_SQL = _license_sql()


def _escaped(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for control in ("<s>", "</s>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
             coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(len({_escaped('role')}) + len({_escaped('text')}) + len('[INST]  [/INST]</s>'))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

FIM_SQL = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT rn, doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT rn, doc_id, t, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN len(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def _codes_sql() -> str:
    """Rounds of assignment and replacement, one after the other."""
    gap = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"

    def assigned(k: int) -> str:
        return (f"a{k} AS MATERIALIZED (SELECT rn, p.part, min({gap} * 16 + b.entry)::BIGINT AS best FROM parts AS p JOIN b{k} AS b ON p.part = b.part GROUP BY rn, p.part)")

    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, label, list_transform(embedding, lambda e: floor(4096 * e::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
parts AS MATERIALIZED (SELECT rn, part, x[part * len(x) // 8 + 1:(part + 1) * len(x) // 8] AS x FROM v, unnest(range(0, 8)) AS u(part)),
firsts AS (SELECT rn, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 16),
b0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN firsts USING (rn))"""]
    for k in range(6):
        steps.append(assigned(k))
        steps.append(f"""m{k} AS (SELECT a.part, a.best % 16 AS entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS mean
      FROM a{k} AS a JOIN parts AS p ON a.rn = p.rn AND a.part = p.part, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY a.part, a.best % 16, i)""")
        steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{k} AS b
      LEFT JOIN (SELECT part, entry, list(mean ORDER BY i) AS x FROM m{k} GROUP BY part, entry) AS n USING (part, entry))""")
    steps.append(assigned(6))
    steps.append("c AS (SELECT rn, string_agg(lpad(to_hex(best % 16), 2, '0'), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM a6 GROUP BY rn)")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS digest FROM b6)")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM c JOIN v USING (rn), h
"""


CODES_SQL = _codes_sql()
