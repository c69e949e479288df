"""DuckDB statements of the corpus queries, written from the contracts."""

from __future__ import annotations

import re

from voxrisk.llm import licenses


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates_sql() -> str:
    return f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) ELSE w END AS s FROM tokens
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (n_a + n_b - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""


# DuckDB counts edits in bytes: letters of the corpus beyond ASCII are given codes of one byte that no text has.
ONE_BYTE = [*range(1, 9), 11, 12, *range(14, 32), 127]


def line_dedup_sql() -> str:
    letters = sorted(set("äöüßàâçèéêíñóÄÖÜÀÂÇÈÉÊÍÑÓáÁúÚ"))[:len(ONE_BYTE)]
    narrow = lambda x: f"translate({x}, '{''.join(letters)}', {' || '.join(f'chr({c})' for c in ONE_BYTE[:len(letters)])})"
    return f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents
), rows_ AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS pos FROM parts
), lines AS (SELECT *, trim(raw) AS line FROM rows_
), known AS (
  SELECT line, doc_id AS d, pos AS p, length(line) AS len, least(2, length(line) // 20) AS edits, {narrow('line')} AS thin
  FROM lines WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1
), links AS (
  SELECT s.line AS a, l.line AS b, s.d AS d_a, s.p AS p_a, l.d AS d_b, l.p AS p_b FROM known s JOIN known l
  ON l.len BETWEEN s.len AND s.len + s.edits AND s.line <> l.line AND s.edits > 0 AND levenshtein(s.thin, l.thin) <= s.edits
), later AS (
  SELECT a AS line FROM links WHERE (d_b, p_b) < (d_a, p_a) UNION SELECT b FROM links WHERE (d_a, p_a) < (d_b, p_b)
), judged AS (
  SELECT l.doc_id, l.pos, l.raw, l.line <> '' AS text, later.line IS NOT NULL AS near,
    later.line IS NULL AND l.line <> '' AND (l.doc_id, l.pos) <> (known.d, known.p) AS exact
  FROM lines l LEFT JOIN known USING (line) LEFT JOIN later USING (line)
)
SELECT doc_id, count(*) FILTER (WHERE text)::BIGINT AS n_lines, count(*) FILTER (WHERE exact)::BIGINT AS n_exact, count(*) FILTER (WHERE near)::BIGINT AS n_near,
  md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT exact AND NOT near), '')) AS kept_md5
FROM judged GROUP BY doc_id
"""


def chat_sql() -> str:
    coded = lambda x: f"replace(replace(replace({x}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"
    return f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS trained,
    sum(length({coded('role')}) + length({coded('text')}) + length('<turn ') + length('>') + 1 + length('</turn>') + 1) AS chars
  FROM given GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(trained)::BIGINT AS loss_chars, sha256(trained) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM whole
"""


def template_pattern(template: str) -> str:
    """Regular expression over space-separated words, each followed by one space."""
    out = []
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<optional>>":
            out.append("(?:")
        elif part == "<</optional>>":
            out.append(")?")
        elif part.startswith("<<any"):
            least, most = re.findall(r"\d+", part)
            out.append(f"(?:[^ ]+ ){{{least},{most}}}")
        else:
            out += [w + " " for w in part.split()]
    return "".join(out)


def license_sql() -> str:
    phrases = [(p.split(), label) for p, label in licenses.PHRASES.items()]
    at = lambda words: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    places = ", ".join(f"[i FOR i IN range(1, len(w) + 1) IF {at(words)}]" for words, _ in phrases)
    base = ", ".join(f"CASE WHEN len(found[{k}]) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases, 1))
    own = ", ".join(
        f"CASE WHEN regexp_matches(joined, ' {template_pattern(t)}') THEN '{label}' END" for label, t in licenses.TEMPLATES.items())
    sorted_join = lambda x: f"array_to_string(list_sort(list_distinct({x})), ',')"
    return f"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), found AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, [{places}] AS found FROM low
), named AS (
  SELECT doc_id, len(w) AS n_words, flatten(found) AS hits, list_filter([{base}], lambda x: x IS NOT NULL) AS base,
    list_filter([{own}], lambda x: x IS NOT NULL) AS own
  FROM found
)
SELECT doc_id, n_words::BIGINT AS n_words, len(hits)::BIGINT AS n_base, (list_min(hits) - 1)::BIGINT AS first_word, (list_max(hits) - 1)::BIGINT AS last_word,
  {sorted_join('base')} AS base_labels, {sorted_join('list_concat(base, own)')} AS labels,
  CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM named
"""


def phrases_sql(min_count: int = 100, max_words: int = 5, top: int = 2000) -> str:
    ends = ".,;:!?" + "".join(map(chr, range(10, 14)))
    grams = " UNION ALL ".join(
        f"SELECT lang, array_to_string(words[i:i + {k - 1}], ' ') AS phrase, {k} AS k FROM pieces, unnest(range(1, len(words) - {k - 2})) t(i) WHERE len(words) >= {k}"
        for k in range(1, max_words + 1))
    return f"""
WITH folded AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (
  SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda w: w <> '') AS words
  FROM (SELECT lang, unnest(string_split(translate(text, '{ends[:6]}' || {' || '.join(f'chr({ord(c)})' for c in ends[6:])}, repeat(chr(10), 10)), chr(10))) AS piece FROM folded)),
grams AS ({grams}),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, phrase, k, count(*) AS a FROM grams GROUP BY lang, phrase, k HAVING count(*) >= {min_count}),
cuts AS (
  SELECT c.lang, c.phrase, c.k AS words, c.a, t.cut, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM f c JOIN totals n USING (lang), unnest(range(1, c.k)) t(cut)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:t.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[t.cut + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
absorbed AS (
  SELECT DISTINCT s.lang, s.phrase FROM scored s JOIN f ON f.lang = s.lang AND f.k > s.words AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * f.a >= 100 * s.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM scored ANTI JOIN absorbed USING (lang, phrase))
WHERE rank <= {top}
"""
