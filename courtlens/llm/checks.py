"""DuckDB SQL for the rows of the operators that SQL can express."""

from __future__ import annotations

import zlib
from typing import Sequence

from courtlens.llm import covertree, licenses, phrases, topk, variants
from courtlens.llm.common import UPPER


def _vectors(table: str, id_column: str, vector_column: str) -> str:
    """Vectors of finite doubles only."""
    return f"""
SELECT {id_column}, list_transform({vector_column}, lambda x: CAST(x AS DOUBLE)) AS e FROM {table}
WHERE {id_column} IS NOT NULL AND {vector_column} IS NOT NULL AND len(list_filter({vector_column}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def top_k(is_query: str, k: int = 10) -> str:
    return f"""
WITH usable AS ({_vectors('embeddings', 'vec_id', 'embedding')}),
v AS (SELECT vec_id, list_transform(e, lambda x: floor(x * {topk.SCALE})) AS q FROM usable),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.{is_query}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def cosine_groups(least: float = covertree.LEAST) -> str:
    return f"""
WITH RECURSIVE usable AS ({_vectors('embeddings', 'vec_id', 'embedding')}),
v AS (SELECT vec_id, e FROM usable WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {least}),
reach AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
least AS (SELECT u, min(w) AS w FROM reach GROUP BY u),
direct AS (SELECT u, count(*) AS n FROM links GROUP BY u),
named AS (SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.w, vec_id)) AS component_id
  FROM embeddings LEFT JOIN direct ON direct.u = vec_id LEFT JOIN least ON least.u = vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM named"""


def license_labels(templates: Sequence[licenses.Template] = licenses.BASE + licenses.NOTICES) -> str:
    rows = []
    for number, template in enumerate(templates):
        words = template.text.split()
        grams = len(words) - licenses.K + 1
        rows += [f"({number}, '{template.label}', {template.base}, {grams}, {at}, '{' '.join(words[at:at + licenses.K])}')" for at in range(grams)]
    gram = " || ' ' || ".join(f"w[i + {k + 1}]" for k in range(licenses.K))
    return f"""
WITH t(template, label, base, grams, spot, gram) AS (VALUES {', '.join(rows)}),
words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, unnest(list_transform(range(0, len(w) - {licenses.K - 1}), lambda i: {{'place': i, 'gram': {gram}}})) AS g FROM words),
lines AS (SELECT doc_id, template, label, base, grams, g.place - spot AS diagonal, min(g.place) AS first, list(DISTINCT spot) AS seen
  FROM places JOIN t ON g.gram = t.gram GROUP BY ALL),
opened AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER d > {licenses.DRIFT}, true) THEN 1 ELSE 0 END AS opens
  FROM lines WINDOW d AS (PARTITION BY doc_id, template ORDER BY diagonal)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM opened),
covered AS (SELECT doc_id, template, label, base, grams, run, first, unnest(seen) AS spot FROM runs),
merged AS (SELECT doc_id, label, base, min(first) AS first, count(DISTINCT spot) / CAST(grams AS DOUBLE) AS score FROM covered GROUP BY doc_id, template, label, base, grams, run),
kept AS (SELECT * FROM merged WHERE score >= CASE WHEN base THEN 1 ELSE {licenses.COVER} END),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM words LEFT JOIN found USING (doc_id)"""


def _crc32(bytes_list: str) -> str:
    """crc32 of a list of bytes. Entry b of the table follows from zlib's crc32 of the one byte b ^ 255."""
    table = ", ".join(str(zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000) for b in range(256))
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_list}), "
            f"lambda c, b: xor(c >> 8, list_extract(CAST([{table}] AS BIGINT[]), (xor(c, b) & 255) + 1))), 4294967295)")


def spelling_variants() -> str:
    key = "coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"
    utf8 = f"flatten(list_transform(string_split({key}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END))"
    return f"""
WITH RECURSIVE found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{UPPER.lower()}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM found GROUP BY ALL),
hashed AS (SELECT run, c, {_crc32(utf8)} AS h FROM counted),
lossy AS (SELECT c, CASE WHEN h % {variants.LOSES} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM lossy WHERE length(word) >= {variants.LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {variants.LEAST_COUNT}),
holes AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word FROM holes h JOIN words w ON h.rest = w.word UNION SELECT w.word, h.word FROM holes h JOIN words w ON h.rest = w.word),
best AS (SELECT p.word, count(*) AS n_near, min({{'less': -w.n, 'other': w.word}}) AS b FROM pairs p JOIN words w ON p.other = w.word GROUP BY p.word),
formed AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {variants.AHEAD} * n THEN b.other END AS form,
  CASE WHEN -b.less >= {variants.AHEAD} * n THEN -b.less END AS form_n FROM words LEFT JOIN best ON best.word = words.word),
chain(word, spot, depth) AS (SELECT word, word, 0 FROM formed UNION ALL
  SELECT chain.word, formed.form, depth + 1 FROM chain JOIN formed ON chain.spot = formed.word WHERE formed.form IS NOT NULL),
roots AS (SELECT word, arg_max(spot, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""


def collocations(least: int = phrases.LEAST, top: int = phrases.TOP) -> str:
    grams = "\nUNION ALL ".join(
        f"SELECT lang, {k} AS size, array_to_string(w[i:i + {k - 1}], ' ') AS gram FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM split)"
        for k in range(1, phrases.WORDS + 1))
    return f"""
WITH RECURSIVE pieces AS (SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
f AS MATERIALIZED (SELECT lang, size, gram, count(*) AS n FROM ({grams}) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, gram AS phrase, string_split(gram, ' ') AS w, n AS a FROM f WHERE size > 1 AND n >= {least}),
cut AS MATERIALIZED (SELECT *, array_to_string(w[:k], ' ') AS part, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
left_cut AS MATERIALIZED (SELECT c.*, f.n AS l FROM cut c JOIN f ON f.lang = c.lang AND f.gram = c.part),
cuts AS (SELECT c.*, f.n AS r, CAST(a AS HUGEINT) * {phrases.SCALE} // (l + f.n) AS score FROM left_cut c JOIN f ON f.lang = c.lang AND f.gram = c.rest),
scored AS MATERIALIZED (SELECT lang, phrase, size, w, a, arg_min(l, score * 10 + k) AS l, arg_min(r, score * 10 + k) AS r, CAST(min(score) AS BIGINT) AS score
  FROM cuts GROUP BY lang, phrase, size, w, a),
inner_parts AS (SELECT lang, array_to_string(w[i:i + part - 1], ' ') AS phrase, a FROM
  (SELECT *, unnest(range(1, size - part + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS part FROM scored))),
around AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * {phrases.COVERED}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
heavy AS (SELECT lang, phrase AS gram, array_to_string(w[:3], ' ') AS head, array_to_string(w[2:], ' ') AS tail, a AS n FROM candidates WHERE size = {phrases.WORDS}),
follows AS MATERIALIZED (SELECT x.lang, x.gram AS before, y.gram FROM heavy x JOIN heavy y ON x.lang = y.lang AND x.tail = y.head AND x.n = y.n
  JOIN f ON f.lang = x.lang AND f.gram = x.tail AND f.n = x.n),
walk(lang, gram, path, path_at) AS (SELECT lang, gram, gram, 0 FROM heavy ANTI JOIN follows USING (lang, gram)
  UNION ALL SELECT w.lang, s.gram, w.path, w.path_at + 1 FROM walk w JOIN follows s ON s.lang = w.lang AND s.before = w.gram),
long AS (SELECT lang, path, max(path_at) + {phrases.WORDS} AS path_words FROM walk GROUP BY ALL)
SELECT r.lang, r.rank, r.phrase, r.a, l, r, t.n, score, w.path, CAST(w.path_at AS BIGINT) AS path_at, CAST(path_words AS BIGINT) AS path_words
FROM ranked r JOIN totals t ON t.lang = r.lang LEFT JOIN walk w ON w.lang = r.lang AND w.gram = r.phrase LEFT JOIN long ON long.lang = w.lang AND long.path = w.path
WHERE r.rank <= {top}"""
