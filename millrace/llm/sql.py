"""What the queries must give, in SQL: plain definitions without sketches, tiles or indexes.

op3, op8 and op9 rest on tests of randomness, merges and hashes that SQL doesn't have;
their queries are compared with brute force in tests/llm.
"""

from __future__ import annotations

from millrace.llm.license_scan import NAMED, TEMPLATES, TERM

#: Words as millrace.llm.text has them.
WORDS = r"""
    words AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w
        FROM documents
    )"""

LM_SCORING = f"""
WITH {WORDS},
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
    SELECT doc_id, i, n, array_to_string(list_slice(w, i - n + 1, i), ' ') AS g
    FROM places, (SELECT unnest([1, 2, 3]) AS n) WHERE i >= n
),
own AS (SELECT doc_id, n, g, count(*) AS c FROM grams GROUP BY ALL),
total AS (SELECT n, g, sum(c) AS c FROM own GROUP BY ALL),
rest AS (SELECT o.doc_id, o.n, o.g, t.c - o.c AS c FROM own o JOIN total t USING (n, g)),
counts AS (
    SELECT s.doc_id, s.i, max(r.c) FILTER (s.n = 1) AS c1, max(r.c) FILTER (s.n = 2) AS c2, max(r.c) FILTER (s.n = 3) AS c3
    FROM grams s JOIN rest r USING (doc_id, n, g) GROUP BY ALL
),
sizes AS (SELECT doc_id, len(w) AS n_words, (SELECT sum(len(w)) FROM words) - len(w) AS others FROM words),
levels AS (
    SELECT c.doc_id, c.i, c.c1, c.c2, c.c3, p.c1 AS p1, p.c2 AS p2, z.others, least(c.i, 3) AS most,
           CASE WHEN c.c3 > 0 THEN 3 WHEN c.c2 > 0 THEN 2 WHEN c.c1 > 0 THEN 1 ELSE 0 END AS level
    FROM counts c JOIN sizes z USING (doc_id) LEFT JOIN counts p ON p.doc_id = c.doc_id AND p.i = c.i - 1
),
scores AS (
    SELECT doc_id, level, (most - level) * ln(0.4) + CASE level
        WHEN 3 THEN ln(c3) - ln(p2) WHEN 2 THEN ln(c2) - ln(p1) WHEN 1 THEN ln(c1) - ln(others) ELSE -ln(greatest(others, 1)) END AS s
    FROM levels
)
SELECT z.doc_id, z.n_words::BIGINT AS n_words, count(*) FILTER (level = 0)::BIGINT AS n_unseen, count(*) FILTER (level = 1)::BIGINT AS n_unigram,
       count(*) FILTER (level = 2)::BIGINT AS n_bigram, count(*) FILTER (level = 3)::BIGINT AS n_trigram, round(coalesce(sum(s), 0), 6) AS log_score
FROM sizes z LEFT JOIN scores USING (doc_id) GROUP BY z.doc_id, z.n_words
"""

CHAT = """
WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
places AS (SELECT pair_id, i, max(CASE WHEN side = 0 THEN role || chr(1) || text END) AS a, max(CASE WHEN side = 1 THEN role || chr(1) || text END) AS b FROM n GROUP BY ALL),
common AS (SELECT pair_id, coalesce(min(i) FILTER (a IS DISTINCT FROM b), max(i) + 1) - 1 AS p FROM places GROUP BY pair_id),
w AS (
    SELECT n.*, p, '<|im_start|>' || replace(role, '<|im_', '<|_im_') || chr(10) || replace(text, '<|im_', '<|_im_') || '<|im_end|>' || chr(10) AS s,
           length(replace(role, '<|im_', '<|_im_')) AS r
    FROM n JOIN common USING (pair_id)
),
m AS (SELECT *, sum(length(s)) OVER (PARTITION BY pair_id, side, i > p ORDER BY i)::BIGINT AS e FROM w)
SELECT pair_id, p AS n_prompt_turns,
       coalesce(string_agg(s, '' ORDER BY i) FILTER (i <= p AND side = 0), '') AS prompt,
       coalesce(string_agg(s, '' ORDER BY i) FILTER (i > p AND side = 0), '') AS chosen,
       coalesce(string_agg((e - length(s) + 13 + r)::VARCHAR || ':' || e, ',' ORDER BY i) FILTER (i > p AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(s, '' ORDER BY i) FILTER (i > p AND side = 1), '') AS rejected,
       coalesce(string_agg((e - length(s) + 13 + r)::VARCHAR || ':' || e, ',' ORDER BY i) FILTER (i > p AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair_id, p
"""

_REACH = """
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE {WORDS},
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
),
nodes AS (SELECT doc_id AS id, len(s) AS n FROM sets),
elements AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM elements a JOIN elements b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
{_REACH}
SELECT n.id AS doc_id, n.n::BIGINT AS n_shingles, min(root) AS component_id, min(root) = n.id AS kept FROM nodes n JOIN reach USING (id) GROUP BY n.id, n.n
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, h, from_hex(sha1(h))::BIT::VARCHAR AS bits FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i * 5 + 1, 1)::BIGINT + 8 * substr(bits, i * 5 + 2, 1)::BIGINT
           + 4 * substr(bits, i * 5 + 3, 1)::BIGINT + 2 * substr(bits, i * 5 + 4, 1)::BIGINT + substr(bits, i * 5 + 5, 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (h)
"""

NEAR_VECTORS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (
    SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM nodes
    WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.label = b.label AND a.id < b.id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
{_REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM both_ways WHERE a = n.id) AS n_links, min(root) AS component_id, min(root) = n.id AS kept FROM nodes n JOIN reach USING (id) GROUP BY n.id
"""

#: Items of five words or more, as the benchmark's are.
DECONTAMINATION = f"""
WITH {WORDS},
items AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM benchmark),
b AS (SELECT item_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS x FROM items),
d AS (SELECT doc_id, len(w) AS m, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS x FROM words),
hits AS (SELECT DISTINCT doc_id, item_id, n, m, i FROM d JOIN b USING (x)),
windows AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(greatest(1, i - n + 5), least(i, m - n + 1) + 1)) AS start FROM hits),
own AS (SELECT w.doc_id, w.item_id, w.n, w.start, d.x, count(*) AS c FROM windows w JOIN d ON d.doc_id = w.doc_id AND d.i BETWEEN w.start AND w.start + w.n - 5 GROUP BY ALL),
bag AS (SELECT item_id, x, count(*) AS c FROM b GROUP BY ALL),
scores AS (SELECT doc_id, item_id, own.n, start, sum(least(own.c, bag.c))::BIGINT AS common FROM own JOIN bag USING (item_id, x) GROUP BY ALL),
ranked AS (SELECT *, common / (2 * (n - 4) - common) AS similarity FROM scores)
SELECT doc_id, item_id, arg_min(start, struct_pack(a := -similarity, b := start)) - 1 AS first_word, n::BIGINT AS n_words, max(similarity) AS similarity
FROM ranked GROUP BY doc_id, item_id, n HAVING max(similarity) >= 0.8
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({_quoted(f'{name}#{k}')}, {_quoted(name)}, {_quoted(x)})" for name, texts in TEMPLATES.items() for k, x in enumerate(texts))

LICENCES = f"""
WITH files AS (SELECT '/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id AS path, doc_id, coalesce(text, '') AS text FROM documents),
templates AS (SELECT * FROM (VALUES {_TEMPLATES}) AS v(template, licence, text)),
tt AS (SELECT template, licence, unnest(regexp_extract_all(lower(text), {_quoted(TERM)})) AS term FROM templates),
tf AS (SELECT template, licence, term, count(*) AS n FROM tt GROUP BY ALL),
seen AS (SELECT DISTINCT path, term FROM (SELECT path, unnest(regexp_extract_all(lower(text), {_quoted(TERM)})) AS term FROM files) WHERE term IN (SELECT term FROM tf)),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM files)) / (1 + (SELECT count(*) FROM seen s WHERE s.term = t.term))) + 1 AS w FROM (SELECT DISTINCT term FROM tf) t),
unit AS (SELECT template, licence, term, n * w / sqrt(sum((n * w) ** 2) OVER (PARTITION BY template)) AS x FROM tf JOIN idf USING (term)),
lines AS (SELECT path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT path, string_split(text, chr(10)) AS l FROM files)),
lt AS (SELECT path, line, len(regexp_extract_all(lower(text), {_quoted(TERM)})) AS n_words, unnest(regexp_extract_all(lower(text), {_quoted(TERM)})) AS term FROM lines),
lf AS (SELECT path, line, n_words, term, count(*) * coalesce(w, ln(1 + (SELECT count(*) FROM files)) + 1) AS y FROM lt LEFT JOIN idf USING (term) GROUP BY path, line, n_words, term, w),
size AS (SELECT path, line, n_words, sqrt(sum(y * y)) AS length FROM lf GROUP BY ALL),
dots AS (SELECT path, line, template, licence, sum(x * y) AS dot FROM lf JOIN unit USING (term) GROUP BY ALL),
scored AS (SELECT path, line, n_words, licence, round(dot / length, 9) AS score FROM dots JOIN size USING (path, line)),
best AS (SELECT path, line, n_words, max(licence) AS licence, score FROM (SELECT *, max(score) OVER (PARTITION BY path, line) AS top FROM scored WHERE score >= 0.75) WHERE score = top GROUP BY ALL),
own AS (SELECT path, arg_min(licence, struct_pack(a := -score, b := licence)) AS licence, max(score) AS score, sum(n_words) AS n FROM best GROUP BY path),
words AS (SELECT path, len(regexp_extract_all(lower(text), {_quoted(TERM)})) AS n_terms FROM files),
stated AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence, score FROM own JOIN words USING (path) WHERE n >= 0.5 * n_terms OR regexp_matches(regexp_extract(path, '[^/]*$'), {_quoted(NAMED)})),
given AS (SELECT dir, arg_min(licence, struct_pack(a := -score, b := licence)) AS licence, max(score) AS score FROM stated GROUP BY dir),
up AS (
    SELECT f.path, arg_max(g.dir, length(g.dir)) AS origin FROM files f JOIN given g ON starts_with(f.path, g.dir || '/') GROUP BY f.path
)
SELECT f.doc_id, f.path, coalesce(o.licence, g.licence) AS licence, round(coalesce(o.score, g.score), 6) AS score,
       CASE WHEN o.path IS NOT NULL THEN 'header' WHEN g.dir IS NOT NULL THEN 'inherited' END AS how, CASE WHEN o.path IS NULL THEN u.origin END AS origin
FROM files f LEFT JOIN own o USING (path) LEFT JOIN up u USING (path) LEFT JOIN given g ON g.dir = u.origin
"""

ORACLES = {
    "op1_lm_scoring": LM_SCORING,
    "op2_chat_formatting": CHAT,
    "op4_minhash_near_dedup": NEAR_DUPLICATES,
    "op5_warc": WARC,
    "op6_embedding_near_dedup": NEAR_VECTORS,
    "op7_benchmark_decontamination": DECONTAMINATION,
    "op10_license_scans": LICENCES,
}
