"""SQL for DuckDB that gives the rows of the operators that SQL can express."""

from __future__ import annotations

from . import licences, resample, sharding
from .jaccard import SIMILARITY, WORDS
from .lattice import COSINE

SPACE = r"[\x20\x09-\x0D]+"


def sharding_sql(shards: list[str], size: int) -> str:
    slots = ",".join(map(str, sharding.fill_table(shards, size)))
    return f"""
WITH t AS (SELECT [{slots}] AS shards),
p AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size} AS slot FROM documents)
SELECT doc_id, slot::INTEGER AS slot, shards[slot + 1]::INTEGER AS shard, 'shard-' || lpad(shards[slot + 1]::VARCHAR, 3, '0') AS shard_name FROM p, t
"""


def reached(links: str, rows: str, id_col: str) -> str:
    """The verdicts that follow from links (a, b), both ways, over all rows (id)."""
    return f"""
r AS (SELECT id, id AS root FROM {rows} UNION SELECT {links}.b, r.root FROM r JOIN {links} ON r.id = {links}.a),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n_links FROM {links} GROUP BY a)
SELECT c.id AS {id_col}, coalesce(n_links, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n USING (id)
"""


def jaccard_sql() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g FROM w WHERE len(w) > 0),
k AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b WHERE common >= {SIMILARITY} * (x.n + y.n - common)),
d AS (SELECT doc_id AS id FROM documents),
{reached('l', 'd', 'doc_id')}"""


def lattice_sql() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
u AS (SELECT id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
l AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id WHERE list_dot_product(a.e, b.e) >= {COSINE}),
d AS (SELECT vec_id AS id FROM embeddings),
{reached('l', 'd', 'vec_id')}"""


def rules_sql(limit: float = 0.5) -> str:
    rules = {
        "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words",
        "word_length": "word_chars < 3 * greatest(n_words, 1) OR word_chars > 12 * greatest(n_words, 1)", "dup_lines": "n_dup_lines >= 10",
    }
    sums = ", ".join(f"sum(({c})::INT) AS f_{r}" for r, c in rules.items())
    facts = ", ".join(f"sum(f_{r}) / sum(n_docs) AS m_{r}, sum(f_{r} * f_{r} / n_docs) AS s_{r}" for r in rules)
    strength = lambda r: (
        f"CASE WHEN hosts > 1 AND m_{r} > 0 AND m_{r} < 1 AND s_{r} - docs * m_{r} * m_{r} - (hosts - 1) * m_{r} * (1 - m_{r}) > 0 "
        f"THEN least(greatest(docs, 1), greatest(m_{r} * (1 - m_{r}) / ((s_{r} - docs * m_{r} * m_{r} - (hosts - 1) * m_{r} * (1 - m_{r})) / greatest(docs - hosts, 1)) - 1, 1)) ELSE greatest(docs, 1) END"
    )
    rates = ", ".join(f"(f_{r} + ({strength(r)}) * m_{r}) / (n_docs + ({strength(r)})) AS rate_{r}" for r in rules)
    kept = " AND ".join(f"NOT (rate_{r} > {limit})" for r in rules)
    return f"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
m AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
q AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM m, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t),
y AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM x WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN y USING (doc_id) LEFT JOIN q USING (doc_id)),
h AS (SELECT host, count(*) AS n_docs, {sums} FROM c GROUP BY host),
f AS (SELECT sum(n_docs) AS docs, count(*) AS hosts, {facts} FROM h),
r AS (SELECT host, {rates} FROM h, f), k AS (SELECT *, {kept} AS host_kept FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {rules['base']} AS base_failed, {', '.join(f'round(rate_{r}, 6) AS rate_{r}' for r in rules)}, host_kept,
 NOT ({rules['base']}) AND host_kept AS kept FROM c JOIN k ON c.host IS NOT DISTINCT FROM k.host"""


def licences_sql(least: float = 0.7) -> str:
    postings = ", ".join(f"({t}, {at}, '{w}', {key})" for t, at, w, key in licences.index(licences.TEMPLATES))
    names = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()})" for i, t in enumerate(licences.TEMPLATES))
    return f"""
WITH p(template, "at", word, need) AS (VALUES {postings}), names(template, label, base) AS (VALUES {names}),
t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM t), hit AS (SELECT * FROM x WHERE word IN (SELECT word FROM p)),
idf AS (SELECT word, 1 + ln(((SELECT count(*) FROM t) + 1) / (count(DISTINCT doc_id) + 1)) AS idf FROM (SELECT DISTINCT word FROM p) LEFT JOIN hit USING (word) GROUP BY word),
ready AS (SELECT template, "at", word, idf, need, sum(idf) OVER (PARTITION BY template) AS whole, sum(need) OVER (PARTITION BY template) AS needed FROM p JOIN idf USING (word)),
met AS (SELECT doc_id, template, pos - "at" AS place, sum(idf) / any_value(whole) AS score FROM hit JOIN ready USING (word) GROUP BY 1, 2, 3 HAVING sum(need) = any_value(needed) AND round(sum(idf) / any_value(whole), 9) >= {least}),
m AS (SELECT * FROM met JOIN names USING (template)),
d AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
 array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(least(score, 1)) AS score FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score FROM t LEFT JOIN d USING (doc_id)"""


def resampling_sql() -> str:
    """crc32 byte by byte over each different word, by a table made from its polynomial."""
    size = resample.BUCKETS
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"unnest(regexp_extract_all(coalesce({lower}, ''), '{word}'))"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: {step})) AS t),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, {words} AS w FROM documents) GROUP BY 1, 2),
bw AS (SELECT w, count(*) AS n FROM (SELECT {words} AS w FROM benchmark) GROUP BY 1),
u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {size} AS bucket FROM u, t),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN b USING (w) GROUP BY 1), q AS (SELECT bucket, sum(n) AS t FROM bw JOIN b USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {size})::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM q), 0) + {size})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN q USING (bucket)),
f AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
e AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{resample.SEED}:' || d.doc_id), 1, 8))::BIGINT AS h FROM documents d LEFT JOIN f USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score FROM e),
y AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= {resample.LEAST_WORDS})
SELECT x.doc_id, n_features, weight, score, y.rank FROM x LEFT JOIN y ON x.doc_id = y.doc_id AND y.rank <= {resample.PERCENT} * (SELECT count(*) FROM y) // 100
"""
