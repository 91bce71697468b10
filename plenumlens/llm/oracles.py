"""SQL that the queries must agree with, for DuckDB over the same tables."""

from __future__ import annotations

from plenumlens.llm import leaks, licenses, line_dedup, mixing
from plenumlens.llm.jaccard import PERCENT, SHINGLE

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontamination(span: int = leaks.SPAN_WORDS) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
it AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), {span}) AS n, array_to_string(ws[k:k + least(len(ws), {span}) - 1], ' ') AS win
  FROM it, unnest(range(1, len(ws) - least(len(ws), {span}) + 2)) AS r(k) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS r(i)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


def license_scan() -> str:
    quoted = [(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES)]
    rows = ", ".join(f"({i}, '{name}', '{text}')" for i, name, text in quoted)
    split = rf"regexp_extract_all({_FOLD}, '[a-z0-9]+')"
    cut = f"array_to_string(ws[i + 1:i + {SHINGLE}], ' ')"
    phrases = ", ".join(f"('{name}', '{phrase}')" for name, some in licenses.TELLING.items() for phrase in some)
    return f"""
WITH notices AS (SELECT id, license, {split} AS ws FROM (VALUES {rows}) AS v(id, license, text)),
t AS (SELECT id, license, ws, greatest({licenses.LEAST_STEP}, 2 ** ceil(log2(len(ws))))::BIGINT AS step FROM notices),
wanted AS (SELECT DISTINCT id, license, step, {cut} AS sh FROM t, unnest(range(0, len(ws) - {SHINGLE - 1})) AS r(i)),
sizes AS (SELECT id, count(*) AS m FROM wanted GROUP BY id),
telling AS (SELECT id, phrase, sh FROM wanted JOIN (VALUES {phrases}) AS v(license, phrase) USING (license)
  WHERE contains(' ' || sh || ' ', ' ' || phrase || ' ')),
needed AS (SELECT id, count(DISTINCT phrase) AS k FROM telling GROUP BY id),
d AS (SELECT doc_id, {split} AS ws FROM documents),
held AS (SELECT doc_id, i, {cut} AS sh FROM d, unnest(range(0, len(ws) - {SHINGLE - 1})) AS r(i)),
hits AS (SELECT doc_id, i, id, license, step, sh FROM held JOIN wanted USING (sh)),
windows AS (SELECT doc_id, id, license, sh, i // step - back AS win FROM hits, (VALUES (0), (1)) AS b(back)
  WHERE i // step >= back AND i + {SHINGLE} <= (i // step - back + 2) * step),
matched AS (SELECT doc_id, id, license, win, count(DISTINCT sh) / m AS share, count(DISTINCT phrase) AS told
  FROM windows JOIN sizes USING (id) LEFT JOIN telling USING (id, sh) GROUP BY doc_id, id, license, win, m),
found AS (SELECT doc_id, max(share) AS best, list_sort(list_distinct(list(license))) AS names
  FROM matched LEFT JOIN needed USING (id) WHERE share >= {licenses.CONTAINED} AND told = coalesce(k, 0) GROUP BY doc_id)
SELECT doc_id, coalesce(len(names), 0) AS n_licenses, coalesce(array_to_string(names, ','), '') AS licenses,
  coalesce(best, 0)::DOUBLE AS best FROM d LEFT JOIN found USING (doc_id)"""


def jaccard() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_FOLD)} AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS sh FROM d,
  unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, least(len(ws), 1)) + 1)) AS r(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN sizes USING (doc_id)
  JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""


def line_dedup_sql() -> str:
    least = line_dedup.MIN_WORDS
    return rf"""
WITH l0 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS no
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
l AS (SELECT doc_id, no, line, regexp_extract_all({_FOLD.replace('text', 'line')}, '[^\x20\x09-\x0D]+') AS ws FROM l0),
n AS (SELECT *, array_to_string(ws, ' ') AS norm FROM l),
d AS (SELECT norm, any_value(ws) AS ws, min((doc_id, no)) AS place FROM n WHERE len(ws) > 0 GROUP BY norm),
v AS (SELECT norm, place, i, CASE WHEN i = 0 THEN norm ELSE array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') END AS var
  FROM d, unnest(range(0, len(ws) + 1)) AS r(i) WHERE len(ws) >= {least}),
m AS (SELECT norm, place, i, min(place) OVER (PARTITION BY var, i) AS same,
  min(place) FILTER (i = 0) OVER (PARTITION BY var) AS whole, min(place) FILTER (i > 0) OVER (PARTITION BY var) AS short FROM v),
near AS (SELECT DISTINCT norm FROM m WHERE CASE WHEN i > 0 THEN coalesce(same < place, false) OR coalesce(whole < place, false)
  ELSE coalesce(short < place, false) END),
s AS (SELECT doc_id, no, line, len(n.ws) > 0 AND (near.norm IS NOT NULL OR (doc_id, no) <> place) AS gone
  FROM n LEFT JOIN d USING (norm) LEFT JOIN near USING (norm)),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, octet_length(encode(kept)) AS kept_bytes, sha256(kept) AS kept_sha256 FROM k"""


def _apportion(source: str, group: str, votes: str, order: str) -> str:
    """Parties of ``source`` with ``seats``, and their quota by highest quotients."""
    return f"""(WITH a AS (SELECT *, (sum({votes}) OVER (PARTITION BY {group}))::DOUBLE AS v_all, count(*) OVER (PARTITION BY {group}) AS v_n FROM {source}),
  b AS (SELECT *, coalesce(ceil(v_n * ({votes} / v_all)), 0)::BIGINT + 2 AS margin FROM a),
  c AS (SELECT *, coalesce(greatest(floor(seats * ({votes} / v_all))::BIGINT - margin, 0), 0) AS base FROM b),
  e AS (SELECT *, seats - sum(base) OVER (PARTITION BY {group}) AS free FROM c),
  q AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {votes} / (2 * (base + k) + 1)::DOUBLE DESC, {order}, k) AS r
    FROM e, unnest(range(0, 2 * margin + 2)) AS t(k))
  SELECT {group}, {order}, base + count(*) FILTER (r <= free AND {votes} > 0) AS quota FROM q GROUP BY {group}, {order}, base)"""


def mixing_sql(block: int = mixing.BLOCK, repeats: int = mixing.REPEATS, shard_docs: int = mixing.SHARD_DOCS, seed: int = mixing.SEED) -> str:
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)
    before = "OVER (ORDER BY per, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    digits = "('0x' || {}[1:12])::BIGINT"
    within = "greatest(least(last, {1}) - greatest(last - size, {0}), 0)"
    return f"""
WITH s AS (SELECT doc_id, source, len({_SPACED.format("coalesce(text, '')")}) AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s GROUP BY source),
w AS (SELECT *, [{weights}][(place - 1) % {len(mixing.WEIGHTS)} + 1] AS w, source_size * {repeats} AS lim FROM src),
p AS (SELECT *, lim / w AS per FROM w),
f AS (SELECT *, per < (sum(source_size) OVER () - coalesce(sum(lim) {before}, 0)) / (sum(w) OVER () - coalesce(sum(w) {before}, 0)) AS capped FROM p),
t AS (SELECT *, CASE WHEN capped THEN lim::DOUBLE ELSE (sum(source_size) OVER () - sum(CASE WHEN capped THEN lim ELSE 0 END) OVER ())
  / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () * w END AS target,
  floor(sum(source_size) OVER () / {float(block)} + 0.5)::BIGINT AS seats, 0 AS everyone, ceil(docs / {float(shard_docs)})::BIGINT AS shards FROM f),
q AS {_apportion('t', 'everyone', 'target', 'place')},
ps AS (SELECT s.*, t.source_size, t.target, t.place, q.quota AS seats, {digits.format('s.h')} % t.shards AS shard
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source JOIN q ON q.place = t.place),
sh AS (SELECT place, shard, sum(size)::BIGINT AS tokens, any_value(seats) AS seats FROM ps GROUP BY place, shard),
sq AS {_apportion('sh', 'place', 'tokens', 'shard')},
sb AS (SELECT place, shard, ceil(tokens / {float(block)})::BIGINT AS blocks, quota FROM sh JOIN sq USING (place, shard)),
sc AS (SELECT place, shard, blocks, least(quota, blocks * {repeats}) AS take, {digits.format(f"md5(concat_ws(':', '{seed}', place, shard))")} AS at0 FROM sb),
sd AS (SELECT place, shard, blocks, take // greatest(blocks, 1) AS passes, take % greatest(blocks, 1) AS more, at0 % greatest(blocks, 1) AS begins FROM sc),
laid AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS last FROM ps)
SELECT doc_id, size, source_size, target, (passes * size + {within.format(f'begins * {block}', f'(begins + more) * {block}')}
  + {within.format('0', f'(begins + more - blocks) * {block}')})::BIGINT AS taken FROM laid JOIN sd USING (place, shard)"""


def merkle_sql() -> str:
    """Levels of all trees as lists, proofs as the other nodes of a leaf's pairs, checksums bit by bit."""
    part = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = "sha256({} || {} || {} || {} || {})"
    before, after = [part.format(c) for c in ("doc_id", "source", "lang")], part.format("text")
    crc = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
           "lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))))")
    levels = ("SELECT tree, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) AS nodes, "
              "level + 1 AS level FROM {} WHERE len(nodes) > 1")
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, lang, {leaf.format(*before, part.format('n_chars'), after)} AS leaf, CASE WHEN {crc} % 7 = 0
  THEN {leaf.format(*before, part.format('(n_chars + 1)'), after)} END AS shown FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY lang, doc_id, leaf) AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree FROM l),
g AS (SELECT tree, list(leaf ORDER BY idx) AS nodes, 0 AS level FROM o GROUP BY tree UNION ALL {levels.format('g')}),
s AS (SELECT tree, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM g WHERE len(nodes) = 1),
t AS (SELECT '' AS tree, list(subroot ORDER BY place) AS nodes, 0 AS level FROM s UNION ALL {levels.format('t')}),
other AS (SELECT nodes[xor(pos, 1) + 1] AS sib, pos % 2 AS side, doc, step FROM (
  SELECT g.nodes, idx // (2 ** level)::BIGINT AS pos, o.rid AS doc, level AS step FROM o JOIN g USING (tree) WHERE len(g.nodes) > 1
  UNION ALL SELECT t.nodes, place // (2 ** t.level)::BIGINT, o.rid, height + t.level FROM o JOIN s USING (tree), t WHERE len(t.nodes) > 1)),
p AS (SELECT doc, list(struct_pack(sib := coalesce(sib, ''), side := side) ORDER BY step) AS steps FROM other GROUP BY doc),
f AS (SELECT o.*, coalesce(steps, []) AS steps FROM o LEFT JOIN p ON p.doc = o.rid),
folded AS (SELECT f.*, list_reduce(list_concat([struct_pack(sib := coalesce(shown, leaf), side := 0)], steps),
  lambda a, x: struct_pack(sib := sha256(CASE WHEN x.side = 1 THEN x.sib || a.sib ELSE a.sib || x.sib END), side := 0)).sib AS folded_root FROM f)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(array_to_string(list_transform(steps, lambda x: x.sib), '')) AS proof_sha256,
  folded_root, folded_root = nodes[1] AS verified FROM folded JOIN s USING (tree), t WHERE len(t.nodes) = 1"""


ORACLES: dict[str, str] = {
    "op4_decontamination": decontamination(),
    "op5_licenses": license_scan(),
    "op6_jaccard_join": jaccard(),
    "op7_line_dedup": line_dedup_sql(),
    "op8_mixing": mixing_sql(),
    "op11_merkle": merkle_sql(),
}
