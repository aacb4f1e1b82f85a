"""DuckDB SQL for the rows of the registered queries that SQL can express."""

OP2 = r"""
WITH parts AS (SELECT doc_id, rowid AS r, string_split(coalesce(text, ''), chr(10)) AS p FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)),
lines AS (SELECT doc_id, r, unnest(p) AS line, unnest(range(len(p))) AS pos FROM parts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
gone AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::bigint AS n_lines, count(*) FILTER (k IN (FROM gone))::bigint AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (FROM gone)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id, r
"""

OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 0 GROUP BY h)
SELECT page_id, strlen(p.h)::bigint AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * (instr('0123456789abcdef', substr(s, 1 + (5 * j) // 4, 1)) - 1) + instr('0123456789abcdef', substr(s, 2 + (5 * j) // 4, 1)) - 1) >> (3 - (5 * j) % 4)) & 31)::int, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN g ON p.h = g.h
"""

OP9 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP10 = rf"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_FOLDED} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS pos FROM i)),
grams AS (SELECT doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
hits AS (SELECT doc_id, pos, n, item_id FROM grams JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, pos, hash(list_slice(w, pos, pos + 49)) AS h, md5(array_to_string(list_slice(w, pos, pos + 49), ' ')) AS m FROM (SELECT *, unnest(range(1, len(w) - 48)) AS pos FROM d)),
least AS (SELECT h, m, min(doc_id) AS first FROM windows GROUP BY h, m),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS p FROM windows JOIN least USING (h, m) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 3), ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 2))) AS pos FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, min(other)::bigint AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""

SQL = {"op7_substring_dedup": OP7, "op8_jaccard_join": OP8, "op2_line_dedup": OP2, "op5_warc": OP5, "op9_topk": OP9, "op10_decontaminate": OP10}

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
r AS (SELECT doc_id, t, n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::ubigint) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1))::bigint AS a, greatest(h[1] % (n + 1), h[2] % (n + 1))::bigint AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

#: Levels of the trees that the SQL goes through: 16 ** 6 documents of a source, 16 ** 5 sources.
_LEVELS, _TOP_LEVELS = 6, 5


def _trees(name: str, levels: int) -> str:
    """CTEs of the inner nodes of name0 (tree, pos, d), level by level."""
    one = "(SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM {0})"
    return ",\n".join(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, list(d ORDER BY pos) AS kids, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {one.format(name + str(k))} WHERE nodes > 1 GROUP BY tree, pos // 16)" for k in range(levels))


def _walk(name: str, trees: str, start: str, levels: int) -> str:
    """CTEs that follow (r, tree, pos, f, proof) to the root."""
    kid = "list_transform(range(len(kids)), lambda i: CASE WHEN i = w.pos % 16 THEN {0} ELSE kids[i + 1] END)"
    step = lambda before, k: f"SELECT r, w.tree, w.pos // 16 AS pos, CASE WHEN kids IS NULL THEN f ELSE sha256(array_to_string({kid.format('f')}, '')) END AS f, CASE WHEN kids IS NULL THEN proof ELSE proof || array_to_string({kid.format(chr(39) * 2)}, '') END AS proof FROM {before} w LEFT JOIN {trees}{k + 1} t ON w.tree IS NOT DISTINCT FROM t.tree AND w.pos // 16 = t.pos"
    return ",\n".join(f"{name}{k + 1} AS ({step(start if k == 0 else name + str(k), k)})" for k in range(levels))


def _last(name: str, levels: int) -> str:
    """tree and digest of the last node of each tree."""
    return " UNION ALL ".join(f"SELECT tree, d FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM {name}{k}) WHERE nodes = 1" for k in range(levels + 1))




def _leaf(text: str) -> str:
    field = lambda c, v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::varchar)::varchar || ':' || {v}::varchar END"
    return "sha256(" + " || ".join(field(c, c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + field("text", text) + ")"


_CRC = "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::ubigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: i::ubigint)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::ubigint))), 4294967295::ubigint)"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS tree, {_leaf('text')} AS d,
  {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered, coalesce(doc_id::varchar, '') AS s FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, CASE WHEN {_CRC} % 5 = 0 THEN lowered ELSE d END AS f FROM d),
s0 AS (SELECT tree, pos, d FROM leaves),
{_trees('s', _LEVELS)},
heads AS MATERIALIZED ({_last('s', _LEVELS)}),
t0 AS (SELECT NULL::varchar AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, d, tree AS source FROM heads),
{_trees('t', _TOP_LEVELS)},
top AS ({_last('t', _TOP_LEVELS)}),
{_walk('w', 's', "(SELECT r, tree, pos, f, '' AS proof FROM leaves)", _LEVELS)},
over AS (SELECT w.r, NULL::varchar AS tree, t0.pos, w.f, w.proof FROM w{_LEVELS} w JOIN t0 ON w.tree IS NOT DISTINCT FROM t0.source),
{_walk('v', 't', 'over', _TOP_LEVELS)}
SELECT l.doc_id, l.d AS leaf, h.d AS subroot, top.d AS root, sha256(v.proof) AS proof_sha256, v.f AS folded_root, v.f = top.d AS verified
FROM leaves l JOIN v{_TOP_LEVELS} v USING (r) JOIN heads h ON l.tree IS NOT DISTINCT FROM h.tree CROSS JOIN top
"""

OP12 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM (SELECT unnest(range(2)) AS i)),
t AS (SELECT *, sha256(text) AS h, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|><|im_end|>') + 2 AS chars FROM c)
SELECT conv_id, count(*)::bigint AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, h)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, h) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::bigint AS formatted_chars
FROM t GROUP BY conv_id
"""

SQL |= {"op11_merkle": OP11, "op12_reply_trees": OP12, "op13_fill_middle": OP13}
