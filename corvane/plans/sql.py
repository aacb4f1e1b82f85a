"""DuckDB SQL of the registered queries, put together from common table expressions."""

from __future__ import annotations

from corvane.functions.text import CONCEPT_STOPWORDS, KEYWORD_STOPWORDS
from corvane.operators.agent import BAD_VERDICT, NO_CITATION, UNKNOWN_SOURCE
from corvane.operators.evaluation import STRATEGIES
from corvane.operators.models import APPROVAL
from corvane.plans.runs import RUNS


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def keywords(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({c}), '[a-z0-9\-]+'), lambda t: length(t) > 2 AND NOT list_contains({_list(KEYWORD_STOPWORDS)}, t))"


def chunks(size: int = 800, overlap: int = 120) -> str:
    step = max(size - overlap, 1)
    return rf"""docs_w AS (SELECT doc_id::varchar AS source_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w, lang, source FROM documents),
chunks AS MATERIALIZED (SELECT source_id, i::bigint AS chunk_index, array_to_string(list_slice(w, i * {step} + 1, i * {step} + {size}), ' ') AS text
  FROM (SELECT source_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {size} THEN 1 ELSE ceil((len(w) - {size}) / {step}.0)::bigint + 1 END)) AS i FROM docs_w))"""


def _vectors(name: str, source: str, keys: str) -> str:
    digit = lambda k: f"(instr('0123456789abcdef', substr(md5(w), {k}, 1)) - 1)"
    return f"""{name}_counts AS (SELECT {keys}, (16 * {digit(31)} + {digit(32)}) % 64 AS b, count(*) AS n FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {source}) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS norm2 FROM (SELECT {keys}, list(coalesce(n, 0)::double ORDER BY r.b) AS v FROM (SELECT {keys} FROM {source}) CROSS JOIN (SELECT range AS b FROM range(64)) r LEFT JOIN {name}_counts USING ({keys}, b) GROUP BY {keys}))"""


SIM = "CASE WHEN q.norm2 * c.norm2 > 0 THEN list_dot_product(q.v, c.v) / sqrt(q.norm2 * c.norm2) ELSE 0 END"
VECTORS = ",\n".join([chunks(), "questions AS (SELECT item_id AS qid, text, text AS question FROM benchmark)", _vectors("cvec", "chunks", "source_id, chunk_index"), _vectors("qvec", "questions", "qid")])
POOL = f"""{VECTORS},
pool AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, source_id, chunk_index) AS rank FROM (SELECT qid, source_id, chunk_index, {SIM} AS sim FROM cvec c, qvec q)) WHERE rank <= 20)"""
QUESTION_TERMS = f"qterms AS (SELECT qid, term, count(*) AS qc FROM (SELECT qid, unnest({keywords('question')}) AS term FROM questions) GROUP BY ALL)"


def overlap(name: str, pool: str) -> str:
    return f"""{name}_had AS (SELECT source_id, chunk_index, term, count(*) AS cc FROM (SELECT source_id, chunk_index, unnest({keywords('text')}) AS term FROM chunks SEMI JOIN {pool} USING (source_id, chunk_index)) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT p.*, coalesce(coalesce(k.common, 0)::double / t.total::double, 0) AS kw FROM {pool} p LEFT JOIN (SELECT qid, sum(qc) AS total FROM qterms GROUP BY qid) t USING (qid)
  LEFT JOIN (SELECT qid, source_id, chunk_index, sum(least(qc, cc)) AS common FROM {pool} JOIN qterms USING (qid) JOIN {name}_had USING (source_id, chunk_index, term) GROUP BY ALL) k USING (qid, source_id, chunk_index))"""


def blended(w: float) -> str:
    return f"((1.0::double - {w}::double) * sim + {w}::double * {'kw' if w > 0 else '0::double'})"


SCORED = f"{POOL},\n{QUESTION_TERMS},\n{overlap('scored', 'pool')}"


def ranked(name: str, w: float, top: int) -> str:
    return f"{name} AS (SELECT qid, rank::bigint AS rank, source_id, chunk_index, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_id, chunk_index) AS rank FROM (SELECT qid, source_id, chunk_index, {blended(w)} AS score FROM scored)) WHERE rank <= {top})"


PAPERS = r"""papers AS (SELECT doc_id::varchar AS source_id, array_to_string(list_slice(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''), 1, 8), ' ') AS title, coalesce(text, '') AS abstract, lang AS category, source AS author FROM documents)"""
GRAMS = rf"""cwords AS (SELECT source_id, list_filter(regexp_extract_all(lower(title || ' ' || abstract), '[a-z][a-z0-9\-]{{2,}}'), lambda t: NOT list_contains({_list(CONCEPT_STOPWORDS)}, t)) AS w FROM papers),
gram_counts AS MATERIALIZED (SELECT source_id, term, count(*) AS c FROM (SELECT source_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM cwords) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, (SELECT count(*) FROM papers) AS n_docs FROM gram_counts GROUP BY term HAVING count(*) >= 2 AND count(*) <= (SELECT count(*) FROM papers) * 0.5::double)"""
CONCEPTS = f"""{PAPERS},
{GRAMS},
concepts AS MATERIALIZED (SELECT source_id, rank::bigint AS rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, term DESC) AS rank FROM
  (SELECT source_id, term, round(c / total::double * ln(n_docs / df::double), 12) AS score FROM gram_counts JOIN df USING (term) JOIN (SELECT source_id, sum(c) AS total FROM gram_counts GROUP BY 1) USING (source_id))) WHERE rank <= 12)"""
EDGES = f"""{CONCEPTS},
edges AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT source_id AS src, 'AUTHORED_BY' AS relation, 'author:' || author AS dst FROM papers WHERE author IS NOT NULL
  UNION ALL SELECT source_id, 'IN_CATEGORY', 'category:' || category FROM papers WHERE category IS NOT NULL UNION ALL SELECT source_id, 'MENTIONS', 'concept:' || term FROM concepts))"""


def related(name: str, seeds: str, limit: int) -> str:
    return f"""{name} AS (SELECT src, other, relatedness, rank::bigint AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY relatedness DESC, other) AS rank FROM (
  SELECT a.src, b.src AS other, round(sum(CASE a.relation WHEN 'MENTIONS' THEN 1.0::double WHEN 'AUTHORED_BY' THEN 0.8::double WHEN 'IN_CATEGORY' THEN 0.25::double ELSE 0.5::double END / ln(n + 1.5::double)), 6) AS relatedness
  FROM (SELECT * FROM edges SEMI JOIN {seeds} USING (src)) a JOIN (SELECT relation, dst, count(*) AS n FROM edges GROUP BY ALL HAVING count(*) > 1) USING (relation, dst) JOIN edges b USING (relation, dst) WHERE a.src <> b.src GROUP BY ALL)) WHERE rank <= {limit})"""


def starts(name: str, seeds: str) -> str:
    return f"{name} AS (SELECT qid, source_id AS src FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS place FROM (SELECT qid, source_id, min(rank) AS first FROM {seeds} GROUP BY ALL)) WHERE place <= 3)"


def expanded(name: str, w: float, g: float, top: int = 5) -> str:
    if g <= 0:
        return ranked(name, w, top)
    n = name
    return f"""{ranked(f'{n}_seeds', w, 20)},
{starts(f'{n}_starts', f'{n}_seeds')},
{related(f'{n}_related', f'{n}_starts', 3)},
{n}_fresh AS (SELECT *, coalesce(relatedness / nullif(max(relatedness) OVER (PARTITION BY qid), 0), 0) AS share FROM (SELECT qid, other AS source_id, max(relatedness) AS relatedness FROM {n}_starts JOIN {n}_related USING (src) GROUP BY ALL) ANTI JOIN {n}_seeds USING (qid, source_id)),
{n}_near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, source_id, chunk_index) AS place FROM (SELECT f.qid, c.source_id, c.chunk_index, f.share, {SIM} AS sim FROM {n}_fresh f JOIN cvec c USING (source_id) JOIN qvec q ON q.qid = f.qid)) WHERE place <= 20),
{overlap(f'{n}_kw', f'{n}_near')},
{n}_both AS (SELECT qid, source_id, chunk_index, score, 0 AS origin FROM {n}_seeds UNION ALL SELECT qid, source_id, chunk_index, {blended(w)} * ((1.0::double - {g}::double) + {g}::double * share), 1 FROM {n}_kw),
{n} AS (SELECT qid, rank::bigint AS rank, source_id, chunk_index, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, origin, source_id, chunk_index) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY qid, source_id, chunk_index ORDER BY score DESC, origin) AS nth FROM {n}_both) WHERE nth = 1) WHERE rank <= {top})"""


def normalise(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^a-z0-9\s]', ' ', 'g')"


def recall(name: str, retrieved: str, questions: str = "questions") -> str:
    return f"""{name} AS (SELECT q.qid, CASE WHEN len(expected) = 0 THEN 1.0::double ELSE len(list_filter(expected, lambda k: contains(coalesce(hay, ''), {normalise('k')})))::double / len(expected)::double END AS recall, coalesce(n_papers, 0)::bigint AS n_papers
  FROM (SELECT qid, list_slice(list_distinct_ordered, 1, 5) AS expected FROM (SELECT qid, list_filter({keywords('question')}, lambda x, i: list_position({keywords('question')}, x) = i) AS list_distinct_ordered FROM {questions})) q
  LEFT JOIN (SELECT qid, {normalise("string_agg(text, ' ' ORDER BY rank)")} AS hay, count(DISTINCT source_id) AS n_papers FROM {retrieved} JOIN chunks USING (source_id, chunk_index) GROUP BY qid) USING (qid))"""


def with_(*parts: str) -> str:
    *ctes, last = parts
    return "WITH " + ",\n".join(ctes) + "\n" + last


def _hybrid(w: float) -> str:
    return with_(SCORED, ranked("out", w, 5), "FROM out")


SWEEP = with_(
    SCORED,
    EDGES,
    *[part for s, w, g in STRATEGIES for part in (expanded(s, w, g), recall(f"{s}_recall", s))],
    "records AS (" + " UNION ALL ".join(f"SELECT '{s}' AS strategy, {k}::bigint AS ordinal, recall, n_papers FROM {s}_recall" for k, (s, _, _) in enumerate(STRATEGIES)) + ")",
    "summary AS (SELECT strategy, ordinal, ((20000 * sum(round(recall * 60)::bigint) + 60 * count(*)) // (120 * count(*)))::double / 10000 AS mean_recall, count(*) FILTER (recall = 1.0)::bigint AS perfect, ((200 * sum(n_papers) + count(*)) // (2 * count(*)))::double / 100 AS mean_papers FROM records GROUP BY ALL)",
    "FROM summary",
)
_ANSWERS = r"""answers AS (SELECT conv_id, turn, text || ' [arxiv:' || (conv_id % 7)::varchar || '] and [arxiv:' || (turn % 3)::varchar || ']' AS draft FROM conversations WHERE role = 'assistant')"""
_CITED = r"list_sort(list_distinct(regexp_extract_all(draft, '\[arxiv:([^\]]+)\]', 1)))"
_REPLIES = """replies AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '{"faithful": true, "issues": "", "sufficient_context": true}' WHEN 1 THEN '```json' || chr(10) || '{"faithful": false, "issues": "x"}' || chr(10) || '```' WHEN 2 THEN 'Verdict: {"faithful": true} as asked' WHEN 3 THEN 'The draft looks fine.' WHEN 4 THEN '[true]' WHEN 5 THEN '{"issues": "none"}' WHEN 6 THEN '{"faithful": "true"}' ELSE '{"faithful": true, "sufficient_context": "no"}' END AS raw FROM labels)"""
_ERRORS = """errors AS (SELECT doc_id, (doc_id % 4)::bigint AS attempt, CASE doc_id % 5 WHEN 0 THEN 'connection reset' WHEN 1 THEN '429 retryDelay: "7s"' WHEN 2 THEN 'RESOURCE_EXHAUSTED PerDay' WHEN 3 THEN '429 retryDelay: "200s"' ELSE '429 slow down' END AS error FROM labels)"""

_ROUTED = f"""c AS (SELECT conv_id, turn, {_CITED} AS cited, conv_id % 3 AS n, CASE conv_id % 8 WHEN 0 THEN '{{"faithful": true, "issues": "", "sufficient_context": true}}' WHEN 1 THEN '{{"faithful": false, "issues": "x"}}' WHEN 2 THEN '{{"faithful": true}}' WHEN 3 THEN 'x' WHEN 4 THEN '[true]' WHEN 5 THEN '{{"issues": "none"}}' WHEN 6 THEN '{{"faithful": "true"}}' ELSE '{{"faithful": true, "sufficient_context": "no"}}' END AS raw
  FROM (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'no source' ELSE draft END AS draft FROM answers)),
j AS (SELECT *, coalesce(json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END, '$.faithful') = 'BOOLEAN' AND coalesce(json_type(CASE WHEN json_valid(raw) THEN raw END, '$.sufficient_context') = 'BOOLEAN', true), false) AS valid, coalesce(json_extract(CASE WHEN json_valid(raw) THEN raw END, '$.faithful') = 'true', false) AS faithful FROM c),
v AS (SELECT *, CASE WHEN len(cited) = 0 THEN 'needs_retrieval' WHEN len(list_filter(cited, lambda x: NOT list_contains(['0', '1', '2', '3'], x))) > 0 THEN 'needs_rewrite' WHEN valid AND faithful THEN 'approved' ELSE 'needs_rewrite' END AS first FROM j),
r AS (SELECT *, CASE WHEN first <> 'approved' AND n >= 2 THEN 'unverified' ELSE first END AS verdict FROM v)"""


def _unfenced(raw: str) -> str:
    return rf"regexp_replace(trim({raw}, ' ' || chr(9) || chr(10) || chr(13)), '(?m)^```(json)?|```$', '', 'g')"


def _readable(clean: str) -> str:
    """The JSON of a reply: all of it, or else what lies between the first and the last brace; null if neither can be read."""
    return rf"CASE WHEN json_valid({clean}) THEN {clean} WHEN json_valid(regexp_extract({clean}, '(?s)(\{{.*\}})', 1)) THEN regexp_extract({clean}, '(?s)(\{{.*\}})', 1) END"


def _valid(j: str) -> str:
    return f"coalesce(json_type({j}, '$.faithful') = 'BOOLEAN' AND coalesce(json_type({j}, '$.sufficient_context') = 'BOOLEAN', true), false)"


def _flag(j: str, name: str, default: str) -> str:
    return f"coalesce(json_extract({j}, '$.{name}') = 'true', {default})"


def _told(role: int, kind: str, call: str, default: str) -> str:
    """A script's reply; of drafts the last repeats."""
    cases = []
    for k, run in enumerate(RUNS):
        texts = run[role]
        for i, t in enumerate(texts):
            at_least = role == 0 and i == len(texts) - 1
            cases.append(f"WHEN {kind} = {k} AND {call} {'>=' if at_least else '='} {i + 1} THEN '{t}'")
    return f"CASE {' '.join(cases)} ELSE '{default}' END"


def _pass(k: int, before: str) -> str:
    """One pass of the loop over the pending questions of a CTE."""
    caveat = "draft || chr(10) || chr(10) || '[Not verified: the last of ' || (retries + 1)::varchar || ' attempts was still rejected. Reason: ' || CASE WHEN issue = '' THEN 'unspecified' ELSE issue END || ']'"
    return f"""a{k} AS (SELECT qid, kind, retries, n_rewrite + (verdict = 'needs_retrieval')::int AS n_rewrite, n_synthesis + 1 AS n_synthesis, n_judge FROM {before} WHERE verdict LIKE 'needs_%'),
b{k} AS (SELECT a.*, f.ids, f.context_md5, replace({_told(0, 'kind', 'n_synthesis', '')}, '{{source}}', f.ids[1]) AS draft FROM a{k} a JOIN found_of f ON f.qid = 4 * a.qid + a.n_rewrite),
c{k} AS (SELECT *, {_CITED} AS cited, list_sort(list_filter({_CITED}, lambda x: NOT list_contains(ids, x))) AS unknown FROM b{k}),
d{k} AS (SELECT * REPLACE (n_judge + (len(cited) > 0 AND len(unknown) = 0)::int AS n_judge), {_told(1, 'kind', '(n_judge + 1)', APPROVAL)} AS raw FROM c{k}),
e{k} AS (SELECT *, {_readable(_unfenced('raw'))} AS j FROM d{k}),
f{k} AS (SELECT *, {_valid('j')} AS valid, {_flag('j', 'faithful', 'false')} AS faithful, {_flag('j', 'sufficient_context', 'true')} AS enough FROM e{k}),
g{k} AS (SELECT *, CASE WHEN len(cited) = 0 THEN 'needs_retrieval' WHEN len(unknown) > 0 OR NOT valid THEN 'needs_rewrite' WHEN faithful AND enough THEN 'approved' WHEN NOT enough THEN 'needs_retrieval' ELSE 'needs_rewrite' END AS first,
  CASE WHEN len(cited) = 0 THEN '{NO_CITATION}' WHEN len(unknown) > 0 THEN '{UNKNOWN_SOURCE}[' || array_to_string(list_transform(unknown, lambda x: chr(39) || x || chr(39)), ', ') || ']' WHEN NOT valid THEN '{BAD_VERDICT}' ELSE coalesce(json_extract_string(j, '$.issues'), '') END AS issue FROM f{k}),
s{k} AS MATERIALIZED (SELECT qid, kind, CASE WHEN first <> 'approved' AND retries >= 2 THEN 'unverified' ELSE first END AS verdict, (retries + (first <> 'approved' AND retries < 2)::int)::bigint AS retries,
  CASE WHEN first = 'approved' THEN draft WHEN retries >= 2 THEN {caveat} END AS answer, cited, ids, context_md5, n_rewrite::bigint AS n_rewrite, n_synthesis::bigint AS n_synthesis, n_judge::bigint AS n_judge FROM g{k})"""


_HALF = "length(text) // 2"
LOOP = ",\n".join([
    SCORED.replace("questions AS (SELECT item_id AS qid, text, text AS question FROM benchmark)", f"questions AS (SELECT qid, text, text AS question FROM (SELECT 4 * item_id + c AS qid, CASE c WHEN 1 THEN text WHEN 2 THEN substr(text, {_HALF} + 1) ELSE substr(text, 1, {_HALF}) END AS text FROM benchmark, (SELECT unnest([1, 2, 3]) AS c)))"),
    ranked("hits", 0.3, 5),
    "titles AS (SELECT source_id, chunk_index, text FROM chunks)",
    "found_of AS MATERIALIZED (SELECT qid, list(source_id ORDER BY rank) AS ids, md5(string_agg('[arxiv:' || source_id || '] ' || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM hits JOIN titles USING (source_id, chunk_index) GROUP BY qid)",
    f"s0 AS (SELECT item_id AS qid, item_id % {len(RUNS)} AS kind, 'needs_retrieval' AS verdict, 0 AS retries, 0 AS n_rewrite, 0 AS n_synthesis, 0 AS n_judge FROM benchmark)",
    *(_pass(k, f"s{k - 1}") for k in (1, 2, 3)),
    "ended AS (" + " UNION ALL ".join(f"SELECT * FROM s{k} WHERE verdict NOT LIKE 'needs_%'" for k in (1, 2, 3)) + ")",
])
_CONTEXT = """f AS (SELECT source_id, chunk_index, text FROM chunks)"""

SQL = {
    "eval_slice": "SELECT item_id AS qid, length(text)::bigint AS n_chars FROM benchmark ORDER BY item_id LIMIT 10 OFFSET 5",
    "critic_route": with_(_ANSWERS, _ROUTED, "SELECT conv_id, turn, verdict, (n + (verdict IN ('needs_retrieval', 'needs_rewrite'))::bigint)::bigint AS retries, CASE WHEN verdict IN ('approved', 'unverified') THEN 'end' WHEN verdict = 'needs_retrieval' THEN 'retriever' ELSE 'synthesis' END AS route FROM r"),
    "quota_cut": with_(
        LOOP.replace(ranked("hits", 0.3, 5), ranked("hits", 0.15, 5)),
        "asked AS (SELECT item_id AS qid, text AS question FROM benchmark)",
        "found AS (SELECT e.qid, f.rank, f.source_id, f.chunk_index FROM ended e JOIN hits f ON f.qid = 4 * e.qid + e.n_rewrite)",
        recall("recalled", "found", "asked"),
        "stop AS (SELECT min(item_id) AS qid FROM benchmark WHERE item_id % 16 = 9)",
        "SELECT 'hybrid_light' AS strategy, 0::bigint AS ordinal, e.qid AS question_no, round(recall, 6) AS recall, round(CASE WHEN len(cited) > 0 THEN len(list_filter(cited, lambda x: list_contains(ids, x)))::double / len(cited)::double ELSE 0 END, 6) AS citation_validity, retries, true AS stopped_early FROM ended e JOIN recalled r ON e.qid = r.qid, stop WHERE e.qid < stop.qid",
    ),
    "contexts": with_(chunks(), _CONTEXT, """SELECT source_id, md5(string_agg('[arxiv:' || source_id || '] "Paper ' || source_id || '" (chunk ' || chunk_index::varchar || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index)) AS writer_md5, md5(string_agg('[arxiv:' || source_id || '] ' || text, chr(10) || chr(10) ORDER BY chunk_index)) AS judge_md5 FROM f GROUP BY source_id"""),
    "kg_nodes": with_(EDGES, "SELECT source_id AS id, 'paper' AS type FROM papers UNION SELECT dst, split_part(dst, ':', 1) FROM edges"),
    "chunk_windows": with_(chunks(), "SELECT source_id, chunk_index, md5(text) AS text_md5, length(text)::bigint AS n_chars FROM chunks"),
    "chunk_windows_200": with_(chunks(200, 30), "SELECT source_id, chunk_index, md5(text) AS text_md5, length(text)::bigint AS n_chars FROM chunks"),
    "chunk_stats": with_(chunks(), "SELECT count(*) AS n_chunks, quantile_cont(length(text), 0.5)::double AS median_chars, round(avg(least(500, length(text)) / length(text)::double), 6) AS shown_share FROM chunks"),
    "chunk_payload": with_(chunks(), PAPERS, "SELECT md5(text) AS text_md5, source_id, coalesce(title, '') AS source_title, chunk_index, coalesce(author, '') AS authors, coalesce(category, '') AS primary_category, coalesce(category, '') AS categories, '' AS published, NULL::int AS published_year, 2 AS schema_version FROM chunks LEFT JOIN papers USING (source_id)"),
    "keyword_counts": f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({keywords('text')}) AS term FROM documents) GROUP BY ALL",
    "published_year": "SELECT o_orderkey, left(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 4)::bigint AS published_year FROM orders",
    "hashed_embedding": with_(VECTORS, "SELECT source_id, chunk_index, array_to_string(list_transform(v, lambda x: x::bigint::varchar), ' ') AS v, norm2::bigint AS norm2 FROM cvec"),
    "vector_topk": with_(POOL, "SELECT qid, rank::bigint AS rank, source_id, chunk_index, round(sim, 6) AS sim FROM pool"),
    "vector_topk_embeddings": "WITH v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings), s AS (SELECT q.label AS label, c.vec_id, round(list_dot_product(q.e, c.e), 6) AS sim FROM (SELECT label, e FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) q, v c) SELECT label::bigint AS label, rank::bigint AS rank, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 20",
    "filtered_vector_topk": with_(VECTORS, f"s AS (SELECT qid, source_id, chunk_index, {SIM} AS sim FROM (SELECT * FROM cvec WHERE source_id IN (SELECT doc_id::varchar FROM documents WHERE lang = 'de')) c, qvec q)", "SELECT qid, rank::bigint AS rank, source_id, chunk_index, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, source_id, chunk_index) AS rank FROM s) WHERE rank <= 20"),
    "keyword_overlap": with_(SCORED, "SELECT qid, source_id, chunk_index, round(kw, 6) AS kw FROM scored"),
    "hybrid_vector_only": _hybrid(0.0),
    "hybrid_light": _hybrid(0.15),
    "hybrid_search": _hybrid(0.3),
    "hybrid_heavy": _hybrid(0.5),
    "doc_frequency": with_(PAPERS, GRAMS, "SELECT term, df FROM df"),
    "tfidf_concepts": with_(CONCEPTS, "FROM concepts"),
    "kg_edges": with_(EDGES, "FROM edges"),
    "kg_nodes_stats": with_(EDGES, "n AS (SELECT (SELECT count(DISTINCT source_id) FROM papers) AS papers, count(*) FILTER (dst LIKE 'author:%') AS authors, count(*) FILTER (dst LIKE 'category:%') AS categories, count(*) FILTER (dst LIKE 'concept:%') AS concepts FROM (SELECT DISTINCT dst FROM edges))", "SELECT papers + authors + categories + concepts AS nodes, *, (SELECT count(*) FROM edges) AS edges FROM n"),
    "related_papers": with_(SCORED, EDGES, ranked("seeds", 0.3, 20), starts("starts", "seeds"), related("out", "starts", 5), "FROM out"),
    **{f"graph_expanded_{name}": with_(SCORED, EDGES, expanded("out", 0.3, g), "FROM out") for name, g in (("light", 0.2), ("default", 0.3), ("heavy", 0.6))},
    "graph_zero_equals_hybrid": _hybrid(0.3),
    "keyword_recall": with_(SCORED, ranked("found", 0.3, 5), recall("out", "found"), "FROM out"),
    "retrieval_sweep": SWEEP,
    "best_strategy": SWEEP.removesuffix("FROM summary") + "SELECT strategy, mean_recall FROM summary ORDER BY mean_recall DESC, ordinal LIMIT 1",
    "citation_validity": with_(_ANSWERS, f"SELECT conv_id, turn, list_count(list_filter({_CITED}, lambda x: list_contains(['0', '1', '2', '3'], x)))::double / len({_CITED})::double AS validity FROM answers"),
    "extract_citations": with_(_ANSWERS, f"SELECT conv_id, turn, array_to_string({_CITED}, '|') AS cited FROM answers"),
    "has_citations": with_(_ANSWERS, r"SELECT conv_id, turn, regexp_matches(CASE WHEN conv_id % 5 = 0 THEN coalesce(text, '') ELSE draft END, '\[arxiv:[^\]]+\]') AS has_citations FROM answers JOIN (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') USING (conv_id, turn)"),
    "structural_check": with_(_ANSWERS, f"c AS (SELECT conv_id, turn, {_CITED} AS cited FROM answers)", "SELECT conv_id, turn, CASE WHEN len(cited) = 0 THEN 'needs_retrieval' WHEN len(list_filter(cited, lambda x: NOT list_contains(['0', '1', '2', '3'], x))) > 0 THEN 'needs_rewrite' ELSE 'pass' END AS verdict FROM c"),
    "judge_parse": with_(_REPLIES, f"p AS (SELECT doc_id, {_readable(_unfenced('raw'))} AS j FROM replies)", f"SELECT doc_id, {_valid('j')} AS valid, {_valid('j')} AND {_flag('j', 'faithful', 'false')} AS faithful, {_valid('j')} AND {_flag('j', 'sufficient_context', 'true')} AS sufficient FROM p"),
    "retry_decision": with_(_ERRORS, """SELECT doc_id, CASE WHEN error = 'connection reset' THEN 'raise' WHEN error LIKE '%PerDay%' OR error LIKE '%200s%' OR attempt >= 3 THEN 'give_up' ELSE 'wait' END AS action, CASE WHEN error LIKE '%"7s"%' THEN 7 WHEN error LIKE '%200s%' THEN 200 ELSE pow(2, attempt) END::double AS delay FROM errors"""),
    "message_text": """SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN '' ELSE coalesce(text, '') END AS text FROM conversations""",
    "agent_loop": with_(LOOP, "SELECT qid, verdict, retries, answer, array_to_string(cited, '|') AS cited, array_to_string(ids, '|') AS retrieved, context_md5, n_rewrite, n_synthesis, n_judge FROM ended"),
    "agent_eval_summary": with_(
        LOOP,
        "asked AS (SELECT item_id AS qid, text AS question FROM benchmark)",
        "found AS (SELECT e.qid, f.rank, f.source_id, f.chunk_index FROM ended e JOIN hits f ON f.qid = 4 * e.qid + e.n_rewrite)",
        recall("recalled", "found", "asked"),
        "records AS (SELECT recall, CASE WHEN len(cited) > 0 THEN len(list_filter(cited, lambda x: list_contains(ids, x)))::double / len(cited)::double ELSE 0 END AS validity, retries, regexp_matches(answer, '\\[arxiv:[^\\]]+\\]')::int AS tagged, verdict <> 'approved' AS unverified FROM ended JOIN recalled USING (qid))",
        "SELECT count(*) AS questions_completed, round(avg(recall), 6) AS avg_recall, round(avg(validity), 6) AS avg_citation_validity, round(avg(validity) FILTER (NOT unverified), 6) AS avg_citation_validity_verified, round(avg(retries::double), 6) AS avg_retries, round(avg(tagged::double), 6) AS citation_rate, round(avg(unverified::int::double), 6) AS unverified_rate FROM records",
    ),
}
