"""DuckDB SQL of the core's queries, written from the rules, not from the plans.

Queries with Python operators that SQL cannot express (chunk folds, embedding, shredding) have
none and are tested against brute force in the test folder.
"""

from __future__ import annotations

from ..functions.text import CJK, LINE_END, LINK, SPACE, STUDENT, TEACHER, WORD, phrases_of, terms_of
from ..operators.shred import OWN_MEMBERS, REPEATED, WRAPPERS
from .queries import CHINESE, DEVICE, DIM, MODEL, QUESTION

_S = rf"\n{SPACE}"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _lines(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '{LINE_END}', chr(10), 'g'), chr(10))"


def _bare(x: str) -> str:
    return f"list_filter(list_transform({_lines(x)}, lambda l: {_strip('l')}), lambda l: l <> '')"


def _score(question: str, title: str = "coalesce(document_title, '')", content: str = "coalesce(content, '')") -> str:
    terms, cjk = terms_of(question)
    t, c = f"lower({title})", f"substring(lower({content}), 1, 800)"
    parts = []
    for words, a, b in ((phrases_of(terms, 4, "" if cjk else " "), 1000, 50), (terms, 100, 10)):
        parts += [f"CASE WHEN contains({t}, '{w}') THEN {a} ELSE 0 END + CASE WHEN contains({c}, '{w}') THEN {b} ELSE 0 END" for w in words]
    return f"CAST({' + '.join(parts)} AS DOUBLE)"


_USABLE = f"""usable AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM chunks
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM} AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT v AS qv FROM usable ORDER BY id LIMIT 1),
near AS (SELECT usable.*, greatest(-1.0, least(1.0, list_cosine_similarity(v, qv))) AS sim FROM usable, q)"""


def _matched(threshold: float, kind: str | None = None) -> str:
    where = f" AND manual_type = '{kind}'" if kind else ""
    return f"{_USABLE}, matched AS (SELECT id, document_title, chunk_index, sim FROM near WHERE sim > {threshold}{where} ORDER BY sim DESC, id LIMIT 8)"


_NEEDED = "needed AS (SELECT DISTINCT document_title, i AS chunk_index FROM (SELECT document_title, unnest([chunk_index - 1, chunk_index, chunk_index + 1]) AS i FROM matched) WHERE i >= 0)"
_FOUND = "found AS (SELECT c.*, coalesce(m.sim, 0.0) AS similarity FROM chunks c JOIN needed USING (document_title, chunk_index) LEFT JOIN matched m ON m.id = c.id)"


def _rerank(source: str, position: str, question: str = QUESTION) -> str:
    return f"""scored AS (SELECT *, {_score(question)} AS score FROM {source}),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(document_title, '') ORDER BY score DESC, {position}) AS r1 FROM scored) WHERE r1 = 1),
reranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, coalesce(document_title, '')) - 1 AS INTEGER) AS rank FROM one ORDER BY score DESC, coalesce(document_title, '') LIMIT 8)"""


_EXPAND = """firsts AS (SELECT * FROM (SELECT c.id, c.document_title, c.chunk_index, c.content, c.source_url, row_number() OVER (PARTITION BY c.document_title ORDER BY c.chunk_index NULLS LAST, c.id) AS r2 FROM chunks c
  WHERE c.document_title IN (SELECT document_title FROM reranked WHERE rank < 3 AND document_title <> '')) WHERE r2 <= 10),
both_ AS (SELECT id, document_title, chunk_index, content, source_url, similarity, 0 AS f FROM reranked UNION ALL SELECT id, document_title, chunk_index, content, source_url, NULL, 1 FROM firsts),
once_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f) AS r3 FROM both_) WHERE r3 = 1),
expanded AS (SELECT o.id, o.document_title, o.chunk_index, o.content, o.source_url, o.similarity, coalesce(r.rank, 9999) AS title_rank FROM once_ o LEFT JOIN reranked r ON r.document_title = o.document_title)"""


def _candidates(question: str, limit: int = 8) -> str:
    terms, _ = terms_of(question)
    of = lambda column, words, phase, most: " UNION ALL ".join(
        f"SELECT * FROM (SELECT {phase} AS phase, {i} AS term_no, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS row_no, * FROM chunks WHERE contains(lower({column}), '{w}')) WHERE row_no <= {most}" for i, w in enumerate(words)
    )
    return f"""by_title AS ({of("document_title", terms, 0, 2 * limit)}), by_content AS ({of("content", terms[:3], 1, limit)}),
candidates AS (SELECT * FROM by_title UNION ALL SELECT * FROM by_content WHERE (SELECT count(*) FROM by_title) < {limit})"""


def _terms(x: str) -> str:
    found = f"regexp_extract_all(lower({x}), '{WORD.replace(chr(39), chr(39) * 2)}')"
    owner = f"list_transform({found}, lambda t: regexp_replace(t, '''s$', ''))"
    single = f"list_transform({owner}, lambda t: CASE WHEN length(t) > 4 THEN regexp_replace(t, 's$', '') ELSE t END)"
    kept = f"list_filter({single}, lambda t: length(t) >= 3)"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


def _cjk(x: str) -> str:
    return f"regexp_extract_all({x}, '[{CJK}]')"


def _phrases(most: int) -> str:
    runs = " || ".join(f"CASE WHEN len(terms) >= {n} THEN list_transform(range(1, len(terms) - {n} + 2), lambda i: array_to_string(terms[i:i + {n - 1}], ' ')) ELSE [] END" for n in range(2, most + 1))
    return runs


_H = "h AS (SELECT DISTINCT ON (id) * FROM chat_history)"
_HM = "h AS (SELECT DISTINCT ON (id) * FROM chat_history WHERE user_message IS NOT NULL)"
_P = "pages AS (SELECT document_title, page_number, content AS text FROM chunks)"
_HEAD = f"""n AS (SELECT document_title, count(*) AS pages FROM pages GROUP BY 1 HAVING count(*) >= 3),
raw AS (SELECT document_title, unnest(list_distinct({_lines("text")})) AS raw FROM pages),
counts AS (SELECT document_title, {_strip("raw")} AS line, count(*) AS seen FROM raw GROUP BY 1, 2),
headers AS (SELECT document_title, line FROM counts JOIN n USING (document_title) WHERE line <> '' AND seen >= greatest(2, pages // 2 + 1))"""
_HEADING = rf"""CASE WHEN starts_with(f, '#') THEN {_strip("regexp_replace(f, '^[# ]+', '')")} ELSE f END"""


def _first_heading(x: str) -> str:
    return rf"list_filter({_bare(x)}, lambda l: starts_with(l, '#') OR (upper(l) = l AND lower(l) <> l AND len(regexp_split_to_array(l, '[{SPACE}]+')) < 10))[1]"


_URL1 = rf"""regexp_replace({_strip("coalesce(source_url, '')")}, '^[()\[\]<>{{}}.,;"'']+|[()\[\]<>{{}}.,;"'']+$', '', 'g')"""
_URL = f"(SELECT CASE WHEN starts_with(w, 'https://') THEN w ELSE '' END FROM (SELECT regexp_replace(CASE WHEN starts_with(u, 'www.') THEN 'https://' || u ELSE u END, '^http://', 'https://') AS w FROM (SELECT {_URL1} AS u)))"
_SOURCES = f"""u AS (SELECT *, {_URL} AS url FROM chunks),
s AS (SELECT coalesce(document_title, 'Unknown') AS title, url, CASE WHEN coalesce(manual_type, '') = '' THEN 'Unknown' ELSE manual_type END AS type, page_number AS page, 50.0 AS similarity
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS r FROM u WHERE url <> '') WHERE r = 1)"""


def _kind(x: str, other: str) -> str:
    has = lambda e, ws: "(" + " OR ".join(f"contains({e}, '{w}')" for w in ws) + ")"
    a, b = f"lower(coalesce({x}, ''))", f"lower(coalesce({other}, ''))"
    return f"CASE WHEN {has(a, TEACHER)} THEN 'teacher' WHEN {has(a, STUDENT)} THEN 'student' WHEN {has(b, TEACHER)} THEN 'teacher' WHEN {has(b, STUDENT)} THEN 'student' ELSE '' END"



def _unquoted(j: str) -> str:
    """JSON text inside a JSON string as JSON."""
    t = f"json_extract_string({j}, '$')"
    return f"CASE WHEN json_type({j}) = 'VARCHAR' THEN CASE WHEN json_valid({t}) THEN CAST({t} AS JSON) END ELSE {j} END"


def _unwrapped(j: str) -> str:
    """The list inside an object that only wraps it."""
    own = " OR ".join(f"json_exists({j}, '$.{k}')" for k in sorted(OWN_MEMBERS))
    inner = " ".join(f"WHEN json_type({j}) = 'OBJECT' AND NOT ({own}) AND json_exists({j}, '$.{k}') THEN json_extract({j}, '$.{k}')" for k in sorted(WRAPPERS))
    return f"CASE {inner} ELSE {j} END"


def _list(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE CAST([] AS JSON[]) END"


_NODES = f"""RECURSIVE h AS (SELECT DISTINCT ON (id) id, CASE WHEN json_valid(sources) THEN CAST(sources AS JSON) END AS j FROM chat_history WHERE sources IS NOT NULL),
a AS (SELECT id, {_unquoted("j")} AS j FROM h), b AS (SELECT id, {_unwrapped("j")} AS j FROM a), c AS (SELECT id, {_unquoted("j")} AS j FROM b), e AS (SELECT id, {_unwrapped("j")} AS j FROM c),
node(id, path, obj) AS (
SELECT id, CAST(i - 1 AS VARCHAR), x FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT id, {_list("j")} AS l FROM e))
UNION ALL
SELECT id, path || '/' || name || '/' || CAST(i - 1 AS VARCHAR), x FROM (SELECT id, path, name, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
  SELECT node.id, node.path, k.name, {_list("json_extract(node.obj, '$.' || k.name)")} AS l FROM node, (VALUES {", ".join(f"('{r}')" for r in REPEATED)}) k(name) WHERE json_type(node.obj) = 'OBJECT')))"""


def _typed(kind: str) -> str:
    """The table of one kind of node with typed columns."""
    from ..operators.shred import COLUMNS

    columns = ", ".join(f"TRY_CAST(json_extract_string(obj, '$.{n}') AS {t.replace('string', 'VARCHAR')}) AS {n.replace('.', '_')}" for n, t in COLUMNS[kind].items())
    return f"""WITH {_NODES} SELECT id AS message_id, path, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]+/[0-9]+$', '') END AS parent_path, {columns}
FROM node WHERE json_type(obj) = 'OBJECT' AND len(json_keys(obj)) > 0 AND CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '([^/]+)/[0-9]+$', 1) ELSE 'sources' END = '{kind}'"""


SQL: dict[str, str] = {
    **{f"p4_{kind}": _typed(kind) for kind in ("sources", "related", "passages", "highlights")},
    "p4_found": f"WITH {_NODES} SELECT DISTINCT id AS message_id, path FROM node WHERE json_type(obj) = 'OBJECT' AND len(json_keys(obj)) > 0",
    "mth01_cosine_topk": f"WITH {_matched(0.1)} SELECT id, document_title, chunk_index, round(sim, 6) AS similarity FROM matched",
    "flt02_cosine_topk_typed": f"WITH {_matched(0.1, 'teacher')} SELECT id, document_title, chunk_index, round(sim, 6) AS similarity FROM matched",
    "jn03_neighbour_indices": f"WITH {_matched(0.1)}, {_NEEDED} SELECT * FROM needed",
    "ret01_search": f"WITH {_matched(0.1)}, {_NEEDED}, {_FOUND} SELECT id, document_title, chunk_index, manual_type, round(similarity, 6) AS similarity FROM found",
    "ret01_search_typed": f"WITH {_matched(0.1, 'student')}, {_NEEDED}, {_FOUND} SELECT id, document_title, chunk_index, manual_type, round(similarity, 6) AS similarity FROM found",
    "mth02_relevance": f"SELECT id, {_score(QUESTION)} AS score FROM chunks",
    "mth02_relevance_cjk": f"SELECT id, {_score(CHINESE)} AS score FROM chunks",
    "ret02_rerank": f"WITH {_rerank('chunks', 'chunk_index NULLS LAST, id')} SELECT id, document_title, score, rank FROM reranked",
    "set01_candidates": f"WITH {_candidates(QUESTION)} SELECT phase, term_no, row_no, id FROM candidates",
    "flt05_candidates_content": f"WITH {_candidates('zylophone password hidden comments')} SELECT phase, term_no, row_no, id FROM candidates",
    "win05_first_chunks": "SELECT id, document_title, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY document_title ORDER BY chunk_index NULLS LAST, id) AS r FROM chunks WHERE document_title IS NOT NULL) WHERE r <= 10",
    "ret03_expand": f"WITH c AS (SELECT *, 0.5 AS similarity FROM chunks), {_rerank('c', 'chunk_index NULLS LAST, id')}, {_EXPAND.replace('NULL, 1 FROM firsts', '0.5 * NULL, 1 FROM firsts')} SELECT id, document_title, chunk_index, CAST(similarity AS DOUBLE) AS similarity, title_rank FROM expanded",
    "ret04_fallback": f"WITH {_candidates(QUESTION)}, c AS (SELECT *, CAST(NULL AS DOUBLE) AS similarity FROM candidates), {_rerank('c', 'phase, term_no, row_no')}, {_EXPAND} SELECT id, document_title, chunk_index, title_rank FROM expanded",
    "ret05_retrieve": f"WITH {_matched(0.2)}, {_NEEDED}, {_FOUND}, {_rerank('found', 'chunk_index NULLS LAST, id')}, {_EXPAND} SELECT id, document_title, chunk_index, round(similarity, 6) AS similarity, title_rank FROM expanded",
    "ret06_sources": f"WITH {_SOURCES} SELECT title, url, type, page, CAST(similarity AS DOUBLE) AS similarity FROM s",
    "mth03_display_similarity": f"WITH {_USABLE}, r AS (SELECT id, sim AS s FROM near) SELECT id, 0.0 + round(CASE WHEN s BETWEEN 0 AND 1 THEN round(s * 100, 1) ELSE round(least(s * 20, 100.0), 1) END, 1) AS shown FROM r",
    "ret07_context": f"""WITH {_candidates(QUESTION)}, c AS (SELECT *, CAST(NULL AS DOUBLE) AS similarity FROM candidates), {_rerank('c', 'phase, term_no, row_no')}, {_EXPAND},
g AS (SELECT document_title, string_agg(coalesce(content, ''), chr(10) ORDER BY coalesce(chunk_index, 0), id) AS body, {_strip("coalesce(first(source_url ORDER BY coalesce(chunk_index, 0), id), '')")} AS url FROM expanded GROUP BY 1)
SELECT document_title, 'SOURCE: ' || coalesce(document_title, 'Unknown Document') || CASE WHEN url <> '' THEN chr(10) || 'URL: ' || url ELSE '' END || chr(10) || chr(10) || '```' || chr(10) || body || chr(10) || '```' AS block FROM g""",
    "str17_sources_markdown": f"WITH {_SOURCES} SELECT url, '- [' || title || '](' || url || ')' || CASE WHEN coalesce(page, 0) <> 0 THEN ' (page ' || page || ')' ELSE '' END AS line FROM s",
    "str01_clean_text": rf"""SELECT doc_id, {_strip(rf"regexp_replace(array_to_string(list_filter({_bare('text')}, lambda l: NOT regexp_matches(l, '^[0-9]+$') AND NOT regexp_matches(l, '^(?i:page)\s+[0-9]+')), chr(10)), '[ \t]+', ' ', 'g')")} AS clean FROM documents""",
    "str02_headings": f"SELECT doc_id, {_HEADING} AS heading FROM (SELECT doc_id, {_first_heading('text')} AS f FROM documents) WHERE f IS NOT NULL",
    "str03_sentences": rf"""SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS INTEGER) AS longest
FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.?!])[{_S}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)""",
    "str05_words": rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{_S}]+')) AS INTEGER) AS words FROM documents WHERE text IS NOT NULL",
    "agg05_headers": f"WITH {_P}, {_HEAD} SELECT * FROM headers",
    "jn09_lines_left": f"""WITH {_P}, {_HEAD}, l AS (SELECT document_title, {_strip("raw")} AS line FROM (SELECT document_title, unnest({_lines("text")}) AS raw FROM pages))
SELECT document_title, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM l WHERE line <> '' AND NOT EXISTS (SELECT 1 FROM headers h WHERE h.document_title = l.document_title AND h.line = l.line) GROUP BY 1""",
    "str06_manual_types": f"""WITH {_P}, f AS (SELECT document_title, string_agg(text, chr(10) ORDER BY page_number, text) AS sample FROM pages WHERE page_number <= 2 GROUP BY 1)
SELECT document_title, {_kind('document_title', 'sample')} AS manual_type FROM (SELECT DISTINCT document_title FROM pages) LEFT JOIN f USING (document_title)""",
    "str07_links": f"""WITH l AS (SELECT document_title, coalesce(page_number, 2147483647) AS p, regexp_extract(coalesce(source_url, ''), '{LINK}') AS link FROM chunks)
SELECT t.document_title, coalesce(x.link, '') AS source_url FROM (SELECT DISTINCT document_title FROM l) t LEFT JOIN (SELECT document_title, first(link ORDER BY p, link) AS link FROM l WHERE link <> '' GROUP BY 1) x USING (document_title)""",
    "str08_source_urls": f"SELECT id, {_URL} AS url FROM chunks",
    "str09_cjk": f"WITH {_HM} SELECT id, regexp_matches(user_message, '[{CJK}]') AS has_cjk, CAST(len({_cjk('user_message')}) AS INTEGER) AS characters FROM h",
    "str11_word_terms": f"WITH {_HM} SELECT id, array_to_string({_terms('user_message')}, '|') AS terms FROM h",
    "str12_query_terms": f"WITH {_HM} SELECT term, count(*) AS uses FROM (SELECT unnest({_cjk('lower(user_message)')} || {_terms('user_message')}) AS term FROM h) GROUP BY 1",
    "str13_phrases": f"WITH {_HM}, t AS (SELECT id, {_terms('user_message')} AS terms FROM h), p AS (SELECT id, {_phrases(3)} AS ps FROM t) SELECT id, array_to_string(list_filter(ps, lambda x, i: list_position(ps, x) = i), '|') AS phrases FROM p",
    "flt10_prefixed": f"""WITH {_HM}, k AS (SELECT id, user_message, CASE WHEN starts_with(lower(user_message), 'teacher:') THEN 'teacher' WHEN starts_with(lower(user_message), 'student:') THEN 'student' END AS kind FROM h)
SELECT * FROM (SELECT id, kind, {_strip("CASE WHEN kind IS NOT NULL THEN substring(user_message, 9) ELSE user_message END")} AS message FROM k) WHERE message <> ''""",
    "str18_demo_reply": f"""WITH {_HM} SELECT id, 'Found in Guide, ' || coalesce(device_id, 'Unknown') || '. Set up a chat model for a full answer.' AS reply,
CASE WHEN contains(lower(user_message), 'hello') OR contains(lower(user_message), 'hi') THEN 'Hello! Ingest some manuals first, then ask again.' WHEN contains(lower(user_message), 'what') THEN 'Good question. It needs ingested manuals to be answered.'
ELSE 'You asked: ''' || user_message || '''. Ingest manuals and set up a chat model first.' END AS bare_reply FROM h""",
    "dte02_clock": f"WITH {_H} SELECT id, strftime(created_at, '%H:%M') AS shown FROM h",
    "str20_previews": "SELECT id, substring(id, 1, 8) AS short_id, substring(document_title, 1, 40) AS short_title FROM chunks",
    "win08_sections": f"""WITH l AS (SELECT doc_id, unnest({_lines('text')}) AS raw, generate_subscripts({_lines('text')}, 1) AS pos FROM documents), s AS (SELECT doc_id, pos, {_strip('raw')} AS line FROM l),
h AS (SELECT doc_id, pos, f, {_HEADING} AS heading FROM (SELECT doc_id, pos, {_first_heading('line')} AS f FROM s WHERE line <> '')),
c AS (SELECT doc_id, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h)
SELECT doc_id, coalesce(section, '') AS section, count(*) AS lines FROM c GROUP BY 1, 2""",
    "his01_device_sessions": f"""WITH {_H}, n AS (SELECT session_id, count(*) AS c FROM h GROUP BY 1)
SELECT s.id, s.title, s.updated_at, coalesce(n.c, 0) AS message_count FROM (SELECT * FROM chat_sessions WHERE device_id = '{DEVICE}' ORDER BY updated_at DESC NULLS FIRST, id LIMIT 20) s LEFT JOIN n ON n.session_id = s.id""",
    "his01_all_devices": f"""WITH {_H}, n AS (SELECT session_id, count(*) AS c FROM h GROUP BY 1), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY updated_at DESC NULLS FIRST, id) AS INTEGER) AS place FROM chat_sessions)
SELECT s.device_id, s.id, s.place, coalesce(n.c, 0) AS message_count FROM s LEFT JOIN n ON n.session_id = s.id WHERE place <= 20""",
    "his02_history": f"WITH {_H} SELECT session_id, id, created_at, CASE WHEN json_valid(sources) AND json_type(sources) = 'ARRAY' THEN CAST(json_array_length(sources) AS INTEGER) ELSE 0 END AS citations FROM h",
    "arr03_flattened": f"WITH {_H} SELECT id, 0 AS side, 'user' AS sender, CAST(length(user_message) AS INTEGER) AS characters FROM h UNION ALL SELECT id, 1, 'bot', CAST(length(bot_response) AS INTEGER) FROM h",
    "str15_session_titles": f"WITH {_HM} SELECT id, substring(user_message, 1, 50) || CASE WHEN length(user_message) > 50 THEN '...' ELSE '' END AS title FROM h",
    "agg01_message_counts": f"WITH {_H} SELECT s.id, count(h.id) AS message_count FROM chat_sessions s LEFT JOIN h ON h.session_id = s.id GROUP BY 1",
    "jn05_owned": f"WITH {_H} SELECT id, session_id, device_id FROM h WHERE EXISTS (SELECT 1 FROM chat_sessions s WHERE s.id = h.session_id AND s.device_id = h.device_id)",
    "his03_requests": f"WITH {_H}, r AS (SELECT DISTINCT device_id, session_id FROM h) SELECT r.device_id, s.id IS NULL AS created, count(*) AS sessions FROM r LEFT JOIN chat_sessions s ON s.id = r.session_id AND s.device_id = r.device_id GROUP BY 1, 2",
    "his04_saved": f"""WITH {_H}, m AS (SELECT session_id, first(user_message ORDER BY created_at, id) AS f, max(created_at) AS t FROM h WHERE session_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1)
SELECT s.id, CASE WHEN title = 'New Chat' AND f IS NOT NULL THEN substring(f, 1, 50) || CASE WHEN length(f) > 50 THEN '...' ELSE '' END ELSE title END AS title, CASE WHEN title = 'New Chat' AND f IS NOT NULL THEN t ELSE updated_at END AS updated_at FROM chat_sessions s LEFT JOIN m ON m.session_id = s.id""",
    "snk09_logged": f"WITH {_H}, m AS (SELECT session_id, max(created_at) AS t FROM h WHERE session_id IS NOT NULL GROUP BY 1) SELECT s.id, coalesce(t, updated_at) AS updated_at FROM chat_sessions s LEFT JOIN m ON m.session_id = s.id",
    "snk12_surviving": f"WITH {_H} SELECT 'chat_history' AS child, id FROM h WHERE session_id IN (SELECT id FROM chat_sessions) UNION ALL SELECT 'document_embeddings', id FROM document_embeddings WHERE document_id IN (SELECT id FROM chunks)",
    "jn04_pending": f"SELECT id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM document_embeddings e WHERE e.document_id = c.id AND e.model_name = '{MODEL}')",
    "jn04_pending_limited": f"SELECT id FROM (SELECT id FROM chunks ORDER BY id LIMIT 100) c WHERE NOT EXISTS (SELECT 1 FROM document_embeddings e WHERE e.document_id = c.id AND e.model_name = '{MODEL}')",
    "emb03_dry_run": f"SELECT id AS document_id, '{MODEL}' AS model_name, 'dry_run' AS status, 32 AS dimensions, CAST(0.0 AS DOUBLE) AS total FROM chunks",
    "snk03_upserted": f"""WITH a AS (SELECT id, document_id, model_name, coalesce(len(embedding), 0) AS dimensions, 0 AS n FROM document_embeddings UNION ALL SELECT 'new-' || id, id, '{MODEL}', 32, 1 FROM chunks)
SELECT id, document_id, model_name, CAST(dimensions AS INTEGER) AS dimensions FROM (SELECT *, row_number() OVER (PARTITION BY document_id, model_name ORDER BY n DESC, id DESC) AS r FROM a) WHERE r = 1""",
    "agg02_counts": "SELECT count(*) AS chunks, count(embedding) AS embedded FROM chunks",
    "agg03_chunks_per_title": "SELECT document_title, count(*) AS chunks FROM chunks GROUP BY 1",
    "agg09_numbering": "SELECT id, CAST(row_number() OVER (PARTITION BY document_title ORDER BY page_number NULLS LAST, chunk_index NULLS LAST, id) - 1 AS INTEGER) AS new_index, count(*) OVER (PARTITION BY document_title) AS new_total FROM chunks",
    "snk10_recent": "SELECT id, document_title, manual_type, created_at, CAST(length(content) AS INTEGER) AS content_length FROM chunks ORDER BY created_at DESC NULLS FIRST, id LIMIT 100",
    "agg10_statistics": f"SELECT count(DISTINCT document_title) AS files, count(*) AS pages, count(*) FILTER (WHERE {_strip(chr(99) + 'oalesce(content, ' + chr(39) * 2 + ')')} = '') AS blank_pages, CAST(0 AS BIGINT) AS ocr_pages FROM chunks",
    "prj03_defaults": "SELECT id, coalesce(document_title, 'Unknown') AS title, coalesce(nullif(manual_type, ''), 'Unknown') AS type, coalesce(chunk_index, 0) AS chunk_index FROM chunks",
    "src05_projection": "SELECT id, document_title, chunk_index, manual_type FROM chunks WHERE manual_type = 'teacher'",
    "jsn01_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "snk02_inserted": "SELECT document_title, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS characters FROM chunks GROUP BY 1",
}
