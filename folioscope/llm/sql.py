"""DuckDB SQL of those llm queries that SQL can express on whole tables.

The others (learnt models, alignment, graphs beyond the smallest tables, tokenizers) are tested
against brute force, exact round trips or held-out accuracy in tests/llm.
"""

from __future__ import annotations

_GAP = r"[\s\p{Z}\p{C}⠀ㅤᅟᅠ]*"


def _blank(x: str) -> str:
    from ..functions.blank import BLANK

    return f"({x} IS NULL OR regexp_matches({x}, '{BLANK.replace(chr(39), chr(39) * 2)}'))"


#: Stretches between breaks, outer white space dropped; breaks become chr(1) first.
_BREAK = r"regexp_replace(content, '(?:\r\n|\r|\n)(?:[ \t\x{0B}\f\x{A0}\x{2000}-\x{200A}\x{3000}]*(?:\r\n|\r|\n))+', chr(1), 'g')"
_ENDS = rf"regexp_replace(regexp_replace({_BREAK}, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), '([。！？])', '\1' || chr(1), 'g')"
_FITS = r"coalesce(list_max(list_transform(string_split({}, chr(1)), lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')))), 0) <= 1000"



def _words(x: str) -> str:
    """Words without markup, accents and case."""
    x = rf"regexp_replace({x}, '(?i)</?(?:p|br|li|div|td|tr|h)[^<>]*>', ' ', 'g')"
    x = rf"regexp_replace({x}, '</?[a-zA-Z][^<>]*>|\]\([^()\s]*\)|!\[|[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g')"
    x = rf"regexp_replace({x}, '(\p{{L}})[''’`´](\p{{L}})', '\1\2', 'g')"
    return rf"regexp_extract_all(lower(strip_accents({x})), '[\x{{4E00}}-\x{{9FFF}}]|[\p{{L}}\p{{N}}]+')"


SQL: dict[str, str] = {
    "p8_found": f"""WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_words("text")} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p1_found": """WITH u AS (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM chunks WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id),
n AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS r FROM s WHERE c >= 0.90 - 1e-9)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n WHERE r <= 5""",
    "p5_found": f"""WITH h AS (SELECT DISTINCT ON (id) id, session_id, device_id, created_at, NOT {_blank("user_message")} AS asks, NOT {_blank("bot_response")} AS answers FROM chat_history WHERE session_id IS NOT NULL),
o AS (SELECT *, lag(asks AND NOT answers) OVER w AS after_message, lead(answers AND NOT asks) OVER w AS before_reply FROM h WHERE created_at IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)),
f AS (SELECT session_id, bool_or(answers AND NOT asks AND NOT coalesce(after_message, false)) AS orphan, bool_or(asks AND NOT answers AND NOT coalesce(before_reply, false)) AS unanswered FROM o GROUP BY 1),
g AS (SELECT session_id, bool_or(asks OR answers) AS speaks, bool_or(created_at IS NULL) AS timeless, min(device_id) <> max(device_id) AS shared FROM h GROUP BY 1),
k AS (SELECT DISTINCT id FROM chat_sessions WHERE id IS NOT NULL),
t AS (SELECT coalesce(k.id, g.session_id) AS session_id, CASE WHEN NOT coalesce(speaks, false) THEN 'empty' WHEN k.id IS NULL OR timeless OR shared OR coalesce(orphan, false) THEN 'broken' WHEN coalesce(unanswered, false) THEN 'missing_reply' END AS reason
  FROM k FULL JOIN g ON k.id = g.session_id LEFT JOIN f ON f.session_id = g.session_id)
SELECT * FROM t WHERE reason IS NOT NULL""",
    "p6_found": rf"""SELECT id, CASE WHEN {_FITS.format(_BREAK)} THEN 'paragraph' WHEN {_FITS.format(_ENDS)} THEN 'sentence'
WHEN coalesce(list_max(list_transform(regexp_extract_all(content, '\S+'), lambda s: length(s))), 0) <= 1000 THEN 'word' ELSE 'none' END AS boundary FROM chunks WHERE length(content) > 1000""",
}
