"""DuckDB SQL of those queries that SQL can express on whole tables."""

_CLOSURE = """, edges AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties), reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)"""
_TIES = r"""WITH RECURSIVE w AS (SELECT chunk_id, any_value(regexp_extract_all(lower(text_for_embedding), '[\pL\pN]+')) AS w FROM chunks WHERE chunk_id IS NOT NULL AND text_for_embedding IS NOT NULL GROUP BY 1),
g AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20), n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.chunk_id < y.chunk_id GROUP BY 1, 2),
ties AS (SELECT a, b FROM shared JOIN n p ON p.chunk_id = a JOIN n q ON q.chunk_id = b WHERE k >= 0.6 * (p.n + q.n - k))"""
_ALIKE = """WITH RECURSIVE v AS (SELECT DISTINCT chunk_id, list_transform(dense_vector, lambda x: coalesce(x, 0)) AS v FROM chunks WHERE chunk_id IS NOT NULL AND list_count(dense_vector) = 64 AND list_sum(list_transform(dense_vector, lambda x: x * x)) > 0),
ties AS (SELECT x.chunk_id AS a, y.chunk_id AS b FROM v x JOIN v y ON x.chunk_id < y.chunk_id AND list_cosine_similarity(x.v, y.v) >= 0.8), near AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties), low AS (SELECT b AS chunk_id, min(a) AS a FROM near GROUP BY 1),
up AS (SELECT chunk_id, least(a, chunk_id) AS cluster_key FROM low UNION SELECT u.chunk_id, least(l.a, u.cluster_key) FROM up u JOIN low l ON l.chunk_id = u.cluster_key), keyed AS (SELECT chunk_id, min(cluster_key) AS cluster_key FROM up GROUP BY 1)"""
_TALKS = r"""WITH v AS (SELECT DISTINCT ON (id) * FROM chat_messages WHERE session_id IS NOT NULL ORDER BY id, updated_at DESC),
ids AS (SELECT id AS session_id FROM chat_sessions UNION SELECT session_id FROM chat_messages WHERE session_id IS NOT NULL),
live AS (SELECT v.session_id, v.id, v.created_at, v.content, a.role, coalesce(regexp_full_match(v.content, '[\s\x{000B}\x{0085}\x{2028}\x{2029}\pZ\x{00A0}\x{200B}-\x{200D}\x{2060}\x{FEFF}]*'), true) AS blank
  FROM v LEFT JOIN chat_sessions s ON s.id = v.session_id LEFT JOIN role_aliases a ON a.alias = lower(trim(v.role, ' ' || chr(9) || chr(10) || chr(13)))
  WHERE v.deleted_at IS NULL AND (s.cleared_at IS NULL OR v.created_at > s.cleared_at)),
talk AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM live WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)),
good AS (SELECT session_id FROM talk GROUP BY 1 HAVING bool_and(CASE WHEN before IS NULL THEN role = 'user' ELSE role <> before END) AND bool_and(after IS NOT NULL OR role = 'assistant')),
bad AS (SELECT session_id FROM live WHERE role IS NULL OR blank)"""
# What each letter on the left is shown like on screen.
_LIKE = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "р", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑᎪꓮ", "B": "ВΒꓐ", "C": "СϹᏟꓚ", "D": "ꓓᎠ", "E": "ЕΕᎬꓰ", "F": "ꓝϜ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀꓲ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜᎷꓟ", "N": "Νꓠ",
    "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "ҮΥꓬ", "Z": "ΖᏃꓜ", "Г": "Γ", "П": "Π", "Ф": "Φ",
}
_FROM = "".join(_LIKE.values()) + "".join(chr(0xFF01 + i) for i in range(94)) + "\u2010\u2011\u00b5"
_TO = "".join(first * len(like) for first, like in _LIKE.items()) + "".join(chr(0x21 + i) for i in range(94)) + "--\u03bc"
_FORM = f"""nfc_normalize(translate(regexp_replace(regexp_replace(replace(translate(nfc_normalize(text), '{_FROM.replace("'", "''")}', '{_TO.replace("'", "''")}'), chr(13) || chr(10), chr(10)), '[\\pZ\\t]', ' ', 'g'), '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '{_FROM.replace("'", "''")}', '{_TO.replace("'", "''")}'))"""

SQL = {
    "p3_found": _TIES + _CLOSURE + " SELECT a AS chunk_id_a, b AS chunk_id_b FROM reach WHERE a < b",
    "p3_classes": _TIES + _CLOSURE + " SELECT n.chunk_id, coalesce(min(r.b), n.chunk_id) AS class_id, greatest(count(r.b), 1) AS n_members FROM n LEFT JOIN reach r ON r.a = n.chunk_id GROUP BY n.chunk_id",
    "p4_found": _ALIKE + " SELECT cluster_key, chunk_id FROM keyed QUALIFY count(*) OVER (PARTITION BY cluster_key) >= 3",
    "p4_sizes": _ALIKE + " SELECT coalesce(k.cluster_key, v.chunk_id) AS cluster_key, count(*) AS n_members FROM (SELECT DISTINCT chunk_id FROM v) v LEFT JOIN keyed k ON k.chunk_id = v.chunk_id GROUP BY 1",
    "p9_found": f"""WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p9_classes": f"""WITH f AS (SELECT DISTINCT doc_id, md5(text) AS digest, {_FORM} AS form FROM documents WHERE text IS NOT NULL), n AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT doc_id) AS n_members, count(DISTINCT digest) AS n_texts FROM f GROUP BY 1)
SELECT DISTINCT f.doc_id, n.class_id, n.n_members, n.n_texts FROM f JOIN n ON n.form = f.form""",
    "p1_found": """SELECT DISTINCT 'chunks' AS item_table, chunk_id AS item_id FROM chunks WHERE length(text_for_embedding) // 4 > 500
UNION SELECT DISTINCT 'elements', element_id FROM elements WHERE length(content.raw) // 4 > 500""",
    "p5_found": _TALKS + " SELECT session_id FROM ids WHERE session_id NOT IN (SELECT session_id FROM good) OR session_id IN (SELECT session_id FROM bad)",
    "p5_conversations": _TALKS + """ SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1 AS position, id, role, content, epoch_us(created_at) AS created_us FROM live
WHERE session_id IN (SELECT session_id FROM good) AND session_id NOT IN (SELECT session_id FROM bad)""",
    "p1_check": """SELECT DISTINCT 'chunks' AS item_table, chunk_id AS item_id, md5(text_for_embedding) AS text_hash, 0::BIGINT AS n_too_long, 0::BIGINT AS n_repeat_too_much FROM chunks WHERE length(text_for_embedding) // 4 > 500
UNION SELECT DISTINCT 'elements', element_id, md5(content.raw), 0, 0 FROM elements WHERE length(content.raw) // 4 > 500""",
    "p7_check": "SELECT profile, (SELECT count(*) FROM documents WHERE text <> '') AS n_documents, 0::BIGINT AS n_over, 0::BIGINT AS n_cut, 0::BIGINT AS n_lost FROM pack_profiles",
    "p8_check": "SELECT source, true AS within_repeats, true AS near_target FROM mix_targets",
}
