"""The registered queries as DuckDB SQL.

Written from the rules and not from the plans: the driver's texts are Latin
with precomposed accents, so a key is the text without them, character by
character, and Arabic text is made of it with Buckwalter's letters.
"""

from __future__ import annotations

import re
import unicodedata

from ..functions.translit import token_pairs

# fixed values: Buckwalter's letters
_LATIN = "'|>&<}AbptvjHxd*rzs$SDTZEg_fqklmnhwYyFNKaui~o`{PJVG"
_ARABIC = "ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىيًٌٍَُِّْٰٱپچڤگ"
_HARAKAT, _DAGGER, _TATWEEL = "".join(map(chr, range(0x64B, 0x653))), "ٰ", "ـ"
_ACCENTED = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1}
_BASE = {c: d[0] for c, d in _ACCENTED.items()}
_SKELETONS = {"ب": "ٮ", "ت": "ٮ", "ث": "ٮ", "ن": "ٮ", "ي": "ٮ", "ج": "ح", "خ": "ح", "ذ": "د", "ز": "ر", "ش": "س", "ض": "ص", "ظ": "ط", "غ": "ع", "ف": "ٯ", "ق": "ٯ"}
_ALEFS, _SEATS = {"آ": "ا", "أ": "ا", "إ": "ا"}, {"ؤ": "و", "ئ": "ي"}
_DECOMPOSED = {c: unicodedata.normalize("NFD", c) for c in "آأإؤئ"}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fold(x: str, one: dict[str, str], drop: str = "") -> str:
    return f"translate({x}, {_q(''.join(one) + drop)}, {_q(''.join(one.values()))})"


def _swap(x: str, many: dict[str, str]) -> str:
    for a, b in many.items():
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return x


_BW = f"translate(text, {_q(_LATIN)}, {_q(_ARABIC)})"
_MARKS = _HARAKAT + _DAGGER
_SEARCH = _ALEFS | _SEATS | {"ٱ": "ا", "ة": "ه", "ى": "ي"} | _BASE
_search = lambda x: _fold(x, _SEARCH, _MARKS + _TATWEEL)
_KEY = "strip_accents(text)"

_LINES = r"""
p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, len(p) AS n, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM p),
lines AS (SELECT doc_id, i::BIGINT AS line, CASE WHEN i < n THEN regexp_replace(t, '\r$', '') ELSE t END AS text FROM u WHERE NOT (i = n AND t = ''))
"""
_ARABIC_LINES = _LINES + f", arabic AS (SELECT doc_id, line, {_BW} AS text FROM lines)"


def _lines(select: str, where: str = "") -> str:
    return f"WITH {_LINES} SELECT doc_id, line, {select} FROM lines {'WHERE ' + where if where else ''}"


def _arabic(select: str) -> str:
    return f"WITH {_ARABIC_LINES} SELECT doc_id, line, {select} FROM arabic"


def _pieces(find: str, split: str, of: str, size: str) -> str:
    """CTEs: lines with ``spots``, the (start, size) of each match, in characters."""
    return f"""g AS (SELECT doc_id, line, text, {split} AS g, {find} AS m FROM {of}),
h AS (SELECT * FROM g WHERE len(m) > 0),
hits AS (SELECT doc_id, line, text, list_transform(range(1, len(m) + 1), lambda i: {{
  'c': (list_sum(list_transform(g[1:i], lambda x: {size}(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {size}(x))), 0))::BIGINT,
  'n': {size}(m[i])}}) AS spots FROM h)"""


def _literal(word: str, of: str = "lines") -> str:
    return _pieces(f"list_transform(range(1, len(string_split({_KEY}, {_q(word)}))), lambda i: {_q(word)})", f"string_split({_KEY}, {_q(word)})", of, "length")


def _regex(pattern: str, of: str = "lines", text: str = _KEY, size: str = "length") -> str:
    return _pieces(f"regexp_extract_all({text}, {_q(pattern)})", f"string_split_regex({text}, {_q(pattern)})", of, size)


#: Spans in bytes of the text, from places in characters.
_SPANS = "array_to_string(list_transform(spots, lambda s: strlen(left(text, s.c)) || '-' || strlen(left(text, s.c + s.n))), ',')"
_WORD = r"[\p{L}\p{N}\p{M}_]"


def _context(hit: str, before: int, after: int, more: str = "") -> str:
    return f"""WITH {_LINES}, s AS (SELECT *, {hit} AS sel FROM lines),
k AS (SELECT *, bool_or(sel) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN {after} PRECEDING AND {before} FOLLOWING) AS near FROM s),
c AS (SELECT doc_id, line, text, NOT sel AS context, coalesce(line > lag(line) OVER (PARTITION BY doc_id ORDER BY line) + 1, FALSE) AS group_start FROM k WHERE near){more}
"""


def _from_latin(scheme: str, text: str) -> str:
    to: dict[str, str] = {}
    for a, latin in token_pairs(scheme):
        to.setdefault(latin, a)
    tokens = sorted(to, key=lambda t: -len(t.encode()))
    find = "(?s)" + "|".join(re.escape(t).replace("\\ ", " ") for t in tokens) + "|."
    table = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in to.items()) + "}"
    return f"array_to_string(list_transform(regexp_extract_all({text}, {_q(find)}), lambda t: coalesce({table}[t], t)), '')"


_SKIPPED = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in "script style noscript svg template".split()) + "|<!--.*?-->"
_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"


def _html_text() -> str:
    """By regular expressions; enough for pages whose tags are whole and whose entities are few."""
    x = r"regexp_replace(html, '\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is){_SKIPPED}', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)</?({_BLOCKS})\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '</?[A-Za-z!][^>]*>', ' ', 'g')"
    for a, b in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    rows = rf"list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> '')"
    return f"SELECT page_id, array_to_string(list_transform({rows}, lambda l: l || chr(10)), '') AS text FROM pages WHERE html IS NOT NULL"


_two = "translate({x}, 'كيةه', 'کیۀہ')".format(x=_BW)
_languages = lambda **more: _fold(_two, _SEARCH | {k: v for k, v in more.items()}, _MARKS + _TATWEEL)
_ZW, _BIDI, _QURANIC = {"ب": "ب‌‍"}, {"ن": "ن‏⁦"}, {"ر": "رۖۥ"}
_COUNT = "SELECT d.doc_id, count(l.doc_id)::BIGINT AS selected FROM documents d LEFT JOIN (SELECT doc_id FROM {of} WHERE {hit}) l USING (doc_id) GROUP BY d.doc_id"
_FAULT = "f AS (SELECT doc_id, min(line) AS bad FROM lines WHERE strlen(text) > 400 GROUP BY doc_id)"
_FUZZY = " OR ".join(f"levenshtein(substr(k, i, {n}), 'therand') <= 1" for n in (6, 7, 8))
#: Per end the nearest, then longest window; of windows that overlap, the nearest, then first, then longest.
_FUZZY_SPANS = f"""WITH {_LINES}, k AS (SELECT doc_id, line, text, replace({_KEY}, 'ß', '#') AS k FROM lines),
c AS (SELECT doc_id, line, text, list_filter(flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform([6, 7, 8], lambda n: {{'s': levenshtein(substr(k, i, n), 'therand'), 'a': i - 1, 'z': 1 - i - n, 'fits': i + n - 1 <= length(k)}}))), lambda x: x.s <= 1 AND x.fits) AS c
  FROM k WHERE len(list_filter(range(1, len(k) + 1), lambda i: {_FUZZY})) > 0),
e AS (SELECT doc_id, line, text, list_sort(list_filter(c, lambda x: len(list_filter(c, lambda y: y.z = x.z AND (y.s < x.s OR (y.s = x.s AND y.a < x.a)))) = 0)) AS c FROM c),
t AS (SELECT doc_id, line, text, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a < -x[1].z AND x[1].a < -y.z)) = 0 THEN acc || x ELSE acc END) AS c FROM e),
hits AS (SELECT doc_id, line, text, list_transform(list_sort(list_transform(c, lambda x: {{'a': x.a, 'z': x.z}})), lambda x: {{'c': x.a::BIGINT, 'n': -x.z - x.a}}) AS spots FROM t)
SELECT doc_id, line, text, {_SPANS} AS spans FROM hits"""
_HIGHLIGHT = "((?:t[iìíîï][oòóôõö][nñ])+)"

ORACLE_SQL = {
    "s18_lines": _lines("text"),
    "w3_line_counts": f"WITH {_LINES} SELECT doc_id, max(line) AS n_lines FROM lines GROUP BY doc_id",
    "s10_decode_utf16": "SELECT doc_id, text, 'utf16le' AS encoding FROM documents WHERE text IS NOT NULL",
    "s11_detect_encoding": "SELECT doc_id, unnest(['utf16be', 'utf8']) AS encoding, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "s14_html_text": _html_text(),
    "s19_line_limit": f"WITH {_LINES}, {_FAULT} SELECT doc_id, bad AS line, 'over 400 bytes' AS error FROM f",
    "s20_invalid_utf8": f"WITH {_LINES} SELECT doc_id, min(line) AS line, 'invalid UTF-8' AS error FROM lines WHERE line % 5 = 0 OR contains(text, 'tion') GROUP BY doc_id",
    "a6_lines_before_fault": f"WITH {_LINES}, {_FAULT} SELECT doc_id, line, text FROM lines LEFT JOIN f USING (doc_id) WHERE bad IS NULL OR line < bad",
    "n1_key_latin": _lines(f"{_KEY} AS key"),
    "n5_key_latin_decomposed": _lines(f"{_swap('text', _ACCENTED)} AS key"),
    "n28_key_reordered": _lines(f"{_swap('text', {c: d + chr(0x323) if len(d) == 2 else d for c, d in _ACCENTED.items()})} AS given, {_swap('text', {c: d[0] + ''.join(sorted(d[1:] + chr(0x323), key=unicodedata.combining)) for c, d in _ACCENTED.items() if len(d) == 2})} AS key, {_KEY} AS key_search"),
    "n7_key_search": _arabic(f"{_search('text')} AS key"),
    "n9_key_strict": _arabic(f"{_swap(_fold('text', _BASE, _MARKS + _TATWEEL), _DECOMPOSED)} AS key"),
    "n25_key_loose": _arabic(f"{_fold(_search('text'), _SKELETONS)} AS key"),
    "n11_key_lucene": _arabic(f"{_swap(_fold('text', _ALEFS | {'ة': 'ه', 'ى': 'ي'}, _HARAKAT + _TATWEEL), {c: _DECOMPOSED[c] for c in _SEATS} | _ACCENTED)} AS key"),
    "n11_key_camel": _arabic(f"{_swap(_fold('text', _ALEFS | {'ٱ': 'ا', 'ة': 'ه', 'ى': 'ي'}, _MARKS), {c: _DECOMPOSED[c] for c in _SEATS} | _ACCENTED)} AS key"),
    "n13_key_languages": _lines(f"{_languages(ۀ='ە')} AS key_ar, {_languages(ۀ='ه', ک='ك', ی='ي')} AS key_ar_fa, {_languages(ۀ='ە', ک='ك', ی='ي', ہ='ه')} AS key_ar_ur, {_languages(ۀ='ه')} AS key_fa"),
    "n19_key_controls": _arabic(f"{_search('text')} AS key, {_search(_swap('text', _ZW))} AS key_joiners, {_search(_swap('text', _BIDI))} AS key_bidi, {_search(_swap('text', _QURANIC))} AS key_quranic, {_search(_swap('text', {'ب': 'ب' + chr(0x200C)}))} AS key_fa"),
    "n2_key_presentation": _arabic(f"{_search('text')} AS key, {_search(_swap(_fold('text', {'ك': 'ﻛ', 'م': 'ﻤ'}), {'لا': 'ﻻ'}))} AS key_forms"),
    "n17_key_overrides": _arabic(
        f"{_swap(_fold('text', _BASE | {'ة': 'ه', 'ى': 'ي'}, _MARKS + _TATWEEL), _DECOMPOSED)} AS key_hamza, "
        f"{_fold('text', {k: v for k, v in _SEARCH.items() if k != 'ة'}, _MARKS + _TATWEEL)} AS key_tamarbuta, {_fold(_search('text'), _SKELETONS)} AS key_rasm"
    ),
    "n23_digits": _lines("translate(text, ',;?%.', '،؛؟٪۔') AS digits, translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS punctuation, strip_accents(text) AS key"),
    "n25_rasm": _arabic(f"{_fold('text', _SKELETONS)} AS skeleton"),
    "n26_key_index": _lines(
        f"{_KEY} AS key, md5(array_to_string(list_append(flatten(list_transform(range(1, len(text) + 1), lambda i: CASE WHEN substr(text, i, 1) = 'ß' THEN [strlen(left(text, i - 1)), strlen(left(text, i - 1))] ELSE [strlen(left(text, i - 1))] END)), strlen(text)), ',')) AS index_md5"
    ),
    "n33_explain": _lines(f"{_KEY} AS key, CASE WHEN {_KEY} <> text THEN 'Unicode NFD,tashkil' ELSE '' END AS rules"),
    "t1_from_buckwalter": _arabic("text"),
    "t1_from_arabtex": _lines(f"{_from_latin('arabtex', 'text')} AS text"),
    "t1_from_iso233": _lines(f"{_from_latin('iso233', 'nfc_normalize(text)')} AS text"),
    "t2_to_buckwalter": _lines("text"),
    "t2_to_arabtex": _arabic(f"{_swap('text', dict(token_pairs('arabtex')))} AS text"),
    "t2_to_iso233": _arabic(f"{_swap('text', dict(token_pairs('iso233')))} AS text"),
    "t7_translit_matches": f"WITH {_LINES}, {_regex('n[aiuo`~FNK_]*t[aiuo`~FNK_]*', text='text')} SELECT doc_id, line, text, {_SPANS} AS spans FROM hits",
    "m1_literal": _lines("text", f"contains({_KEY}, 'Tion')"),
    "m1_any_of": _lines("text", " OR ".join(f"contains({_KEY}, '{w}')" for w in ("ationt", "scherr", "eparre", "cionta"))),
    "m1_arabic_prefiltered": f"WITH {_ARABIC_LINES} SELECT * FROM arabic WHERE contains({_search('text')}, 'خطق') OR contains({_search('text')}, 'نتن')",
    "m1_conversations": f"WITH p AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS p FROM conversations), u AS (SELECT conv_id, turn, role, unnest(p) AS text, generate_subscripts(p, 1)::BIGINT AS line FROM p) SELECT conv_id, turn, role, line, text FROM u WHERE contains({_KEY}, 'theth')",
    "m3_literal_spans": f"WITH {_LINES}, {_literal('tion')} SELECT doc_id, line, text, {_SPANS} AS spans FROM hits",
    # spans of the Arabic text, found in the Latin one
    "m3_any_of_spans": f"WITH {_LINES}, {_regex('n[aiuo`~FNK_]*t[aiuo`~FNK_]*', text='text')}, b AS (SELECT doc_id, line, {_BW} AS text, spots FROM hits) SELECT doc_id, line, text, {_SPANS} AS spans FROM b",
    "m4_ignore_case": _lines("text", f"contains(replace(lower({_KEY}), 'ß', 'ss'), 'strass') OR contains(replace(lower({_KEY}), 'ß', 'ss'), 'erier')"),
    "m5_regex": _lines("text", " OR ".join(f"regexp_matches({_KEY}, '{p}')" for p in (r"\bth\w+ (?:and|of)\b", r"^[A-E][a-z]{2,4}\.$", "[[:digit:]]{4}"))),
    "m6_regex_spans": f"WITH {_LINES}, {_regex('th[a-z]*e')} SELECT doc_id, line, text, {_SPANS} AS spans FROM hits",
    "m7_fuzzy": f"WITH {_LINES}, k AS (SELECT doc_id, line, text, replace({_KEY}, 'ß', '#') AS k FROM lines) SELECT doc_id, line, text FROM k WHERE len(list_filter(range(1, len(k) + 1), lambda i: {_FUZZY})) > 0",
    "m10_fuzzy_spans": _FUZZY_SPANS,
    "m13_invert": _lines("text", f"NOT contains({_KEY}, 'e')"),
    "m14_word": _lines("text", f"regexp_matches({_KEY}, '(^|[^{_WORD[1:-1]}])des($|[^{_WORD[1:-1]}])')"),
    "m14_word_spans": f"""WITH {_LINES}, {_literal('des')}, w AS (SELECT doc_id, line, text, list_filter(spots, lambda s: NOT regexp_matches(substr({_KEY}, s.c, CASE WHEN s.c > 0 THEN 1 ELSE 0 END), '{_WORD}') AND NOT regexp_matches(substr({_KEY}, s.c + 4, 1), '{_WORD}')) AS spots FROM hits)
SELECT doc_id, line, text, {_SPANS} AS spans FROM w WHERE len(spots) > 0""",
    "j1_patterns_in_texts": "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(strip_accents(d.text), strip_accents(b.text)) AND b.text <> ''",
    "w1_context": _context(f"contains({_KEY}, 'theth')", 1, 2) + "SELECT * FROM c",
    "w1_context_inverted": _context(f"NOT contains({_KEY}, 'e')", 2, 0) + "SELECT * FROM c",
    "a1_count_per_document": f"WITH {_LINES} " + _COUNT.format(of="lines", hit=f"contains({_KEY}, 'tion')"),
    "a1_count_arabic": f"WITH {_ARABIC_LINES} " + _COUNT.format(of="arabic", hit=f"contains({_search('text')}, 'نت')"),
    "a2_documents_with": f"WITH {_LINES} SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM lines WHERE contains({_KEY}, 'theth'))",
    "a3_documents_without": f"WITH {_LINES} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE contains({_KEY}, 'theth'))",
    "a4_first_line": f"WITH {_LINES} SELECT doc_id, min(line) AS line FROM lines WHERE contains({_KEY}, 'tion') GROUP BY doc_id",
    "a5_status": f"WITH {_LINES} SELECT count(*)::BIGINT AS selected, CASE WHEN count(*) > 0 THEN 0 ELSE 1 END::INTEGER AS status FROM lines WHERE contains({_KEY}, 'tion')",
    "p1_json_lines": _context(f"contains({_KEY}, 'ation')", 1, 0, f", {_literal('ation', 'c')}")
    + """SELECT c.doc_id, c.line, '{"file":' || to_json(c.doc_id::VARCHAR) || ',"line":' || c.line || ',"text":' || to_json(c.text) || CASE WHEN context THEN ',"context":true' ELSE '' END
  || CASE WHEN spots IS NULL THEN '' ELSE ',"spans":[' || array_to_string(list_transform(spots, lambda s: '[' || strlen(left(c.text, s.c)) || ',' || strlen(left(c.text, s.c + s.n)) || ']'), ',') || ']' END || '}' AS out
FROM c LEFT JOIN hits USING (doc_id, line)""",
    "p2_human_lines": _context(f"contains({_KEY}, 'theth')", 1, 1)
    + "SELECT doc_id, line, CASE WHEN group_start THEN '--' || chr(10) ELSE '' END || doc_id || CASE WHEN context THEN '-' ELSE ':' END || line || CASE WHEN context THEN '-' ELSE ':' END || text AS out FROM c",
    "p3_only_matching": f"WITH {_LINES}, {_regex('th[a-z]*e')}, s AS (SELECT doc_id, line, text, unnest(spots) AS s, (generate_subscripts(spots, 1) - 1)::INTEGER AS pos FROM hits) SELECT doc_id, line, pos, substr(text, s.c + 1, s.n) AS part FROM s",
    "p4_highlight": _lines(rf"regexp_replace(text, '{_HIGHLIGHT}', '<mark>\1</mark>', 'g') AS out", f"contains({_KEY}, 'tion')"),
    "r1_stream": _lines("text", f"contains({_KEY}, 'Tion')"),
}
