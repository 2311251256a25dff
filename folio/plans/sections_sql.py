"""Joins across pages and sections of chapters said once more in SQL, by plain recursion over pages and parts."""

from __future__ import annotations

from folio.operators import segments as S
from folio.plans.prose_sql import strip, words
from folio.plans.scalars import tail
from folio.plans.views import _STARTS

FIRST = "f AS (SELECT * FROM (SELECT DISTINCT id, project_id, page_number, source_text, created_at FROM pages WHERE page_number IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY project_id, page_number ORDER BY created_at, id) = 1)"
#: Pages whose last mark is taken off where their number is even.
CUT = f"{FIRST}, u AS (SELECT project_id, page_number, CASE WHEN page_number % 2 = 0 THEN regexp_replace({strip('source_text')}, '[.!?]$', '') ELSE coalesce(source_text, '') END AS raw, row_number() OVER (PARTITION BY project_id ORDER BY page_number) AS k FROM f)"
FIXED = r"^(?:#|- |\* |```|!\[)"


def takes(x: str) -> str:
    last = strip(f"string_split({x}, chr(10))[-1]")
    return rf"""({x} <> '' AND NOT regexp_matches({x}, '[.!?:`"''”’)\]>}}]$') AND NOT regexp_matches({last}, '{FIXED}') AND NOT regexp_matches({last}, '(?i)^(?:CHAPTER|SECTION|PART|\p{{Nd}}+[.)])\s+'))"""


def head(x: str) -> str:
    return rf"""CASE WHEN {x} <> '' AND NOT regexp_matches({x}, '{FIXED}') AND NOT regexp_matches({x}, '^\p{{Nd}}+[.)]\s+') AND NOT regexp_matches({x}, '(?i)^(?:CHAPTER|SECTION)\b') THEN nullif(regexp_extract({x}, '^([\s\S]*?[.!?](?:\s+|$))', 1), '') END"""


STITCH_PAGES = f"""
    WITH RECURSIVE {CUT},
    r AS (SELECT project_id, k, page_number, NULL::INT AS earlier, raw AS open, NULL::VARCHAR AS done FROM u WHERE k = 1
          UNION ALL
          SELECT project_id, k, page_number, earlier, CASE WHEN moved IS NULL THEN raw ELSE {strip('substr(f, length(moved) + 1)')} END, CASE WHEN moved IS NULL THEN open ELSE c || ' ' || {strip('moved')} END
          FROM (SELECT *, CASE WHEN {takes('c')} THEN {head('f')} END AS moved FROM (SELECT u.project_id, u.k, u.page_number, r.page_number AS earlier, open, raw, {strip('open')} AS c, {strip('raw')} AS f FROM r JOIN u ON u.project_id = r.project_id AND u.k = r.k + 1)))
    SELECT project_id, earlier AS page_number, done AS text FROM r WHERE k > 1
    UNION ALL SELECT project_id, page_number, open FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY k DESC) = 1)"""
STITCH_SINGLE = f"""
    WITH {CUT}, a AS (SELECT *, {strip('raw')} AS s, {strip('lag(raw) OVER w')} AS b, {strip('lead(raw) OVER w')} AS n FROM u WINDOW w AS (PARTITION BY project_id ORDER BY page_number)),
    a2 AS (SELECT *, coalesce(b, '') AS bb, coalesce(n, '') AS nn FROM a), l AS (SELECT *, CASE WHEN {takes('bb')} THEN {head('s')} END AS lost FROM a2),
    o AS (SELECT *, CASE WHEN lost IS NULL THEN raw ELSE {strip('substr(s, length(lost) + 1)')} END AS own FROM l),
    g AS (SELECT *, {strip('own')} AS so FROM o), x AS (SELECT *, CASE WHEN {takes('so')} THEN {head('nn')} END AS gained FROM g)
    SELECT project_id, page_number, CASE WHEN gained IS NULL THEN own ELSE so || ' ' || {strip('gained')} END AS text FROM x"""

_MARK = r"<!-- PAGE_([0-9]+) -->\n*"
_LINE = r"regexp_extract(p, '^(#{1,2}\s+[^\n]+)', 1)"
_FULL = f"r.words + n.words > {S.TARGET_WORDS} AND r.words >= {S.LEAST_WORDS}"
_PREFIX = r"regexp_replace(x, '(?i)^(?:chapter[\s\p{Z}\x1c-\x1f\x{85}]+\p{Nd}+\.?[\s\p{Z}\x1c-\x1f\x{85}]*|#+[\s\p{Z}\x1c-\x1f\x{85}]*)', '', 'g')"
_TITLE = "regexp_replace(" + _LINE + r", '^#{1,2}\s+', '')"
_BODY = f"({strip(_LINE)} || chr(10) || chr(10) || {strip(r"regexp_replace(p, '^(#{1,2}\s+[^\n]+)', '')")})"
_KEY = "project_id, chapter, start_page"
#: ``sections``: project_id, chapter, start_page, section, title, first_page, last_page, words, text.
SECTIONS = rf"""
    RECURSIVE {_STARTS}, {FIRST},
    h AS (SELECT {_KEY}, end_page FROM (SELECT DISTINCT {_KEY}, end_page FROM c) QUALIFY row_number() OVER (PARTITION BY project_id, start_page ORDER BY chapter) = 1),
    w AS (SELECT h.project_id, chapter, start_page, end_page, string_agg('<!-- PAGE_' || page_number || ' -->' || chr(10) || coalesce(source_text, ''), chr(10) || chr(10) ORDER BY page_number) AS t
          FROM h JOIN f ON f.project_id = h.project_id AND page_number BETWEEN start_page AND end_page GROUP BY 1, 2, 3, 4),
    parts AS (SELECT {_KEY}, end_page, string_split(regexp_replace({tail('t')}, '(?:\n|^)(#{{1,2}}\s+[^\n])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM w),
    split AS (SELECT {_KEY}, end_page, unnest(range(len(ps))) AS n, unnest(ps) AS x FROM parts),
    e AS (SELECT {_KEY}, end_page, n, {strip('x')} AS p FROM split),
    titled AS (SELECT *, CASE WHEN regexp_matches(p, '^#{{1,2}}\s+[^\n]') THEN {strip(_TITLE)} ELSE '{S.INTRO_TITLE}' END AS title, CASE WHEN regexp_matches(p, '^#{{1,2}}\s+[^\n]') THEN {strip(_BODY)} ELSE p END AS body FROM e WHERE p <> ''),
    raw AS (SELECT *, {words('body')} AS words, row_number() OVER (PARTITION BY {_KEY} ORDER BY n) AS k FROM titled WHERE title <> '{S.INTRO_TITLE}' OR {words(f"regexp_replace(body, '{_MARK}', '', 'g')")} > {S.INTRO_WORDS}),
    named AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)^(?:chapter|فصل)\s+\p{{Nd}}+') AND words <= 100 THEN [] ELSE [title] END AS ts FROM raw),
    r AS (SELECT {_KEY}, end_page, k, 1 AS pack, ts AS titles, body AS text, words FROM named WHERE k = 1
          UNION ALL
          SELECT n.project_id, n.chapter, n.start_page, n.end_page, n.k, CASE WHEN {_FULL} THEN r.pack + 1 ELSE r.pack END, CASE WHEN {_FULL} THEN n.ts ELSE list_concat(r.titles, n.ts) END,
                 CASE WHEN {_FULL} THEN n.body ELSE r.text || chr(10) || chr(10) || n.body END, CASE WHEN {_FULL} THEN n.words ELSE r.words + n.words END
          FROM r JOIN named n ON n.project_id = r.project_id AND n.chapter = r.chapter AND n.start_page = r.start_page AND n.k = r.k + 1),
    last_of AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY {_KEY}, pack ORDER BY k DESC) = 1),
    packs AS (SELECT *, count(*) OVER c1 AS packs, lead(words) OVER c2 AS next_words, lead(text) OVER c2 AS next_text, lead(titles) OVER c2 AS next_titles FROM last_of WINDOW c1 AS (PARTITION BY {_KEY}), c2 AS (PARTITION BY {_KEY} ORDER BY pack)),
    tails AS (SELECT {_KEY}, end_page, pack, packs > 1 AND pack = packs AND words < {S.TAIL_WORDS} AS gone, CASE WHEN pack = packs - 1 AND next_words < {S.TAIL_WORDS} THEN text || chr(10) || chr(10) || next_text ELSE text END AS text,
                     CASE WHEN pack = packs - 1 AND next_words < {S.TAIL_WORDS} THEN list_concat(titles, next_titles) ELSE titles END AS titles FROM packs),
    pages_of AS (SELECT *, {strip(f"regexp_replace(text, '{_MARK}', '', 'g')")} AS clean, coalesce(list_min(list_transform(regexp_extract_all(text, '{_MARK}', 1), lambda x: x::INT)), start_page) AS first_page,
                     coalesce(list_max(list_transform(regexp_extract_all(text, '{_MARK}', 1), lambda x: x::INT)), end_page) AS last_page, list_filter(list_transform(titles, lambda x: {strip(_PREFIX)}), lambda x: x <> '') AS cs FROM tails WHERE NOT gone),
    sections AS (SELECT {_KEY}, pack::INT AS section, CASE WHEN len(cs) = 1 THEN cs[1] WHEN len(cs) = 2 THEN cs[1] || ' و ' || cs[2] WHEN len(cs) > 2 THEN cs[1] || '، ' || cs[2] || ' تا ' || cs[-1] ELSE 'سرفصل‌های صفحات ' || first_page || ' الی ' || last_page END AS title,
                        first_page, last_page, {words('clean')} AS words, clean AS text FROM pages_of)"""
