"""Queries of the column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import markdown as M
from folio.functions import persian as P
from folio.functions import text as T
from folio.plans import prose_sql
from folio.runtime import table

# Classes for the SQL side, whose engine knows Unicode classes but no lookaround.
W = r"[^\p{L}\p{N}_]"
S = r"[\s\p{Z}\x1c-\x1f\x{85}]"
L = r"[\x{0621}-\x{06CC}]"
Z = "‌"


def _persian(spark: SparkSession, directory: str) -> DataFrame:
    """Translations with the non-joiners taken out again, so that the rules have work."""
    pages = table(spark, directory, "pages").where("latest_translation is not null").select("id", "latest_translation").distinct()
    return pages.select(F.col("id").alias("page_id"), F.translate("latest_translation", Z, " ").alias("t"))


PERSIAN_SQL = f"WITH p AS (SELECT DISTINCT id AS page_id, translate(latest_translation, '{Z}', ' ') AS t FROM pages WHERE latest_translation IS NOT NULL)"


def _per_page(*made):
    def query(spark: SparkSession, directory: str) -> DataFrame:
        return _persian(spark, directory).select("page_id", *(f("t").alias(name) for name, f in made))

    return query


def _edge_twice(pattern: str, to: str, x: str) -> str:
    """A rule with captured borders, run twice: a border that one match takes is missing for the next."""
    return f"regexp_replace(regexp_replace({x}, '{pattern}', '{to}', 'g'), '{pattern}', '{to}', 'g')"


SQL_VERBS = f"regexp_replace(t, '(^|{W})(ن?می){S}+({L}{{2,}})', '\\1\\2{Z}\\3', 'g')"
SQL_PREFIXES = _edge_twice(f"(^|{W})(بی){S}+({L}{{2,}})($|{W})", f"\\1\\2{Z}\\3\\4", _edge_twice(f"(^|{W})(به){S}+({'|'.join(P.BE_WORDS)})($|{W})", f"\\1\\2{Z}\\3\\4", "t"))
SQL_SUFFIXES = f"regexp_replace(t, '({L}+){S}+({'|'.join(P.SUFFIXES)})($|{W})', '\\1{Z}\\2\\3', 'g')"
SQL_POSSESSIVES = f"regexp_replace(t, '({L}+[هة]){S}+({'|'.join(P.POSSESSIVES)})($|{W})', '\\1{Z}\\2\\3', 'g')"


def code_spans(spark: SparkSession, directory: str) -> DataFrame:
    """Every fenced block of every page with its language and number."""
    pages = table(spark, directory, "pages").where("source_text <> ''").select("id", "source_text").distinct()
    found = pages.select(F.col("id").alias("page_id"), F.posexplode(M.blocks("source_text", M.FENCED)).alias("n", "block"))
    return found.withColumn("language", M.code_language(F.regexp_replace("block", r"^```[^\n]*\n|```$", "")))


def masks(spark: SparkSession, directory: str) -> DataFrame:
    """Pages with code and images masked, and whether unmasking gives all blocks back."""
    pages = table(spark, directory, "pages").where("source_text <> ''").select("id", "source_text").distinct()
    code, image = M.blocks("source_text", M.FENCED), M.blocks("source_text", M.IMAGE)
    return pages.select(
        F.col("id").alias("page_id"),
        M.masked_code("source_text").alias("code_masked"),
        M.masked_images("source_text").alias("images_masked"),
        F.size(code).alias("code_blocks"),
        F.size(image).alias("image_blocks"),
        M.unmasked(M.masked_code("source_text"), code, "CODE_BLOCK").alias("code_restored"),
        M.only_code_or_media("source_text").alias("media_only"),
    )


def media_only_sql(x: str) -> str:
    """Whether nothing is left of a text without code, images, rules, digits and punctuation."""
    left = rf"regexp_replace(regexp_replace(regexp_replace({x}, '```[a-zA-Z0-9_-]*\n[\s\S]*?```', '', 'g'), '!\[[^\]]*\]\([^)]+\)', '', 'g'), '(?m)^[ \t]*[-*_]{{3,}}[ \t]*$', '', 'g')"
    return rf"""length(regexp_replace({left}, '[\s\p{{Z}}\x1c-\x1f\x{{85}}\p{{Nd}}.,:;!?"''()\[\]{{}}\-_/\\|><+=*&^%$#@~`]+', '', 'g')) = 0"""


MASKS_SQL = r"""
    WITH p AS (SELECT DISTINCT id AS page_id, source_text AS t FROM pages WHERE source_text <> ''),
    q AS (SELECT *, regexp_extract_all(t, '```[a-zA-Z0-9_-]*\n[\s\S]*?```') AS c, regexp_extract_all(t, '!\[[\s\S]*?\]\([^\n]*?\)') AS i,
                 regexp_split_to_array(t, '```[a-zA-Z0-9_-]*\n[\s\S]*?```') AS cp, regexp_split_to_array(t, '!\[[\s\S]*?\]\([^\n]*?\)') AS ip FROM p),
    m AS (SELECT *, array_to_string(list_transform(range(1, len(cp) + 1), lambda k: CASE WHEN k = 1 THEN cp[k] ELSE chr(10) || chr(10) || '[[CODE_BLOCK_' || (k - 2) || ']]' || chr(10) || chr(10) || cp[k] END), '') AS code_masked,
                 array_to_string(list_transform(range(1, len(ip) + 1), lambda k: CASE WHEN k = 1 THEN ip[k] ELSE chr(10) || chr(10) || '[[IMAGE_BLOCK_' || (k - 2) || ']]' || chr(10) || chr(10) || ip[k] END), '') AS images_masked,
                 array_to_string(list_transform(range(1, len(cp) + 1), lambda k: CASE WHEN k = 1 THEN cp[k] ELSE chr(10) || chr(10) || c[k - 1] || chr(10) || chr(10) || cp[k] END), '') AS back FROM q)
    SELECT page_id, code_masked, images_masked, len(c)::INT AS code_blocks, len(i)::INT AS image_blocks,
           CASE WHEN len(c) = 0 THEN code_masked ELSE regexp_replace(back, '^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$', '', 'g') END AS code_restored,
           length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '```[a-zA-Z0-9_-]*\n[\s\S]*?```', '', 'g'), '!\[[^\]]*\]\([^)]+\)', '', 'g'),
                  '(?m)^[ \t]*[-*_]{3,}[ \t]*$', '', 'g'), '[\s\p{Z}\x1c-\x1f\x{85}\p{Nd}.,:;!?"''()\[\]{}\-_/\\|><+=*&^%$#@~`]+', '', 'g')) = 0 AS media_only
    FROM m"""


def paragraphs(spark: SparkSession, directory: str) -> DataFrame:
    """Paragraphs of the articles with their kind and number of words."""
    articles = table(spark, directory, "fetched_articles").where("markdown <> ''").select("article_id", "markdown").distinct()
    cut = articles.select("article_id", F.posexplode(F.split("markdown", r"\n{2,}")).alias("n", "p")).where(T.has_text("p"))
    return cut.select("article_id", "n", M.block_type("p").alias("kind"), T.word_count("p").alias("words"), M.is_generic_caption("p").alias("generic_caption"))


def page_text_views(spark: SparkSession, directory: str) -> DataFrame:
    """What lists and readers show of a page's texts."""
    pages = table(spark, directory, "pages").select("id", "project_id", "page_number", "source_text", "latest_translation", "approved_text").distinct()
    shown = T.best_text("approved_text", "latest_translation")
    return pages.select(
        F.col("id").alias("page_id"),
        T.preview(shown).alias("preview"),
        T.has_text("source_text").alias("has_text"),
        T.word_count(T.best_text("approved_text", "latest_translation", "source_text")).alias("words"),
        T.unix_lines("source_text").alias("clean_source"),
        shown.isNotNull().alias("readable"),
        F.concat(F.lit("/api/projects/"), "project_id", F.lit("/pages/"), F.col("page_number").cast("string"), F.lit("/image")).alias("image_url"),
        F.concat(F.lit("/api/projects/"), "project_id", F.lit("/pages/"), F.col("page_number").cast("string"), F.lit("/thumbnail")).alias("thumbnail_url"),
        F.when(F.col("page_number") > 1, F.col("page_number") - 1).alias("previous_page"),
    )


def canned_answers(spark: SparkSession, directory: str) -> DataFrame:
    talks = table(spark, directory, "page_conversations").select("id", "answer").distinct()
    return talks.select(F.col("id").alias("conversation_id"), M.is_canned("answer").alias("canned"), M.without_wrapper("answer").alias("answer"))


def without_tails(spark: SparkSession, directory: str) -> DataFrame:
    """Articles cut at their closing headings; references are hung on so that the second rule has work."""
    articles = table(spark, directory, "fetched_articles").select("article_id", "markdown").distinct()
    tail = F.lit("\n\n[1] a 2001\n[2] b 2002\n[3] c 2003\n")
    return articles.select("article_id", M.without_tail(F.concat("markdown", tail)).alias("body"), M.without_tail(F.concat("markdown", F.lit("\n## References\nx\n"))).alias("before_references"))


def addresses(spark: SparkSession, directory: str) -> DataFrame:
    """Checks and parts of article addresses."""
    articles = table(spark, directory, "fetched_articles").select("article_id", "title", "final_url").distinct()
    return articles.select(
        "article_id",
        M.is_web_address("final_url").alias("valid"),
        F.coalesce(F.try_parse_url("final_url", F.lit("PROTOCOL")).isin("http", "https") & (F.length(F.try_parse_url("final_url", F.lit("HOST"))) > 0), F.lit(False)).alias("fetchable"),
        M.safe_name(F.coalesce(T.filled(T.strip("title")), "final_url")).alias("file_name"),
        F.coalesce(T.filled(T.strip("title")), "final_url").alias("shown_title"),
        M.clean_alt("title").alias("alt"),
    )


def image_tags(spark: SparkSession, directory: str) -> DataFrame:
    """First occurrence of every image of a page with the place its address names and the best of a set of sources."""
    pages = table(spark, directory, "pages").where("source_text <> ''").select("id", "source_text").distinct()
    tags = pages.select(F.col("id").alias("page_id"), F.posexplode(F.array_distinct(M.blocks("source_text", M.IMAGE))).alias("n", "tag"))
    url = F.regexp_extract("tag", r"\]\(([^)]*)\)", 1)
    moved = F.regexp_replace(url, r"/images/page_([0-9]+)_img_([0-9]+)\.png", "/pages/$1/images/$2")
    place = M.image_place(moved)
    return tags.select("page_id", "n", url.alias("url"), place["page"].alias("page"), place["image"].alias("image"), M.best_source(F.concat(url, F.lit(" 320w, b.png 640w, c.png 2x, d.png"))).alias("best"))


QUERIES = {
    "fa_digits": _per_page(("persian", P.persian_digits), ("latin", P.latin_digits)),
    "fa_letters": _per_page(("letters", P.persian_letters), ("plain", P.without_tatweel), ("bare", P.without_diacritics)),
    "fa_zwnj_verbs": _per_page(("text", P.joined_verbs)),
    "fa_zwnj_prefixes": _per_page(("text", P.joined_prefixes)),
    "fa_zwnj_suffixes": _per_page(("text", P.joined_suffixes)),
    "fa_zwnj_possessives": _per_page(("text", P.joined_possessives)),
    "fa_punctuation": _per_page(("text", P.persian_punctuation)),
    "fa_spacing": _per_page(("text", P.punctuation_spacing)),
    "fa_clean_prose": _per_page(("text", lambda c: P.clean_prose(P.composed_where_needed(c)))),
    "code_spans": code_spans,
    "masks": masks,
    "paragraphs": paragraphs,
    "page_text_views": page_text_views,
    "canned_answers": canned_answers,
    "without_tails": without_tails,
    "addresses": addresses,
    "image_tags": image_tags,
}

_STRIP = lambda x: f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"
_PUNCT = f"regexp_replace(regexp_replace(regexp_replace(translate(t, '?;', '؟؛'), '({L}){S}*,{S}*', '\\1، ', 'g'), ',{S}*({L})', '، \\1', 'g'), '[ \\t]*—[ \\t]*', '، ', 'g')"
_TITLES = "|".join(x.replace(T.WS, S[1:-1]) for x in M.TAIL_TITLES)
tail = lambda x: _STRIP(f"regexp_replace({_STRIP(f"regexp_replace({x}, '(?i)(?:\\n|^){S}*#{{1,3}}{S}*(?:{_TITLES})($|{W}[\\s\\S]*$)', '')")}, '(?:\\n{S}*\\[\\p{{Nd}}+\\][^\\n]+){{3,}}{S}*$', '')")

#: The languages of code in SQL: no lookahead, so the marks of JSON are looked for one by one.
_JSON = r"""regexp_matches(body, '\A\s*(?:\{[\s\S]*\}|\[[\s\S]*\])\s*\z') AND contains(body, '"') AND contains(body, ':')"""
LANGUAGE = " ".join(f"WHEN {_JSON if name == 'json' else "regexp_matches(body, '(?m)" + pattern.replace("'", "''") + "')"} THEN '{name}'" for name, pattern in M.CODE_LANGUAGES)

SQL = {
    "fa_spacing": f"{PERSIAN_SQL}, {prose_sql.chain('q', 'p', 'page_id', prose_sql.SPACING)} SELECT page_id, t AS text FROM q",
    "fa_clean_prose": f"{PERSIAN_SQL}, {prose_sql.chain('q', 'p', 'page_id', prose_sql.PROSE, 'nfc_normalize(t)')} SELECT page_id, t AS text FROM q",
    "code_spans": rf"""
        WITH p AS (SELECT DISTINCT id AS page_id, source_text AS t FROM pages WHERE source_text <> ''),
        c AS (SELECT page_id, regexp_extract_all(t, '```[a-zA-Z0-9_-]*\n[\s\S]*?```') AS cs FROM p),
        e AS (SELECT page_id, unnest(range(len(cs)))::INT AS n, unnest(cs) AS block FROM c),
        b AS (SELECT *, regexp_replace(block, '^```[^\n]*\n|```$', '', 'g') AS body FROM e)
        SELECT page_id, n, block, CASE {LANGUAGE} ELSE '' END AS language FROM b""",
    "fa_digits": f"{PERSIAN_SQL} SELECT page_id, translate(t, '0123456789٠١٢٣٤٥٦٧٨٩', '۰۱۲۳۴۵۶۷۸۹۰۱۲۳۴۵۶۷۸۹') AS persian, translate(t, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789') AS latin FROM p",
    "fa_letters": f"{PERSIAN_SQL} SELECT page_id, replace(translate(t, '{P.ARABIC_LETTERS[0]}', '{P.ARABIC_LETTERS[1]}'), '{P.HEH_WITH_YEH[0]}', '{P.HEH_WITH_YEH[1]}') AS letters, replace(t, '{P.TATWEEL}', '') AS plain, regexp_replace(t, '[{P.DIACRITICS}]', '', 'g') AS bare FROM p",
    "fa_zwnj_verbs": f"{PERSIAN_SQL} SELECT page_id, {SQL_VERBS} AS text FROM p",
    "fa_zwnj_prefixes": f"{PERSIAN_SQL} SELECT page_id, {SQL_PREFIXES} AS text FROM p",
    "fa_zwnj_suffixes": f"{PERSIAN_SQL} SELECT page_id, {SQL_SUFFIXES} AS text FROM p",
    "fa_zwnj_possessives": f"{PERSIAN_SQL} SELECT page_id, {SQL_POSSESSIVES} AS text FROM p",
    "fa_punctuation": f"""{PERSIAN_SQL}, q AS (SELECT page_id, {_PUNCT} AS t FROM p), r AS (SELECT *, string_split(t, '"') AS parts FROM q)
        SELECT page_id, CASE WHEN len(parts) > 2 THEN array_to_string(list_transform(range(1, len(parts) + 1), lambda k: CASE WHEN k = 1 THEN parts[k] WHEN k % 2 = 0 THEN '«' || parts[k] ELSE '»' || parts[k] END), '') ELSE t END AS text FROM r""",
    "masks": MASKS_SQL,
    "paragraphs": rf"""
        WITH a AS (SELECT DISTINCT article_id, markdown FROM fetched_articles WHERE markdown <> ''),
        c AS (SELECT article_id, regexp_split_to_array(markdown, '\n{{2,}}') AS ps FROM a),
        e AS (SELECT article_id, unnest(range(len(ps)))::INT AS n, unnest(ps) AS p FROM c),
        s AS (SELECT *, {_STRIP('p')} AS x FROM e)
        SELECT article_id, n, CASE WHEN regexp_matches(x, '^!\[[^\]]*\]\([^)]*\)') THEN 'image' WHEN starts_with(x, '# ') THEN 'h1' WHEN starts_with(x, '## ') THEN 'h2' WHEN starts_with(x, '### ') THEN 'h3'
               WHEN starts_with(x, '- ') OR starts_with(x, '* ') THEN 'bullet' WHEN regexp_matches(x, '^\p{{Nd}}+\.{S}') THEN 'numbered' WHEN starts_with(x, '>') THEN 'quote' ELSE 'body' END AS kind,
               len(regexp_extract_all(p, '[^{S[1:-1]}]+'))::INT AS words, regexp_matches(x, '(?i)^(figure[\s/_-]*diagram|image|تصویر|نمودار)\s*\p{{Nd}}*$') AS generic_caption
        FROM s WHERE x <> ''""",
    "page_text_views": rf"""
        WITH p AS (SELECT DISTINCT id, project_id, page_number, source_text, latest_translation, approved_text FROM pages),
        q AS (SELECT *, coalesce(nullif(approved_text, ''), nullif(latest_translation, '')) AS shown FROM p)
        SELECT id AS page_id, CASE WHEN length(shown) > 120 THEN left(shown, 120) || '...' ELSE shown END AS preview, coalesce({_STRIP('source_text')} <> '', false) AS has_text,
               coalesce(len(regexp_extract_all(coalesce(shown, nullif(source_text, '')), '[^{S[1:-1]}]+')), 0)::INT AS words, {_STRIP("regexp_replace(source_text, '\\r\\n?', chr(10), 'g')")} AS clean_source,
               shown IS NOT NULL AS readable, '/api/projects/' || project_id || '/pages/' || page_number || '/image' AS image_url, '/api/projects/' || project_id || '/pages/' || page_number || '/thumbnail' AS thumbnail_url, CASE WHEN page_number > 1 THEN page_number - 1 END AS previous_page FROM q""",
    "canned_answers": rf"""SELECT DISTINCT id AS conversation_id, coalesce(length({_STRIP('answer')}) < 320 AND regexp_matches(answer, '{M.CANNED.replace(T.WS, S[1:-1])}'), false) AS canned,
        {_STRIP("regexp_replace(answer, '(?i)</?(?:source_document|translation)>', '', 'g')")} AS answer FROM page_conversations""",
    "without_tails": f"""WITH a AS (SELECT DISTINCT article_id, markdown FROM fetched_articles)
        SELECT article_id, {tail("(markdown || chr(10) || chr(10) || '[1] a 2001' || chr(10) || '[2] b 2002' || chr(10) || '[3] c 2003' || chr(10))")} AS body, {tail("(markdown || chr(10) || '## References' || chr(10) || 'x' || chr(10))")} AS before_references FROM a""",
    "addresses": rf"""
        WITH a AS (SELECT DISTINCT article_id, title, final_url FROM fetched_articles), b AS (SELECT *, coalesce(nullif({_STRIP('title')}, ''), final_url) AS shown_title FROM a)
        SELECT article_id, coalesce(regexp_matches(final_url, '(?i)^https?://\S+$'), false) AS valid, coalesce(regexp_matches(final_url, '^https?://[^/?#:]+'), false) AS fetchable,
               left(regexp_replace(shown_title, '[\\/*?:"<>| ]', '_', 'g'), 40) AS file_name, shown_title,
               coalesce(nullif(left({_STRIP(f"regexp_replace(regexp_replace(title, '[\\[\\]()\\n\\r\\t]+', ' ', 'g'), '{S}{{2,}}', ' ', 'g')")}, 150), ''), 'Figure/Diagram') AS alt FROM b""",
    "image_tags": r"""
        WITH p AS (SELECT DISTINCT id, source_text FROM pages WHERE source_text <> ''),
        t AS (SELECT id, regexp_extract_all(source_text, '!\[[\s\S]*?\]\([^\n]*?\)') AS tags FROM p),
        e AS (SELECT id, unnest(range(len(tags))) AS k, unnest(tags) AS tag FROM t),
        f AS (SELECT id, tag, min(k) AS k FROM e GROUP BY 1, 2),
        u AS (SELECT id AS page_id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INT AS n, regexp_extract(tag, '\]\(([^)]*)\)', 1) AS url FROM f)
        SELECT page_id, n, url, nullif(regexp_extract(url, '/images/page_([0-9]+)_img_([0-9]+)\.png', 1), '')::INT AS page, nullif(regexp_extract(url, '/images/page_([0-9]+)_img_([0-9]+)\.png', 2), '')::INT AS image, 'c.png' AS best FROM u""",
}
