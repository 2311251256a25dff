"""Queries of prompts, repairs and the stand-in model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import sinks
from folio.functions import markdown as M
from folio.functions import repair
from folio.functions import text as T
from folio.operators import glossary as G
from folio.operators import prompts as Q
from folio.operators import relational as R
from folio.plans import prose_sql
from folio.plans.prose_sql import strip
from folio.plans.scalars import media_only_sql
from folio.plans.sections_sql import SECTIONS
from folio.plans.segmenting import chapter_sections
from folio.plans.views import SQL as VIEWS
from folio.runtime import table

TEMPLATE = 'متن مورد سوال از کتاب:\n"""\n{selected_text}\n"""\n\nکانتکست صفحه:\n"""\n{page_text}\n"""\n\nسوال:\n{question}'


def _pages(spark: SparkSession, directory: str) -> DataFrame:
    return R.once(table(spark, directory, "pages"), "id", "project_id", "source_text").where("source_text is not null").withColumnRenamed("id", "page_id")


def _with_terms(spark: SparkSession, directory: str) -> DataFrame:
    return G.with_terms(_pages(spark, directory), "source_text", table(spark, directory, "glossary_items"), "project_id")


def translation_prompts(spark: SparkSession, directory: str) -> DataFrame:
    """What a model is sent for each page: the masked text with the terms it holds, the ends of its neighbours and the rules for tokens."""
    projects = table(spark, directory, "projects").select(F.col("id").alias("project_id"), "source_language", "target_language")
    resolved = R.resolved_profiles(table(spark, directory, "projects"), table(spark, directory, "translation_profiles"))
    system = table(spark, directory, "translation_profiles").select(F.col("id").alias("profile_id"), "system_prompt")
    about = projects.join(resolved, "project_id").join(system, "profile_id", "left")
    context = R.neighbour_context(table(spark, directory, "pages"))
    joined = _with_terms(spark, directory).withColumn("coded", M.masked_code("source_text")).join(about, "project_id").join(context, "page_id", "left")
    code, images = F.size(M.blocks("source_text", M.FENCED)) > 0, F.size(M.blocks("coded", M.IMAGE)) > 0
    notes = Q.context_notes(F.col("before"), F.col("after"), code, images, F.concat(F.lit("Page of "), "source_language"))
    return joined.select("page_id", Q.translation_prompt(M.masked_images("coded"), F.col("source_language"), F.col("target_language"), F.col("system_prompt"), F.col("terms"), notes).alias("prompt"))


def question_prompts(spark: SparkSession, directory: str) -> DataFrame:
    talks = R.once(table(spark, directory, "page_conversations"), "id", "project_id", "page_number", "selected_text", "question")
    history = R.conversation_history(table(spark, directory, "page_conversations"))
    pages = R.first_by(R.once(table(spark, directory, "pages"), "id", "project_id", "page_number", "created_at", "source_text", "latest_translation", "approved_text"), ["project_id", "page_number"], F.col("created_at"), F.col("id"))
    text = pages.select("project_id", "page_number", T.best_text("approved_text", "latest_translation", "source_text").alias("page_text"))
    joined = talks.join(text, ["project_id", "page_number"], "left").join(history.withColumnRenamed("conversation_id", "id"), "id")
    return joined.select(F.col("id").alias("conversation_id"), Q.question_prompt(F.lit(TEMPLATE), F.col("page_text"), F.col("selected_text"), F.col("question"), F.col("history")).alias("prompt"))


def mock_translate(spark: SparkSession, directory: str) -> DataFrame:
    return _with_terms(spark, directory).select("page_id", Q.mock_translation(F.col("source_text"), F.col("terms")).alias("translation"))


def translate_pipeline(spark: SparkSession, directory: str) -> DataFrame:
    return Q.translated(_with_terms(spark, directory))


def translation_attempt_rows(spark: SparkSession, directory: str) -> DataFrame:
    """The attempts that translating every page anew would add."""
    made = Q.attempts(translate_pipeline(spark, directory), table(spark, directory, "translation_attempts"), "mock", "mock-model")
    return made.select("page_id", "version_number", "provider_name", "model_name", "is_approved", F.length("raw_response").alias("characters"))


def section_prompts(spark: SparkSession, directory: str) -> DataFrame:
    sections = chapter_sections(spark, directory)
    template = F.lit("{chapter_title} ({start_page}-{end_page}):\n{content_text}")
    return sections.select("project_id", "chapter", "section", Q.section_prompt(template, F.col("chapter"), F.col("title"), F.col("first_page"), F.col("last_page"), F.col("text")).alias("prompt"), Q.progress(F.col("section") - 1, F.count("*").over(R.W.partitionBy("project_id", "chapter"))).alias("progress"))


def open_notes(spark: SparkSession, directory: str) -> DataFrame:
    """Sections without a note when every other section has one, every fourth of them empty."""
    sections = chapter_sections(spark, directory).select("project_id", "chapter", "section", "title")
    notes = sections.where("section % 2 = 1").select("project_id", "chapter", F.col("section").alias("section_index"), F.col("title").alias("section_title"), F.when(F.col("section") % 4 == 1, "").otherwise("note").alias("note"))
    return Q.open_sections(sections, notes)


def _reader():
    """A stand-in that gives the text of a section back, but answers every second request with an acknowledgement first."""

    def ask(prompts: list[str | None]) -> list[str | None]:
        texts = [p.split(Q.NOTES_ONLY)[0].split("\n<text>\n", 1)[-1] for p in prompts]
        return ["بله، بفرستید" if len(t) % 2 and not p.startswith(Q.STRICT) else t for p, t in zip(prompts, texts, strict=True)]

    return ask


def chapter_notes(spark: SparkSession, directory: str) -> DataFrame:
    """Notes of all sections when every other one has a note, every fourth of them empty."""
    sections = chapter_sections(spark, directory)
    notes = sections.where("section % 2 = 1").select("project_id", "chapter", F.col("section").alias("section_index"), F.col("title").alias("section_title"), F.when(F.col("section") % 4 == 1, "").otherwise("note").alias("note"))
    return Q.made_notes(sections, notes, F.lit("{chapter_title}\n<text>\n{content_text}"), _reader).select("project_id", "chapter", "section", "note")


def _notes(sections: DataFrame) -> DataFrame:
    """Notes of chapters kept as JSON; the text of a section stands for its note."""
    note = F.struct(F.col("section").alias("section_index"), F.col("title").alias("section_title"), F.col("first_page").alias("start_page"), F.col("last_page").alias("end_page"), F.col("words").alias("word_count"), F.col("text").alias("note"))
    grouped = sections.groupBy("project_id", "chapter", "start_page")
    return grouped.agg(F.to_json(F.array_sort(F.collect_list(note))).alias("notes"), F.min("first_page").alias("first"), F.max("last_page").alias("last"))


def chapter_question_texts(spark: SparkSession, directory: str) -> DataFrame:
    """What a question about the second section or the whole chapter is asked on."""
    kept = _notes(chapter_sections(spark, directory))
    return kept.select("project_id", "chapter", Q.chapter_question_text(F.col("notes"), F.lit(2)).alias("second"), Q.chapter_question_text(F.col("notes"), F.lit(None).cast("int")).alias("whole"))


def note_exports(spark: SparkSession, directory: str) -> DataFrame:
    kept = _notes(chapter_sections(spark, directory))
    first, last, chapter = (F.col(c) for c in ("first", "last", "chapter"))
    return kept.select("project_id", sinks.notes_file_name(first, last, chapter, "md").alias("file"), sinks.notes_markdown(chapter, first, last, F.col("notes")).alias("markdown"))


def cleaned_markdown(spark: SparkSession, directory: str) -> DataFrame:
    pages = R.once(table(spark, directory, "pages"), "id", "latest_translation").where("latest_translation is not null")
    return repair.clean_markdown(pages.select(F.col("id").alias("page_id"), F.translate("latest_translation", "\u200c", " ").alias("text")), "text")


def repaired_markdown(spark: SparkSession, directory: str) -> DataFrame:
    """Emphasis and fences of articles put right, after blanks were moved inside the signs of their notes."""
    articles = R.once(table(spark, directory, "fetched_articles"), "article_id", "markdown").where("markdown is not null")
    spoilt = F.replace("markdown", F.lit("**See also** "), F.lit("**See also **"))
    return articles.select("article_id", repair.tidied_fences(repair.emphasis(spoilt)).alias("text"))


def restored_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """Pages masked and restored from garbled tokens."""
    pages = _pages(spark, directory)
    garbled = F.regexp_replace(M.masked_code("source_text"), r"\[\[CODE_BLOCK_", r"[[ CODE\\\\_BLOCK\\\\_")
    images = repair.restored_images(F.regexp_replace(M.masked_images("source_text"), "_", " "), "source_text")
    answer = F.concat(F.lit("see [[IMAGE_BLOCK_۰]]: "), "source_text")
    return pages.select("page_id", repair.restored_code(garbled, "source_text").alias("code"), images.alias("images"), repair.answered_images(answer, "source_text").alias("answer"))


QUERIES = {
    "translation_prompts": translation_prompts,
    "question_prompts": question_prompts,
    "mock_translate": mock_translate,
    "translate_pipeline": translate_pipeline,
    "translation_attempt_rows": translation_attempt_rows,
    "note_exports": note_exports,
    "section_prompts": section_prompts,
    "open_notes": open_notes,
    "chapter_notes": chapter_notes,
    "note_progress": lambda spark, directory: Q.finished_sections(chapter_notes(spark, directory)),
    "chapter_question_texts": chapter_question_texts,
    "clean_markdown": cleaned_markdown,
    "repaired_markdown": repaired_markdown,
    "restored_blocks": restored_blocks,
}

_UNIX = lambda x: strip(f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')")
_FENCED, _IMAGE = r"```[a-zA-Z0-9_-]*\n[\s\S]*?```", r"!\[[\s\S]*?\]\([^\n]*?\)"
_P = "p AS (SELECT DISTINCT id, project_id, source_text FROM pages WHERE source_text IS NOT NULL)"
#: The terms each page holds, sorted; of one term the project's own.
_TERMS = f"""tm AS (SELECT project_id, {strip('source_term')} AS s, min({{'t': target_term, 'b': include_parenthesis_english}}) AS x FROM glossary_items WHERE source_term IS NOT NULL GROUP BY 1, 2),
    hit AS (SELECT p.id, s, x FROM p JOIN tm ON (tm.project_id IS NULL OR tm.project_id = p.project_id) AND s <> '' AND contains(lower(source_text), lower(s)) QUALIFY row_number() OVER (PARTITION BY p.id, p.project_id, source_text, s ORDER BY tm.project_id NULLS LAST) = 1),
    pt AS (SELECT id, list({{'s': s, 't': x.t, 'b': x.b}} ORDER BY s) AS terms FROM hit GROUP BY 1)"""


def _masked(parts: str, name: str) -> str:
    token = f"chr(10) || chr(10) || '[[{name}_BLOCK_' || (k - 2) || ']]' || chr(10) || chr(10)"
    return f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda k: CASE WHEN k = 1 THEN '' ELSE {token} END || {parts}[k]), '')"


def _unmasked(text: str, blocks: str, name: str) -> str:
    """Tokens replaced by their blocks through the parts between them; every token is there."""
    parts = f"regexp_split_to_array({text}, '\\[\\[{name}_BLOCK_[0-9]+\\]\\]')"
    return f"CASE WHEN len({blocks}) = 0 THEN {text} ELSE {strip(f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda k: CASE WHEN k = 1 THEN '' ELSE {blocks}[k - 1] END || {parts}[k]), '')")} END"


_MASKS = f"""mc AS (SELECT *, regexp_extract_all(source_text, '{_FENCED}') AS code, regexp_split_to_array(source_text, '{_FENCED}') AS cp FROM p),
    md AS (SELECT *, {_masked('cp', 'CODE')} AS coded FROM mc),
    mi AS (SELECT *, regexp_extract_all(coded, '{_IMAGE}') AS tags, regexp_split_to_array(coded, '{_IMAGE}') AS ip FROM md),
    ms AS (SELECT *, {_masked('ip', 'IMAGE')} AS masked FROM mi)"""


def _mock(text: str) -> str:
    """The stand-in's answer to a text, with ``terms`` at hand."""
    line = f"""CASE WHEN {strip('line')} = '' THEN '' WHEN regexp_matches(line, '^\\s*\\[\\[(?:CODE|IMAGE)_BLOCK_[0-9]+\\]\\]\\s*$') THEN line WHEN starts_with(line, '#') THEN line || '{Q.MOCK_SUFFIX}'
        ELSE list_reduce(list_prepend('{Q.MOCK_PREFIX}' || line, list_transform(coalesce(terms, []), lambda g: g.s || chr(1) || CASE WHEN g.b THEN g.t || ' (' || g.s || ')' ELSE g.t END)),
               lambda acc, g: CASE WHEN contains(lower(line), lower(split_part(g, chr(1), 1))) THEN replace(acc, split_part(g, chr(1), 1), split_part(g, chr(1), 2)) ELSE acc END) END"""
    return f"array_to_string(list_transform(string_split({strip(text)}, chr(10)), lambda line: {line}), chr(10))"


_TRANSLATED = f"""WITH {_P}, {_TERMS}, {_MASKS},
    said AS (SELECT ms.id, source_text, code, tags, {_mock('masked')} AS m FROM ms LEFT JOIN pt USING (id)), si AS (SELECT *, {_unmasked('m', 'tags', 'IMAGE')} AS n FROM said), sc AS (SELECT id, source_text, {_unmasked('n', 'code', 'CODE')} AS t FROM si), {prose_sql.clean('cl', 'sc', 'id, source_text')},
    tr AS (SELECT id AS page_id, {media_only_sql('source_text')} AS media, source_text, t FROM cl), done AS (SELECT page_id, NOT media AS asked, CASE WHEN media THEN {strip('source_text')} ELSE t END AS translation FROM tr)"""
_KEPT = f"""{SECTIONS}, n AS (SELECT *, CASE WHEN section % 4 = 1 THEN '' ELSE 'note' END AS note FROM sections WHERE section % 2 = 1),
    k AS (SELECT project_id, chapter, title, arg_max(note, section) AS by_title FROM n WHERE title IS NOT NULL GROUP BY 1, 2, 3), i AS (SELECT project_id, chapter, section, max(note) AS by_number FROM n GROUP BY 1, 2, 3),
    kept AS (SELECT s.project_id, s.chapter, s.section, s.title, s.text, coalesce(CASE WHEN k.by_title IS NOT NULL THEN k.by_title ELSE i.by_number END, '') AS note FROM sections s LEFT JOIN k USING (project_id, chapter, title) LEFT JOIN i ON i.project_id = s.project_id AND i.chapter = s.chapter AND i.section = s.section)"""
_NOTED = f"""WITH {_KEPT}, q AS (SELECT project_id, chapter, section, note, text AS t FROM kept), {prose_sql.clean('cl', 'q', 'project_id, chapter, section, note')},
    noted AS (SELECT project_id, chapter, section, CASE WHEN note = '' THEN {strip('t')} ELSE note END AS note FROM cl)"""
_QUOTE = "CASE WHEN coalesce(selected_text, '') <> '' THEN ' (نقل‌قول مربوطه: «' || left(selected_text, 60) || '...»)' ELSE '' END"
_TURNS = f"""c AS (SELECT DISTINCT id, project_id, page_number, selected_text, question, answer, created_at FROM page_conversations),
    hs AS (SELECT *, coalesce(list('کاربر: ' || question || {_QUOTE} || chr(10) || 'پاسخ دستیار: ' || answer) FILTER (WHERE question IS NOT NULL AND answer IS NOT NULL) OVER (PARTITION BY project_id, page_number ORDER BY created_at, id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []) AS history FROM c)"""

SQL = {
    "translation_prompts": f"""
        WITH {_P}, {_TERMS}, {_MASKS}, near AS ({VIEWS['neighbour_context']}), prof AS ({VIEWS['profile_resolution']}),
        a AS (SELECT ms.id, ms.project_id, masked, len(code) > 0 AS has_code, len(tags) > 0 AS has_images, j.source_language AS sl, j.target_language AS tl, system_prompt, terms, before, after
              FROM ms JOIN projects j ON j.id = ms.project_id JOIN prof ON prof.project_id = j.id LEFT JOIN translation_profiles f ON f.id = prof.profile_id LEFT JOIN pt ON pt.id = ms.id LEFT JOIN near ON near.page_id = ms.id),
        b AS (SELECT *, concat_ws(chr(10), CASE WHEN before <> '' THEN '{Q.BEFORE[0].replace("'", "''")}' || before || '{Q.BEFORE[1].replace("'", "''")}' END, CASE WHEN after <> '' THEN '{Q.AFTER[0].replace("'", "''")}' || after || '{Q.AFTER[1].replace("'", "''")}' END) AS ends FROM a),
        n AS (SELECT *, CASE WHEN ends <> '' THEN '{Q.BOUNDARY_HEAD}' || chr(10) || ends || chr(10) || '{Q.BOUNDARY_RULE.replace("'", "''")}' ELSE '' END || CASE WHEN has_code THEN chr(10) || chr(10) || '{Q.CODE_RULE}' ELSE '' END
                     || CASE WHEN has_images THEN chr(10) || chr(10) || '{Q.IMAGE_RULE}' ELSE '' END || coalesce(chr(10) || chr(10) || '{Q.INSTRUCTIONS}Page of ' || sl, '') AS notes, {_UNIX("coalesce(system_prompt, '')")} AS head, {_UNIX('masked')} AS body,
                     array_to_string(list_transform(terms, lambda g: '- ' || chr(39) || g.s || chr(39) || ' → ' || chr(39) || g.t || chr(39) || CASE WHEN g.b THEN ' (در صورت لزوم با ذکر انگلیسی در پرانتز: ' || g.t || ' (' || g.s || '))' ELSE '' END), chr(10)) AS rules FROM b)
        SELECT id AS page_id, CASE WHEN head = '' THEN body ELSE head || chr(10) || chr(10) || '{Q.SOURCE_LABEL}' || coalesce(sl, '') || chr(10) || '{Q.TARGET_LABEL}' || coalesce(tl, '') || chr(10)
               || coalesce(chr(10) || chr(10) || '{Q.GLOSSARY_HEAD}' || chr(10) || rules, '') || chr(10) || CASE WHEN notes <> '' THEN chr(10) || chr(10) || '{Q.CONTEXT_HEAD}' || chr(10) || {_UNIX('notes')} ELSE '' END
               || chr(10) || chr(10) || '{Q.SOURCE_HEAD}' || chr(10) || '<source_document>' || chr(10) || body || chr(10) || '</source_document>' || chr(10) || chr(10) || '{Q.CLOSING}' || chr(10) END AS prompt FROM n""",
    "question_prompts": f"""
        WITH {_TURNS},
        p AS (SELECT * FROM (SELECT DISTINCT id, project_id, page_number, created_at, source_text, latest_translation, approved_text FROM pages) QUALIFY row_number() OVER (PARTITION BY project_id, page_number ORDER BY created_at, id) = 1),
        b AS (SELECT hs.id AS conversation_id, history, coalesce({strip('selected_text')}, '') AS chosen, coalesce({strip('question')}, '') AS asked, coalesce(nullif(approved_text, ''), nullif(latest_translation, ''), nullif(source_text, ''), '') AS page_text
              FROM hs LEFT JOIN p ON p.project_id = hs.project_id AND p.page_number = hs.page_number),
        t AS (SELECT *, page_text || CASE WHEN len(history) > 0 THEN chr(10) || chr(10) || CASE WHEN chosen <> '' THEN '{Q.HISTORY_HEAD}' ELSE '{Q.FOLLOW_UP_HEAD}' END || chr(10) || repeat(chr(34), 3) || chr(10) || array_to_string(history, chr(10) || chr(10)) || chr(10) || repeat(chr(34), 3) ELSE '' END AS around FROM b)
        SELECT conversation_id, CASE WHEN chosen <> '' THEN 'متن مورد سوال از کتاب:' || chr(10) || repeat(chr(34), 3) || chr(10) || chosen || chr(10) || repeat(chr(34), 3) || chr(10) || chr(10) ELSE chr(10) END
               || 'کانتکست صفحه:' || chr(10) || repeat(chr(34), 3) || chr(10) || around || chr(10) || repeat(chr(34), 3) || chr(10) || chr(10) || 'سوال:' || chr(10) || asked AS prompt FROM t""",
    "mock_translate": f"WITH {_P}, {_TERMS} SELECT p.id AS page_id, {_mock('source_text')} AS translation FROM p LEFT JOIN pt USING (id)",
    "translate_pipeline": f"{_TRANSLATED} SELECT page_id, translation, asked FROM done",
    "translation_attempt_rows": f"""{_TRANSLATED}, e AS (SELECT page_id, count(DISTINCT id) AS n FROM translation_attempts GROUP BY 1)
        SELECT done.page_id, (coalesce(n, 0) + 1)::INT AS version_number, CASE WHEN asked THEN 'mock' ELSE '{Q.PASSED_THROUGH}' END AS provider_name, CASE WHEN asked THEN 'mock-model' ELSE 'N/A' END AS model_name, false AS is_approved, length(translation)::INT AS characters
        FROM done LEFT JOIN e USING (page_id)""",
    "section_prompts": f"""WITH {SECTIONS} SELECT project_id, chapter, section, chapter || ' - ' || title || ' (' || first_page || '-' || last_page || '):' || chr(10) || text AS prompt,
        CASE WHEN section = 1 THEN 10 ELSE 10 + (section - 1) * 90 // count(*) OVER (PARTITION BY project_id, chapter) END::INT AS progress FROM sections""",
    "open_notes": f"WITH {_KEPT} SELECT project_id, chapter, section, title FROM kept WHERE note = ''",
    "chapter_notes": f"{_NOTED} SELECT project_id, chapter, section, note FROM noted",
    "note_progress": f"{_NOTED} SELECT project_id, chapter, count(*) FILTER (WHERE note <> '') AS done, CASE WHEN done <= 0 THEN 10 WHEN done >= count(*) THEN 100 ELSE 10 + done * 90 // count(*) END::INT AS progress FROM noted GROUP BY 1, 2",
    "chapter_question_texts": f"""WITH {SECTIONS} SELECT project_id, chapter, coalesce(string_agg('## ' || title || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY section) FILTER (WHERE section = 2), '') AS second,
        string_agg('## ' || title || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY section) AS whole FROM sections GROUP BY project_id, chapter, start_page""",
    "note_exports": f"""WITH {SECTIONS}, g AS (SELECT project_id, chapter, min(first_page) AS a, max(last_page) AS b, string_agg('## بخش ' || section || ': ' || title || chr(10) || '**صفحات ' || first_page || ' الی ' || last_page || '**' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY section) AS body
        FROM sections GROUP BY project_id, chapter, start_page)
        SELECT project_id, 'Chapter_' || a || '_' || b || '_' || left(regexp_replace(chapter, '[\\/*?:"<>| ]', '_', 'g'), 40) || '.md' AS file, '# ' || chapter || chr(10) || chr(10) || '**صفحات:** ' || a || ' الی ' || b || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body AS markdown FROM g""",
    "clean_markdown": f"WITH q AS (SELECT DISTINCT id AS page_id, translate(latest_translation, chr(8204), ' ') AS t FROM pages WHERE latest_translation IS NOT NULL), {prose_sql.clean('cl', 'q', 'page_id')} SELECT page_id, t AS text FROM cl",
    "repaired_markdown": rf"""WITH q AS (SELECT DISTINCT article_id, markdown FROM fetched_articles WHERE markdown IS NOT NULL), b AS (SELECT article_id, {prose_sql.LISTS.replace('(t,', '(markdown,')} AS t FROM q),
        f AS (SELECT article_id, regexp_split_to_array(t, '```([a-zA-Z0-9_-]*)\n([\s\S]*?)```') AS parts, regexp_extract_all(t, '```([a-zA-Z0-9_-]*)\n([\s\S]*?)```', 1) AS langs, regexp_extract_all(t, '```([a-zA-Z0-9_-]*)\n([\s\S]*?)```', 2) AS codes FROM b),
        g AS (SELECT article_id, parts, list_transform(range(1, len(codes) + 1), lambda k: '```' || langs[k] || chr(10) || regexp_replace(regexp_replace(array_to_string(list_transform(string_split(codes[k], chr(10)), lambda x: rtrim(x)), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') || chr(10) || '```') AS fences FROM f)
        SELECT article_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda k: CASE WHEN k = 1 THEN '' ELSE fences[k - 1] END || parts[k]), '') AS text FROM g""",
    "restored_blocks": rf"""WITH {_P}, q AS (SELECT *, regexp_extract_all(source_text, '{_FENCED}') AS c, regexp_split_to_array(source_text, '{_FENCED}') AS cp, regexp_extract_all(source_text, '{_IMAGE}') AS i, regexp_split_to_array(source_text, '{_IMAGE}') AS ip FROM p),
        m AS (SELECT *, array_to_string(list_transform(range(1, len(cp) + 1), lambda k: CASE WHEN k = 1 THEN '' ELSE chr(10) || chr(10) || c[k - 1] || chr(10) || chr(10) END || cp[k]), '') AS code_back,
                     array_to_string(list_transform(range(1, len(ip) + 1), lambda k: CASE WHEN k = 1 THEN '' ELSE chr(10) || chr(10) || i[k - 1] || chr(10) || chr(10) END || replace(ip[k], '_', ' ')), '') AS image_back FROM q)
        SELECT id AS page_id, CASE WHEN len(c) = 0 THEN source_text ELSE {strip('code_back')} END AS code, CASE WHEN len(i) = 0 THEN replace(source_text, '_', ' ') ELSE {strip('image_back')} END AS images,
               'see ' || coalesce(regexp_extract_all(source_text, '!\[[^\]]*\]\([^)]+\)')[1], '') || ': ' || source_text AS answer FROM m""",
}
