"""Roll-ups, lookups and windows over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import schemas, sinks
from folio.functions import text as T
from folio.functions import values as V
from folio.operators import glossary
from folio.operators import relational as R
from folio.runtime import table

#: States that count as finished.
DONE = ("APPROVED", "EXPORTED")
#: Tables of a backup.
BACKED_UP = ("projects", "pages", "translation_attempts", "page_conversations", "fetched_articles", "translation_profiles", "glossary_items")


def project_progress(spark: SparkSession, directory: str) -> DataFrame:
    """Approved pages and progress in per cent of each project.

    Pages repeated verbatim count once. The project's own ``total_pages`` is the
    base; 0 or null gives 0 per cent. Projects without pages are kept.
    """
    done = (
        table(spark, directory, "pages")
        .select("id", "project_id", "status")
        .distinct()
        .groupBy("project_id")
        .agg(F.count("*").alias("pages"), F.count_if(F.col("status").isin(*DONE)).alias("approved"))
    )
    projects = table(spark, directory, "projects").select("id", "total_pages")
    return projects.join(done, projects["id"] == done["project_id"], "left").select(
        projects["id"].alias("project_id"),
        F.coalesce("pages", F.lit(0)).alias("pages"),
        F.coalesce("approved", F.lit(0)).alias("approved"),
        F.when(F.col("total_pages") > 0, F.round(F.coalesce("approved", F.lit(0)) * 100.0 / F.col("total_pages"), 1)).otherwise(0.0).alias("progress"),
    )


def _starts(spark: SparkSession, directory: str) -> DataFrame:
    """Chapters by their headings: the first top heading of a page starts one."""
    pages = R.once(table(spark, directory, "pages"), "project_id", "page_number", "source_text")
    title = F.regexp_extract("source_text", r"(?m)^# ([^\n]+)", 1)
    return pages.select("project_id", F.col("page_number").alias("start_page"), title.alias("chapter")).where("chapter <> '' and page_number is not null").distinct()


def _chapters(spark: SparkSession, directory: str) -> DataFrame:
    totals = R.once(table(spark, directory, "pages"), "project_id", "page_number").groupBy("project_id").agg(F.max("page_number").alias("total_pages"))
    return R.chapter_bounds(_starts(spark, directory), totals)


def _events(spark: SparkSession, directory: str) -> DataFrame:
    """A log of page states, with the users of the event stream as pages."""
    states = F.array(*(F.lit(s) for s in R.STATES))
    return table(spark, directory, "events").select(F.col("user_id").alias("page_id"), F.col("ts").alias("at"), "event_id", F.get(states, F.pmod("event_id", F.lit(len(R.STATES))).cast("int")).alias("status"))


def project_list(spark: SparkSession, directory: str) -> DataFrame:
    """Projects as lists show them: title or file name or address, newest first by rank."""
    from pyspark.sql import Window as W

    projects = table(spark, directory, "projects")
    title = F.coalesce(T.filled(T.strip("title")), T.filled("source_pdf_filename"), T.filled("source_url"), F.lit(""))
    # The rank is that of a report over all projects; one partition orders short rows only.
    rank = F.row_number().over(W.partitionBy(F.lower(T.strip("target_language"))).orderBy(F.desc("created_at"), "id"))
    return projects.select(F.col("id").alias("project_id"), title.alias("title"), rank.alias("rank"), F.lower(T.strip("source_language")).alias("language"))


def page_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """Numbers of the pages before and after, within the project's pages."""
    pages = R.once(table(spark, directory, "pages"), "id", "project_id", "page_number")
    total = table(spark, directory, "projects").select(F.col("id").alias("project_id"), "total_pages")
    n = F.col("page_number")
    return pages.join(total, "project_id", "left").select(F.col("id").alias("page_id"), F.when(n > 1, n - 1).alias("previous_page"), F.when(n < F.col("total_pages"), n + 1).alias("next_page"))


def reader_pages(spark: SparkSession, directory: str) -> DataFrame:
    pages = R.once(table(spark, directory, "pages"), "id", "project_id", "page_number", "latest_translation", "approved_text")
    shown = T.best_text("approved_text", "latest_translation")
    return pages.where(shown.isNotNull()).select(F.col("id").alias("page_id"), "project_id", "page_number", F.length(shown).alias("characters"))


def surviving_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Rows left in each table when all projects of German sources are deleted, conversations, attempts, pages and own glossary terms included."""
    projects = table(spark, directory, "projects")
    deleted = projects.where(F.lower(T.strip("source_language")) == "german")
    parts = [R.without_projects(table(spark, directory, name).select("id", "project_id").distinct(), deleted).select(F.lit(name).alias("table"), "id") for name in ("pages", "translation_attempts", "page_conversations", "glossary_items")]
    kept = projects.where(~F.coalesce(F.lower(T.strip("source_language")) == "german", F.lit(False))).select(F.lit("projects").alias("table"), "id")
    for part in parts:
        kept = kept.unionByName(part)
    return kept.groupBy("table").agg(F.count("*").alias("rows"))


def saved_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Pages after a log of changes: failed pages are set to ready one second after their last change."""
    pages = R.once(table(spark, directory, "pages"), "id", "status", "updated_at")
    changes = pages.where("status = 'FAILED'").select("id", F.lit("READY").alias("status"), (F.col("updated_at") + F.expr("INTERVAL 1 SECOND")).alias("updated_at"))
    return R.upserted(pages, changes, "id", "updated_at").select("id", "status")


def glossary_hits(spark: SparkSession, directory: str) -> DataFrame:
    questions = R.once(table(spark, directory, "page_conversations"), "id", "question").where("question is not null").select(F.col("id").alias("key"), F.col("question").alias("line"))
    return glossary.hits(questions, table(spark, directory, "glossary_items"))


def illegal_transitions(spark: SparkSession, directory: str) -> DataFrame:
    return R.changed_states(_events(spark, directory), schemas.transitions(spark)).groupBy("from_state", "status").agg(F.count("*").alias("times"))


def repaired_states(spark: SparkSession, directory: str) -> DataFrame:
    """Notes of chapters after a restart; the state of each is made up from its first page."""
    states = F.array(*(F.lit(s) for s in ("PENDING", "PROCESSING", "COMPLETED", "FAILED")))
    summaries = _chapters(spark, directory).select("project_id", "chapter", "start_page", F.get(states, F.pmod("start_page", F.lit(4))).alias("status"), F.lit(None).cast("string").alias("error_message"))
    return R.restarted(summaries)


def backup_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of every table of a backup as one JSON document."""
    return sinks.manifest({n: table(spark, directory, n).select("article_id" if n == "fetched_articles" else "id").distinct() for n in BACKED_UP})


def addresses_of_images(spark: SparkSession, directory: str) -> DataFrame:
    """Articles by the sort of answer their address would get, from a made-up status: what to do with each."""
    articles = R.once(table(spark, directory, "fetched_articles"), "article_id", "image_count", "title")
    status = F.get(F.array(*(F.lit(s) for s in (200, 200, 301, 403, 404, 429, 500, 503))), F.pmod(F.coalesce("image_count", F.lit(0)), F.lit(8)))
    kind = F.when(F.col("title").isNull(), "application/pdf").when(F.col("title") == "", "image/png").otherwise("text/html; charset=utf-8")
    return articles.select("article_id", status.alias("status"), V.fetch_action(status, kind).alias("action"))


def embedded_texts(spark: SparkSession, directory: str) -> DataFrame:
    """Titles sent through a data address and back."""
    from folio.sources.embedded import decoded

    articles = R.once(table(spark, directory, "fetched_articles"), "article_id", "title").where("title is not null")
    uri = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("title", "UTF-8")))
    return articles.select("article_id", F.decode(decoded(uri), "UTF-8").alias("title"))


def _view(function, *names):
    return lambda spark, directory: function(*(table(spark, directory, n) for n in names))


QUERIES = {
    "project_progress": project_progress,
    "project_list": project_list,
    "project_status_counts": _view(R.status_counts, "pages"),
    "latest_attempts": _view(R.latest_attempts, "translation_attempts"),
    "attempt_versions": _view(R.attempt_versions, "translation_attempts"),
    "page_attempts": _view(R.attempts_of_pages, "pages", "translation_attempts"),
    "profile_resolution": _view(R.resolved_profiles, "projects", "translation_profiles"),
    "page_neighbours": page_neighbours,
    "neighbour_context": _view(R.neighbour_context, "pages"),
    "qa_history": _view(R.conversation_history, "page_conversations"),
    "chapter_bounds": lambda spark, directory: _chapters(spark, directory).withColumn("valid", R.range_is_valid(F.col("start_page"), F.col("end_page"), F.col("total_pages"))),
    "chapter_pages": lambda spark, directory: R.pages_of_ranges(_chapters(spark, directory).select("project_id", "chapter", "start_page", "end_page"), table(spark, directory, "pages")),
    "reader_pages": reader_pages,
    "cascade_delete": surviving_rows,
    "saved_pages": saved_pages,
    "path_rebase": lambda spark, directory: R.rebased_paths(table(spark, directory, "pages"), "/data/new"),
    "glossary_hits": glossary_hits,
    "illegal_transitions": illegal_transitions,
    "repaired_states": repaired_states,
    "backup_manifest": backup_manifest,
    "fetch_actions": addresses_of_images,
    "data_uris": embedded_texts,
}

_S = r"[\s\p{Z}\x1c-\x1f\x{85}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"
_PAGES = "p AS (SELECT DISTINCT id, project_id, page_number FROM pages)"
_STARTS = r"""s AS (SELECT DISTINCT project_id, page_number AS start_page, regexp_extract(source_text, '(?m)^# ([^\n]+)', 1) AS chapter FROM pages WHERE page_number IS NOT NULL AND regexp_extract(source_text, '(?m)^# ([^\n]+)', 1) <> ''),
    m AS (SELECT project_id, max(page_number) AS total_pages FROM pages GROUP BY 1),
    c AS (SELECT s.*, total_pages, least(greatest(coalesce(lead(start_page) OVER (PARTITION BY s.project_id ORDER BY start_page, chapter) - 1, total_pages), start_page), greatest(total_pages, start_page)) AS end_page FROM s JOIN m USING (project_id))"""
_CASES = " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(R.STATES))
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, after in schemas.TRANSITIONS.items() for b in after)

SQL = {
    "project_progress": """
        WITH p AS (SELECT DISTINCT id, project_id, status FROM pages),
        d AS (SELECT project_id, count(*) AS pages, count(*) FILTER (WHERE status IN ('APPROVED', 'EXPORTED')) AS approved FROM p GROUP BY 1)
        SELECT j.id AS project_id, coalesce(d.pages, 0) AS pages, coalesce(d.approved, 0) AS approved,
               CASE WHEN j.total_pages > 0 THEN round(coalesce(d.approved, 0) * 100.0::DOUBLE / j.total_pages, 1) ELSE 0.0 END AS progress
        FROM projects j LEFT JOIN d ON d.project_id = j.id""",
    "project_list": f"""SELECT id AS project_id, coalesce(nullif({_STRIP('title')}, ''), nullif(source_pdf_filename, ''), nullif(source_url, ''), '') AS title,
        row_number() OVER (PARTITION BY lower({_STRIP('target_language')}) ORDER BY created_at DESC, id)::INT AS rank, lower({_STRIP('source_language')}) AS language FROM projects""",
    "project_status_counts": f"WITH p AS (SELECT DISTINCT id, project_id, status FROM pages) SELECT project_id, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in R.STATES)} FROM p GROUP BY 1",
    "latest_attempts": """WITH a AS (SELECT DISTINCT id, page_id, version_number, is_approved, created_at FROM translation_attempts)
        SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY version_number DESC NULLS LAST, created_at DESC NULLS LAST, id DESC) = 1""",
    "attempt_versions": """WITH a AS (SELECT DISTINCT id, page_id, version_number, created_at FROM translation_attempts)
        SELECT id, page_id, row_number() OVER (PARTITION BY page_id ORDER BY version_number NULLS FIRST, created_at NULLS FIRST, id)::INT AS version, count(*) OVER (PARTITION BY page_id) + 1 AS next_version FROM a""",
    "page_attempts": """WITH a AS (SELECT DISTINCT id, page_id, version_number, provider_name FROM translation_attempts), p AS (SELECT DISTINCT id FROM pages),
        l AS (SELECT page_id, list(concat_ws(':', version_number::VARCHAR, provider_name) ORDER BY version_number DESC, id DESC) AS attempts FROM a GROUP BY 1)
        SELECT p.id AS page_id, coalesce(l.attempts, []) AS attempts FROM p LEFT JOIN l ON l.page_id = p.id""",
    "profile_resolution": """WITH o AS (SELECT id, name FROM translation_profiles ORDER BY created_at, id LIMIT 1)
        SELECT p.id AS project_id, coalesce(t.id, o.id) AS profile_id, coalesce(t.name, o.name) AS profile_name FROM projects p LEFT JOIN translation_profiles t ON t.id = p.profile_id, o""",
    "page_neighbours": f"WITH {_PAGES} SELECT p.id AS page_id, CASE WHEN page_number > 1 THEN page_number - 1 END AS previous_page, CASE WHEN page_number < j.total_pages THEN page_number + 1 END AS next_page FROM p LEFT JOIN projects j ON j.id = p.project_id",
    "neighbour_context": f"""WITH d AS (SELECT DISTINCT id, project_id, page_number, created_at, source_text FROM pages),
        f AS (SELECT *, string_split({_STRIP('source_text')}, chr(10)) AS l FROM d QUALIFY row_number() OVER (PARTITION BY project_id, page_number ORDER BY created_at, id) = 1)
        SELECT id AS page_id, lag(right({_STRIP('l[len(l)]')}, 160)) OVER w AS before, lead(left({_STRIP('l[1]')}, 160)) OVER w AS after FROM f WINDOW w AS (PARTITION BY project_id ORDER BY page_number)""",
    "qa_history": """WITH c AS (SELECT DISTINCT id, project_id, page_number, selected_text, question, answer, created_at FROM page_conversations),
        t AS (SELECT *, 'کاربر: ' || question || CASE WHEN coalesce(selected_text, '') <> '' THEN ' (نقل‌قول مربوطه: «' || left(selected_text, 60) || '...»)' ELSE '' END || chr(10) || 'پاسخ دستیار: ' || answer AS turn FROM c)
        SELECT id AS conversation_id, coalesce(list(turn) FILTER (WHERE turn IS NOT NULL) OVER (PARTITION BY project_id, page_number ORDER BY created_at, id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []) AS history FROM t""",
    "chapter_bounds": f"WITH {_STARTS} SELECT project_id, start_page, chapter, total_pages, end_page, start_page >= 1 AND start_page <= end_page AND end_page <= total_pages AS valid FROM c",
    "chapter_pages": f"WITH {_STARTS}, {_PAGES} SELECT c.project_id, chapter, start_page, end_page, p.id AS page_id, page_number FROM c JOIN p ON p.project_id = c.project_id AND page_number BETWEEN start_page AND end_page",
    "reader_pages": "SELECT DISTINCT id AS page_id, project_id, page_number, length(coalesce(nullif(approved_text, ''), nullif(latest_translation, '')))::INT AS characters FROM pages WHERE coalesce(nullif(approved_text, ''), nullif(latest_translation, '')) IS NOT NULL",
    "cascade_delete": f"""WITH g AS (SELECT id FROM projects WHERE lower({_STRIP('source_language')}) = 'german')
        SELECT 'projects' AS "table", count(*) AS rows FROM projects WHERE id NOT IN (SELECT id FROM g)
        """
    + "".join(f""" UNION ALL SELECT '{t}', count(DISTINCT id) FROM {t} WHERE project_id IS NULL OR project_id NOT IN (SELECT id FROM g)""" for t in ("pages", "translation_attempts", "page_conversations", "glossary_items")),
    "saved_pages": "SELECT DISTINCT id, CASE WHEN status = 'FAILED' THEN 'READY' ELSE status END AS status FROM pages",
    "path_rebase": """SELECT DISTINCT id AS page_id, CASE WHEN image_path = '' THEN '' ELSE '/data/new/projects/' || project_id || '/pages/page_' || page_number || '.png' END AS image_path,
        CASE WHEN thumbnail_path = '' THEN '' ELSE '/data/new/projects/' || project_id || '/pages/page_' || page_number || '_thumb.png' END AS thumbnail_path FROM pages""",
    "glossary_hits": f"""WITH q AS (SELECT DISTINCT id, question FROM page_conversations WHERE question IS NOT NULL), t AS (SELECT DISTINCT {_STRIP('source_term')} AS term FROM glossary_items)
        SELECT q.id AS key, t.term FROM q, t WHERE term <> '' AND contains(lower(question), lower(term))""",
    "illegal_transitions": f"""WITH e AS (SELECT user_id, CASE event_id % 9 {_CASES} END AS status, lag(CASE event_id % 9 {_CASES} END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
        SELECT from_state, status, count(*) AS times FROM e WHERE from_state IS NOT NULL AND from_state <> status AND (from_state, status) NOT IN ({_ALLOWED}) GROUP BY 1, 2""",
    "repaired_states": f"""WITH {_STARTS} SELECT project_id, chapter, start_page, CASE start_page % 4 WHEN 2 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
        CASE WHEN start_page % 4 < 2 THEN 'پردازش با ری‌استارت سرور متوقف شد. لطفاً دکمه تلاش مجدد را بزنید.' END AS error_message FROM c""",
    "backup_manifest": "SELECT '{' || " + " || ',' || ".join(f"""'"{n}":' || (SELECT count(DISTINCT {'article_id' if n == 'fetched_articles' else 'id'}) FROM {n})""" for n in sorted(BACKED_UP)) + " || '}' AS counts",
    "fetch_actions": """WITH a AS (SELECT DISTINCT article_id, title, [200, 200, 301, 403, 404, 429, 500, 503][(coalesce(image_count, 0) % 8 + 8) % 8 + 1] AS status FROM (SELECT DISTINCT article_id, image_count, title FROM fetched_articles))
        SELECT article_id, status, CASE WHEN status IN (401, 403, 429) OR status >= 500 THEN 'browser' WHEN status >= 400 THEN 'error_status' WHEN title IS NULL THEN 'error_pdf' WHEN title = '' THEN 'error_type' ELSE 'parse' END AS action FROM a""",
    "data_uris": "SELECT DISTINCT article_id, title FROM fetched_articles WHERE title IS NOT NULL",
}


def scalar_families(spark: SparkSession, directory: str) -> DataFrame:
    """Times, guards, JSON and maps over the projects and pages."""
    projects = table(spark, directory, "projects")
    as_json = F.to_json(F.struct("total_pages", "source_type"))
    lookup = F.create_map(F.lit("PDF"), F.lit("book"), F.lit("ARTICLE"), F.lit("page"))
    return projects.select(
        F.col("id").alias("project_id"),
        V.iso_time("created_at").alias("created"),
        V.file_stamp("updated_at").alias("stamp"),
        V.upload_kind("source_pdf_filename").alias("upload"),
        V.is_export_format(F.when(F.col("source_type") == "PDF", "docx").otherwise(F.lower("source_type"))).alias("exportable"),
        F.get_json_object(as_json, "$.source_type").alias("kind"),
        F.element_at(lookup, F.col("source_type")).alias("shown_as"),
        F.round(V.thumbnail_scale(F.col("total_pages") + 500.0), 6).alias("scale"),
    )


def page_formulas(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").where("text is not null")
    return documents.select("doc_id", F.size(V.formulas("text")).alias("formulas"))


QUERIES |= {"scalar_families": scalar_families, "page_formulas": page_formulas}
SQL |= {
    "scalar_families": """SELECT id AS project_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created, strftime(updated_at, '%Y-%m-%d_%H%M%S') AS stamp,
        CASE WHEN lower(source_pdf_filename) LIKE '%.pdf' THEN 'book' WHEN lower(source_pdf_filename) LIKE '%.zip' THEN 'backup' END AS upload, coalesce(source_type = 'PDF', false) AS exportable, source_type AS kind,
        CASE source_type WHEN 'PDF' THEN 'book' WHEN 'ARTICLE' THEN 'page' END AS shown_as, CASE WHEN total_pages + 500 > 0 THEN round(300 / (total_pages + 500.0::DOUBLE), 6) END AS scale FROM projects""",
    "page_formulas": r"SELECT doc_id, len(regexp_extract_all(text, '\$\$[\s\S]+?\$\$|\\\[[\s\S]+?\\\]|\\\([\s\S]+?\\\)|\$[^$\n]+?\$'))::INT AS formulas FROM documents WHERE text IS NOT NULL",
}
