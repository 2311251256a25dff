"""Queries of the ordered folds over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import relational as R
from folio.operators import segments as S
from folio.plans.prose_sql import words as _WORDS
from folio.plans.sections_sql import FIRST as _FIRST
from folio.plans.sections_sql import SECTIONS, STITCH_PAGES, STITCH_SINGLE
from folio.plans.views import _STRIP, _chapters
from folio.runtime import table

#: Limit of the chunk query: small, so that packing shows on pages of ordinary length.
SMALL_CHUNK = 400


def _pages(spark: SparkSession, directory: str) -> DataFrame:
    """One row per page number: of several the oldest, then the smallest id."""
    rows = R.once(table(spark, directory, "pages"), "id", "project_id", "page_number", "source_text", "created_at").where("page_number is not null")
    return R.first_by(rows, ["project_id", "page_number"], F.col("created_at"), F.col("id"))


def chunk_paragraphs(spark: SparkSession, directory: str) -> DataFrame:
    pages = R.once(table(spark, directory, "pages"), "id", "source_text").where("source_text is not null")
    return S.chunk_rows(pages, "id", "source_text", SMALL_CHUNK)


def page_slices(spark: SparkSession, directory: str) -> DataFrame:
    return S.page_slices(_pages(spark, directory).select("project_id", "page_number", T.word_count("source_text").alias("words")))


def chapter_sections(spark: SparkSession, directory: str) -> DataFrame:
    """Sections of the chapters that headings start."""
    chapters = _chapters(spark, directory).select("project_id", "chapter", "start_page", "end_page")
    first = R.first_by(chapters, ["project_id", "start_page"], F.col("chapter"))
    joined = R.pages_of_ranges(first, _pages(spark, directory).withColumnRenamed("source_text", "text"), "text")
    whole = joined.groupBy("project_id", "chapter", "start_page", "end_page").agg(F.collect_list(F.struct("page_number", "text")).alias("pages"))
    return S.chapter_sections(whole)


def outline_chapters(spark: SparkSession, directory: str) -> DataFrame:
    """Chapters of an outline made of all headings of the pages."""
    heads = _pages(spark, directory).select("project_id", "page_number", F.posexplode(F.regexp_extract_all("source_text", F.lit(r"(?m)^(#{1,3} [^\n]+)"), F.lit(1))).alias("k", "h"))
    outline = heads.select("project_id", F.row_number().over(W.partitionBy("project_id").orderBy("page_number", "k")).alias("seq"), (F.length("h") - F.length(F.regexp_replace("h", "^#+", ""))).alias("level"), F.regexp_replace("h", "^#+ ", "").alias("title"), F.col("page_number").alias("page"))
    totals = table(spark, directory, "projects").where("total_pages > 0").select(F.col("id").alias("project_id"), "total_pages")
    return S.chapters_of_outline(outline, totals)


def _cut_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Pages whose last mark is taken off where their number is even, so that sentences run on."""
    pages = _pages(spark, directory)
    return pages.select("project_id", "page_number", F.when(F.col("page_number") % 2 == 0, F.regexp_replace(T.strip("source_text"), r"[.!?]$", "")).otherwise(F.coalesce("source_text", F.lit(""))).alias("text"))


def heading_chapters(spark: SparkSession, directory: str) -> DataFrame:
    """Chapters by numbered headings; those of the pages get the number of their page."""
    pages = _pages(spark, directory)
    numbered = pages.withColumn("source_text", F.regexp_replace("source_text", r"(?m)^# ", F.concat(F.lit("# Chapter "), F.col("page_number").cast("string"), F.lit(". "))))
    totals = table(spark, directory, "projects").select(F.col("id").alias("project_id"), "total_pages")
    return R.chapter_bounds(S.chapters_of_headings(numbered).withColumnRenamed("title", "chapter"), totals).select("project_id", "chapter", "start_page", "end_page")


QUERIES = {
    "heading_chapters": heading_chapters,
    "chunk_paragraphs": chunk_paragraphs,
    "page_slices": page_slices,
    "chapter_sections": chapter_sections,
    "outline_chapters": outline_chapters,
    "stitch_pages": lambda spark, directory: S.stitched_books(_cut_pages(spark, directory)),
    "stitch_single": lambda spark, directory: S.stitched_single(_cut_pages(spark, directory)),
}

SQL = {
    "heading_chapters": rf"""WITH {_FIRST}, s AS (SELECT project_id, page_number AS start_page, 'Chapter ' || page_number || '. ' || {_STRIP(r"regexp_extract(source_text, '(?m)^# ([^\n]+)', 1)")} AS chapter FROM f WHERE regexp_matches(source_text, '(?m)^# [^\n]')),
        j AS (SELECT s.*, total_pages FROM s JOIN projects ON projects.id = s.project_id)
        SELECT project_id, {_STRIP('chapter')} AS chapter, start_page, least(greatest(coalesce(lead(start_page) OVER (PARTITION BY project_id ORDER BY start_page) - 1, total_pages), start_page), greatest(total_pages, start_page)) AS end_page FROM j""",
    "chapter_sections": f"WITH {SECTIONS} SELECT * FROM sections",
    "stitch_pages": STITCH_PAGES,
    "stitch_single": STITCH_SINGLE,
    "chunk_paragraphs": rf"""
        WITH RECURSIVE p AS (SELECT DISTINCT id, source_text AS t FROM pages WHERE source_text IS NOT NULL),
        a AS (SELECT id, list_filter(regexp_split_to_array({_STRIP('t')}, '\n{{2,}}'), lambda x: {_STRIP('x')} <> '') AS ps FROM p WHERE length(t) > {SMALL_CHUNK}),
        r AS (SELECT id, ps, 1 AS k, 1 AS part, ps[1] AS chunk FROM a WHERE len(ps) > 0
              UNION ALL
              SELECT id, ps, k + 1, CASE WHEN length(chunk) + 2 + length(ps[k + 1]) > {SMALL_CHUNK} THEN part + 1 ELSE part END,
                     CASE WHEN length(chunk) + 2 + length(ps[k + 1]) > {SMALL_CHUNK} THEN ps[k + 1] ELSE chunk || chr(10) || chr(10) || ps[k + 1] END FROM r WHERE k < len(ps)),
        c AS (SELECT id, part, chunk FROM r QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY k DESC) = 1 UNION ALL SELECT id, 1, t FROM p WHERE length(t) <= {SMALL_CHUNK}),
        n AS (SELECT *, count(*) OVER (PARTITION BY id) AS parts FROM c)
        SELECT id, part::INT AS part, parts::INT AS parts, CASE WHEN parts > 1 THEN 'part ' || part || ' of ' || parts ELSE '' END AS note, chunk FROM n""",
    "page_slices": f"""
        WITH RECURSIVE {_FIRST}, w AS (SELECT project_id, page_number, {_WORDS('source_text')} AS words, row_number() OVER (PARTITION BY project_id ORDER BY page_number) AS k FROM f),
        r AS (SELECT project_id, k, 1 AS slice, page_number AS first, page_number AS last, 1 AS pages, words FROM w WHERE k = 1
              UNION ALL
              SELECT w.project_id, w.k, CASE WHEN r.pages >= 4 OR r.words + w.words > 3000 THEN r.slice + 1 ELSE r.slice END, CASE WHEN r.pages >= 4 OR r.words + w.words > 3000 THEN w.page_number ELSE r.first END, w.page_number,
                     CASE WHEN r.pages >= 4 OR r.words + w.words > 3000 THEN 1 ELSE r.pages + 1 END, CASE WHEN r.pages >= 4 OR r.words + w.words > 3000 THEN w.words ELSE r.words + w.words END
              FROM r JOIN w ON w.project_id = r.project_id AND w.k = r.k + 1)
        SELECT project_id, slice::INT AS slice, first, last, pages::INT AS pages, words::INT AS words FROM r QUALIFY row_number() OVER (PARTITION BY project_id, slice ORDER BY k DESC) = 1""",
    "outline_chapters": rf"""
        WITH {_FIRST}, h AS (SELECT project_id, page_number, regexp_extract_all(source_text, '(?m)^(#{{1,3}} [^\n]+)', 1) AS hs FROM f),
        e AS (SELECT project_id, page_number AS page, unnest(range(len(hs))) AS k, unnest(hs) AS h FROM h),
        o AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY page, k) AS seq, length(regexp_extract(h, '^#+')) AS level, regexp_replace(h, '^#+ ', '') AS title, page FROM e),
        n AS (SELECT *, regexp_matches(title, '(?i)(?:chapter|فصل)\s*\p{{Nd}}+') AS num FROM o),
        u AS (SELECT *, bool_or(level = 2 AND num) OVER w AS two, bool_or(level = 1 AND num) OVER w AS one, bool_or(level = 1) OVER w AS any1 FROM n WINDOW w AS (PARTITION BY project_id)),
        q AS (SELECT u.*, greatest(page, 1) AS start_page, total_pages FROM u JOIN projects j ON j.id = u.project_id AND total_pages > 0 WHERE CASE WHEN two AND NOT one THEN level = 2 WHEN any1 THEN level = 1 ELSE true END),
        z AS (SELECT *, least(greatest(coalesce(lead(start_page) OVER (PARTITION BY project_id ORDER BY seq) - 1, total_pages), start_page), total_pages) AS end_page FROM q)
        SELECT project_id, seq::INT AS seq, {_STRIP('title')} AS title, start_page, end_page, regexp_matches(title, '(?i)^\s*(?:chapter|part|فصل|بخش)')
               OR (lower({_STRIP('title')}) NOT IN ('cover', 'copyright', 'title page', 'table of contents', 'contents', 'toc') AND end_page - start_page >= 3) AS is_main FROM z WHERE start_page <= total_pages""",
}
