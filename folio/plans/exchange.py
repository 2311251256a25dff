"""Queries of HTML, exports and the stream of states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import sinks
from folio.functions import markdown as M
from folio.functions import text as T
from folio.operators import html as H
from folio.operators import images as I
from folio.operators import relational as R
from folio.plans import prose_sql
from folio.plans.views import SQL as VIEWS
from folio.plans.views import _STRIP, _events
from folio.runtime import removed_at_exit, shared_folder, table


def as_html(spark: SparkSession, directory: str) -> DataFrame:
    """Articles wrapped up as pages: ``url``, ``html`` with navigation, the text as headings and paragraphs with links, and a footer."""
    rows = R.once(table(spark, directory, "fetched_articles"), "article_id", "title", "markdown").where("markdown is not null")
    safe = F.replace(F.replace(F.replace("markdown", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    linked = F.regexp_replace(safe, r"(?<!!)\[([^\[\]\n]*)\]\(([^)\n]*)\)", '<a href="$2">$1</a>')
    part = lambda p: F.when(p.rlike(r"^#{1,3} [^\n]+$"), F.concat(F.lit("<h2>"), F.regexp_replace(p, r"^#+ ", ""), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), p, F.lit("</p>")))
    body = F.array_join(F.transform(F.split(linked, r"\n{2,}"), part), "\n")
    head = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><nav><a href='/'>Home</a></nav><div id='page'><article>"))
    return rows.select(F.col("article_id").alias("url"), F.concat(head, body, F.lit("</article></div><footer>foot</footer><script>var x = 1;</script></body></html>")).alias("html"))


def article_titles(spark: SparkSession, directory: str) -> DataFrame:
    return H.articles(as_html(spark, directory)).select(F.col("url").alias("article_id"), "title")


def article_lengths(spark: SparkSession, directory: str) -> DataFrame:
    """Characters of articles besides images, and whether they are long enough."""
    rows = R.once(table(spark, directory, "fetched_articles"), "article_id", "markdown").where("markdown is not null")
    return rows.select("article_id", H.prose_length("markdown").alias("characters"), H.is_long_enough("markdown").alias("long_enough"))


def link_density(spark: SparkSession, directory: str) -> DataFrame:
    """Characters of articles, the share of them that is link text, and the characters of their long paragraphs that are not mostly links."""
    found = H.measures(as_html(spark, directory), "article")
    return found.select(F.col("url").alias("article_id"), "characters", F.round("link_share", 9).alias("link_share"), "prose")


def chat_answers(spark: SparkSession, directory: str) -> DataFrame:
    """Fenced code of pages as chat pages show it, with the bar above it, read back."""
    code = R.once(table(spark, directory, "pages"), "id", "source_text").select("id", F.get(M.blocks("source_text", M.FENCED), F.lit(0)).alias("block")).where("block is not null")
    body = F.regexp_replace("block", r"^```[^\n]*\n|\n?```$", "")
    safe = F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<p>متن  پاسخ</p><pre><div class='toolbar'><span>python</span><button>Copy code</button></div><code class='hljs language-python'>"), safe, F.lit("</code></pre><p>پایان</p>"))
    return H.chat_answers(code.select("id", page.alias("html")), "id")


def _best_pages(spark: SparkSession, directory: str) -> DataFrame:
    pages = R.once(table(spark, directory, "pages"), "id", "project_id", "page_number", "source_text", "latest_translation", "approved_text")
    return pages.select("id", "project_id", "page_number", F.coalesce(T.best_text("approved_text", "latest_translation", "source_text"), F.lit("")).alias("text"))


def page_exports(spark: SparkSession, directory: str) -> DataFrame:
    return _best_pages(spark, directory).select(F.col("id").alias("page_id"), sinks.page_markdown(F.coalesce("page_number", F.lit(0)), F.col("text")).alias("markdown"))


def book_exports(spark: SparkSession, directory: str) -> DataFrame:
    return sinks.books(table(spark, directory, "projects"), _best_pages(spark, directory))


def page_documents(spark: SparkSession, directory: str) -> DataFrame:
    return sinks.described(sinks.pages_docx(_best_pages(spark, directory).select(F.col("id").alias("page_id"), "page_number", "text")), "page_id")


def book_documents(spark: SparkSession, directory: str) -> DataFrame:
    return sinks.described(sinks.books_docx(book_exports(spark, directory)), "project_id")


def backups(spark: SparkSession, directory: str) -> DataFrame:
    """Page exports packed per project and read back."""
    pages = _best_pages(spark, directory)
    path = F.concat("project_id", F.lit("/pages/page_"), F.coalesce(F.col("page_number").cast("string"), F.lit("x")), F.lit("_"), "id", F.lit(".md"))
    packed = sinks.archives(pages.select("project_id", path.alias("path"), F.encode("text", "UTF-8").alias("content")), {"version": 1})
    return sinks.unpacked(packed.withColumnRenamed("project_id", "archive")).select("archive", "path", F.decode("content", "UTF-8").alias("text"), "error").where("path <> 'manifest.json'")


def restored_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Pages and projects backed up as whole tables and restored below another data folder."""
    folder = removed_at_exit(spark, f"{shared_folder(spark)}/folio-backup-{uuid.uuid4().hex}")
    sinks.snapshot({n: table(spark, directory, n) for n in ("pages", "projects")}, folder)
    found = sinks.restored(spark, folder, "/data/new")
    return found["pages"].join(found["projects"].select(F.col("id").alias("project_id"), "source_type"), "project_id", "left").select("id", "project_id", "source_type", "status", "image_path", "thumbnail_path", F.length("source_text").alias("characters"))


def localised_images(spark: SparkSession, directory: str) -> DataFrame:
    """Articles whose images have been fetched, with sizes made up from their addresses."""
    articles = R.once(table(spark, directory, "fetched_articles"), "article_id", "project_id", "markdown").where("markdown is not null")
    found = I.images(articles.select("article_id", "markdown")).select("src").distinct()
    n = F.length("src")
    sizes = found.where(n % 5 != 0).select("src", (40 + n).alias("width"), (90 - n % 2 * 50).alias("height"))
    return I.localised(articles, sizes)


def state_stream(spark: SparkSession, directory: str) -> DataFrame:
    """The log of states as a stream, run to its end: refused moves by kind."""
    from folio.streaming.states import checked_states

    folder = removed_at_exit(spark, f"{shared_folder(spark)}/folio-states-{uuid.uuid4().hex}")
    _events(spark, directory).select(F.col("page_id").cast("string").alias("page_id"), "event_id", F.col("at").cast("timestamp").alias("at"), "status").write.parquet(f"{folder}/in")
    source = spark.readStream.schema("page_id string, event_id long, at timestamp, status string").parquet(f"{folder}/in")
    checked_states(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("not allowed").groupBy("from_state", F.col("to_state").alias("status")).agg(F.count("*").alias("times"))


QUERIES = {
    "article_titles": article_titles,
    "article_lengths": article_lengths,
    "article_markdown": lambda spark, directory: H.articles(as_html(spark, directory)),
    "link_density": link_density,
    "chat_answers": chat_answers,
    "book_parts": lambda spark, directory: sinks.book_parts(_best_pages(spark, directory)),
    "page_exports": page_exports,
    "book_exports": book_exports,
    "page_documents": page_documents,
    "book_documents": book_documents,
    "backups": backups,
    "restored_pages": restored_pages,
    "localised_images": localised_images,
    "state_stream": state_stream,
}

_BEST = "b AS (SELECT DISTINCT id, project_id, page_number, coalesce(nullif(approved_text, ''), nullif(latest_translation, ''), nullif(source_text, ''), '') AS t FROM pages)"

_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '[\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}]+', ' ', 'g'))"
#: Paragraphs of articles: ``p``, ``text`` without the marks of links and headings, ``shown`` with white space closed up, the ``labels`` of links.
_PARTS = rf"""WITH a AS (SELECT *, row_number() OVER () AS row_no FROM (SELECT DISTINCT article_id, title, markdown FROM fetched_articles WHERE markdown IS NOT NULL)), s AS (SELECT *, regexp_split_to_array(markdown, '\n{{2,}}') AS ps FROM a),
    u AS (SELECT article_id, row_no, title, unnest(range(len(ps))) AS k, unnest(ps) AS p FROM s), h AS (SELECT *, regexp_matches(p, '^#{{1,3}} [^\n]+$') AS heading FROM u),
    t AS (SELECT *, list_transform(regexp_extract_all(p, '(?:^|[^!])\[([^\[\]\n]*)\]\([^)\n]*\)', 1), lambda x: x) AS labels, regexp_replace(regexp_replace(CASE WHEN heading THEN regexp_replace(p, '^#+ ', '') ELSE p END, '(^|[^!])\[([^\[\]\n]*)\]\([^)\n]*\)', '\1\2', 'g'), '(^|[^!])\[([^\[\]\n]*)\]\([^)\n]*\)', '\1\2', 'g') AS text FROM h),
    e AS (SELECT *, {_SQUEEZE('text')} AS shown FROM t)"""

def _documents(source: str, keys: str) -> str:
    """Common table expressions that count paragraphs and headings of the Markdown ``t`` of ``source``: ``counted``."""
    fence = "```[^\\n]*\\n[\\s\\S]*?```"
    lines = f"len(list_filter(string_split(b, chr(10)), lambda x: {_STRIP('x')} <> ''))"
    return rf"""w AS (SELECT {keys}, list_concat(flatten(list_transform(regexp_split_to_array(t, '{fence}'), lambda p: regexp_split_to_array(p, '\n{{2,}}'))), regexp_extract_all(t, '{fence}')) AS bs FROM {source}),
        o AS (SELECT {keys}, list_filter(list_transform(bs, lambda x: {_STRIP('x')}), lambda x: x <> '') AS bs FROM w),
        counted AS (SELECT {keys}, coalesce(list_sum(list_transform(bs, lambda b: CASE WHEN starts_with(b, '```') THEN len(string_split(regexp_replace(b, '^```[^\n]*\n?|\n?```$', '', 'g'), chr(10))) WHEN regexp_matches(b, '^!\[[^\]]*\]\([^)]*\)|^#{{1,3}} +') THEN 1 ELSE {lines} END)), 0)::INT AS n,
                           len(list_filter(bs, lambda b: regexp_matches(b, '^#{{1,3}} +')))::INT AS h FROM o)"""


SQL = {
    "page_documents": f"WITH {_BEST}, d AS (SELECT id, t FROM b), {prose_sql.clean('cl', 'd', 'id')}, {_documents('cl', 'id')} SELECT id AS page_id, n + 1 AS paragraphs, h + 1 AS headings FROM counted",
    "book_documents": f"""WITH {_BEST}, d AS (SELECT project_id, id, {_STRIP('t')} AS t FROM b WHERE page_number IS NOT NULL), {_documents('d', 'project_id, id')}, s AS (SELECT project_id, sum(n + 2)::INT AS n, sum(h + 1)::INT AS h FROM counted GROUP BY 1)
        SELECT j.id AS project_id, 1 + coalesce(n, 0) AS paragraphs, 1 + coalesce(h, 0) AS headings FROM projects j LEFT JOIN s ON s.project_id = j.id""",
    "article_titles": f"SELECT article_id, {_SQUEEZE("coalesce(title, '')")} AS title FROM (SELECT DISTINCT article_id, title, markdown FROM fetched_articles WHERE markdown IS NOT NULL)",
    "article_lengths": rf"""WITH a AS (SELECT DISTINCT article_id, length({_STRIP(r"regexp_replace(markdown, '!\[[^\]]*\]\([^)]*\)', '', 'g')")})::INT AS n, markdown FROM fetched_articles WHERE markdown IS NOT NULL)
        SELECT article_id, n AS characters, n >= 150 AS long_enough FROM a""",
    "article_markdown": rf"""{_PARTS}, b AS (SELECT article_id, any_value(title) AS title, string_agg(CASE WHEN heading THEN '## ' || trim(shown, '#¶ ') ELSE {_SQUEEZE('p')} END, chr(10) || chr(10) ORDER BY k) FILTER (WHERE CASE WHEN heading THEN trim(shown, '#¶ ') ELSE {_SQUEEZE('p')} END <> '') AS body FROM e GROUP BY article_id, row_no),
        c AS (SELECT article_id, {_SQUEEZE("coalesce(title, '')")} AS title, coalesce(body, '') AS body FROM b),
        d AS (SELECT *, CASE WHEN title <> '' AND lower({_SQUEEZE(r"regexp_extract(body, '^#+ ([^\n]+)', 1)")}) <> lower(title) THEN {_STRIP("('# ' || title || chr(10) || chr(10) || body)")} ELSE body END AS m FROM c)
        SELECT article_id AS url, title, CASE WHEN n >= 150 THEN m END AS markdown, CASE WHEN n < 150 THEN 'too_short' END AS error FROM (SELECT *, length({_STRIP(r"regexp_replace(m, '!\[[^\]]*\]\([^)]*\)', '', 'g')")}) AS n FROM d)""",
    "link_density": rf"""{_PARTS}, f AS (SELECT *, coalesce(list_sum(list_transform(labels, lambda x: length({_SQUEEZE('x')}))), 0) AS linked FROM e)
        SELECT article_id, length({_SQUEEZE("string_agg(text, chr(10) ORDER BY k)")})::INT AS characters, round(CASE WHEN characters > 0 THEN sum(linked)::DOUBLE / characters ELSE 0 END, 9) AS link_share,
               coalesce(sum(length(shown)) FILTER (WHERE NOT heading AND length(shown) >= 40 AND linked::DOUBLE / length(shown) < 0.5), 0)::INT AS prose FROM f GROUP BY article_id, row_no""",
    "chat_answers": r"""WITH p AS (SELECT DISTINCT id, regexp_extract(source_text, '```[a-zA-Z0-9_-]*\n[\s\S]*?```') AS block FROM pages)
        SELECT id, 'متن پاسخ' || chr(10) || chr(10) || '```python' || chr(10) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(block, '^```[^\n]*\n|\n?```$', '', 'g'), '^\n+', ''), '\s+$', ''), '\n{3,}', chr(10) || chr(10), 'g') || chr(10) || '```' || chr(10) || chr(10) || 'پایان' AS markdown FROM p WHERE block <> ''""",
    "book_parts": f"WITH {_BEST} SELECT project_id, page_number, id, chr(10) || '<!-- Page ' || page_number || ' -->' || chr(10) || chr(10) || {_STRIP('t')} || chr(10) || chr(10) || '---' || chr(10) AS part FROM b WHERE page_number IS NOT NULL",
    "page_exports": f"WITH {_BEST} SELECT id AS page_id, '# Page ' || coalesce(page_number, 0) || chr(10) || chr(10) || {_STRIP('t')} || chr(10) AS markdown FROM b",
    "book_exports": f"""WITH {_BEST}, g AS (SELECT project_id, string_agg(chr(10) || '<!-- Page ' || page_number || ' -->' || chr(10) || chr(10) || {_STRIP('t')} || chr(10) || chr(10) || '---' || chr(10), '' ORDER BY page_number, id) AS body FROM b WHERE page_number IS NOT NULL GROUP BY 1)
        SELECT j.id AS project_id, '# ' || coalesce(title, '') || chr(10) || '_' || source_language || ' → ' || target_language || '_' || chr(10) || chr(10) || '---' || chr(10) || coalesce(body, '') AS book FROM projects j LEFT JOIN g ON g.project_id = j.id""",
    "backups": f"WITH {_BEST} SELECT project_id AS archive, 'projects/' || project_id || '/pages/page_' || coalesce(page_number::VARCHAR, 'x') || '_' || id || '.md' AS path, t AS text, NULL::VARCHAR AS error FROM b",
    "restored_pages": """WITH p AS (SELECT DISTINCT id, project_id, page_number, status, source_text, image_path, thumbnail_path, created_at, updated_at, latest_translation, approved_text FROM pages)
        SELECT p.id, p.project_id, source_type, p.status, CASE WHEN image_path = '' THEN '' ELSE '/data/new/projects/' || p.project_id || '/pages/page_' || page_number || '.png' END AS image_path,
               CASE WHEN thumbnail_path = '' THEN '' ELSE '/data/new/projects/' || p.project_id || '/pages/page_' || page_number || '_thumb.png' END AS thumbnail_path, length(source_text)::INT AS characters FROM p LEFT JOIN projects j ON j.id = p.project_id""",
    "localised_images": rf"""WITH a AS (SELECT DISTINCT article_id, project_id, markdown FROM fetched_articles WHERE markdown IS NOT NULL), t AS (SELECT article_id, project_id, markdown, regexp_extract_all(markdown, '!\[([^\]]*)\]\(([^)]*)\)', 2) AS srcs, regexp_extract_all(markdown, '!\[([^\]]*)\]\(([^)]*)\)', 1) AS alts, regexp_split_to_array(markdown, '!\[[^\]]*\]\([^)]*\)') AS ps FROM a),
        e AS (SELECT article_id, markdown, unnest(range(1, len(srcs) + 1)) AS k, unnest(srcs) AS src FROM t),
        f AS (SELECT article_id, markdown, src, min(k) AS k, row_number() OVER (PARTITION BY article_id, markdown ORDER BY min(k)) AS place FROM e GROUP BY 1, 2, 3),
        s AS (SELECT *, place <= 80 AND length(src) % 5 <> 0 AS fetched, 40 + length(src) >= 48 AND 90 - length(src) % 2 * 50 >= 48 AS large FROM f),
        n AS (SELECT *, sum((fetched AND large)::INT) OVER (PARTITION BY article_id, markdown ORDER BY k) AS number FROM s),
        m AS (SELECT article_id, markdown, map_from_entries(list((src, {{'k': k, 'n': CASE WHEN fetched AND large THEN number END, 'gone': CASE WHEN fetched THEN NOT large ELSE starts_with(src, 'data:') END}}))) AS by_src, count(*) FILTER (WHERE fetched AND large) AS images FROM n GROUP BY 1, 2)
        SELECT t.article_id, coalesce(images, 0) AS images, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN i = 1 OR by_src[srcs[i - 1]].gone OR by_src[srcs[i - 1]].k <> i - 1 THEN '' ELSE '![' || coalesce(nullif(left({_STRIP(r"regexp_replace(regexp_replace(alts[i - 1], '[\[\]()\n\r\t]+', ' ', 'g'), '[\s\p{Z}\x1c-\x1f\x{85}]{2,}', ' ', 'g')")}, 150), ''), 'Figure/Diagram') || ']('
               || CASE WHEN by_src[srcs[i - 1]].n IS NULL THEN srcs[i - 1] ELSE '/api/projects/' || project_id || '/pages/1/images/' || by_src[srcs[i - 1]].n END || ')' END || ps[i]), '') AS markdown
        FROM t LEFT JOIN m ON m.article_id = t.article_id AND m.markdown = t.markdown""",
    "state_stream": VIEWS["illegal_transitions"],
}
