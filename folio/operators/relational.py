"""Joins, roll-ups and windows over projects, pages, attempts and conversations.

All functions take and return DataFrames. Rows repeated verbatim count once;
pages that share a number are told apart by creation time and id, so every
"first" and "latest" is a total order. Small reference tables are left to the
optimizer's own size check; nothing is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as T

# Fixed values.
STATES = ("PENDING", "READY", "APPROVED_FOR_TRANSLATION", "TRANSLATING", "TRANSLATED", "IN_REVIEW", "APPROVED", "EXPORTED", "FAILED")
CONTEXT_CHARS = 160
HISTORY_TURNS, QUOTED_CHARS = 4, 60
STALLED = "پردازش با ری‌استارت سرور متوقف شد. لطفاً دکمه تلاش مجدد را بزنید."

#: Page numbers in which pages and ranges of pages meet.
RANGE_PAGES = 64


def once(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def status_counts(pages: DataFrame) -> DataFrame:
    """Pages of each project by state, zero where there are none."""
    counted = once(pages, "id", "project_id", "status").groupBy("project_id").pivot("status", list(STATES)).count()
    return counted.select("project_id", *(F.coalesce(F.col(s), F.lit(0)).alias(s.lower()) for s in STATES))


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The attempt with the highest version of each page; of equal versions the one made last, then the highest id."""
    rows = once(attempts, "id", "page_id", "version_number", "is_approved", "created_at")
    return first_by(rows, ["page_id"], F.desc("version_number"), F.desc("created_at"), F.desc("id"))


def attempt_versions(attempts: DataFrame) -> DataFrame:
    """Versions counted anew without gaps or repeats, and the number the next attempt gets."""
    rows = once(attempts, "id", "page_id", "version_number", "created_at")
    order = W.partitionBy("page_id").orderBy("version_number", "created_at", "id")
    return rows.select("id", "page_id", F.row_number().over(order).alias("version"), (F.count("*").over(W.partitionBy("page_id")) + 1).alias("next_version"))


def attempts_of_pages(pages: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each page with the list of its attempts (version, provider), newest first; pages without attempts have an empty list."""
    rows = once(attempts, "id", "page_id", "version_number", "provider_name")
    listed = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("version_number", "id", "provider_name")), asc=False).alias("all"))
    joined = once(pages, "id").join(listed, F.col("id") == F.col("page_id"), "left")
    return joined.select(F.col("id").alias("page_id"), F.coalesce(F.transform("all", lambda a: F.concat_ws(":", a["version_number"].cast("string"), a["provider_name"])), F.array().cast("array<string>")).alias("attempts"))


def resolved_profiles(projects: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profile of each project: its own, else the oldest one; null if there is none at all."""
    # One row, whatever the size of the tables: it becomes a constant of the plan.
    oldest = profiles.agg(F.min_by(F.struct("id", "name"), F.struct("created_at", "id")).alias("fallback")).first()["fallback"]
    number, name = (F.lit(v).cast("string") for v in (oldest or (None, None)))
    own = projects.select(F.col("id").alias("project_id"), "profile_id").join(profiles.select(F.col("id").alias("profile_id"), F.col("name").alias("own_name")), "profile_id", "left")
    return own.select("project_id", F.when(F.col("own_name").isNotNull(), F.col("profile_id")).otherwise(number).alias("profile_id"), F.coalesce("own_name", name).alias("profile_name"))


def neighbour_context(pages: DataFrame) -> DataFrame:
    """End of the last line of the page before and start of the first line of the page after, CONTEXT_CHARS each."""
    rows = once(pages, "id", "project_id", "page_number", "created_at", "source_text")
    rows = first_by(rows, ["project_id", "page_number"], F.col("created_at"), F.col("id"))
    lines = F.split(T.strip("source_text"), "\n")
    order = W.partitionBy("project_id").orderBy("page_number")
    # Only the ends go through the window, not the texts.
    ends = rows.select("id", "project_id", "page_number", T.strip(F.get(lines, F.lit(0))).alias("head"), T.strip(F.element_at(lines, -1)).alias("tail"))
    ends = ends.select("id", "project_id", "page_number", F.substring("head", 1, CONTEXT_CHARS).alias("head"), F.when(F.length("tail") > CONTEXT_CHARS, F.right("tail", F.lit(CONTEXT_CHARS))).otherwise(F.col("tail")).alias("tail"))
    return ends.select(F.col("id").alias("page_id"), F.lag("tail").over(order).alias("before"), F.lead("head").over(order).alias("after"))


def conversation_history(conversations: DataFrame) -> DataFrame:
    """The up to HISTORY_TURNS turns before each turn of a page, oldest first: question, start of the text it quotes, answer. Turns without a question or answer are left out."""
    rows = once(conversations, "id", "project_id", "page_number", "selected_text", "question", "answer", "created_at")
    order = W.partitionBy("project_id", "page_number").orderBy("created_at", "id").rowsBetween(-HISTORY_TURNS, -1)
    quote = F.when(T.filled("selected_text").isNotNull(), F.concat(F.lit(" (نقل‌قول مربوطه: «"), F.substring("selected_text", 1, QUOTED_CHARS), F.lit("...»)"))).otherwise("")
    turn = F.concat(F.lit("کاربر: "), "question", quote, F.lit("\nپاسخ دستیار: "), "answer")
    return rows.select(F.col("id").alias("conversation_id"), F.collect_list(turn).over(order).alias("history"))


def pages_of_ranges(ranges: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """Pages (and ``columns`` of them) whose number lies in a range of their project; ranges may overlap.

    Pages and ranges meet in buckets of RANGE_PAGES numbers, so a project that holds
    many rows is spread over many tasks, and only ranges and pages of one bucket are
    compared. Null numbers and empty ranges give nothing; pages of one number all count.
    """
    bucket = lambda c: F.expr(f"cast(floor({c} / {RANGE_PAGES}) as int)")
    rows = once(pages, "id", "project_id", "page_number", *columns).where("page_number is not null").withColumn("_bucket", bucket("page_number")).withColumnRenamed("project_id", "_project")
    parts = ranges.where("start_page <= end_page").withColumn("_bucket", F.explode(F.sequence(bucket("start_page"), bucket("end_page"))))
    meet = (parts["project_id"] == rows["_project"]) & (parts["_bucket"] == rows["_bucket"]) & rows["page_number"].between(parts["start_page"], parts["end_page"])
    return parts.join(rows, meet).select("project_id", "chapter", "start_page", "end_page", rows["id"].alias("page_id"), "page_number", *columns)


def range_is_valid(start: Column, end: Column, total: Column) -> Column:
    return F.coalesce((start >= 1) & (start <= end) & (end <= total), F.lit(False))


def chapter_bounds(starts: DataFrame, totals: DataFrame) -> DataFrame:
    """Chapters end where the next one begins, at least on their own first page; the last ends with the book."""
    order = W.partitionBy("project_id").orderBy("start_page", "chapter")
    joined = starts.join(totals, "project_id")
    end = F.least(F.greatest(F.coalesce(F.lead("start_page").over(order) - 1, F.col("total_pages")), F.col("start_page")), F.greatest("total_pages", "start_page"))
    return joined.withColumn("end_page", end)


def without_projects(children: DataFrame, deleted: DataFrame, key: str = "project_id") -> DataFrame:
    """Rows of a table that survive the deletion of projects; rows without a project stay."""
    gone = deleted.select(F.col("id").alias("_gone")).distinct()
    return children.join(gone, children[key] == gone["_gone"], "left_anti")


def upserted(stored: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest version of every row of a table and a log of changes; of equal times the change wins."""
    both = stored.withColumn("_log", F.lit(0)).unionByName(changes.withColumn("_log", F.lit(1)))
    rest = [F.desc(c) for c in stored.columns if c not in (key, order)]
    return first_by(both, [key], F.desc(order), F.desc("_log"), *rest).drop("_log")


def rebased_paths(pages: DataFrame, root: str) -> DataFrame:
    """Paths of images below another data folder; empty paths (articles) stay empty."""
    base = F.concat(F.lit(f"{root}/projects/"), "project_id", F.lit("/pages/page_"), F.col("page_number").cast("string"))
    return once(pages, "id", "project_id", "page_number", "image_path", "thumbnail_path").select(
        F.col("id").alias("page_id"),
        F.when(F.col("image_path") == "", "").otherwise(F.concat(base, F.lit(".png"))).alias("image_path"),
        F.when(F.col("thumbnail_path") == "", "").otherwise(F.concat(base, F.lit("_thumb.png"))).alias("thumbnail_path"),
    )


def changed_states(events: DataFrame, allowed: DataFrame, key: str = "page_id", state: str = "status", order: tuple[str, ...] = ("at", "event_id")) -> DataFrame:
    """Changes of state of each key that no rule allows; staying in a state is always allowed."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(*order))
    moves = events.withColumn("from_state", before).where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))
    return moves.join(allowed, (moves["from_state"] == allowed["from_status"]) & (moves[state] == allowed["to_status"]), "left_anti")


def restarted(summaries: DataFrame) -> DataFrame:
    """Notes of chapters (``status``, ``error_message``) after a restart: what was waiting or running has failed and says why."""
    stalled = F.col("status").isin("PENDING", "PROCESSING")
    return summaries.withColumns({"status": F.when(stalled, "FAILED").otherwise(F.col("status")), "error_message": F.when(stalled, STALLED).otherwise(F.col("error_message"))})


def default_rows(templates: DataFrame) -> DataFrame:
    """The default of a table of templates: the first one marked, else the oldest."""
    return templates.orderBy(F.desc(F.coalesce("is_default", F.lit(False))), "created_at", "id").limit(1)


def with_single_default(templates: DataFrame, chosen: str) -> DataFrame:
    """One template as the default and no other."""
    return templates.withColumn("is_default", F.col("id") == chosen)


def conversations_of(conversations: DataFrame, chapter: str, section: int | None = None) -> DataFrame:
    """Conversations of a chapter, oldest first: of one section, or all of them if none is given."""
    rows = conversations.where(F.col("chapter_summary_id") == chapter)
    return (rows if section is None else rows.where(F.col("section_index") == section)).orderBy("created_at", "id")


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with a key; the filter reaches the scan."""
    return df.where(F.col(key) == value).limit(1)
