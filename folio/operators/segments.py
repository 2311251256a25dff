"""Chunks for requests, sections of chapters and slices of pages: ordered folds over one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import markdown as M
from folio.functions import text as T

# Fixed values.
CHUNK_CHARS = 6000
TARGET_WORDS, LEAST_WORDS, TAIL_WORDS, INTRO_WORDS = 1500, 650, 500, 20
SLICE_PAGES, SLICE_WORDS = 4, 3000
INTRO_TITLE = "مقدمه و پیش‌زمینه فصل (Introduction)"
FRONT_MATTER = ("cover", "copyright", "title page", "table of contents", "contents", "toc")
MAIN_PREFIX = r"(?i)^\s*(?:chapter|part|فصل|بخش)"
PAGE_MARK = r"<!-- PAGE_([0-9]+) -->\n*"


def packed(items: Column, size, fits) -> Column:
    """Greedy packing of an array in order: an item joins the last pack while ``fits(pack size, item size)``, else it opens one.

    Returns an array of arrays; no item is split or dropped.
    """
    empty = F.array().cast("array<array<string>>")
    start = F.struct(empty.alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        n = size(x)
        keep = (F.size(acc["open"]) == 0) | fits(acc["n"], n)
        return F.struct(
            F.when(keep, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(keep, F.concat(acc["open"], F.array(x))).otherwise(F.array(x)).alias("open"),
            F.when(keep, acc["n"] + n).otherwise(n).alias("n"),
        )

    return F.aggregate(items, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def chunks(x: Column | str, most: int = CHUNK_CHARS) -> Column:
    """Paragraphs packed into chunks of at most ``most`` characters; a longer paragraph is a chunk of its own, a text that fits stays as it is."""
    c = T.col(x)
    paragraphs = F.filter(F.split(T.strip(c), r"\n{2,}"), T.has_text)
    # Two characters join paragraphs, so each counts with two more and the pack may be two over.
    packs = packed(paragraphs, lambda p: F.length(p) + 2, lambda n, p: n + p - 2 <= most)
    return F.when(F.length(c) <= most, F.array(c)).otherwise(F.transform(packs, lambda p: F.array_join(p, "\n\n")))


def chunk_rows(df: DataFrame, key: str, text: str, most: int = CHUNK_CHARS) -> DataFrame:
    """One row per chunk, numbered from 1, with a note "part i of n" where there are several."""
    cut = df.select(key, chunks(text, most).alias("c")).select(key, F.size("c").alias("parts"), F.posexplode_outer("c").alias("k", "chunk")).where("k is not null")
    note = F.when(F.col("parts") > 1, F.format_string("part %d of %d", F.col("k") + 1, F.col("parts"))).otherwise("")
    return cut.select(key, (F.col("k") + 1).alias("part"), "parts", note.alias("note"), "chunk")


def page_slices(pages: DataFrame) -> DataFrame:
    """Slices of up to SLICE_PAGES pages and SLICE_WORDS words of each project (``project_id``, ``page_number``, ``words``)."""
    # Only numbers are gathered per project, not texts.
    rows = pages.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "words"))).alias("p"))
    start = F.struct(F.array().cast("array<struct<first:int,last:int,pages:int,words:int>>").alias("done"), F.lit(None).cast("struct<first:int,last:int,pages:int,words:int>").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        full = acc["open"].isNotNull() & ((acc["open"]["pages"] >= SLICE_PAGES) | (acc["open"]["words"] + x["words"] > SLICE_WORDS))
        fresh = F.struct(x["page_number"].alias("first"), x["page_number"].alias("last"), F.lit(1).alias("pages"), x["words"].cast("int").alias("words"))
        grown = F.struct(acc["open"]["first"].alias("first"), x["page_number"].alias("last"), (acc["open"]["pages"] + 1).alias("pages"), (acc["open"]["words"] + x["words"]).cast("int").alias("words"))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["open"].isNull(), fresh).otherwise(grown).alias("open"),
        )

    made = rows.select("project_id", F.aggregate("p", start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"]))).alias("s"))
    return made.select("project_id", F.posexplode("s").alias("k", "s")).select("project_id", (F.col("k") + 1).alias("slice"), "s.first", "s.last", "s.pages", "s.words")


def chapters_of_outline(outline: DataFrame, totals: DataFrame) -> DataFrame:
    """Chapters of an outline (``project_id``, ``seq``, ``level``, ``title``, ``page``).

    Level 2 counts only where it has numbered chapters and level 1 has none, else
    level 1, else all. Pages before the first are the first; entries beyond the
    book are left out, though they still end the entry before. Main chapters are
    called chapter or part, or are no front matter and four pages long or more.
    """
    numbered = F.col("title").rlike(r"(?i)(?:chapter|فصل)\s*\p{Nd}+")
    whole = W.partitionBy("project_id")
    use = F.when(F.coalesce(F.max(F.when(F.col("level") == 2, numbered)).over(whole), F.lit(False)) & ~F.coalesce(F.max(F.when(F.col("level") == 1, numbered)).over(whole), F.lit(False)), 2).when(F.max(F.col("level") == 1).over(whole), 1)
    picked = outline.withColumn("_use", use).where(F.col("_use").isNull() | (F.col("level") == F.col("_use"))).withColumn("start_page", F.greatest("page", F.lit(1)))
    order = W.partitionBy("project_id").orderBy("seq")
    ended = picked.join(totals, "project_id").withColumn("end_page", F.least(F.greatest(F.coalesce(F.lead("start_page").over(order) - 1, F.col("total_pages")), F.col("start_page")), F.col("total_pages")))
    main = F.col("title").rlike(MAIN_PREFIX) | (~F.lower(T.strip("title")).isin(*FRONT_MATTER) & (F.col("end_page") - F.col("start_page") >= 3))
    return ended.where(F.col("start_page") <= F.col("total_pages")).select("project_id", "seq", T.strip("title").alias("title"), "start_page", "end_page", main.alias("is_main"))


def chapters_of_headings(pages: DataFrame) -> DataFrame:
    """``project_id``, ``start_page``, ``title``: the first heading of each page (``project_id``, ``page_number``, ``source_text``) that names a numbered chapter, where there is no outline."""
    title = F.regexp_extract("source_text", r"(?mi)^\s*#\s+((?:Chapter\s+[0-9]+|فصل\s+\p{Nd}+)[^\n]*)$", 1)
    return pages.select("project_id", F.col("page_number").alias("start_page"), T.strip(title).alias("title")).where("title <> '' and start_page is not null")


def raw_sections(text: Column) -> Column:
    """A chapter's text (pages behind their marks) cut at first and second level headings: array of (title, text).

    What comes before the first heading is a section if it has more than INTRO_WORDS words.
    """
    body = M.without_tail(text)
    pattern = r"(?:\n|^)(?=#{1,2}\s+[^\n])"
    parts = F.filter(F.transform(F.split(body, pattern, -1), T.strip), lambda p: F.length(p) > 0)
    made = F.transform(
        parts,
        lambda p, k: F.when(
            p.rlike(r"^#{1,2}\s+[^\n]"),
            F.struct(T.strip(F.regexp_replace(F.regexp_extract(p, r"^(#{1,2}\s+[^\n]+)", 1), r"^#{1,2}\s+", "")).alias("title"), T.strip(F.concat(T.strip(F.regexp_extract(p, r"^(#{1,2}\s+[^\n]+)", 1)), F.lit("\n\n"), T.strip(F.regexp_replace(p, r"^(#{1,2}\s+[^\n]+)", "")))).alias("text")),
        ).otherwise(F.struct(F.lit(INTRO_TITLE).alias("title"), p.alias("text"))),
    )
    return F.filter(made, lambda s: (s["title"] != INTRO_TITLE) | (T.word_count(F.regexp_replace(s["text"], PAGE_MARK, "")) > INTRO_WORDS))


SECTION = "struct<titles:array<string>,text:string,words:int>"


def packed_sections(raw: Column) -> Column:
    """Sections joined in order until the next one would exceed TARGET_WORDS and LEAST_WORDS are reached; a last one below TAIL_WORDS joins the one before."""
    start = F.struct(F.array().cast(f"array<{SECTION}>").alias("done"), F.lit(None).cast(SECTION).alias("open"))

    def put(acc: Column, s: Column, words: Column) -> Column:
        banner = s["title"].rlike(r"(?i)^(?:chapter|فصل)\s+\p{Nd}+") & (words <= 100)
        titles = F.when(banner, F.array().cast("array<string>")).otherwise(F.array(s["title"]))
        seal = acc["open"].isNotNull() & (acc["open"]["words"] + words > TARGET_WORDS) & (acc["open"]["words"] >= LEAST_WORDS)
        fresh = F.struct(titles.alias("titles"), s["text"].alias("text"), words.cast("int").alias("words"))
        grown = F.struct(F.concat(acc["open"]["titles"], titles).alias("titles"), F.concat(acc["open"]["text"], F.lit("\n\n"), s["text"]).alias("text"), (acc["open"]["words"] + words).cast("int").alias("words"))
        return F.struct(F.when(seal, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(seal | acc["open"].isNull(), fresh).otherwise(grown).alias("open"))

    def step(acc: Column, s: Column) -> Column:
        return T.let(T.word_count(s["text"]), lambda words: put(acc, s, words))

    def finish(acc: Column) -> Column:
        last = F.element_at(acc["done"], -1)
        merged = F.struct(F.concat(last["titles"], acc["open"]["titles"]).alias("titles"), F.concat(last["text"], F.lit("\n\n"), acc["open"]["text"]).alias("text"), (last["words"] + acc["open"]["words"]).cast("int").alias("words"))
        short = (F.size(acc["done"]) > 0) & (acc["open"]["words"] < TAIL_WORDS)
        return (
            F.when(acc["open"].isNull(), acc["done"])
            .when(short, F.concat(F.slice(acc["done"], F.lit(1), F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(merged)))
            .otherwise(F.concat(acc["done"], F.array(acc["open"])))
        )

    return F.aggregate(raw, start, step, finish)


def chapter_sections(chapters: DataFrame) -> DataFrame:
    """Sections of chapters (``project_id``, ``chapter``, ``start_page``, ``end_page``, ``pages``: array of (page_number, text)).

    A section's pages are those whose marks lie in it, else the whole chapter's.
    """
    ordered = F.array_sort("pages")
    text = F.array_join(F.transform(ordered, lambda p: F.concat(F.lit("<!-- PAGE_"), p["page_number"].cast("string"), F.lit(" -->\n"), F.coalesce(p["text"], F.lit("")))), "\n\n")
    cut = chapters.select("project_id", "chapter", "start_page", "end_page", packed_sections(raw_sections(text)).alias("s")).select("project_id", "chapter", "start_page", "end_page", F.posexplode_outer("s").alias("k", "s")).where("k is not null")
    marks = F.transform(F.regexp_extract_all(F.col("s.text"), F.lit(PAGE_MARK), F.lit(1)), lambda m: m.cast("int"))
    first, last = F.coalesce(F.array_min(marks), F.col("start_page")), F.coalesce(F.array_max(marks), F.col("end_page"))
    clean = T.strip(F.regexp_replace("s.text", PAGE_MARK, ""))
    return cut.select(
        "project_id", "chapter", "start_page", (F.col("k") + 1).alias("section"), M.section_title(F.col("s.titles"), first, last).alias("title"), first.alias("first_page"), last.alias("last_page"), T.word_count(clean).alias("words"), clean.alias("text")
    )


# Joining sentences across pages.

NO_JOIN = r"^(?:#|- |\* |```|!\[)"
NUMBERED = r"^\p{Nd}+[.)]\s+"
COMPLETE = r"""[.!?:`"'”’)\]>}]$"""


def joined_pages(texts: Column) -> Column:
    """Pages in order with the first sentence of a page moved back where the page before breaks off in one.

    A left-to-right fold: a page that has lost its first sentence is looked at as
    it is left. Words are moved, never dropped.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, raw: Column) -> Column:
        return T.let(
            F.struct(T.strip(acc["open"]).alias("c"), T.strip(raw).alias("f")),
            lambda p: T.let(
                moved_sentence(p["c"], p["f"]),
                lambda moved: F.struct(
                    F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.when(moved.isNotNull(), F.concat(p["c"], F.lit(" "), T.strip(moved))).otherwise(acc["open"])))).alias("done"),
                    F.when(moved.isNotNull(), T.strip(F.substring(p["f"], F.length(moved) + 1, F.length(p["f"])))).otherwise(raw).alias("open"),
                ),
            ),
        )

    return F.aggregate(F.transform(texts, lambda t: F.coalesce(t, F.lit(""))), start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def takes(current: Column) -> Column:
    """Whether a stripped page breaks off in a sentence."""
    last_line = T.strip(F.element_at(F.split(current, "\n"), -1))
    return (F.length(current) > 0) & ~current.rlike(COMPLETE) & ~last_line.rlike(NO_JOIN) & ~last_line.rlike(r"(?i)^(?:CHAPTER|SECTION|PART|\p{Nd}+[.)])\s+")


def offered(following: Column) -> Column:
    """The first sentence of a stripped page, with the white space after it, if it may be moved."""
    sentence = F.regexp_extract(following, r"^([\s\S]*?[.!?](?:\s+|$))", 1)
    return F.when((F.length(following) > 0) & ~following.rlike(NO_JOIN) & ~following.rlike(NUMBERED) & ~following.rlike(r"(?i)^(?:CHAPTER|SECTION)\b"), F.nullif(sentence, F.lit("")))


def moved_sentence(current: Column, following: Column) -> Column:
    """The start of ``following`` that belongs to ``current`` (both stripped), with the white space after it; null if nothing moves."""
    return F.when(takes(current), offered(following))


def stitched_books(pages: DataFrame) -> DataFrame:
    """All pages of each project after joining (``project_id``, ``page_number``, ``text``), as ``joined_pages`` folds them.

    Written without gathering a book: whether a page loses its first sentence
    depends on the page before only by whether that one has lost its own, so the
    answers follow from each other by constants and negations, which running sums
    resolve. Windows see flags and first sentences; texts stay where they are. A
    page number stands for one page.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = pages.select("project_id", "page_number", "text", T.strip(text).alias("s")).select("project_id", "page_number", "text", "s", offered(F.col("s")).alias("head"))
    rest = T.strip(F.substring("s", F.length("head") + 1, F.length("s")))
    small = read.select("project_id", "page_number", "head", F.col("head").isNotNull().alias("gives"), takes(F.col("s")).alias("takes"), F.coalesce(takes(rest), F.lit(False)).alias("takes_after"))
    order = W.partitionBy("project_id").orderBy("page_number")
    # Whether a page gives, if the page before has kept its sentence, and if it has given it.
    kept, gave = (F.col("gives") & F.coalesce(F.lag(c).over(order), F.lit(False)) for c in ("takes", "takes_after"))
    step = small.withColumn("kept", kept).withColumn("gave", gave)
    # Where both are alike the page before does not matter; from there on each "kept, not gave" turns the answer round.
    runs = step.withColumn("run", F.sum((F.col("kept") == F.col("gave")).cast("int")).over(order))
    inside = W.partitionBy("project_id", "run").orderBy("page_number")
    turns = F.sum((F.col("kept") & ~F.col("gave")).cast("int")).over(inside)
    lost = runs.withColumn("loses", (F.first("kept").over(inside).cast("int") + turns) % 2 == 1)
    gained = lost.withColumn("gains", F.when(F.lead("loses").over(order), F.lead("head").over(order)))
    moves = gained.where("loses or gains is not null").select("project_id", "page_number", "loses", "gains")
    joined = read.join(moves, ["project_id", "page_number"], "left")
    own = F.when(F.col("loses"), rest).otherwise(text)
    return joined.select("project_id", "page_number", F.when(F.col("gains").isNotNull(), F.concat(T.strip(own), F.lit(" "), T.strip("gains"))).otherwise(own).alias("text"))


def stitched_single(pages: DataFrame) -> DataFrame:
    """Each page (``project_id``, ``page_number``, ``text``) joined with its raw neighbours only: it loses what the page before takes and gains from the page after.

    Runs page by page, without a fold; windows see flags and first sentences only.
    A page number stands for one page.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = pages.select("project_id", "page_number", text.alias("text"), T.strip(text).alias("s")).withColumn("head", offered(F.col("s")))
    order = W.partitionBy("project_id").orderBy("page_number")
    small = read.select("project_id", "page_number", takes(F.col("s")).alias("takes"), "head")
    near = small.select("project_id", "page_number", F.coalesce(F.lag("takes").over(order), F.lit(False)).alias("taken"), F.lead("head").over(order).alias("next"))
    joined = read.join(near, ["project_id", "page_number"])
    own = F.when(F.col("taken") & F.col("head").isNotNull(), T.strip(F.substring("s", F.length("head") + 1, F.length("s")))).otherwise(F.col("text"))
    kept = joined.withColumn("own", own)
    gains = takes(T.strip("own")) & F.col("next").isNotNull()
    return kept.select("project_id", "page_number", F.when(gains, F.concat(T.strip("own"), F.lit(" "), T.strip("next"))).otherwise(F.col("own")).alias("text"))
