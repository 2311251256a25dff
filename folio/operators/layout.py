"""Markdown from the positioned text of PDF pages.

Input is one row per span: ``page_id, block_no, line_no, span_no, text, font,
size, flags, x0, y0, x1, y1, page_height``. Everything is grouping, windows and
folds over arrays of one page; pages are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import markdown as M
from folio.functions import text as T

# Fixed values.
MONOSPACE = ("mono", "courier", "consolas", "code", "typewriter", "inconsolata", "menlo", "fira", "thesansmono", "sourcecode", "jetbrains", "dejavu", "ubuntu")
BOLD = ("bold", "black", "heavy", "semi")
BOLD_FLAG = 2
BODY_SIZE, CHAR_WIDTH = 10.0, 5.12
H1_FACTOR, H2_FACTOR, GAP_FACTOR = 1.45, 1.18, 1.65
HEAD_SHARE, FOOT_SHARE = 0.08, 0.92
BULLETS = "•⁃‣"


def is_monospace(font: Column) -> Column:
    return F.lower(F.coalesce(font, F.lit(""))).rlike("|".join(MONOSPACE))


def is_bold(font: Column, flags: Column) -> Column:
    return F.coalesce(flags.bitwiseAND(BOLD_FLAG) > 0, F.lit(False)) | F.lower(F.coalesce(font, F.lit(""))).rlike("|".join(BOLD))


def is_running_line(text: Column, y0: Column, y1: Column, height: Column) -> Column:
    """Page numbers, running titles and notices in the margins; blank lines too."""
    t = T.strip(text)
    number = t.rlike(r"(?i)^(?:page\s+)?\p{Nd}{1,4}$") | t.rlike(r"(?i)^[ivxlcdm]{1,6}$")
    foot = (y0 > height * FOOT_SHARE) & (number | t.contains("|") | F.lower(t).contains("all rights reserved") | F.lower(t).contains("isbn"))
    head = (y1 < height * HEAD_SHARE) & (number | t.contains("|") | t.rlike(r"(?i)^(?:chapter|section|part)\s+\p{Nd}+"))
    return F.coalesce((t == "") | foot | head, F.lit(True))


def body_sizes(spans: DataFrame) -> DataFrame:
    """The commonest rounded size of each page's running text; of equally common ones the one seen first; BODY_SIZE without any."""
    order = F.struct("block_no", "line_no", "span_no")
    rows = spans.select("page_id", F.round("size", 1).alias("s"), order.alias("at"), (~is_monospace(F.col("font")) & T.has_text("text")).alias("counts"))
    sizes = rows.groupBy("page_id", "s").agg(F.count_if("counts").alias("n"), F.min(F.when(F.col("counts"), F.col("at"))).alias("at"))
    key = F.struct(F.col("n").alias("n"), (-F.col("at.block_no")).alias("b"), (-F.col("at.line_no")).alias("l"), (-F.col("at.span_no")).alias("k"))
    return sizes.groupBy("page_id").agg(F.coalesce(F.max_by("s", F.when(F.col("n") > 0, key)), F.lit(BODY_SIZE)).alias("body_size"))


def lines(spans: DataFrame) -> DataFrame:
    """One row per line: its text with inline code in backticks, its largest size, boldness and share of monospace."""
    stripped = T.strip("text")
    coded = is_monospace(F.col("font")) & (stripped != "") & ~stripped.startswith("`")
    piece = F.when(coded, F.concat(F.when(F.startswith("text", F.lit(" ")), " ").otherwise(""), F.lit("`"), stripped, F.lit("`"), F.when(F.endswith("text", F.lit(" ")), " ").otherwise(""))).otherwise(F.coalesce("text", F.lit("")))
    rows = spans.withColumn("piece", piece).withColumn("mono", F.when(is_monospace(F.col("font")), F.length("text")).otherwise(0))
    made = rows.groupBy("page_id", "block_no", "line_no").agg(
        F.array_sort(F.collect_list(F.struct("span_no", "piece", "text"))).alias("s"),
        F.max(F.round("size", 1)).alias("size"),
        F.bool_or(is_bold(F.col("font"), F.col("flags"))).alias("bold"),
        F.sum("mono").alias("mono"),
        F.sum(F.length("text")).alias("chars"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("y1").alias("y1"),
        F.max("x1").alias("x1"),
        F.max("page_height").alias("page_height"),
    )
    joined = lambda name: F.array_join(F.transform("s", lambda x: F.coalesce(x[name], F.lit(""))), "")
    return made.select("page_id", "block_no", "line_no", F.regexp_replace(T.strip(joined("piece")), r"`\s+`", " ").alias("line"), joined("text").alias("raw"), "size", "bold", "mono", "chars", "x0", "x1", "y0", "y1", "page_height")


def with_blocks(rows: DataFrame) -> DataFrame:
    """Lines with what their block is: code if more than half of its characters are monospace, and the block's own place."""
    block = W.partitionBy("page_id", "block_no")
    return rows.withColumn("is_code", F.sum("mono").over(block) > 0.5 * F.sum("chars").over(block)).withColumn("block_y0", F.min("y0").over(block)).withColumn("block_y1", F.max("y1").over(block))


def kind_of_line() -> Column:
    """Kind of a line outside code: bullet, h1, h2, h3, numbered or text, the first that fits."""
    line, size = F.col("line"), F.col("size")
    return (
        F.when(line.rlike(rf"^[{BULLETS}]|^[*-]\s"), "bullet")
        .when(size >= F.col("body_size") * H1_FACTOR, "h1")
        .when(size >= F.col("body_size") * H2_FACTOR, "h2")
        .when(F.col("bold") & (F.length(line) < 70) & ~line.rlike(r"[.:;,?!]$") & ~line.startswith("`"), "h3")
        .when(line.rlike(r"^\p{Nd}+[.)]\s"), "numbered")
        .otherwise("text")
    )


def is_prose() -> Column:
    """Whether a line outside code has text and is not one of the margins."""
    return (F.col("line") != "") & ~is_running_line(F.col("line"), F.col("y0"), F.col("y1"), F.col("page_height"))


def kinds(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lines outside code and margins with their kind."""
    return rows.where(~F.col("is_code")).join(sizes, "page_id").where(is_prose()).withColumn("kind", kind_of_line())


def with_units(rows: DataFrame) -> DataFrame:
    """Lines with the unit they belong to: ``island`` of neighbouring code blocks, or ``para`` of their block, where a text line continues the bullet or paragraph before it and all other lines stand alone. Lines that are dropped still part islands."""
    block, page = W.partitionBy("page_id", "block_no"), W.partitionBy("page_id")
    opens_block = F.col("line_no") == F.min("line_no").over(block)
    islands = rows.withColumn("_new", (opens_block & ~F.col("is_code")).cast("int")).withColumn("island", F.sum("_new").over(page.orderBy("block_no", "line_no"))).drop("_new")
    kept = islands.where(F.col("is_code") | is_prose()).withColumn("kind", F.when(F.col("is_code"), "code").otherwise(kind_of_line()))
    before = F.lag("kind").over(block.orderBy("line_no"))
    opens = (F.col("kind") != "text") | before.isNull() | before.isin("h1", "h2", "h3", "numbered")
    return kept.withColumn("_opens", opens.cast("int")).withColumn("para", F.when(F.col("is_code"), 0).otherwise(F.sum("_opens").over(block.orderBy("line_no")))).drop("_opens")


def placed_code() -> Column:
    """A line of code indented by its position in its island, after a blank line where the gap before it is wide."""
    island = W.partitionBy("page_id", "is_code", "island")
    width = F.coalesce(F.avg(F.when(F.length("raw") > 0, (F.col("x1") - F.col("x0")) / F.length("raw"))).over(island), F.lit(CHAR_WIDTH))
    gap = F.col("y0") - F.lag("y0").over(island.orderBy("block_no", "line_no"))
    indent = F.greatest(F.lit(0), F.round((F.col("x0") - F.min("x0").over(island)) / F.when(width > 0, width).otherwise(CHAR_WIDTH))).cast("int")
    blank = F.coalesce(gap >= GAP_FACTOR * F.coalesce(F.avg("size").over(island), F.lit(BODY_SIZE)), F.lit(False))
    return F.concat(F.when(blank, "\n").otherwise(""), F.repeat(F.lit(" "), indent), F.rtrim(F.ltrim("raw")))


def texts_of(kind: Column, lines: Column) -> Column:
    """The paragraphs that a unit of lines makes: one, or one for each of several bullets."""
    joined, body = F.array_join(lines, " "), F.array_join(lines, "\n")
    bare = F.regexp_replace(joined, rf"^(?:[{BULLETS}]\s*|[*-]\s+)", "")
    several = F.filter(F.transform(F.split(bare, rf"\s*[{BULLETS}]\s*"), T.strip), lambda x: F.length(x) > 0)
    marks = {"h1": "# ", "h2": "## ", "h3": "### "}
    plain = F.concat(*(F.when(kind == k, m).otherwise("") for k, m in marks.items()), joined)
    fenced = F.concat(F.lit("```"), M.code_language(body), F.lit("\n"), body, F.lit("\n```"))
    return F.when(kind == "bullet", F.transform(several, lambda x: F.concat(F.lit("- "), x))).when(kind == "code", F.array(fenced)).otherwise(F.array(plain))


def images(found: DataFrame) -> DataFrame:
    """Images worth keeping (more than 40 pixels and 30 units either way), numbered from 1 on each page."""
    kept = found.where("pixel_width > 40 and pixel_height > 40 and x1 - x0 > 30 and y1 - y0 > 30")
    return kept.withColumn("number", F.row_number().over(W.partitionBy("page_id").orderBy("y0", "x0", "xref")))


# Folds over the paragraphs of a page.

LONE_NUMBER = r"(?i)^(#+)\s+((?:(?:Chapter|Section|Part|Appendix)\s+)?\p{Nd}+(?:\.\p{Nd}+)*\.?)$"


def pairwise(items: Column, joins, joined) -> Column:
    """One pass over an array from the left in which two neighbours become one where ``joins``; what was joined is not joined again."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        return T.let(
            acc["open"].isNotNull() & F.coalesce(joins(acc["open"], x), F.lit(False)),
            lambda both: F.struct(
                F.when(both, F.concat(acc["done"], F.array(joined(acc["open"], x)))).when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
                F.when(both, F.lit(None).cast("string")).otherwise(x).alias("open"),
            ),
        )

    return F.aggregate(F.transform(items, T.strip), start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def merged_headings(paras: Column) -> Column:
    """Lone numbers joined with the heading or short title that follows, then neighbouring headings of one level joined."""

    def titled(a: Column, b: Column) -> Column:
        return a.rlike(LONE_NUMBER) & (b.rlike(r"^#+\s+") | (~b.rlike(r"^(?:#|- |\* |`|!)") & (F.length(b) < 100) & ~b.rlike(r"[.:;!?]$")))

    first = pairwise(paras, titled, lambda a, b: F.concat(a, F.lit(" "), T.strip(F.regexp_replace(b, r"^#+\s+", ""))))
    level = lambda x: F.regexp_extract(x, r"^(#{1,3})\s+", 1)
    title = lambda x: T.strip(F.regexp_replace(x, r"^#{1,3}\s+", ""))

    def split(a: Column, b: Column) -> Column:
        return (level(a) != "") & (level(a) == level(b)) & (F.length(title(a)) < 60) & ~title(a).rlike(r"[.:;!?]$") & ~title(b).rlike(r"[.;!]$") & ~title(b).rlike(r"^\p{Nd}")

    return pairwise(first, split, lambda a, b: F.concat(a, F.lit(" "), title(b)))


def stitched_paragraphs(paras: Column) -> Column:
    """Plain paragraphs joined where the first does not end like a sentence."""
    fixed = r"^(?:#|- |\* |```|!\[)"
    return pairwise(
        paras,
        lambda a, b: (F.length(a) > 0) & ~a.rlike(fixed) & ~b.rlike(fixed) & ~b.rlike(r"^\p{Nd}+[.)]\s+") & ~a.rlike(r"""[.!?:"'”’`]$"""),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def tidied(x: Column) -> Column:
    """Dashes before a line break as hyphens, hyphenated words joined, runs of blanks closed; code stays."""
    t = F.regexp_replace(x, r"[\x{2010}-\x{2014}\x{AD}]\s*\n\s*", "-\n")
    t = F.regexp_replace(t, r"([A-Za-z]+)-\s*\n\s*([a-z]+)", "$1$2")
    return F.when(x.startswith("```"), x).otherwise(F.regexp_replace(t, r"[ \t]{2,}", " "))


def page_markdown(spans: DataFrame) -> DataFrame:
    """``page_id`` and ``markdown`` of every page with at least one span that stays. Spans are brought together by page once; all that follows stays in place."""
    spans = spans.repartition("page_id")
    rows = with_units(with_blocks(lines(spans)).join(body_sizes(spans), "page_id"))
    code = F.col("is_code")
    pieces = rows.select("page_id", "is_code", F.when(code, F.col("island")).otherwise(F.col("block_no")).alias("unit"), "para", "kind", "block_no", "line_no", "block_y0", F.when(code, placed_code()).otherwise(F.col("line")).alias("piece"))
    units = pieces.groupBy("page_id", "is_code", "unit", "para").agg(F.min_by("kind", "line_no").alias("kind"), F.array_sort(F.collect_list(F.struct("block_no", "line_no", "piece"))).alias("ls"), F.min("block_y0").alias("y0"), F.min("block_no").alias("block_no"))
    made = units.select("page_id", "y0", code.cast("int").alias("sort"), "block_no", "para", texts_of(F.col("kind"), F.col("ls.piece")).alias("texts"))
    gathered = made.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y0", "sort", "block_no", "para", "texts"))).alias("p"))
    paras = stitched_paragraphs(merged_headings(F.flatten("p.texts")))
    return gathered.select("page_id", T.strip(F.array_join(F.transform(paras, tidied), "\n\n")).alias("markdown"))
