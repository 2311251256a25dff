"""Exports: Markdown, Word documents and archives."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import PurePosixPath
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import markdown as M
from folio.functions import persian
from folio.functions import text as T
from folio.operators.relational import rebased_paths
from folio.schemas import NOTES, TABLES, with_schema


def page_markdown(number: Column, text: Column) -> Column:
    return F.concat(F.lit("# Page "), number.cast("string"), F.lit("\n\n"), T.strip(text), F.lit("\n"))


def book_parts(pages: DataFrame) -> DataFrame:
    """``project_id``, ``page_number``, ``id``, ``part``: what each page adds to its book (``pages``: project_id, page_number, id, text). A book too large for a row is written from these, sorted."""
    part = F.concat(F.lit("\n<!-- Page "), F.col("page_number").cast("string"), F.lit(" -->\n\n"), T.strip("text"), F.lit("\n\n---\n"))
    return pages.where("page_number is not null").select("project_id", "page_number", "id", part.alias("part"))


def books(projects: DataFrame, pages: DataFrame) -> DataFrame:
    """``project_id``, ``book``: title, languages and all pages of each project in order. The book is the result and one row, so it must fit into one; ``book_parts`` has no such bound. Projects without pages have only their head."""
    gathered = book_parts(pages).groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "id", "part"))), lambda p: p["part"]), "").alias("body"))
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n_"), F.col("source_language"), F.lit(" → "), F.col("target_language"), F.lit("_\n\n---\n"))
    joined = projects.select(F.col("id").alias("project_id"), head.alias("head")).join(gathered, "project_id", "left")
    return joined.select("project_id", F.concat("head", F.coalesce("body", F.lit(""))).alias("book"))


def notes_markdown(title: Column, start: Column, end: Column, notes_json: Column) -> Column:
    """Notes of a chapter: title, pages, and each section with its number, title, pages and note; null if there are none yet."""
    notes = F.from_json(notes_json, NOTES)
    said = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    pages = lambda label, a, b: F.concat(F.lit(f"**{label}"), said(a), F.lit(" الی "), said(b))
    part = lambda n: F.concat(F.lit("## بخش "), said(n["section_index"]), F.lit(": "), said(n["section_title"]), F.lit("\n"), pages("صفحات ", n["start_page"], n["end_page"]), F.lit("**\n\n"), said(n["note"]), F.lit("\n\n---\n\n"))
    return F.when(F.size(notes) > 0, F.concat(F.lit("# "), title, F.lit("\n\n"), pages("صفحات:** ", start, end), F.lit("\n\n---\n\n"), F.array_join(F.transform(notes, part), "")))


def notes_file_name(start: Column, end: Column, title: Column, kind: str) -> Column:
    return F.concat(F.lit("Chapter_"), start.cast("string"), F.lit("_"), end.cast("string"), F.lit("_"), M.safe_name(title), F.lit(f".{kind}"))


# Word documents, from right to left.

TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: The font of all runs, Latin and complex scripts alike (fixed value).
FONTS = '<w:rFonts w:ascii="Vazirmatn" w:hAnsi="Vazirmatn" w:cs="Vazirmatn"/>'
SIZES = {"h1": 36, "h2": 30, "h3": 26}


def run_xml(text: str, size: int = 24, bold: bool = False, italic: bool = False) -> str:
    marks = f"{FONTS}{'<w:b/><w:bCs/>' * bold}{'<w:i/><w:iCs/>' * italic}<w:sz w:val=\"{size}\"/><w:szCs w:val=\"{size}\"/><w:rtl/>"
    parts = escape(text).split("\n")
    return f'<w:r><w:rPr>{marks}</w:rPr>{"<w:br/>".join(f"<w:t xml:space=\"preserve\">{p}</w:t>" for p in parts)}</w:r>'


def paragraph_xml(runs: str, keep: bool = False, align: str = "start", indent: int = 0) -> str:
    return f'<w:p><w:pPr>{"<w:keepNext/>" * keep}<w:bidi/>{f"<w:ind w:start=\"{indent}\"/>" * bool(indent)}<w:jc w:val="{align}"/></w:pPr>{runs}</w:p>'


def bold_runs(text: str, size: int = 24) -> str:
    return "".join(run_xml(p, size, bold=k % 2 == 1) for k, p in enumerate(re.split(r"\*\*([^*\n]+)\*\*", text)) if p)


def block_xml(block: str) -> str:
    """A paragraph of Markdown in the form of its kind: image, headings, bullet, numbered, quote, code or body."""
    s = block.strip()
    if s.startswith("```"):
        return "".join(paragraph_xml(run_xml(x, 20), align="end") for x in re.sub(r"^```[^\n]*\n?|\n?```$", "", s).split("\n"))
    if m := re.match(r"!\[([^\]]*)\]\(([^)]*)\)", s):
        return paragraph_xml(run_xml(m.group(1) if not re.fullmatch(r"(?i)figure\s*/\s*diagram|image|تصویر|نمودار", m.group(1).strip()) else m.group(2), italic=True), align="center")
    if m := re.match(r"(#{1,3}) +(.*)", s, re.S):
        kind = f"h{len(m.group(1))}"
        return paragraph_xml(run_xml(m.group(2), SIZES[kind], bold=True), keep=True)
    out = []
    for line in s.split("\n"):
        if m := re.match(r"[-*] +(.*)", line):
            out.append(paragraph_xml(run_xml("• ") + bold_runs(m.group(1)), indent=360))
        elif m := re.match(r"([\d۰-۹]+)\. +(.*)", line):
            out.append(paragraph_xml(run_xml(f"{m.group(1)}. ") + bold_runs(m.group(2)), indent=360))
        elif line.startswith(">"):
            out.append(paragraph_xml(run_xml(line.lstrip("> "), italic=True), indent=720))
        elif line.strip():
            out.append(paragraph_xml(bold_runs(line)))
    return "".join(out)


def docx(blocks: list[str]) -> bytes:
    """A Word document of the given paragraphs (XML); the same input gives the same bytes."""
    body = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(blocks)}<w:sectPr><w:bidi/></w:sectPr></w:body></w:document>'
    body = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", body)
    return zipped({"[Content_Types].xml": TYPES.encode(), "_rels/.rels": RELATIONS.encode(), "word/document.xml": body.encode()})


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def paragraphs_xml(text: str) -> list[str]:
    """Paragraphs of a text; fenced code stays together."""
    parts = re.split(r"(```[^\n]*\n[\s\S]*?```)", text)
    return [block_xml(p) for k, part in enumerate(parts) for p in ([part] if k % 2 else re.split(r"\n{2,}", part)) if p.strip()]


def page_docx(number: int, text: str) -> bytes:
    title = f"صفحه {str(number).translate(str.maketrans('0123456789', persian.PERSIAN_DIGITS))}"
    return docx([paragraph_xml(run_xml(title, SIZES["h2"], bold=True), keep=True), *paragraphs_xml(text)])


def pages_docx(pages: DataFrame) -> DataFrame:
    """``page_id``, ``content`` (a Word document) of (page_id, page_number, text); the text is cleaned once before. Null numbers count as 0."""
    from folio.functions import repair

    clean = repair.clean_markdown(pages.select("page_id", F.coalesce("page_number", F.lit(0)).alias("page_number"), F.coalesce("text", F.lit("")).alias("text")), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "content": [page_docx(int(n), t or "") for n, t in zip(frame["page_number"], frame["text"], strict=True)]})

    return clean.mapInPandas(run, "page_id string, content binary")


def described(documents: DataFrame, key: str) -> DataFrame:
    """``key``, ``paragraphs``, ``headings`` of Word documents (``key``, ``content``), read back from their bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bodies = [zipfile.ZipFile(io.BytesIO(c)).read("word/document.xml").decode() for c in frame["content"]]
            yield pd.DataFrame({key: frame[key], "paragraphs": [b.count("<w:p>") for b in bodies], "headings": [b.count("<w:keepNext/>") for b in bodies]})

    return documents.select(key, "content").mapInPandas(run, f"`{key}` string, paragraphs int, headings int")


def books_docx(books_: DataFrame) -> DataFrame:
    """``project_id``, ``content`` of (project_id, book), the Markdown of ``books``: page marks become page breaks."""

    def whole(book: str) -> bytes:
        parts = re.split(r"\n<!-- Page (\d+) -->\n\n", book)
        out = paragraphs_xml(parts[0].replace("\n---\n", "\n"))
        for number, text in zip(parts[1::2], parts[2::2], strict=True):
            out.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
            out.append(paragraph_xml(run_xml(f"صفحه {number.translate(str.maketrans('0123456789', persian.PERSIAN_DIGITS))}", SIZES["h2"], bold=True), keep=True))
            out += paragraphs_xml(re.sub(r"\n\n---\n?$", "", text))
        return docx(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"project_id": frame["project_id"], "content": [whole(b) for b in frame["book"]]})

    return books_.mapInPandas(run, "project_id string, content binary")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``counts``: the number of rows of each table as one JSON document, by name. One row per table is gathered."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("counts"))


#: Files of one archive; a project with more gets several.
ARCHIVE_FILES = 2000


def archives(files: DataFrame, manifest: dict, most: int = ARCHIVE_FILES) -> DataFrame:
    """``project_id``, ``part``, ``content``: archives of the files of each project (project_id, path, content), each with a manifest.

    A task packs about ``most`` files at a time, however many a project has; an
    archive is the unit in which a backup is read back.
    """
    counts = files.groupBy("project_id").agg(F.ceil(F.count("*") / most).alias("parts"))
    placed = files.join(counts, "project_id").withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int")).drop("parts")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        members = {"manifest.json": json.dumps(manifest | {"files": len(frame)}, ensure_ascii=False, sort_keys=True).encode()}
        members |= {f"projects/{p}": bytes(c) for p, c in sorted(zip(frame["path"], frame["content"], strict=True)) if is_inside(p)}
        return pd.DataFrame({"project_id": [frame["project_id"].iloc[0]], "part": [frame["part"].iloc[0]], "content": [zipped(members)]})

    return placed.groupBy("project_id", "part").applyInPandas(pack, "project_id string, part int, content binary")


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """A backup of whole tables below a folder, a table each, and the manifest of their rows; the parts are written by the tasks that hold them."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/tables/{name}")
    manifest(tables).coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def restored(spark: SparkSession, folder: str, root: str) -> dict[str, DataFrame]:
    """The tables of a snapshot in today's schema, with the paths of pages moved below another data folder. A folder without a manifest is no backup."""
    counts = [r[0] for r in spark.read.text(f"{folder}/manifest").collect()]
    if len(counts) != 1:
        raise ValueError(f"{folder} holds no manifest")
    found = {}
    for name in json.loads(counts[0]):
        found[name] = spark.read.parquet(f"{folder}/tables/{name}")
        if name in TABLES:
            found[name] = with_schema(found[name], name)
    if "pages" in found:
        moved = rebased_paths(found["pages"], root).withColumnRenamed("page_id", "id").distinct()
        found["pages"] = found["pages"].drop("image_path", "thumbnail_path").distinct().join(moved, "id").select(*found["pages"].columns)
    return found


def is_inside(path: str) -> bool:
    """Whether a member stays inside the folder it is unpacked to."""
    p = PurePosixPath(path)
    return not p.is_absolute() and ".." not in p.parts and bool(p.parts)


def unpacked(found: DataFrame) -> DataFrame:
    """``archive``, ``path``, ``content``, ``error`` of archives (archive, content): members below projects/ and the manifest; what is no archive or would leave the folder is an error row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["archive"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for member in archive.infolist():
                            if member.is_dir():
                                continue
                            fine = is_inside(member.filename) and (member.filename == "manifest.json" or member.filename.startswith("projects/"))
                            rows.append((name, member.filename, archive.read(member) if fine else None, None if fine else "outside"))
                except (zipfile.BadZipFile, TypeError):
                    rows.append((name, None, None, "no_archive"))
            yield pd.DataFrame(rows, columns=["archive", "path", "content", "error"])

    return found.mapInPandas(run, "archive string, path string, content binary, error string")
