"""Operators on small tables with nulls, ties, repeats and clashing columns."""

import io
import zipfile

from pyspark.sql import functions as F

from folio import schemas, sinks
from folio.operators import glossary as G
from folio.operators import html as H
from folio.operators import images as I
from folio.operators import layout as Y
from folio.operators import prompts as Q
from folio.operators import relational as R
from folio.operators import segments as S
from folio.sources.embedded import decoded


def folded(spark, function, items):
    return spark.createDataFrame([(items,)], "a array<string>").select(function(F.col("a")).alias("r")).first()[0]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "aa\n\nbbb\n\n\ncc"), (2, ""), (3, None), (4, "x" * 20)], "id int, t string")
    got = {r.id: r.c for r in df.select("id", S.chunks("t", 7).alias("c")).collect()}
    assert got == {1: ["aa\n\nbbb", "cc"], 2: [""], 3: None, 4: ["x" * 20]}


def test_page_joins(spark):
    assert folded(spark, S.joined_pages, ["One broken", "sentence. Two.", "Three"]) == ["One broken sentence.", "Two.", "Three"]
    assert folded(spark, S.joined_pages, ["open", "# Head"]) == ["open", "# Head"]
    assert folded(spark, S.joined_pages, ["open", "all of it."]) == ["open all of it.", ""]
    assert folded(spark, S.joined_pages, []) == []
    words = ["a b", "c d. e", "f. g", None, "h"]
    assert " ".join(folded(spark, S.joined_pages, words)).split() == "a b c d. e f. g h".split()


def test_headings_and_paragraphs(spark):
    assert folded(spark, Y.merged_headings, ["## 2.3", "## Title", "text"]) == ["## 2.3 Title", "text"]
    assert folded(spark, Y.merged_headings, ["# One", "# Two", "# Three"]) == ["# One Two", "# Three"]
    assert folded(spark, Y.stitched_paragraphs, ["one", "two.", "- x", "three"]) == ["one two.", "- x", "three"]
    assert folded(spark, Y.stitched_paragraphs, []) == []


def test_sections(spark):
    long = "word " * 700
    text = f"<!-- PAGE_1 -->\n# A\n{long}\n\n<!-- PAGE_2 -->\n## B\n{long}\n## C\n{'w ' * 300}"
    df = spark.createDataFrame([("p", "c", 1, 9, [(2, "skip"), (1, text)])], "project_id string, chapter string, start_page int, end_page int, pages array<struct<page_number:int,text:string>>")
    rows = S.chapter_sections(df).orderBy("section").collect()
    assert [r.section for r in rows] == [1, 2] or len(rows) == 1
    assert sum(r.words for r in rows) >= 1700


def test_latest_and_versions_with_ties(spark):
    rows = [("a", "p", 1, True, None), ("a", "p", 1, True, None), ("b", "p", 1, False, None), ("c", "p", None, None, None), ("d", None, 2, None, None)]
    df = spark.createDataFrame(rows, "id string, page_id string, version_number int, is_approved boolean, created_at timestamp")
    assert {(r.page_id, r.id) for r in R.latest_attempts(df).collect()} == {("p", "b"), (None, "d")}
    assert sorted((r.id, r.version) for r in R.attempt_versions(df).where("page_id = 'p'").collect()) == [("a", 2), ("b", 3), ("c", 1)]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], schemas.TABLES["pages"])
    assert R.status_counts(pages).count() == 0
    assert R.neighbour_context(pages).count() == 0
    assert S.stitched_books(pages.select("project_id", "page_number", F.col("source_text").alias("text"))).count() == 0


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "c", 1), (3, "d", 0)], "id int, v string, at int")
    assert {tuple(r) for r in R.upserted(old, new, "id", "at").collect()} == {(1, "c", 1), (2, "b", 1), (3, "d", 0)}
    children = spark.createDataFrame([("x", "p1"), ("y", None), ("z", "p2")], "id string, project_id string")
    assert {r.id for r in R.without_projects(children, spark.createDataFrame([("p1",)], "id string")).collect()} == {"y", "z"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", "p", "READY", "x", "y")], "id string, project_id string, status string, _rank string, count string")
    assert R.status_counts(df).first().ready == 1


def test_notes_by_title_or_number(spark):
    sections = spark.createDataFrame([("p", "c", 1, "A"), ("p", "c", 2, "B"), ("p", "c", 3, "C")], "project_id string, chapter string, section int, title string")
    notes = spark.createDataFrame([("p", "c", 9, "A", ""), ("p", "c", 2, "old", "note 2"), ("p", "c", 1, "other", "note 1")], "project_id string, chapter string, section_index int, section_title string, note string")
    got = {r.section: r.note for r in Q.cached_notes(sections, notes).collect()}
    # A known title with an empty note wins over the number and asks for a new note.
    assert got == {1: None, 2: "note 2", 3: None}
    assert {r.section for r in Q.open_sections(sections, notes).collect()} == {1, 3}


def test_prompts_and_providers(spark):
    df = spark.createDataFrame([("Hello", [("Hello", "سلام", True)])], f"t string, g {Q.NO_TEXT}")
    row = df.select(Q.translation_prompt(F.col("t"), F.lit("English"), F.lit("Persian"), F.lit("Do"), F.col("g"), F.lit("ctx")).alias("p"), Q.translation_prompt(F.col("t"), F.lit("e"), F.lit("p"), F.lit(" ")).alias("q"), Q.mock_translation(F.col("t"), F.col("g")).alias("m")).first()
    assert "'Hello' → 'سلام'" in row.p and "<source_document>\nHello\n</source_document>" in row.p and row.q == "Hello"
    assert row.m == "ترجمه روان: سلام (Hello)"
    notes = df.select(Q.context_notes(F.lit("end"), F.lit(""), F.lit(True), F.lit(False), F.lit("short")).alias("n"), Q.context_notes(F.lit(None), F.lit(None), F.lit(False), F.lit(False)).alias("e")).first()
    assert notes.n.startswith(f"{Q.BOUNDARY_HEAD}\n- Previous page ends with: '... end'\nRule:") and Q.CODE_RULE in notes.n and Q.IMAGE_RULE not in notes.n and notes.n.endswith("Additional Instructions: short") and notes.e == ""
    Q.register("echo", lambda: lambda prompts: [p.upper() for p in prompts])
    assert Q.answered(df.select("t"), "t", Q.PROVIDERS["echo"]).first().answer == "HELLO"


def test_data_addresses(spark):
    rows = ["data:text/plain;base64,aGk=", "data:text/plain,a%20b", "http://x", "data:;base64,***", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "u string").select(decoded("u").alias("d")).collect()]
    assert [bytes(g) if g is not None else None for g in got] == [b"hi", b"a b", None, None, None]


def test_spans_become_markdown(spark):
    rows = [("p", 1, 1, 0, "Big", "Times", 20.0, 0, 10.0, 100.0, 40.0, 110.0, 800.0), ("p", 2, 2, 0, "• one", "Times", 10.0, 0, 10.0, 120.0, 40.0, 130.0, 800.0), ("p", 2, 3, 0, "more", "Times", 10.0, 0, 10.0, 132.0, 40.0, 142.0, 800.0),
            ("p", 3, 4, 0, "def f():", "Courier", 10.0, 0, 10.0, 150.0, 50.0, 160.0, 800.0), ("p", 3, 5, 0, "return 1", "Courier", 10.0, 0, 30.0, 162.0, 70.0, 172.0, 800.0), ("p", 4, 6, 0, "12", "Times", 10.0, 0, 10.0, 780.0, 20.0, 790.0, 800.0),
            ("p", 5, 7, 0, "body text", "Times", 10.0, 0, 10.0, 200.0, 55.0, 210.0, 800.0)]
    df = spark.createDataFrame(rows, "page_id string, block_no int, line_no int, span_no int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double, page_height double")
    assert Y.page_markdown(df).first().markdown == "# Big\n\n- one more\n\n```python\ndef f():\n    return 1\n```\n\nbody text"


def test_html(spark):
    text = "Some long sentence about nothing, really. " * 20
    page = f"<html><head><title>T</title></head><body><nav><a href='/'>x</a></nav><article><h2>Part</h2><p>{text}</p><img data-src='a.png'></article><div class='related'><p>{text}</p></div></body></html>"
    title, body = H.article_markdown(page, "http://h/")
    assert title == "T" and body.startswith("# T\n\n## Part") and "![Figure/Diagram](http://h/a.png)" in body and body.count("Some long") == 20
    rows = spark.createDataFrame([("u", page), ("v", None), ("w", "")], "url string, html string")
    assert {r.url: r.error for r in H.articles(rows).collect()} == {"u": None, "v": "too_short", "w": "too_short"}
    assert H.best_candidate("a 1x, b 2x") == "b"


def test_content_in_sections():
    text = "Plain words about the matter at hand, with a comma and more words to read. " * 4
    parts = "".join(f"<section><h2><a href='#s{k}'>Part {k}</a></h2><div><p>{text}{k}</p></div></section>" for k in range(5))
    page = f"<html><body><header><p>{text}</p></header><main><div>{parts}</div><ul>{''.join(f'<li><a href=/{k}>link number {k} of the contents</a></li>' for k in range(9))}</ul></main><div class='comments'><p>{text}</p></div></body></html>"
    body = H.article_markdown(page, "http://h/")[1]
    assert [f"## Part {k}" in body for k in range(5)] == [True] * 5 and "link number" not in body and body.count("matter at hand") == 20
    deep = "<div>" * 5000 + f"<p>{text * 3}</p>" + "</div>" * 5000
    assert "matter at hand" in H.article_markdown(deep, "")[1] and H.article_markdown("", "") == ("", "")
    assert H.chat_markdown("<pre><div class='bar'><span>php</span><button>Copy code</button></div><code class='language-php'>a = 1;\n</code></pre>").endswith("a = 1;\n```")


def test_terms(spark):
    rows = [("a", "Hello World, hello"), ("b", None), ("c", ""), ("d", "nothing")]
    df = spark.createDataFrame([(k, t, "p" if k == "a" else "q", 1) for k, t in rows], "id string, t string, project_id string, _low int").drop("_low")
    terms = spark.createDataFrame([(None, " hello ", "x", True), (None, "hello", "b", False), ("p", "World", "own", None), ("q", "Hello", "other", None), (None, "world", "w", None), (None, "", "e", None), (None, None, "n", None)], "project_id string, source_term string, target_term string, include_parenthesis_english boolean")
    for size in (1, 100):
        found = {r.id: [tuple(t) for t in r.terms] for r in G.with_terms(df, "t", terms, "project_id", size=size).collect()}
        assert found == {"a": [("World", "own", None), ("hello", "b", False), ("world", "w", None)], "b": [], "c": [], "d": []}
    lines = df.select(F.col("id").alias("key"), F.col("t").alias("line"))
    assert sorted(r.term for r in G.hits(lines, terms).collect()) == ["Hello", "World", "hello", "world"]
    assert G.hits(lines, terms.limit(0)).count() == 0 and G.with_terms(df.limit(0), "t", terms).count() == 0


def test_pages_of_ranges(spark):
    pages = spark.createDataFrame([(f"{p}{k}", p, k) for p in "ab" for k in (1, 64, 65, 200, None)], "id string, project_id string, page_number int")
    ranges = spark.createDataFrame([("a", "x", 1, 65), ("a", "y", 65, 300), ("b", "z", 5, 2), ("c", "w", 1, 9)], "project_id string, chapter string, start_page int, end_page int")
    found = {(r.chapter, r.page_id) for r in R.pages_of_ranges(ranges, pages.union(pages)).collect()}
    assert found == {("x", "a1"), ("x", "a64"), ("x", "a65"), ("y", "a65"), ("y", "a200")}
    assert R.pages_of_ranges(ranges.limit(0), pages).count() == R.pages_of_ranges(ranges, pages.limit(0)).count() == 0


def test_single_joins(spark):
    df = spark.createDataFrame([("p", 1, "One broken"), ("p", 2, "sentence. Two"), ("p", 3, None), ("p", 4, "end.")], "project_id string, page_number int, text string")
    assert [r.text for r in S.stitched_single(df).orderBy("page_number").collect()] == ["One broken sentence.", "Two", "", "end."]
    assert S.stitched_single(df.limit(0)).count() == 0


def test_documents_and_archives(spark):
    content = sinks.page_docx(3, "# T\n\n- a **b**\n\n```\nx\n```\n\n> q\n\n1. n")
    xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode()
    assert "<w:bidi/>" in xml and "صفحه ۳" in xml and "<w:b/>" in xml
    files = spark.createDataFrame([("p", "p/a.md", b"1"), ("p", "../evil", b"2")], "project_id string, path string, content binary")
    packed = sinks.archives(files, {"version": 1}).withColumnRenamed("project_id", "archive")
    assert {r.path for r in sinks.unpacked(packed).collect()} == {"manifest.json", "projects/p/a.md"}
    broken = spark.createDataFrame([("z", b"no zip"), ("n", None)], "archive string, content binary")
    assert {r.error for r in sinks.unpacked(broken).collect()} == {"no_archive"}


def test_schema_is_additive(spark):
    old = spark.createDataFrame([("i", 1)], "id string, extra int")
    made = schemas.with_schema(old, "page_conversations")
    assert made.columns[0] == "id" and "extra" not in made.columns and made.first().question is None


def test_defaults_and_lookups(spark):
    rows = [("a", False, 2, "c", None), ("b", None, 1, "c", 1), ("d", True, 3, "x", 2)]
    df = spark.createDataFrame(rows, "id string, is_default boolean, created_at int, chapter_summary_id string, section_index int")
    assert R.default_rows(df).first().id == "d" and R.default_rows(df.where("id <> 'd'")).first().id == "b" and R.default_rows(df.limit(0)).count() == 0
    assert {r.id for r in R.with_single_default(df, "a").where("is_default").collect()} == {"a"}
    assert [r.id for r in R.conversations_of(df, "c").collect()] == ["b", "a"] and [r.id for r in R.conversations_of(df, "c", 1).collect()] == ["b"]
    assert R.by_key(df, "id", "a").count() == 1


def test_values(spark):
    from folio.functions import values as V

    row = spark.createDataFrame([("#000000", "#ffffff", "x.PDF", "p/page_2_img_11.png", "OpenAI ", "a $x$ \\(y\\) $$z$$")], "a string, b string, f string, p string, m string, t string").select(
        V.contrast("a", "b").alias("c"), V.upload_kind("f").alias("u"), V.image_order("p").alias("o"), V.provider_key("m").alias("k"), V.formulas("t").alias("t")
    ).first()
    assert abs(row.c - 21) < 1e-9 and row.u == "book" and tuple(row.o) == (2, 11) and row.k == "openai" and row.t == ["$x$", "\\(y\\)", "$$z$$"]


def test_localised_images(spark):
    text = "a ![x](u1) b ![](u2)\n\n![y](u1) ![z](data:image/png;base64,AA) ![t](small) ![v (w)](gone)"
    rows = [("a", "p", text), ("b", "p", None), ("c", "p", ""), ("d", None, "no image"), ("e", "p", "".join(f"![i](n{k})" for k in range(85)))]
    articles = spark.createDataFrame(rows, "article_id string, project_id string, markdown string")
    sizes = spark.createDataFrame([("u1", 100, 100), ("u2", 50, 48), ("small", 47, 500), ("u1", 100, 100), (None, 9, 9), *[(f"n{k}", 60, 60) for k in range(85)]], "src string, width int, height int")
    found = {r.article_id: (r.images, r.markdown) for r in I.localised(articles, sizes).collect()}
    base = "/api/projects/p/pages/1/images/"
    assert found["a"] == (2, f"a ![x]({base}1) b ![Figure/Diagram]({base}2)\n\n   ![v w](gone)")
    assert found["b"] == (0, None) and found["c"] == (0, "") and found["d"] == (0, "no image")
    # Of more images than are fetched the others keep their addresses.
    assert found["e"][0] == 80 and found["e"][1].endswith("![i](n83)![i](n84)")
    assert I.localised(articles.limit(0), sizes).count() == 0 and I.localised(articles, sizes.limit(0)).where("images > 0").count() == 0
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000006400000012C") + b"rest"
    row = spark.createDataFrame([(png,), (b"no",), (None,)], "c binary").select(I.png_size(F.col("c")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in row] == [(1600, 300), None, None]
    row = spark.createDataFrame([(3200, 10), (100, 5)], "w int, h int").select(I.shrunk(F.col("w"), F.col("h")).alias("s")).collect()
    assert [tuple(r.s) for r in row] == [(1600, 5), (100, 5)]


def test_notes_are_asked_for_once_more(spark):
    shape = "project_id string, chapter string, section int, title string, first_page int, last_page int, words int, text string"
    sections = spark.createDataFrame([("p", "c", k, f"T{k}", k, k, 9, t) for k, t in ((1, "kept"), (2, "fine"), (3, "lazy"), (4, "stubborn"), (5, None))], shape)
    notes = spark.createDataFrame([("p", "c", 1, "T1", "old note")], "project_id string, chapter string, section_index int, section_title string, note string")

    def model():
        def ask(prompts):
            return ["بله" if "stubborn" in p or "lazy" in p and not p.startswith(Q.STRICT) else None if "fine" not in p and "lazy" not in p else f"**note: **of {'fine' if 'fine' in p else 'lazy'}" for p in prompts]

        return ask

    made = Q.made_notes(sections, notes, F.lit("{chapter_title}|{content_text}"), model)
    assert {r.section: r.note for r in made.collect()} == {1: "old note", 2: "**note:** of fine", 3: "**note:** of lazy", 4: "بله", 5: ""}
    done = Q.finished_sections(made).first()
    assert (done.done, done.progress) == (4, 82)
    # The next run asks for what is open only.
    kept = made.withColumnRenamed("section", "section_index").withColumnRenamed("title", "section_title")
    assert [r.section for r in Q.open_sections(sections, kept).collect()] == [5]
    assert Q.made_notes(sections.limit(0), notes, F.lit("x"), model).count() == 0


def test_backups_of_tables(spark, tmp_path):
    pages = spark.createDataFrame([("i", "p", 1, "READY", "t", "/old/a.png", ""), ("i", "p", 1, "READY", "t", "/old/a.png", ""), ("j", None, None, None, None, "", None)], "id string, project_id string, page_number int, status string, source_text string, image_path string, thumbnail_path string")
    sinks.snapshot({"pages": pages, "empty": pages.limit(0).select("id")}, str(tmp_path / "b"))
    found = sinks.restored(spark, str(tmp_path / "b"), "/new")
    assert {(r.id, r.image_path) for r in found["pages"].collect()} == {("i", "/new/projects/p/pages/page_1.png"), ("j", "")}
    assert found["pages"].count() == 2 and found["pages"].columns == [f.split(" ")[0] for f in schemas.TABLES["pages"].split(", ")] and found["empty"].count() == 0


def test_restarts_and_answers(spark):
    from folio.functions import values as V

    df = spark.createDataFrame([("a", "PENDING", None), ("b", "COMPLETED", "x"), ("c", None, None)], "id string, status string, error_message string")
    assert [(r.status, bool(r.error_message)) for r in R.restarted(df).orderBy("id").collect()] == [("FAILED", True), ("COMPLETED", True), (None, False)]
    cases = [(200, "text/html"), (200, None), (403, ""), (404, ""), (503, ""), (200, "application/PDF"), (200, "image/png"), (200, "application/xhtml+xml"), (None, None)]
    got = [r.a for r in spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, s int, c string").orderBy("k").select(V.fetch_action("s", "c").alias("a")).collect()]
    assert got == ["parse", "parse", "browser", "error_status", "browser", "error_pdf", "error_type", "parse", "browser"]
    heads = spark.createDataFrame([("p", 3, "text\n# Chapter 2: B\n# Chapter 3"), ("p", 1, "# chapter 1"), ("p", 2, "# Chapters"), ("p", None, "# Chapter 9"), ("q", 1, None)], "project_id string, page_number int, source_text string")
    assert {(r.start_page, r.title) for r in S.chapters_of_headings(heads).collect()} == {(3, "Chapter 2: B"), (1, "chapter 1")}


def test_failing_providers(spark, tmp_path):
    marks = str(tmp_path)

    def shaky():
        def ask(prompts):
            import os

            if not os.path.exists(f"{marks}/seen"):
                open(f"{marks}/seen", "w").close()
                raise OSError("once")
            return [p and p.upper() for p in prompts]

        return ask

    df = spark.createDataFrame([("a",), (None,)], "t string").coalesce(1)
    assert [r.answer for r in Q.answered(df, "t", shaky, pause=0).collect()] == ["A", None]


def test_listed_images(spark, tmp_path):
    for name in ("page_2_img_10.png", "page_2_img_9.png", "page_1_img_1.png", "other.png"):
        (tmp_path / name).write_bytes(b"x")
    assert [(r.page, r.image) for r in I.listed(spark, str(tmp_path)).collect()] == [(1, 1), (2, 9), (2, 10)]
