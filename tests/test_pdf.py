"""PDF files made by hand: text, fonts, outlines, compressed and broken ones."""

import zlib

from pyspark.sql import functions as F

from folio.operators import layout, segments
from folio.sources import pdf


def made(pages, outline=(), packed=True):
    """A PDF file with a content stream per page and an outline of (level, title, page)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 5 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier-Bold >>"}
    kids = []
    for k, content in enumerate(pages):
        data = zlib.compress(content) if packed else content
        objects[20 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (21 + 2 * k)
        objects[21 + 2 * k] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if packed else b"", data)
        kids.append(b"%d 0 R" % (20 + 2 * k))
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (b" ".join(kids), len(kids))
    objects[5] = b"<< /Type /Outlines /First 200 0 R >>" if outline else b"<< /Type /Outlines >>"
    for k, (title, page) in enumerate(outline):
        after = b"/Next %d 0 R" % (201 + k) if k + 1 < len(outline) else b""
        objects[200 + k] = b"<< /Title (%s) /Dest [%d 0 R /Fit] %s >>" % (title, 20 + 2 * (page - 1), after)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [
    b"BT /F1 20 Tf 50 700 Td (Chapter 1: One \\(a\\)) Tj ET BT /F1 10 Tf 1 0 0 1 50 660 Tm (A first sentence) Tj 0 -12 TD [(goes on) -300 (here.)] TJ ET",
    b"BT /F1 10 Tf 14 TL 50 700 Td (Second page.) Tj T* <4d6f7265> Tj ( ) Tj (f) Tj ET BT /F2 10 Tf 50 600 Td (x = 1) Tj ET",
]


def test_spans(spark):
    frame = spark.createDataFrame([("a.pdf", made(PAGES)), ("b.pdf", made(PAGES, packed=False)), ("c.pdf", b"no pdf"), ("d.pdf", None), ("e.pdf", made(PAGES)[:300])], "path string, content binary")
    rows = [(r.path, r.page_number, r.text, r.font, round(r.size, 1), round(r.x0), round(r.y0)) for r in pdf.spans(frame).orderBy("path", "page_number", "line_no", "span_no").collect()]
    one = [r[1:] for r in rows if r[0] == "a.pdf"]
    assert one == [r[1:] for r in rows if r[0] == "b.pdf"] and {r[0] for r in rows} <= {"a.pdf", "b.pdf", "e.pdf"}
    assert one[0] == (1, "Chapter 1: One (a)", "Helvetica", 20.0, 50, 84)
    assert [r[1] for r in one] == ["Chapter 1: One (a)", "A first sentence", "goes on", "here.", "Second page.", "More", " ", "f", "x = 1"]
    assert {r.path: r.pages for r in pdf.page_counts(frame).where("pages > 0").collect()}["a.pdf"] == 2


def test_pages_become_markdown(spark):
    frame = spark.createDataFrame([("a.pdf", made(PAGES))], "path string, content binary")
    text = {r.page_id: r.markdown for r in layout.page_markdown(pdf.spans(frame)).collect()}
    assert text["a.pdf#1"].startswith("# Chapter 1: One (a)\n\nA first sentence goes on") and text["a.pdf#2"] == "Second page. More f\n\n```\nx = 1\n```"


def test_outline(spark):
    frame = spark.createDataFrame([("a.pdf", made([b""] * 10, [(b"Cover", 1), (b"Chapter 1: A", 3), (b"Chapter 2: B", 7)]))], "path string, content binary")
    outline = pdf.outlines(frame).withColumnRenamed("path", "project_id")
    totals = pdf.page_counts(frame).select(F.col("path").alias("project_id"), F.col("pages").alias("total_pages"))
    found = segments.chapters_of_outline(outline, totals).orderBy("seq").collect()
    assert [(r.title, r.start_page, r.end_page, r.is_main) for r in found] == [("Cover", 1, 2, False), ("Chapter 1: A", 3, 6, True), ("Chapter 2: B", 7, 10, True)]


def test_font_with_a_map(spark):
    data = made([b"BT /F9 10 Tf 50 700 Td <00010002> Tj ET"]).replace(b"/F1 3 0 R", b"/F9 9 0 R")
    cmap = b"1 beginbfchar <0001> <0633> endbfchar 1 beginbfrange <0002> <0005> <0627> endbfrange"
    data = data.replace(b"trailer", b"9 0 obj << /Type /Font /Subtype /Type0 /BaseFont /Vazir /ToUnicode 10 0 R >> endobj\n10 0 obj << /Length 9 >>\nstream\n" + cmap + b"\nendstream endobj\ntrailer")
    assert [r[4] for r in pdf.spans_of(data)] == ["سا"]
