"""Small scalar functions: times, scales, colours, formulas, guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import col

# Fixed values.
POINTS_PER_INCH, RASTER_DPI, THUMBNAIL_WIDTH = 72, 150, 300
FORMULA = r"\$\$[\s\S]+?\$\$|\\\[[\s\S]+?\\\]|\\\([\s\S]+?\\\)|\$[^$\n]+?\$"
PROVIDERS = ("mock", "openai", "gemini", "claude", "browser_chatgpt", "browser_gemini", "browser_claude")


def iso_time(x: Column | str) -> Column:
    return F.date_format(col(x), "yyyy-MM-dd'T'HH:mm:ss")


def file_stamp(x: Column | str) -> Column:
    """A time as part of a file name."""
    return F.date_format(col(x), "yyyy-MM-dd_HHmmss")


def raster_zoom(dpi: int = RASTER_DPI) -> float:
    return dpi / POINTS_PER_INCH


def thumbnail_scale(width: Column | str, to: int = THUMBNAIL_WIDTH) -> Column:
    """How a page of a width is scaled; null without a width."""
    return F.when(col(width) > 0, to / col(width))


def luminance(colour: Column | str) -> Column:
    """Relative luminance of a colour like #a0b1c2."""

    def part(k: int) -> Column:
        v = F.conv(F.substring(col(colour), k, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)


def contrast(a: Column | str, b: Column | str) -> Column:
    """Contrast ratio of two colours, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def formulas(x: Column | str) -> Column:
    """Formulas of a text between dollar signs, brackets or parentheses."""
    return F.coalesce(F.regexp_extract_all(col(x), F.lit(f"({FORMULA})"), F.lit(1)), F.array().cast("array<string>"))


def upload_kind(name: Column | str) -> Column:
    """book for PDF files, backup for archives, null for all others; the ending counts, not its case."""
    n = F.lower(col(name))
    return F.when(n.endswith(".pdf"), "book").when(n.endswith(".zip"), "backup")


def is_export_format(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike("^(?:md|docx)$"), F.lit(False))


def provider_key(x: Column | str) -> Column:
    """The registered provider of a profile; unknown ones are the stand-in."""
    p = F.lower(F.trim(col(x)))
    return F.when(p.isin(*PROVIDERS), p).otherwise("mock")


def image_order(path: Column | str) -> Column:
    """Page and number in the name of an extracted image file, for sorting by number."""
    pattern = r"page_([0-9]+)_img_([0-9]+)\.png$"
    return F.struct(F.regexp_extract(col(path), pattern, 1).cast("int").alias("page"), F.regexp_extract(col(path), pattern, 2).cast("int").alias("image"))


def fetch_action(status: Column | str, content_type: Column | str) -> Column:
    """What becomes of an answer to a page request: browser (refused, throttled or failing servers), error_status, error_pdf, error_type, or parse. A missing content type is taken for HTML, a missing status for a failing server."""
    code, kind = F.coalesce(col(status), F.lit(500)), F.lower(F.coalesce(col(content_type), F.lit("")))
    return (
        F.when(code.isin(401, 403, 429) | (code >= 500), "browser")
        .when(code >= 400, "error_status")
        .when(kind.contains("pdf"), "error_pdf")
        .when((kind != "") & ~kind.contains("html") & ~kind.contains("xml"), "error_type")
        .otherwise("parse")
    )
