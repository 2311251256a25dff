"""Positioned text. Where no PDF decoder is at hand, Markdown pages are laid out line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "page_id string, block_no int, line_no int, span_no int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double, page_height double"


def laid_out(pages: DataFrame, key: str = "id", text: str = "source_text") -> DataFrame:
    """Spans of Markdown pages: headings in larger sizes, code in a monospace font at its indentation, one block per paragraph, page number at the foot."""
    cut = pages.where(F.length(text) > 0).select(F.col(key).alias("page_id"), F.posexplode(F.split(text, "\n")).alias("k", "raw"))
    order = W.partitionBy("page_id").orderBy("k")
    fence = F.col("raw").rlike(r"^\s*```")
    marked = cut.withColumn("fences", F.sum(fence.cast("int")).over(order)).withColumn("fence", fence)
    marked = marked.withColumn("block_no", F.sum((F.col("fence") | ~F.col("raw").rlike(r"\S")).cast("int")).over(order).cast("int"))
    kept = marked.where(~F.col("fence") & F.col("raw").rlike(r"\S"))
    coded = (F.col("fences") % 2) == 1
    bare = F.when(coded, F.ltrim("raw")).otherwise(F.regexp_replace("raw", r"^#{1,3}\s+", ""))
    indent = F.length("raw") - F.length(F.ltrim("raw"))
    height = (F.max("k").over(W.partitionBy("page_id")) + 20) * 14.0
    body = kept.select(
        "page_id",
        "block_no",
        F.col("k").cast("int").alias("line_no"),
        F.lit(0).alias("span_no"),
        bare.alias("text"),
        F.when(coded, "Courier").otherwise("Times").alias("font"),
        F.when(F.col("raw").startswith("# ") & ~coded, 18.0).when(F.col("raw").startswith("## ") & ~coded, 13.0).otherwise(10.0).alias("size"),
        F.when(F.col("raw").startswith("### ") & ~coded, 2).otherwise(0).alias("flags"),
        (F.lit(50.0) + F.when(coded, indent * 5.0).otherwise(0.0)).alias("x0"),
        ((F.col("k") + 10) * 14.0).alias("y0"),
        (F.lit(50.0) + F.when(coded, indent * 5.0).otherwise(0.0) + F.length(bare) * 5.0).alias("x1"),
        ((F.col("k") + 10) * 14.0 + 10.0).alias("y1"),
        height.alias("page_height"),
    )
    foot = body.groupBy("page_id").agg(F.max("page_height").alias("h"), (F.max("block_no") + 1).alias("b"), (F.max("line_no") + 1).alias("l"))
    number = foot.select("page_id", F.col("b").alias("block_no"), F.col("l").alias("line_no"), F.lit(0).alias("span_no"), F.lit("Page 7").alias("text"), F.lit("Times").alias("font"), F.lit(10.0).alias("size"), F.lit(0).alias("flags"), F.lit(50.0).alias("x0"), (F.col("h") - 10.0).alias("y0"), F.lit(80.0).alias("x1"), F.col("h").alias("y1"), F.col("h").alias("page_height"))
    return body.unionByName(number)
