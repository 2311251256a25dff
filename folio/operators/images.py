"""Images of articles: their order, what is kept of them, and their new addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import markdown as M
from folio.functions import values as V

# Fixed values.
MOST_IMAGES, LEAST_SIDE, MOST_WIDTH, ARTICLE_PAGE = 80, 48, 1600, 1
TAG = r"!\[([^\]]*)\]\(([^)]*)\)"
PNG_HEAD = "89504E470D0A1A0A"


def images(articles: DataFrame) -> DataFrame:
    """``article_id``, ``markdown`` (a hash), ``src``, ``k``: the images of each article by the place (from 1) where they first stand."""
    places = F.posexplode(F.regexp_extract_all("markdown", F.lit(TAG), F.lit(2))).alias("k", "src")
    found = articles.select("article_id", F.xxhash64("markdown").alias("markdown"), places)
    return found.groupBy("article_id", "markdown", "src").agg((F.min("k") + 1).alias("k"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``page``, ``image``, ``tag``: the extracted images below a folder by the numbers in their names, with the Markdown that shows them. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "page_*_img_*.png").load(folder).select("path")
    place = V.image_order("path")
    tag = F.concat(F.lit("![Figure "), place["image"].cast("string"), F.lit("]("), F.col("path"), F.lit(")"))
    return files.select("path", place["page"].alias("page"), place["image"].alias("image"), tag.alias("tag")).where("page is not null").orderBy("page", "image", "path")


def png_size(content: Column) -> Column:
    """Width and height in the head of PNG bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 24))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("int")
    return F.when(head.startswith(PNG_HEAD) & (F.length(head) == 48), F.struct(number(33).alias("width"), number(41).alias("height")))


def shrunk(width: Column, height: Column) -> Column:
    """Size after images wider than MOST_WIDTH are scaled down."""
    wide = width > MOST_WIDTH
    return F.struct(F.when(wide, MOST_WIDTH).otherwise(width).cast("int").alias("width"), F.when(wide, F.greatest(F.round(height * MOST_WIDTH / width), F.lit(1))).otherwise(height).cast("int").alias("height"))


def localised(articles: DataFrame, sizes: DataFrame) -> DataFrame:
    """``article_id``, ``images``, ``markdown``: articles (``article_id``, ``project_id``, ``markdown``) with the addresses of fetched images (``src``, ``width``, ``height``) replaced by their own.

    Of each article the first MOST_IMAGES different images are fetched, as in the
    rules for pages. Small ones go, and so does every further use of an image; what
    could not be fetched keeps its address, or goes if it lay in the address itself.
    Kept ones are numbered in order. One short row per image is joined with the
    sizes; texts are joined with the decisions on their images once.
    """
    known = sizes.groupBy("src").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    order = W.partitionBy("article_id", "markdown").orderBy("k")
    found = images(articles).withColumn("place", F.row_number().over(order)).join(known, "src", "left")
    fetched = F.col("width").isNotNull() & F.col("height").isNotNull() & (F.col("place") <= MOST_IMAGES)
    kept = fetched & (F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE)
    decided = found.withColumn("kept", kept).withColumn("number", F.when(F.col("kept"), F.sum(F.col("kept").cast("int")).over(order)))
    decided = decided.withColumn("gone", F.when(fetched, ~F.col("kept")).otherwise(F.startswith("src", F.lit("data:"))))
    plans = decided.groupBy(F.col("article_id").alias("_article"), F.col("markdown").alias("_text")).agg(F.map_from_entries(F.collect_list(F.struct("src", F.struct("k", "number", "gone")))).alias("plan"), F.count_if("kept").alias("images"))
    rows = articles.withColumn("_hash", F.xxhash64("markdown"))
    joined = rows.join(plans, (rows["article_id"] == plans["_article"]) & (rows["_hash"] == plans["_text"]), "left")
    tags = F.regexp_extract_all("markdown", F.lit(TAG), F.lit(2))
    alts = F.regexp_extract_all("markdown", F.lit(TAG), F.lit(1))
    uses = F.transform(F.arrays_zip(tags.alias("src"), alts.alias("alt")), lambda x, k: F.struct(x["src"].alias("src"), x["alt"].alias("alt"), (k + 1).alias("k")))

    def tag(x: Column) -> Column:
        plan = F.element_at("plan", x["src"])
        own = F.concat(F.lit("/api/projects/"), "project_id", F.lit(f"/pages/{ARTICLE_PAGE}/images/"), plan["number"].cast("string"))
        shown = F.concat(F.lit("!["), M.clean_alt(x["alt"]), F.lit("]("), F.coalesce(own, x["src"]), F.lit(")"))
        return F.when(plan["gone"] | (plan["k"] != x["k"]), "").otherwise(shown)

    made = F.concat(F.array(F.lit("")), F.transform(uses, tag))
    text = F.array_join(F.zip_with(made, F.split("markdown", TAG, -1), lambda a, b: F.concat(a, b)), "")
    return joined.select("article_id", F.coalesce("images", F.lit(0)).alias("images"), text.alias("markdown"))
