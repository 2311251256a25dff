"""The pN queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import alignment, boilerplate, looks, mixing, quality, responses, splitting, tokens
from folio.runtime import table


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return alignment.sentence_pairs(table(spark, directory, "pages"), table(spark, directory, "glossary_items"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return looks.same_look(table(spark, directory, "pages"))


def p2_forms(spark: SparkSession, directory: str) -> DataFrame:
    return looks.with_forms(table(spark, directory, "pages"), "id", ["latest_translation", "approved_text"]).distinct()


def _oversized(spark: SparkSession, directory: str) -> DataFrame:
    keys = {"pages": "id", "fetched_articles": "article_id"}
    return splitting.oversized({name: table(spark, directory, name) for name in keys}, table(spark, directory, "size_limits"), keys)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return splitting.cut_places(_oversized(spark, directory))


def p3_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return splitting.cut_pieces(_oversized(spark, directory))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return responses.defects(*(table(spark, directory, t) for t in ("pages", "projects", "documents", "glossary_items")))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return boilerplate.not_article(table(spark, directory, "fetched_articles"))


def p5_content(spark: SparkSession, directory: str) -> DataFrame:
    return boilerplate.main_text(table(spark, directory, "fetched_articles"))


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokens.encode_ids(table(spark, directory, "documents"))


def _mix(spark: SparkSession, directory: str) -> mixing.Mix:
    return mixing.Mix(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))


def p7_mix(spark: SparkSession, directory: str) -> DataFrame:
    return _mix(spark, directory).mixed()


def p7_repeats(spark: SparkSession, directory: str) -> DataFrame:
    return _mix(spark, directory).repeats()


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    return _mix(spark, directory).report()


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return quality.not_prose(table(spark, directory, "documents"), table(spark, directory, "common_words"))


def p8_statistics(spark: SparkSession, directory: str) -> DataFrame:
    return quality.statistics(table(spark, directory, "documents"), table(spark, directory, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_forms, p3_found, p3_pieces, p4_found, p5_found, p5_content, p6_ids, p7_mix, p7_repeats, p7_shares, p8_found, p8_statistics)}


P3_SQL = r"""
    WITH i AS (SELECT 'pages' AS item_table, id AS item_id, source_text AS t, max_chars, max_chars - overlap_chars AS room FROM pages, size_limits WHERE size_limits.item_table = 'pages' AND field_name = 'source_text' AND length(source_text) > max_chars
        UNION SELECT 'fetched_articles', article_id, markdown, max_chars, max_chars - overlap_chars FROM fetched_articles, size_limits WHERE size_limits.item_table = 'fetched_articles' AND field_name = 'markdown' AND length(markdown) > max_chars),
    l AS (SELECT item_table, item_id, room, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM (SELECT *, string_split(t, chr(10)) AS ls FROM i)),
    f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, coalesce(sum(regexp_matches(line, '^\s*(```|~~~)')::INT) OVER (PARTITION BY item_table, item_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l),
    g AS (SELECT *, NOT inside AND NOT fence AND NOT regexp_matches(line, '\S') AS blank, lag(fence AND inside, 1, false) OVER w AS closed, (fence AND NOT inside) AS opened FROM f WINDOW w AS (PARTITION BY item_table, item_id ORDER BY k)),
    b AS (SELECT *, sum((blank OR opened OR closed)::INT) OVER (PARTITION BY item_table, item_id ORDER BY k) AS block FROM g),
    n AS (SELECT item_table, item_id, max(size) AS blocks FROM (SELECT item_table, item_id, block, sum(length(line)) + count(*) - 1 AS size FROM b WHERE NOT blank GROUP BY 1, 2, 3) GROUP BY 1, 2),
    m AS (SELECT item_table, item_id, room, max(length(line)) AS lines, max(list_max(list_transform(regexp_split_to_array(regexp_replace(line, '([.!?؟])\s', '\1' || chr(1), 'g'), chr(1)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g'))))) AS sentences,
                 max(list_max(list_transform(regexp_split_to_array(line, '\s+'), lambda x: length(x)))) AS runs FROM b GROUP BY 1, 2, 3)
    SELECT item_table, item_id, CASE WHEN blocks <= room THEN 'block' WHEN lines <= room THEN 'line' WHEN sentences <= room THEN 'sentence' WHEN runs <= room THEN 'space' ELSE 'none' END AS cut_at FROM m JOIN n USING (item_table, item_id)"""


def oracle_sql() -> dict[str, str]:
    """Splitting can be said in SQL of its own; the other operators are tested against brute force, listed pairs, round trips or other libraries."""
    return {"p3_found": P3_SQL}
