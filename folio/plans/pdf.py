"""Queries of the layout pipeline over pages laid out line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import layout as Y
from folio.operators import relational as R
from folio.plans.prose_sql import strip
from folio.plans.scalars import LANGUAGE
from folio.runtime import table
from folio.sources.spans import laid_out


def _spans(spark: SparkSession, directory: str) -> DataFrame:
    return laid_out(R.once(table(spark, directory, "pages"), "id", "source_text"))


def layout_page_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Pages and lines per project."""
    pages = R.once(table(spark, directory, "pages"), "id", "project_id", "page_number")
    return pages.groupBy("project_id").agg(F.max("page_number").alias("last_page"), F.count("*").alias("rows"))


def layout_lines(spark: SparkSession, directory: str) -> DataFrame:
    spans = _spans(spark, directory)
    return Y.kinds(Y.with_blocks(Y.lines(spans)), Y.body_sizes(spans)).groupBy("page_id", "kind").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


def layout_images(spark: SparkSession, directory: str) -> DataFrame:
    """Made-up images on pages, some too small to keep."""
    pages = R.once(table(spark, directory, "pages"), "id", "page_number")
    n = F.coalesce(F.col("page_number"), F.lit(0))
    found = pages.select(F.col("id").alias("page_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("xref"), n.alias("n"))
    size = F.pmod(F.col("n") * F.col("xref"), F.lit(90)).cast("double")
    placed = found.select("page_id", "xref", size.alias("pixel_width"), (size + 5).alias("pixel_height"), F.lit(0.0).alias("x0"), size.alias("x1"), (F.col("xref") * 10.0).alias("y0"), (F.col("xref") * 10.0 + size).alias("y1"))
    return Y.images(placed).select("page_id", "xref", "number")


QUERIES = {
    "layout_page_counts": layout_page_counts,
    "layout_body_sizes": lambda spark, directory: Y.body_sizes(_spans(spark, directory)),
    "layout_lines": layout_lines,
    "layout_images": layout_images,
    "layout_markdown": lambda spark, directory: Y.page_markdown(_spans(spark, directory)),
}

_LINES = r"""
    WITH p AS (SELECT DISTINCT id, source_text FROM pages WHERE source_text <> ''),
    a AS (SELECT id, string_split(source_text, chr(10)) AS ls FROM p),
    e AS (SELECT id, unnest(range(len(ls))) AS k, unnest(ls) AS raw FROM a),
    f AS (SELECT *, regexp_matches(raw, '^\s*```') AS fence, sum(regexp_matches(raw, '^\s*```')::INT) OVER (PARTITION BY id ORDER BY k) % 2 = 1 AS coded FROM e),
    g AS (SELECT id, k, coded, CASE WHEN coded THEN ltrim(raw) ELSE regexp_replace(raw, '^#{1,3}\s+', '') END AS t, CASE WHEN coded THEN 10.0 WHEN starts_with(raw, '# ') THEN 18.0 WHEN starts_with(raw, '## ') THEN 13.0 ELSE 10.0 END AS size,
                 NOT coded AND starts_with(raw, '### ') AS bold FROM f WHERE NOT fence AND regexp_matches(raw, '[^\s\p{Z}\x1c-\x1f\x{85}]')),
    h AS (SELECT id, k, coded, t, size, bold FROM g UNION ALL SELECT id, max(k) + 1, false, 'Page 7', 10.0, false FROM g GROUP BY 1),
    s AS (SELECT id, size, count(*) AS n, min(k) AS first FROM h WHERE NOT coded GROUP BY 1, 2),
    b AS (SELECT id, arg_max(size, n * 100000 - first) AS body FROM s GROUP BY 1)"""

def _pairs(name: str, source: str, joins: str, joined: str) -> str:
    """Recursive expressions that go over the paragraphs ``ps`` of each page once from the left and join neighbours ``a`` and ``b``: ``name``."""
    return f"""{name}_r AS (SELECT id, list_transform(ps, lambda x: {strip('x')}) AS ps, 1 AS i, []::VARCHAR[] AS done FROM {source}
        UNION ALL SELECT id, ps, CASE WHEN j THEN i + 2 ELSE i + 1 END, list_append(done, CASE WHEN j THEN {joined} ELSE a END) FROM (SELECT id, ps, i, done, a, b, coalesce(i < len(ps) AND {joins}, false) AS j FROM (SELECT *, ps[i] AS a, ps[i + 1] AS b FROM {name}_r WHERE i <= len(ps)))),
    {name} AS (SELECT id, done AS ps FROM {name}_r WHERE i > len(ps))"""


_LEVEL = lambda x: rf"regexp_extract({x}, '^(#{{1,3}})\s+', 1)"
_TITLE = lambda x: strip(rf"regexp_replace({x}, '^#{{1,3}}\s+', '')")
_NUMBER = r"(?i)^(#+)\s+((?:(?:Chapter|Section|Part|Appendix)\s+)?\p{Nd}+(?:\.\p{Nd}+)*\.?)$"
_TITLED = rf"regexp_matches(a, '{_NUMBER}') AND (regexp_matches(b, '^#+\s+') OR (NOT regexp_matches(b, '^(?:#|- |\* |`|!)') AND length(b) < 100 AND NOT regexp_matches(b, '[.:;!?]$')))"
_SPLIT = rf"{_LEVEL('a')} <> '' AND {_LEVEL('a')} = {_LEVEL('b')} AND length({_TITLE('a')}) < 60 AND NOT regexp_matches({_TITLE('a')}, '[.:;!?]$') AND NOT regexp_matches({_TITLE('b')}, '[.;!]$') AND NOT regexp_matches({_TITLE('b')}, '^\p{{Nd}}')"
_FIXED = r"^(?:#|- |\* |```|!\[)"
_BROKEN = rf"""length(a) > 0 AND NOT regexp_matches(a, '{_FIXED}') AND NOT regexp_matches(b, '{_FIXED}') AND NOT regexp_matches(b, '^\p{{Nd}}+[.)]\s+') AND NOT regexp_matches(a, '[.!?:"''”’`]$')"""
#: Pages by plain steps: lines and their blocks, paragraphs, code, and three rounds of joining neighbours.
_MARKDOWN = rf"""{_LINES.replace('WITH p AS', 'WITH RECURSIVE p AS', 1)},
    bl AS (SELECT id, k, sum((regexp_matches(raw, '^\s*```') OR NOT regexp_matches(raw, '\S'))::INT) OVER (PARTITION BY id ORDER BY k) AS block, length(raw) - length(ltrim(raw)) AS indent FROM e),
    ln AS (SELECT h.id, h.k, coalesce(block, 1000000) AS block, indent, coded, t, regexp_replace({strip('t')}, '`\s+`', ' ', 'g') AS line, size, bold, body FROM h JOIN b ON b.id = h.id LEFT JOIN bl ON bl.id = h.id AND bl.k = h.k),
    kd AS (SELECT *, CASE WHEN regexp_matches(line, '^[•⁃‣]|^[*-]\s') THEN 'bullet' WHEN size >= body * 1.45 THEN 'h1' WHEN size >= body * 1.18 THEN 'h2'
              WHEN bold AND length(line) < 70 AND NOT regexp_matches(line, '[.:;,?!]$') AND NOT starts_with(line, '`') THEN 'h3' WHEN regexp_matches(line, '^\p{{Nd}}+[.)]\s') THEN 'numbered' ELSE 'text' END AS kind FROM ln WHERE NOT coded AND line <> '' AND t <> 'Page 7'),
    op AS (SELECT *, kind <> 'text' OR coalesce(lag(kind) OVER w IN ('h1', 'h2', 'h3', 'numbered'), true) AS opens FROM kd WINDOW w AS (PARTITION BY id, block ORDER BY k)),
    pa AS (SELECT *, sum(opens::INT) OVER (PARTITION BY id, block ORDER BY k) AS para FROM op),
    pm AS (SELECT id, block, para, arg_min(kind, k) AS kind, string_agg(line, ' ' ORDER BY k) AS x FROM pa GROUP BY 1, 2, 3),
    px AS (SELECT id, block, para, CASE kind WHEN 'bullet' THEN list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(x, '^(?:[•⁃‣]\s*|[*-]\s+)', ''), '\s*[•⁃‣]\s*'), lambda y: {strip('y')}), lambda y: y <> ''), lambda y: '- ' || y)
              WHEN 'h1' THEN ['# ' || x] WHEN 'h2' THEN ['## ' || x] WHEN 'h3' THEN ['### ' || x] ELSE [x] END AS xs FROM pm),
    it AS (SELECT id, block, para, unnest(range(len(xs))) AS n, unnest(xs) AS x FROM px),
    bs AS (SELECT id, block, bool_or(coded) AS code FROM ln GROUP BY 1, 2), il AS (SELECT id, block, code, sum((NOT code)::INT) OVER (PARTITION BY id ORDER BY block) AS island FROM bs),
    cl AS (SELECT ln.id, island, ln.block, k, indent - min(indent) OVER (PARTITION BY ln.id, island) AS ind, coalesce(k - lag(k) OVER (PARTITION BY ln.id, island ORDER BY ln.block, k) >= 2, false) AS gap, trim(t) AS t FROM ln JOIN il ON il.id = ln.id AND il.block = ln.block WHERE code AND coded),
    cb AS (SELECT id, min(block) AS block, string_agg(CASE WHEN gap THEN chr(10) ELSE '' END || repeat(' ', ind) || t, chr(10) ORDER BY block, k) AS body FROM cl GROUP BY id, island),
    al AS (SELECT id, block, para, n, x FROM it UNION ALL SELECT id, block, 0, 0, '```' || CASE {LANGUAGE} ELSE '' END || chr(10) || body || chr(10) || '```' FROM cb),
    m0 AS (SELECT id, list(x ORDER BY block, para, n) AS ps FROM al GROUP BY 1),
    {_pairs('m1', 'm0', _TITLED, "a || ' ' || " + strip(r"regexp_replace(b, '^#+\s+', '')"))}, {_pairs('m2', 'm1', _SPLIT, "a || ' ' || " + _TITLE('b'))}, {_pairs('m3', 'm2', _BROKEN, "a || ' ' || b")}"""

SQL = {
    "layout_markdown": rf"{_MARKDOWN} SELECT id AS page_id, {strip("array_to_string(list_transform(ps, lambda x: CASE WHEN starts_with(x, '```') THEN x ELSE regexp_replace(x, '[ \t]{2,}', ' ', 'g') END), chr(10) || chr(10))")} AS markdown FROM m3",
    "layout_page_counts": "SELECT project_id, max(page_number) AS last_page, count(*) AS rows FROM (SELECT DISTINCT id, project_id, page_number FROM pages) GROUP BY 1",
    "layout_body_sizes": f"{_LINES} SELECT id AS page_id, body::DOUBLE AS body_size FROM b",
    "layout_lines": rf"""{_LINES},
        l AS (SELECT h.id, regexp_replace(t, '^[\s\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g') AS line, size, bold, body FROM h JOIN b ON b.id = h.id WHERE NOT coded AND t <> 'Page 7'),
        c AS (SELECT id AS page_id, line, CASE WHEN regexp_matches(line, '^[•⁃‣]|^[*-]\s') THEN 'bullet' WHEN size >= body * 1.45 THEN 'h1' WHEN size >= body * 1.18 THEN 'h2'
              WHEN bold AND length(line) < 70 AND NOT regexp_matches(line, '[.:;,?!]$') AND NOT starts_with(line, '`') THEN 'h3' WHEN regexp_matches(line, '^\p{{Nd}}+[.)]\s') THEN 'numbered' ELSE 'text' END AS kind FROM l)
        SELECT page_id, kind, count(*) AS lines, sum(length(line))::BIGINT AS characters FROM c GROUP BY 1, 2""",
    "layout_images": """WITH p AS (SELECT DISTINCT id, page_number FROM pages), x AS (SELECT id, xref, ((coalesce(page_number, 0) * xref) % 90 + 90) % 90 AS size FROM p, (SELECT unnest([1, 2, 3])::INT AS xref))
        SELECT id AS page_id, xref, row_number() OVER (PARTITION BY id ORDER BY xref)::INT AS number FROM x WHERE size > 40""",
}
