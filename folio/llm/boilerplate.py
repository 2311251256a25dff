"""Main content of web pages in Markdown, by tag-path ratios.

A line of Markdown is a leaf of a tree of blocks; its path is the kind of the
block it lies in, its own kind and its outward shape (does it end like a
sentence, how many words, how much of it is link). Text length and punctuation
are aggregated per path over the whole corpus, smoothed against the paths of the
same kind and fused with the share of link text and the ends of lines; paths above
the threshold that splits the fused scores best hold content. Headings are weighed by what they say, not by their path.

A second pass removes what has the shape of content but is the site's: sentences
that recur in the corpus word for word while no sentence of the same build does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Set
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.store import spread, written

#: Share of all distinct texts in which a sentence must recur to count as the site's, and the least number of texts.
#: At most 4 * (sentences per article) / RECUR_RATE sentences can recur a quarter as often, which bounds the table that is sent to all tasks.
RECUR_RATE = 0.001
RECUR_LEAST = 5
#: So many recurring sentences that differ in one word mark a pattern of the articles, not of the sites.
PATTERN_VARIANTS = 6
#: Share of a text that sentences of few rows must make up to tell it from others; below that it counts as a copy.
OWN_SHARE = 0.125
#: Words of a sentence up to which its pattern is looked for; longer ones are known by their hash alone.
PATTERN_WORDS = 30
#: Entries a task holds before it hands its counts on.
HELD = 200_000
#: Lines by which the ratios of a path are smoothed, and what lines that do not end like a sentence count for.
SMOOTH, UNFINISHED = 5.0, 0.4
#: Lines of this length are never menus.
LONG_LINE = 200

FENCE = re.compile(r"^\s*(?:```|~~~)")
LINK = re.compile(r"!?\[([^\]\n]*)\]\(([^)\n]*)\)")
SENTENCE = re.compile(r"(?<=[.!?؟])\s+")
TERMINAL = re.compile(r"[.!?؟…:؛;]['\"”’»)\]*_`]*$")
TRAIL = re.compile(r"^\S[^›»/>\n]{0,40}(?: [›»>/] [^›»/>\n]{1,80}){1,6}$")
MARKS = re.compile(r"[.,;:!?؟،؛…]")


class Line(NamedTuple):
    no: int
    kind: str
    text: str
    root: str


HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
IMAGES = re.compile(r"(?:!\[[^\]]*\]\([^)]*\)\s*)+")
ITEM = re.compile(r"^(?:[-*+•◦]|\d{1,3}[.)]|[۰-۹]{1,3}[.)])\s+(.*)$")
BOLD = re.compile(r"\*\*[^*]+\*\*:?|__[^_]+__:?")
ROW = re.compile(r"\s+[|·•–]\s+")
ROW_MARKS, EMPHASIS_MARKS = frozenset("|·•–"), frozenset("*_#>`")


def kind_of(s: str) -> tuple[str, str]:
    """Kind of a stripped line and the text it shows."""
    first = s[0]
    if first == "#" and (m := HEADING.match(s)):
        return "heading", m.group(2)
    if first == "|":
        return "table", s
    if first == "!" and IMAGES.fullmatch(s):
        return "image", s
    if first == ">":
        return "quote", s.lstrip("> ")
    if not first.isalpha() and (m := ITEM.match(s)):
        return "item", m.group(1)
    if first in "*_" and BOLD.fullmatch(s):
        return "bold", s.strip("*_: ")
    return "text", s


def lines_of(markdown: str) -> list[Line]:
    """The non-blank lines; a fence and what it holds are code."""
    found, fenced, root = [], False, ""
    for no, raw in enumerate(markdown.split("\n"), 1):
        s = raw.strip()
        fence = FENCE.match(raw)
        if fenced or fence:
            if s:
                found.append(Line(no, "code", s, "code"))
            if fence:
                fenced = not fenced
            root = ""
            continue
        if not s:
            root = ""
            continue
        kind, text = kind_of(s)
        root = root or kind
        found.append(Line(no, kind, text, root))
    return found


def shape_of(line: Line) -> str:
    """The path of a line: block, kind, shape."""
    if line.kind in ("code", "table", "image"):
        return line.kind
    shown, linked, share = line.text, 0, "no"
    if "](" in shown:
        shown = LINK.sub(r"\1", line.text)
        linked = sum(len(m.group(1)) for m in LINK.finditer(line.text))
        rest = re.sub(r"[\s|·•–—\-*_:]+", "", LINK.sub("", line.text))
        share = "all" if linked and not rest else "much" if linked * 2 > len(shown) else "some" if linked else "no"
    row = False
    if not ROW_MARKS.isdisjoint(shown):
        parts = ROW.split(shown)
        row = len(parts) >= 2 and max(len(p.split()) for p in parts) <= 4
    words = len(shown.split())
    size = "1" if words <= 3 else "2" if words <= 9 else "3" if words <= 19 else "4" if words < 50 else "5"
    if len(shown) >= LONG_LINE and not row:
        size = "5"
    end = "row" if row else "trail" if TRAIL.match(shown) else "end" if TERMINAL.search(shown) else "open"
    return f"{line.root}/{line.kind}/{end}/{size}/{share}"


DIGITS = re.compile(r"[\d۰-۹٠-٩]+")
ADDRESS = re.compile(r"\S+@\S+|https?://\S+")
EMPHASIS = re.compile(r"[*_#>`]+")
ENTRY = re.compile(r"^(?:[-+•◦]|9[.)])\s+")


def plain(text: str, label: str) -> str:
    """A sentence without what differs from site to site: numbers, addresses, marks of emphasis and the site's own name."""
    if "](" in text:
        text = LINK.sub(r"\1", text)
    if "@" in text or "://" in text:
        text = ADDRESS.sub("@", text)
    text = DIGITS.sub("9", text)
    if not EMPHASIS_MARKS.isdisjoint(text):
        text = EMPHASIS.sub(" ", text)
    if label and label in text.lower():
        text = re.sub(rf"(?i)\b{re.escape(label)}\b(?: [A-Z]\w+)?", "@", text)
    text = " ".join(text.split())
    return text if text[:1].isalpha() else ENTRY.sub("", text)


def label_of(host: str | None) -> str:
    """The letters of a host's first label, by which the site calls itself."""
    first = re.sub(r"^www\.", "", host or "").split(".")[0]
    found = re.sub(r"[\W\d_]+$", "", first)
    return found if len(found) >= 4 else ""


def sentences(line: Line, label: str) -> list[str]:
    return [s for x in SENTENCE.split(line.text) if (s := plain(x, label))]


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def prose_sizes(lines: list[tuple[str, str, list[str]]]) -> dict[int, int]:
    """Of lines as kind, path and sentences: hashes and lengths of the sentences by which a text is told from others: those of lines like prose, else of all that are no menus."""
    prose: dict[int, int] = {}
    other: dict[int, int] = {}
    for kind, path, parts in lines:
        if kind == "heading":
            continue
        _, _, end, size, share = path.split("/")
        if share == "all" or end in ("row", "trail"):
            continue
        found = prose if (end == "end" or size == "5") and share != "much" else other
        found.update((hashed(s), len(s)) for s in parts)
    return prose or other


COUNTS = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("chars", pa.int64()), ("marks", pa.int64()), ("linked", pa.int64()), ("keys", pa.list_(pa.int64())), ("prose", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("host", pa.string())])


def counted(articles: DataFrame, host: str, markdown: str) -> DataFrame:
    """``kind`` (path, sentence), ``key``, ``text``, ``n``, ``chars``, ``marks``, ``linked``, summed up inside each task first; of kind article a row each: ``keys`` of its sentences, those of its ``prose`` with their ``sizes``, and its ``host``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict[str, list[int]] = {}
        held: Counter = Counter()

        def handed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), COUNTS, strict=True)], schema=COUNTS)

        def sums() -> pa.RecordBatch:
            return handed([("path", hashed(p), p, *v, None, None, None, None) for p, v in paths.items()] + [("sentence", hashed(s), s if s.count(" ") < PATTERN_WORDS else "", n, 0, 0, 0, None, None, None, None) for s, n in held.items()])

        for batch in batches:
            read = []
            for site, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                label, seen, lines = label_of(site), set(), []
                for line in lines_of(body or ""):
                    if line.kind in ("code", "image", "table"):
                        continue
                    lines.append((line.kind, path := shape_of(line), parts := sentences(line, label)))
                    stats = paths.setdefault(path, [0, 0, 0, 0])
                    shown = LINK.sub(r"\1", line.text) if "](" in line.text else line.text
                    stats[0] += 1
                    stats[1] += len(shown)
                    stats[2] += len(MARKS.findall(shown))
                    if shown is not line.text:
                        stats[3] += sum(len(m.group(1)) for m in LINK.finditer(line.text))
                    # Sentences of paragraphs are counted as well, so that their patterns show.
                    seen.update(parts)
                    if line.kind == "text" and ":" in line.text and not TERMINAL.search(line.text):
                        seen.add(plain(line.text.split(":", 1)[0], label) + ":")
                held.update(seen)
                prose = prose_sizes(lines)
                read.append(("article", 0, "", 1, 0, 0, 0, list(map(hashed, seen)), list(prose), list(prose.values()), site))
            if read:
                yield handed(read)
            if len(held) > HELD:
                yield sums()
                paths = {}
                held = Counter()
        if paths or held:
            yield sums()

    return spread(articles.select(host, markdown)).mapInArrow(run, "kind string, key bigint, text string, n bigint, chars bigint, marks bigint, linked bigint, keys array<bigint>, prose array<bigint>, sizes array<int>, host string")


def body_of(keys: list[int], prose: list[int], sizes: list[int], frequent: Set[int]) -> int:
    """What tells a text from others and is the same in its copies: its longest sentence, of those that stand in few rows if they make up enough of it."""
    own = [(n, k) for k, n in zip(prose, sizes, strict=True) if k not in frequent]
    if own and sum(n for n, _ in own) >= OWN_SHARE * sum(sizes):
        return max(own)[1]
    return max(zip(sizes, prose, strict=True))[1] if prose else hashed(",".join(map(str, sorted(keys))))


def text_counts(rows: DataFrame, frequent: Set[int], own: DataFrame) -> DataFrame:
    """``host``, ``key``, ``n``: the distinct texts, of all hosts (null) and of each, in which each frequent sentence stands; the number of all distinct texts has no key.

    ``own``: ``host``, ``frequent``, the keys of sentences frequent on one host.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str | None, int | None, int]] = set()
            sites: dict[str | None, Set[int]] = {None: frozenset()}
            for k, (keys, prose, sizes, site) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if site not in sites:
                    sites[site] = frozenset(batch.column(4)[k].as_py() or ())
                here = sites[site]
                known = {x for x in (*keys, *prose) if x in here or x in shared.value}
                body = body_of(keys, prose, sizes, known)
                found.add((None, None, body))
                found.update((None, x, body) for x in keys if x in shared.value)
                if site is not None:
                    found.add((site, None, body))
                    found.update((site, x, body) for x in keys if x in here)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], type=t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["host", "key", "body"])

    return rows.select("keys", "prose", "sizes", "host").join(own, "host", "left").select("keys", "prose", "sizes", "host", "frequent").mapInArrow(run, "host string, key bigint, body bigint").distinct().groupBy("host", "key").agg(F.count("*").alias("n"))


class Model(NamedTuple):
    """Paths of content, and all that were ``seen``; hashes of recurring sentences, their first words and the most words one has; the same of single hosts as a table."""

    content: frozenset[str]
    recurring: frozenset[int]
    starts: frozenset[str]
    most: int
    sites: DataFrame | None = None
    seen: frozenset[str] = frozenset()


def otsu(values: list[tuple[float, float]]) -> float:
    """The threshold that splits weighted values into two classes with the largest variance between them."""
    values = sorted(values)
    total, weight = sum(v * w for v, w in values), sum(w for _, w in values)
    best, at, low, sum_low = -1.0, 0.0, 0.0, 0.0
    for (v, w), (after, _) in zip(values, values[1:], strict=False):
        low += w
        sum_low += v * w
        if after > v and low < weight:
            gap = sum_low / low - (total - sum_low) / (weight - low)
            if (between := low * (weight - low) * gap * gap) > best:
                best, at = between, (v + after) / 2
    return at


def content_paths(rows: list[tuple[str, int, int, int, int]]) -> frozenset[str]:
    """Paths that hold content. ``rows``: path, lines, characters, punctuation marks, characters of links.

    The ratios of a path are smoothed by those of all paths of its kind and end, and
    fused: length times punctuation, less what is link, and less for lines that do not
    end like a sentence. The threshold between the two classes is learned.
    """
    by_kind: dict[str, list[int]] = {}
    for path, *counts in rows:
        base = by_kind.setdefault("/".join(path.split("/")[1:3]), [0, 0, 0, 0])
        for k, v in enumerate(counts):
            base[k] += v
    scored = []
    for path, n, chars, marks, linked in rows:
        if path.count("/") < 4:
            continue
        bn, bc, bm, bl = (v for v in by_kind["/".join(path.split("/")[1:3])])
        lines, text = n + SMOOTH, chars + bc / bn * SMOOTH
        fused = math.log1p(text / lines) * math.log1p(4 * (marks + bm / bn * SMOOTH) / lines) * (1 - min(1.0, (linked + bl / bn * SMOOTH) / max(text, 1e-9)))
        scored.append((path, math.sqrt(fused * (1.0 if path.split("/")[2] == "end" else UNFINISHED)), n))
    limit = otsu([(score, n) for _, score, n in scored])
    return frozenset(path for path, score, _ in scored if score >= limit)


def recurring_sentences(rows: list[tuple[int, str, int]], least: float) -> dict[int, str]:
    """Of sentences (key, text, texts they occur in) those that recur in ``least`` texts or more and belong to no pattern. Sentences without a text are too long for one."""
    variants: Counter = Counter()
    masked: dict[int, list[str]] = {}
    for key, text, _ in rows:
        words = text.split(" ")
        masks = [" ".join((*words[:k], "\0", *words[k + 1 :])) for k in range(len(words))] if 2 <= len(words) <= PATTERN_WORDS else []
        if 4 <= len(words) <= PATTERN_WORDS:
            masks += [" ".join((*words[:k], "\0", *words[k + 2 :])) for k in range(len(words) - 1)]
        masked[key] = masks
        variants.update(masks)
    return {key: text for key, text, n in rows if n >= least and max((variants[m] for m in masked[key]), default=0) < PATTERN_VARIANTS}


def learned(articles: DataFrame, host: str = "host", markdown: str = "markdown") -> Model:
    """Paths and recurring sentences of a whole corpus. A text counts once, whatever the number of its copies and the sites they lie on."""
    parts = written(counted(articles, host, markdown), "line-counts")
    rows = parts.where("kind = 'article'")
    # Texts of one key are equal, so any of them will do; sums are combined before the shuffle.
    whole = parts.where("kind <> 'article'").groupBy("kind", "key").agg(F.first("text").alias("text"), *(F.sum(c).alias(c) for c in ("n", "chars", "marks", "linked")))
    paths = [tuple(r) for r in whole.where("kind = 'path'").select("text", "n", "chars", "marks", "linked").collect()]
    sizes = rows.groupBy("host").agg(F.count("*").alias("size")).where("host is not null")
    per_host = written(rows.where("host is not null").select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where("n >= 2"), "host-counts")
    texts = rows.count()
    while True:
        some = max(2, RECUR_RATE / 4 * texts)
        known = {r["key"]: r["text"] for r in whole.where((F.col("kind") == "sentence") & (F.col("n") >= some)).select("key", "text").collect()}
        least_here = F.greatest(F.lit(float(RECUR_LEAST)), F.lit(RECUR_RATE / 4) * F.col("size"))
        own = per_host.join(sizes, "host").where(F.col("n") >= least_here).groupBy("host").agg(F.collect_list("key").alias("frequent"))
        every = written(text_counts(rows, frozenset(known), own), "text-counts")
        counts = {r["key"]: r["n"] for r in every.where("host is null").collect()}
        # With many copies there are far fewer texts than rows, and sentences in fewer rows must be looked at.
        before, texts = texts, counts.pop(None, 0)
        fewer = every.where("host is not null and key is null").select("host", F.col("n").alias("texts"))
        copied = sizes.join(fewer, "host").where((F.col("size") * RECUR_RATE / 4 > RECUR_LEAST) & (F.col("size") > 4 * F.col("texts")))
        sizes = fewer.withColumnRenamed("texts", "size")
        if (before * RECUR_RATE / 4 <= 2 or before <= 4 * texts) and copied.isEmpty():
            break
    some = max(2, RECUR_RATE / 4 * texts)
    found = recurring_sentences([(k, known[k], n) for k, n in counts.items() if n >= some], max(RECUR_LEAST, RECUR_RATE * texts))
    recurring = frozenset(found)
    starts, most = rows_of(found.values())
    sites = host_sentences(per_host, whole, every.where("host is not null and key is not null"), sizes, recurring)
    return Model(content_paths(paths), recurring, starts, most, written(sites, "host-sentences"), frozenset(path for path, *_ in paths))


def rows_of(texts: Iterable[str]) -> tuple[frozenset[str], int]:
    """First words of sentences that may stand in a row, and the most words one has."""
    held = [t for t in texts if t]
    return frozenset(t.split(" ", 1)[0] for t in held), max((t.count(" ") + 1 for t in held), default=0)


def host_sentences(per_host: DataFrame, whole: DataFrame, counts: DataFrame, sizes: DataFrame, recurring: Set[int]) -> DataFrame:
    """``host``, ``keys``, ``starts``, ``most`` of the sentences that recur on a host, as a table: there may be as many as hosts have notices.

    ``recurring`` are those that recur in the corpus anyway.
    """
    import pandas as pd

    rows = per_host.join(sizes, "host").where(F.col("n") >= F.greatest(F.lit(2.0), F.lit(RECUR_RATE / 4) * F.col("size")))
    rows = rows.join(whole.where("kind = 'sentence'").select("key", "text"), "key").join(counts.withColumnRenamed("n", "texts"), ["host", "key"], "left")
    shape = "host string, keys array<bigint>, starts array<string>, most int"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        # Sentences in too few texts serve only to show patterns.
        part = part.fillna({"texts": 0})
        every = recurring_sentences(list(zip(part["key"].tolist(), part["text"], part["texts"], strict=True)), max(RECUR_LEAST, RECUR_RATE * part["size"].iloc[0]))
        found = {key: t for key, t in every.items() if key not in recurring}
        starts, most = rows_of(found.values())
        row = (part["host"].iloc[0], list(found), sorted(starts), most)
        return pd.DataFrame([row] if found else [], columns=["host", "keys", "starts", "most"], dtype=object)

    return rows.select("host", "key", "text", "texts", "size").groupBy("host").applyInPandas(fold, shape)


def with_sites(source: DataFrame, model: Model) -> DataFrame:
    """``source`` with ``_keys``, ``_starts``, ``_most``: the sentences of the host in its second column."""
    if model.sites is None:
        return source.withColumns({"_keys": F.lit(None).cast("array<bigint>"), "_starts": F.lit(None).cast("array<string>"), "_most": F.lit(None).cast("int")})
    host = source.columns[1]
    sites = model.sites.select(F.col("host").alias("_host"), F.col("keys").alias("_keys"), F.col("starts").alias("_starts"), F.col("most").alias("_most"))
    return source.join(sites, source[host] == sites["_host"], "left").drop("_host")


class Sites:
    """The model as it is for each host of a batch as of ``with_sites``."""

    def __init__(self, model: Model, batch: pa.RecordBatch) -> None:
        self.model, self.columns, self.held = model, batch.columns[-3:], {}

    def at(self, row: int, host: str | None) -> Model:
        if host not in self.held:
            keys, starts, most = (c[row].as_py() for c in self.columns)
            self.held[host] = self.model if not keys else self.model._replace(recurring=self.model.recurring | set(keys), starts=self.model.starts | set(starts), most=max(self.model.most, most))
        return self.held[host]


def is_recurring(sentence: str, model: Model) -> bool:
    """A recurring sentence, or a row of them."""
    if not sentence or hashed(sentence) in model.recurring:
        return True
    words = sentence.split(" ")
    if words[0] not in model.starts:
        return False
    reach = {0}
    for start, word in enumerate(words):
        if start in reach and word in model.starts:
            for end in range(start + 1, min(len(words), start + model.most) + 1):
                if hashed(" ".join(words[start:end])) in model.recurring:
                    reach.add(end)
    return len(words) in reach


def site_lines(markdown: str, host: str | None, title: str | None, model: Model) -> list[int]:
    """Numbers of the non-blank lines that are not the article."""
    label, found = label_of(host), []
    lines = lines_of(markdown)
    for line in lines:
        if line.kind in ("code", "table", "image"):
            continue
        parts = sentences(line, label)
        site = bool(parts) and all(is_recurring(s, model) for s in parts)
        if line.kind == "heading":
            if site:
                found.append(line.no)
            continue
        path = shape_of(line)
        # Of a path that the corpus did not have, long lines are content.
        if site or path not in model.content and (path in model.seen or "/row/" in path or not path.endswith(("/5/no", "/5/some"))):
            found.append(line.no)
    return found


def not_article(articles: DataFrame, key: str = "article_id", host: str = "host", markdown: str = "markdown", title: str = "title", model: Model | None = None) -> DataFrame:
    """``article_id``, ``line_no`` of the non-blank lines that are not the article.

    Null and empty texts give nothing; rows repeated verbatim count once; other
    columns are left out. Two passes over the scan; only counts are shuffled.
    """
    model = learned(articles, host, markdown) if model is None else model
    source = with_sites(spread(articles.select(F.col(key), host, title, markdown)), model)
    model = model._replace(sites=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, sites = [], [], Sites(model, batch)
            for n, (k, site, name, body) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                found = site_lines(body or "", site, name, sites.at(n, site))
                keys += [k] * len(found)
                numbers += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string()), pa.array(numbers, type=pa.int32())], names=["article_id", "line_no"])

    return source.mapInArrow(run, "article_id string, line_no int").distinct()


def main_text(articles: DataFrame, key: str = "article_id", host: str = "host", markdown: str = "markdown", title: str = "title", model: Model | None = None) -> DataFrame:
    """``article_id``, ``content``: the Markdown without the lines of the site, runs of blank lines closed up. Null stays null; rows are kept as they are."""
    model = learned(articles, host, markdown) if model is None else model
    source = with_sites(spread(articles.select(F.col(key), host, title, markdown)), model)
    model = model._replace(sites=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sites = [], Sites(model, batch)
            for n, (site, name, body) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True)):
                if body is None:
                    out.append(None)
                    continue
                drop = set(site_lines(body, site, name, sites.at(n, site)))
                kept = "\n".join(x for no, x in enumerate(body.split("\n"), 1) if no not in drop)
                out.append(re.sub(r"\n{3,}", "\n\n", kept).strip("\n"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string())], names=["article_id", "content"])

    return source.mapInArrow(run, "article_id string, content string")
