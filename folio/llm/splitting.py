"""Cutting oversized items into overlapping pieces at natural boundaries.

An item is looked at in ranges. A range is scanned on its own, with one character
of halo before it, and gives a row of the boundary table: for each kind of unit
(block, line, sentence, run without white space) the longest one inside and the
open ends on both sides, what the range does to each state of the block scan, and
the beginning of a line whose kind only a later range can tell. Rows are stitched
by an associative operation, so ranges may be scanned by different workers and
combined in a tree, and no kind of line depends on where a range ends.

Rows of a table give their ranges where they lie; their boundary rows are brought
together by item. Files are scanned by byte range: no worker reads more of a file
than its range and its halo. They are cut into segments at the first natural
boundary after each multiple of ``SEGMENT_CHARS``; an exclusive scan over the
boundary table tells each segment whether it begins in text or code, so segments are
cut independently of each other, and prefix sums of their pieces and lengths give
numbers and offsets.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.store import written

#: Characters (of files: bytes) of a range.
RANGE_CHARS = 1 << 16
#: Characters beyond a segment's nominal begin in which its worker looks for a natural boundary, at least.
REACH_CHARS = 1 << 12
#: Characters of a window of a long item; bytes after which a file is cut into segments.
SEGMENT_CHARS = 1 << 20
#: Summaries combined by one task at a time.
FAN_IN = 512
#: Kinds of places, coarsest first (fixed values).
LEVELS = ("block", "line", "sentence", "space", "none")

LINE_START = re.compile(r"^[^\S\n]*(```|~~~|\S|\n|\Z)", re.M)
#: What follows a line break: the marks of a fence, what may become one, any other sign, the next break or the end of the range.
AFTER_BREAK = re.compile(r"\n(?=[^\S\n]*(```|~~~|`{1,2}\Z|~{1,2}\Z|\S|\n|\Z))")
FENCES = ("```", "~~~")
CUTS = {"line": re.compile("\n"), "sentence": re.compile(r"\n|(?<=[.!?؟])\s"), "space": re.compile(r"\s")}

#: States of the block scan: between blocks, in text, in a fence, in the line that closes a fence.
CLOSED, TEXT, FENCE, CLOSING = range(4)


class Ends(NamedTuple):
    """Units of one kind in a range: open end on the left and right as (first, last) position, the longest closed one, whether any cut was seen."""

    left: tuple[int, int] | None
    longest: int
    right: tuple[int, int] | None
    cut: bool


class Blocks(NamedTuple):
    """What a range does to an incoming state: where it ends the incoming block, the longest block inside, where the open block began (-1: incoming, None: none), the state left."""

    ended: int | None
    longest: int
    opened: int | None
    state: int


class Summary(NamedTuple):
    """A row of the boundary table. ``head``: the first three characters; ``seen``: the first three after white space, up to a line break; ``pending``: begin and first signs of a line whose kind is open."""

    chars: int
    ends: tuple[Ends, Ends, Ends]
    blocks: tuple[Blocks, Blocks, Blocks, Blocks]
    head: str
    seen: str
    pending: tuple[int, str] | None


def joined(a: tuple[int, int] | None, b: tuple[int, int] | None) -> tuple[int, int] | None:
    return (a[0], b[1]) if a and b else a or b


def length(unit: tuple[int, int] | None) -> int:
    return unit[1] - unit[0] + 1 if unit else 0


def stitch_ends(a: Ends, b: Ends) -> Ends:
    if not a.cut and not b.cut:
        return Ends(joined(a.left, b.left), 0, None, False)
    if not a.cut:
        return Ends(joined(a.left, b.left), b.longest, b.right, True)
    if not b.cut:
        return Ends(a.left, a.longest, joined(a.right, b.left), True)
    return Ends(a.left, max(a.longest, b.longest, length(joined(a.right, b.left))), b.right, True)


def stitch_blocks(a: Blocks, after: tuple[Blocks, ...]) -> Blocks:
    b = after[a.state]
    longest, ended = max(a.longest, b.longest), a.ended
    if b.ended is not None and a.opened is not None:
        if a.opened == -1:
            ended = b.ended
        else:
            longest = max(longest, b.ended - a.opened)
    return Blocks(ended, longest, a.opened if b.opened == -1 else b.opened, b.state)


def opened(signs: str, b: Summary) -> tuple[str, str | None]:
    """The signs of an open line with what a range adds to them, and its kind if that tells it."""
    if not signs:
        signs, whole = b.seen, b.seen[:1] != "\n" and len(b.seen) < 3
    else:
        # Signs of a fence follow each other without white space.
        signs, whole = signs + b.head[: 3 - len(signs)], b.chars < 3 - len(signs)
    if signs[:3] in FENCES:
        return signs, "F"
    if whole and any(f.startswith(signs) for f in FENCES):
        return signs, None
    return signs, "B" if signs[:1] == "\n" else "T"


def told(blocks: tuple[Blocks, ...], at: int, kind: str) -> tuple[Blocks, ...]:
    """The effect of ranges and then of one more line."""
    line = tuple(scan_blocks([(at, kind)], state) for state in range(4))
    return tuple(stitch_blocks(x, line) for x in blocks)


def stitch(a: Summary, b: Summary) -> Summary:
    blocks, pending = a.blocks, a.pending
    if pending is not None:
        signs, kind = opened(pending[1], b)
        if kind is not None:
            blocks, pending = told(blocks, pending[0], kind), None
        else:
            pending = (pending[0], signs)
    blocks = tuple(stitch_blocks(x, b.blocks) for x in blocks)
    head = (a.head + b.head)[:3]
    # Fewer than three signs mean that the range ended there.
    seen = a.seen if len(a.seen) == 3 else (a.seen + b.head)[:3] if a.seen else b.seen
    return Summary(a.chars + b.chars, tuple(stitch_ends(x, y) for x, y in zip(a.ends, b.ends, strict=True)), blocks, head, seen, b.pending or pending)


#: What comes before an item: nothing, and its first line is open.
BEGIN = Summary(0, (Ends(None, 0, None, False),) * 3, tuple(Blocks(None, 0, -1 if state else None, state) for state in range(4)), "", "", (0, ""))


#: States between ranges: those of the block scan, for each way in which a line may be open.
OPEN = (None, "", "`", "``", "~", "~~")
START = 4 * OPEN.index("") + CLOSED


def changes_of(part: Summary) -> list[int]:
    """What a range makes of each state between ranges."""
    after = []
    for signs in OPEN:
        whole = stitch(BEGIN._replace(pending=None if signs is None else (0, signs)), part)
        after += [4 * OPEN.index(whole.pending and whole.pending[1]) + b.state for b in whole.blocks]
    return after


def finished(whole: Summary) -> Summary:
    """The summary of an item, of that of all its ranges: the last line is no longer open."""
    if whole.pending is None:
        return whole
    at, signs = whole.pending
    return whole._replace(blocks=told(whole.blocks, at, "T" if signs else "B"), pending=None)


def line_kinds(text: str, first: int, last: int, base: int) -> list[tuple[int, str]]:
    """Start and kind of every line that begins in ``text[first:last]``: T text, B blank, F fence."""
    found = []
    for m in LINE_START.finditer(text, first):
        at = m.start()
        if at >= last:
            break
        if at and text[at - 1] != "\n":
            continue
        mark = m.group(1)
        found.append((base + at, "F" if len(mark) == 3 else "T" if mark.strip() else "B"))
    return found


def scan_blocks(lines: list[tuple[int, str]], state: int) -> Blocks:
    ended, longest, opened = None, 0, -1 if state != CLOSED else None

    def close(at: int) -> None:
        nonlocal ended, longest, opened
        if opened == -1:
            ended = at - 1
        elif opened is not None:
            longest = max(longest, at - 1 - opened)
        opened = None

    for at, kind in lines:
        if state == CLOSING:
            close(at)
            state = CLOSED
        if state == FENCE:
            if kind == "F":
                state = CLOSING
        elif kind == "F":
            if state == TEXT:
                close(at)
            opened, state = at, FENCE
        elif kind == "B":
            if state == TEXT:
                close(at)
            state = CLOSED
        elif state == CLOSED:
            opened, state = at, TEXT
    return Blocks(ended, longest, opened, state)


def scan_ends(text: str, first: int, last: int, base: int, level: str) -> Ends:
    trim = level != "line"
    units, start = [], first

    def unit(a: int, b: int) -> tuple[int, int] | None:
        if trim:
            part = text[a:b]
            left = len(part) - len(part.lstrip())
            right = len(part.rstrip())
            return (base + a + left, base + a + right - 1) if right > left else None
        return (base + a, base + b - 1) if b > a else None

    for m in CUTS[level].finditer(text, first, last):
        units.append(unit(start, m.start()))
        start = m.end()
    units.append(unit(start, last))
    if len(units) == 1:
        return Ends(units[0], 0, None, False)
    return Ends(units[0], max(map(length, units[1:-1]), default=0), units[-1], True)


def scan(text: str, first: int, last: int, base: int) -> Summary:
    """Summary of ``text[first:last]``; what lies before is halo, ``base`` is the position of ``text[0]`` in the item."""
    lines: list[tuple[int, str]] = []
    pending = None
    for m in AFTER_BREAK.finditer(text, first, last):
        mark, at = m.group(1), base + m.end()
        if mark in ("`", "``", "~", "~~") and last - m.end(1) == 0 or not mark:
            pending = (at, mark)
        else:
            lines.append((at, "F" if mark in FENCES else "B" if mark == "\n" else "T"))
    ends = tuple(scan_ends(text, first, last, base, level) for level in CUTS)
    seen = re.compile(r"[^\S\n]*").match(text, first, last).end()
    return Summary(last - first, ends, tuple(scan_blocks(lines, state) for state in range(4)), text[first : min(last, first + 3)], text[seen : min(last, seen + 3)], pending)


def longest_units(whole: Summary) -> dict[str, int]:
    """Length of the longest unit of each kind, of a stitched item."""
    found = {level: max(length(e.left), e.longest, length(e.right)) for level, e in zip(CUTS, whole.ends, strict=True)}
    b = whole.blocks[CLOSED]
    return {"block": max(b.longest, whole.chars - b.opened if b.opened is not None else 0)} | found


def coarsest(whole: Summary, room: int) -> str:
    longest = longest_units(whole)
    return next((level for level in LEVELS[:-1] if longest[level] <= room), "none")


def scanned(text: str, size: int = RANGE_CHARS) -> Iterator[Summary]:
    """The rows of the boundary table of an item in memory, with positions from its begin."""
    for a in range(0, len(text), size):
        low = max(0, a - 1)
        b = min(len(text), a + size)
        part = text[low:b]
        yield scan(part, a - low, b - low, low)


def summary_of(text: str, size: int = RANGE_CHARS) -> Summary:
    """An item in memory, range by range."""
    return finished(reduce(stitch, scanned(text, size), BEGIN))


def places(text: str, first: int = 0, state: int = CLOSED) -> dict[str, list[int]]:
    """Positions where a unit of each kind begins (and the one before has ended). Blocks and lines are looked for from ``first``, where the block scan is in ``state``."""
    lines, blocks = line_kinds(text, first, len(text), 0), []
    for at, kind in lines:
        if state == CLOSING:
            state = CLOSED
        if state == FENCE:
            state = CLOSING if kind == "F" else FENCE
        elif kind == "F":
            blocks.append(at)
            state = FENCE
        elif kind == "B":
            state = CLOSED
        elif state == CLOSED:
            blocks.append(at)
            state = TEXT
    return {
        "block": blocks,
        "line": [at for at, _ in lines],
        "sentence": [m.end() for m in re.finditer(r"(?:\n|(?<=[.!?؟])\s)\s*", text)],
        "space": [m.end() for m in re.finditer(r"\s+", text)],
    }


def cut_window(text: str, most: int, overlap: int, first: int = 0, state: int = CLOSED, lead: int = 0, upto: int | None = None) -> tuple[list[tuple[int, int, int, str]], int, int]:
    """Pieces as of ``cut`` and where the next one begins, with and without overlap. If the text goes on, only pieces whose limit lies before ``upto`` are given."""
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be smaller than the limit")
    n, found, start = len(text), [], first
    at = places(text, first, state) if n > lead + most else {}
    while True:
        limit = lead + most
        if upto is not None and limit >= upto:
            return found, lead, start
        if limit >= n:
            found.append((lead, start, n, "end"))
            return found, n, n
        end, level = limit, "none"
        for kind in LEVELS[:-1]:
            k = bisect_right(at[kind], limit) - 1
            if k >= 0 and at[kind][k] > start:
                end, level = at[kind][k], kind
                break
        found.append((lead, start, end, level))
        low, lead = end - overlap, end
        if overlap:
            for kind in ("sentence", "space"):
                k = bisect_left(at[kind], max(low, found[-1][0] + 1))
                if k < len(at[kind]) and at[kind][k] < end:
                    lead = at[kind][k]
                    break
            else:
                lead = max(low, found[-1][0] + 1)
        start = end


def cut(text: str, most: int, overlap: int, first: int = 0, state: int = CLOSED) -> list[tuple[int, int, int, str]]:
    """Pieces of ``text`` as (start with overlap, start, end, kind of place where it ends); ``text[:first]`` is overlap of the first piece, ``state`` that of the block scan at ``first``."""
    return cut_window(text, most, overlap, first, state)[0]


def pieces_of(text: str, most: int, overlap: int, size: int = SEGMENT_CHARS) -> Iterator[tuple[int, int, int, str]]:
    """Pieces of a whole item as (start with overlap, start, end, kind): those of ``cut(text, most, overlap)``, but no more than a window is looked at in one go."""
    n, lead, start, state = len(text), 0, 0, CLOSED
    size = max(size, 2 * most)
    while True:
        # White space around the window's ends belongs to it, so that places and kinds of lines are those of the whole text.
        low, high = lead, min(n, lead + size)
        while low and text[low - 1].isspace():
            low -= 1
        low, upto = max(0, low - 1), high
        while high < n and text[high].isspace():
            high += 1
        high = min(n, high + 3)
        window = text[low:high]
        found, next_lead, end = cut_window(window, most, overlap, start - low, state, lead - low, None if high == n else upto - low)
        for a, b, c, kind in found:
            yield low + a, low + b, low + c, kind
        if found[-1][3] == "end":
            return
        state = scan_blocks(line_kinds(window, start - low, end, 0), state).state
        lead, start = low + next_lead, low + end


def oversized(items: dict[str, DataFrame], limits: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``item_table``, ``item_id``, ``text``, ``max_chars``, ``overlap_chars`` of the items beyond their limit.

    The limits are one row per field, written by hand. Null texts and tables
    without a limit give nothing; of several limits for a field the smallest counts.
    """
    rules = {(r["item_table"], r["field_name"]): r for r in sorted(limits.select("item_table", "field_name", "max_chars", "overlap_chars").dropna().collect(), key=lambda r: -r["max_chars"])}
    parts = [
        df.where(F.length(field) > r["max_chars"]).select(
            F.lit(name).alias("item_table"), F.col(keys[name]).alias("item_id"), F.col(field).alias("text"), F.lit(r["max_chars"]).alias("max_chars"), F.lit(min(r["overlap_chars"], r["max_chars"] - 1)).alias("overlap_chars")
        )
        for (name, field), r in rules.items()
        if (df := items.get(name)) is not None
    ]
    if not parts:
        first = next(iter(items.values()))
        return first.sparkSession.createDataFrame([], "item_table string, item_id string, text string, max_chars int, overlap_chars int")
    return reduce(DataFrame.unionByName, parts)


BOUNDARIES = "item_table string, item_id string, room int, text bigint, n int, summary string"


def boundary_table(items: DataFrame, size: int = RANGE_CHARS) -> DataFrame:
    """``item_table``, ``item_id``, ``room``, ``text`` (a hash), ``n`` (number of the range), ``summary``: one row per range of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in BOUNDARIES.split(", ")]
        for batch in batches:
            rows = []
            for name, key, text, most, overlap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = xxhash.xxh64_intdigest(text) - (1 << 63)
                rows += [(name, key, most - overlap, mark, n, packed(part)) for n, part in enumerate(scanned(text, size))]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(kinds)], names=names)

    return items.mapInArrow(run, BOUNDARIES)


def cut_places(items: DataFrame, size: int = RANGE_CHARS) -> DataFrame:
    """``item_table``, ``item_id``, ``cut_at`` of oversized items: the coarsest place that suffices. Repeated rows count once.

    Only rows of the boundary table are brought together, some hundred bytes for
    each range of ``size`` characters; texts stay where they are.
    """
    rows = boundary_table(items, size).groupBy("item_table", "item_id", "room", "text").agg(F.array_sort(F.collect_set(F.struct("n", "summary"))).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [coarsest(finished(reduce(stitch, (unpacked(r["summary"]) for r in ranges), BEGIN)), room) for room, ranges in zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(levels, type=pa.string())], names=["item_table", "item_id", "cut_at"])

    found = rows.select("item_table", "item_id", "room", "ranges").mapInArrow(run, "item_table string, item_id string, cut_at string")
    return found.distinct()


def cut_pieces(items: DataFrame) -> DataFrame:
    """The pieces of oversized items in order: ``piece_no`` from 0, ``start`` (of the piece's overlap), ``overlap``, ``cut_at`` (where it ends), ``piece``.

    Every piece has at most ``max_chars`` characters and begins with the last
    ``overlap_chars`` or fewer of the piece before. Items repeated verbatim count once.
    """
    once = items.withColumn("h", F.xxhash64("text")).dropDuplicates(["item_table", "item_id", "h"]).drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, key, text, most, overlap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(pieces_of(text, most, overlap))
                for low in range(0, len(found), 1000):
                    part = found[low : low + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([table] * len(part), type=pa.string()),
                            pa.array([key] * len(part), type=pa.string()),
                            pa.array(range(low, low + len(part)), type=pa.int32()),
                            pa.array([lead for lead, *_ in part], type=pa.int64()),
                            pa.array([start - lead for lead, start, *_ in part], type=pa.int32()),
                            pa.array([kind for *_, kind in part], type=pa.string()),
                            pa.array([text[lead:end] for lead, _, end, _ in part], type=pa.string()),
                        ],
                        names=["item_table", "item_id", "piece_no", "start", "overlap", "cut_at", "piece"],
                    )

    return once.mapInArrow(run, "item_table string, item_id string, piece_no int, start bigint, overlap int, cut_at string, piece string")


# Files, by byte range.


def located(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """Files as addresses in their file system, with their sizes; plain paths lie in the default one."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(conf)
        found.append((system.makeQualified(path).toString(), int(system.getFileStatus(path).getLen())))
    return found


def open_input(path: str):
    """A file that can be read from any place, of whatever file system."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path) if parts.scheme else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_file(inner)


def read_text(path: str, first: int, last: int) -> tuple[str, int]:
    """Characters that begin in the bytes ``first`` … ``last`` of a UTF-8 file, and the byte where they begin."""
    with open_input(path) as file:
        file.seek(first)
        raw = file.read(last - first + 4)
    skip = 0
    while first and skip < 4 and skip < len(raw) and raw[skip] & 0xC0 == 0x80:
        skip += 1
    end = min(last - first, len(raw))
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    return raw[skip:end].decode("utf-8", "replace"), first + skip


def packed(summary: Summary) -> str:
    return json.dumps(summary, ensure_ascii=False, separators=(",", ":"))


def moved(summary: Summary, by: int) -> Summary:
    """The summary with all positions moved."""

    def unit(u: tuple[int, int] | None) -> tuple[int, int] | None:
        return (u[0] + by, u[1] + by) if u else None

    return summary._replace(
        ends=tuple(Ends(unit(e.left), e.longest, unit(e.right), e.cut) for e in summary.ends),
        blocks=tuple(Blocks(None if b.ended is None else b.ended + by, b.longest, b.opened if b.opened in (None, -1) else b.opened + by, b.state) for b in summary.blocks),
        pending=summary.pending and (summary.pending[0] + by, summary.pending[1]),
    )


def combined(parts: Iterable[Summary]) -> Summary:
    """Summaries of neighbouring ranges, each with positions from its own first character."""
    whole, chars = None, 0
    for part in parts:
        part = moved(part, chars)
        whole = part if whole is None else stitch(whole, part)
        chars += part.chars
    return whole


def scan_files(spark: SparkSession, paths: list[tuple[str, int]], size: int = RANGE_CHARS) -> DataFrame:
    """The boundary table of files as of ``located``: ``path``, ``n`` (number of the range), ``chars``, ``summary``, one row per byte range."""
    sized = spark.createDataFrame(paths, "path string, bytes bigint")
    ranges = sized.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.expr(f"(bytes - 1) div {size}")).cast("bigint"))).alias("n"))
    ranges = ranges.repartition(F.col("path"), F.col("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("n", pa.int64()), ("chars", pa.int64()), ("summary", pa.string())])
        for batch in batches:
            rows = []
            for path, total, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = n * size, min(total, (n + 1) * size)
                text, _ = read_text(path, a, b)
                before = read_text(path, max(0, a - 4), a)[0][-1:] if a else ""
                found = scan(before + text, len(before), len(before) + len(text), -len(before))
                rows.append((path, n, found.chars, packed(found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)

    return ranges.mapInArrow(run, "path string, n bigint, chars bigint, summary string")


def unpacked(text: str) -> Summary:
    chars, ends, blocks, head, seen, pending = json.loads(text)
    unit = lambda u: tuple(u) if u else None
    return Summary(chars, tuple(Ends(unit(a), longest, unit(b), cut) for a, longest, b, cut in ends), tuple(Blocks(*b) for b in blocks), head, seen, unit(pending))


def stitched_files(boundaries: DataFrame, ranges: int) -> DataFrame:
    """``path``, ``chars``, ``summary`` of whole files; a tree of FAN_IN-wide steps, so no task combines more than FAN_IN rows of a file."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        whole = combined(map(unpacked, rows["summary"]))
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "n": [rows["n"].iloc[0] // FAN_IN], "chars": [whole.chars], "summary": [packed(whole)]})

    while True:
        boundaries = boundaries.groupBy("path", F.expr(f"n div {FAN_IN}").alias("g")).applyInPandas(fold, "path string, n bigint, chars bigint, summary string")
        ranges = -(-ranges // FAN_IN)
        if ranges <= 1:
            return boundaries.drop("n")


def file_cut_places(spark: SparkSession, paths: list[str], most: int, overlap: int, size: int = RANGE_CHARS) -> DataFrame:
    """``path``, ``cut_at`` of the files longer than ``most`` characters."""
    files = located(spark, paths)
    ranges = max(1, max((-(-n // size) for _, n in files), default=1))
    whole = stitched_files(scan_files(spark, files, size), ranges).where(F.col("chars") > most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [coarsest(finished(stitch(BEGIN, unpacked(s))), most - overlap) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, type=pa.string())], names=["path", "cut_at"])

    return whole.mapInArrow(run, "path string, cut_at string")


def incoming_states(boundaries: DataFrame, ranges: int) -> DataFrame:
    """``path``, ``n``, ``state`` before each range (of ``after``, what it makes of each state): an exclusive scan in a tree, so no task combines more than FAN_IN rows of a file."""
    import pandas as pd

    after = boundaries.select("path", "n", "after")
    groups = after.groupBy("path", F.expr(f"n div {FAN_IN}").alias("g"))
    if ranges <= FAN_IN:
        before = boundaries.select("path", F.lit(0).cast("bigint").alias("g")).distinct().withColumn("entry", F.lit(START))
    else:

        def fold(rows: pd.DataFrame) -> pd.DataFrame:
            whole = reduce(lambda a, b: [b[k] for k in a], rows.sort_values("n")["after"], list(range(4 * len(OPEN))))
            return pd.DataFrame({"path": [rows["path"].iloc[0]], "n": [rows["n"].iloc[0] // FAN_IN], "after": [whole]})

        summed = groups.applyInPandas(fold, "path string, n bigint, after array<int>")
        before = incoming_states(summed, -(-ranges // FAN_IN)).select("path", F.col("n").alias("g"), F.col("state").alias("entry"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        states = [int(rows["entry"].iloc[0])]
        for change in rows["after"]:
            states.append(int(change[states[-1]]))
        return pd.DataFrame({"path": rows["path"], "n": rows["n"], "state": states[:-1]})

    joined = after.withColumn("g", F.expr(f"n div {FAN_IN}")).join(before, ["path", "g"])
    return joined.groupBy("path", "g").applyInPandas(walk, "path string, n bigint, state int")


def segment_begin(path: str, target: int, total: int, state: int, reach: int) -> tuple[int, str, int]:
    """Byte of the first place from ``target`` on, its kind and the state of the block scan there; ``state`` is that between ranges at ``target``.

    The coarsest kind of place within ``reach`` characters counts.
    """
    signs, state = OPEN[state // 4], state % 4
    if target <= 0 or target >= total:
        return max(0, min(target, total)), "end", state
    far = 4 * reach + REACH_CHARS
    while True:
        halo, at = read_text(path, max(0, target - 8), min(total, target + far))
        first = len(read_text(path, at, target)[0])
        # A line that began before is told by what follows, however much white space that is.
        kind = opened(signs, scan(halo, first, len(halo), 0))[1] if signs is not None and halo[first - 1 : first] != "\n" else ""
        if kind is not None or target + far >= total:
            break
        far *= 2
    if kind:
        state = scan_blocks([(0, kind)], state).state
    found = places(halo, first, state)
    for level in LEVELS[:-1]:
        k = bisect_left(found[level], first)
        if k < len(found[level]) and found[level][k] - first <= reach and (place := at + len(halo[: found[level][k]].encode("utf-8"))) < total:
            return place, level, scan_blocks(line_kinds(halo, first, found[level][k], 0), state).state
    return read_text(path, target, min(total, target + 4))[1], "none", state


def file_pieces(spark: SparkSession, paths: list[str], most: int, overlap: int, size: int = SEGMENT_CHARS) -> DataFrame:
    """Pieces of files by offset: ``path``, ``segment``, ``piece_no`` (in the file), ``byte_start``, ``bytes``, ``start`` (in characters), ``chars``, ``cut_at``, ``piece``.

    A segment begins at the first natural boundary after each multiple of ``size``
    bytes. Its worker finds its own begin and that of the next segment from two
    halos and the states of the block scan before them.
    """
    step = max(size, 8 * most)
    reach = max(REACH_CHARS, most)
    files = located(spark, paths)
    sized = spark.createDataFrame(files, "path string, bytes bigint").where("bytes > 0")
    ranges = max(1, max((-(-n // step) for _, n in files), default=1))

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after = [changes_of(unpacked(s)) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(after, type=pa.list_(pa.int32()))], names=["path", "n", "after"])

    boundaries = scan_files(spark, files, step).select("path", "n", "summary").mapInArrow(changes, "path string, n bigint, after array<int>")
    states = written(incoming_states(written(boundaries, "file-ranges"), ranges), "file-states")
    following = states.select("path", (F.col("n") - 1).alias("n"), F.col("state").alias("next"))
    parts = states.join(following, ["path", "n"], "left").join(sized, "path").select("path", "bytes", F.col("n").alias("segment"), "state", F.coalesce("next", F.lit(START)).alias("next"))
    parts = parts.repartition(F.col("path"), F.col("segment"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "segment", "piece_no", "byte_start", "bytes", "start", "chars", "cut_at", "piece", "segment_chars"]
        for batch in batches:
            for path, total, segment, state, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, _, state = segment_begin(path, segment * step, total, state, reach)
                b, level, _ = segment_begin(path, (segment + 1) * step, total, after, reach)
                if b <= a:
                    continue
                text, _ = read_text(path, a, b)
                before = read_text(path, max(0, a - 4 * overlap), a)[0][-overlap:] if overlap and a else ""
                whole, rows = before + text, []
                origin, offset, place = a - len(before.encode("utf-8")), 0, 0
                for k, (lead, _, end, kind) in enumerate(cut(whole, most, overlap, len(before), state)):
                    offset += len(whole[place:lead].encode("utf-8"))
                    place = lead
                    piece = whole[lead:end]
                    rows.append((path, segment, k, origin + offset, len(piece.encode("utf-8")), lead - len(before), len(piece), level if kind == "end" else kind, piece, len(text)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)

    found = written(parts.mapInArrow(run, "path string, segment bigint, piece_no bigint, byte_start bigint, bytes bigint, start bigint, chars bigint, cut_at string, piece string, segment_chars bigint"), "file-pieces")
    # One row per segment: a prefix sum of pieces and characters before it.
    earlier = Window.partitionBy("path").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy("path", "segment").agg(F.count("*").alias("n"), F.first("segment_chars").alias("m"))
    before = counts.select("path", "segment", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "m")))
    moved_on = {"piece_no": F.col("piece_no") + F.col("n_before"), "start": F.col("start") + F.col("m_before")}
    return found.join(before, ["path", "segment"]).withColumns(moved_on).select("path", "segment", "piece_no", "byte_start", "bytes", "start", "chars", "cut_at", "piece")
