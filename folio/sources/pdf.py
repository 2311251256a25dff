"""Spans, page counts and outlines of PDF files, read from their bytes.

Covers what books usually hold: compressed content and object streams, simple fonts
and fonts with a map to Unicode, text operators and their matrices. Files that are
encrypted or broken give no rows; images and drawings are left to others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "path string, page_number int, block_no int, line_no int, span_no int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"
TOKEN = re.compile(rb"%[^\r\n]*|/[^\s()<>\[\]{}/%]*|<<|>>|[\[\]]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))*\)|<[0-9A-Fa-f\s]*>|[^\s()<>\[\]{}/%]+", re.S)
OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Width of a glyph without one of its own, in thousandths of the size; ascent and descent in shares of it.
GLYPH_WIDTH, ASCENT, DESCENT = 500, 0.8, 0.2
#: Share of the size by which baselines or gaps must differ for another line or block to begin.
LINE_STEP, BLOCK_STEP = 0.4, 1.8


class Ref(int):
    """The number of another object."""


class Name(str):
    """A name, without its slash."""


class String(bytes):
    """The bytes of a string, unlike those of an operator."""


def literal(raw: bytes) -> bytes:
    """The bytes of a string in parentheses or angle brackets."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def put(m: re.Match) -> bytes:
        s = m.group(1)
        return bytes([int(s, 8) & 255]) if s[:1].isdigit() else b"" if s in (b"\n", b"\r\n", b"\r") else ESCAPES.get(s, s)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", put, raw[1:-1], flags=re.S)


def values(data: bytes) -> list:
    """All values of a piece of PDF, with references as Ref; other words as bytes."""
    stack: list[list] = [[]]
    for m in TOKEN.finditer(data):
        t = m.group(0)
        if t[:1] == b"%":
            continue
        if t in (b"<<", b"["):
            stack.append([])
        elif t in (b">>", b"]") and len(stack) > 1:
            inner = stack.pop()
            stack[-1].append(dict(zip((str(k) for k in inner[::2]), inner[1::2], strict=False)) if t == b">>" else inner)
        elif t[:1] == b"/":
            stack[-1].append(Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x.group(1).decode()), t[1:]).decode("latin-1")))
        elif t[:1] in b"(<":
            stack[-1].append(String(literal(t)))
        elif t == b"R" and len(stack[-1]) > 1 and isinstance(stack[-1][-2], int):
            stack[-1][-2:] = [Ref(stack[-1][-2])]
        elif re.fullmatch(rb"[+-]?\d+", t):
            stack[-1].append(int(t))
        elif re.fullmatch(rb"[+-]?\d*\.?\d*", t) and t not in (b"", b".", b"+", b"-"):
            stack[-1].append(float(t))
        else:
            stack[-1].append(t)
    return stack[0]


class Document:
    """The objects of a file; a later one of a number replaces the earlier."""

    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        found = list(OBJECT.finditer(data))
        for m, after in zip(found, [*found[1:], None], strict=True):
            body = data[m.end() : after.start() if after else len(data)]
            stream = re.search(rb"\bstream\r?\n", body)
            head = values(body[: stream.start()] if stream else body.split(b"endobj")[0])
            if not head:
                continue
            raw = None
            if stream:
                raw = body[stream.end() : max(body.rfind(b"endstream"), stream.end())]
            self.objects[int(m.group(1))] = (head[0], raw)
        for number, (head, raw) in list(self.objects.items()):
            if raw is not None and isinstance(head, dict) and head.get("Type") == "ObjStm":
                inner = self.stream(number)
                first = int(self.value(head.get("First", 0)))
                places = [int(x) for x in inner[:first].split()]
                for key, at in zip(places[::2], places[1::2], strict=False):
                    if (held := values(inner[first + at :][:1_000_000])) and key not in self.objects:
                        self.objects[key] = (held[0], None)

    def value(self, x: object) -> object:
        seen = 0
        while isinstance(x, Ref) and seen < 20:
            x, seen = self.objects.get(int(x), (None, None))[0], seen + 1
        return x

    def stream(self, ref: object) -> bytes:
        head, raw = self.objects.get(int(ref), (None, None)) if isinstance(ref, int) else (None, None)
        if raw is None:
            return b""
        filters = self.value(head.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters] * bool(filters):
            if f == "FlateDecode":
                raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> list[tuple[int, dict]]:
        """Numbers and dictionaries of the pages in order, with what they inherit."""
        root = next((h for h, _ in self.objects.values() if isinstance(h, dict) and h.get("Type") == "Catalog"), {})
        found: list[tuple[int, dict]] = []
        stack: list[tuple[object, dict]] = [(root.get("Pages"), {})]
        seen: set[int] = set()
        while stack:
            ref, above = stack.pop()
            node = self.value(ref)
            if not isinstance(node, dict) or int(ref) in seen:
                continue
            seen.add(int(ref))
            node = {**{k: above[k] for k in ("MediaBox", "Resources") if k in above}, **node}
            if "Kids" in node:
                stack += [(k, node) for k in reversed(self.value(node["Kids"]) or []) if isinstance(k, Ref)]
            else:
                found.append((int(ref), node))
        return found

    def outline(self) -> list[tuple[int, str, int]]:
        """Level, title and page number (from 1) of the entries in order; entries that lead nowhere are left out."""
        root = next((h for h, _ in self.objects.values() if isinstance(h, dict) and h.get("Type") == "Catalog"), {})
        number = {ref: k for k, (ref, _) in enumerate(self.pages(), 1)}
        top = self.value(root.get("Outlines"))
        stack, found, seen = [(1, top.get("First"))] if isinstance(top, dict) else [], [], set()
        while stack:
            level, ref = stack.pop()
            entry = self.value(ref)
            if not isinstance(entry, dict) or int(ref) in seen:
                continue
            seen.add(int(ref))
            stack.append((level, entry.get("Next")))
            stack.append((level + 1, entry.get("First")))
            action = self.value(entry.get("A"))
            place = self.value(entry.get("Dest") or (action.get("D") if isinstance(action, dict) else None))
            if isinstance(place, list) and place and int(place[0]) in number:
                title = entry.get("Title") or b""
                found.append((level, title.decode("utf-16") if title[:2] in (b"\xfe\xff", b"\xff\xfe") else title.decode("latin-1"), number[int(place[0])]))
        return found


class Font:
    """Name, widths and the map to Unicode of a font."""

    def __init__(self, doc: Document, head: dict) -> None:
        self.name = str(head.get("BaseFont", ""))
        self.wide = head.get("Subtype") == "Type0"
        self.first, self.widths = int(doc.value(head.get("FirstChar")) or 0), [doc.value(w) for w in doc.value(head.get("Widths")) or []]
        self.map: dict[int, str] = {}
        if isinstance(ref := head.get("ToUnicode"), Ref):
            text = lambda b: b.decode("utf-16-be", "replace")
            for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", doc.stream(ref), re.S):
                held = values(body)
                if kind == b"char":
                    self.map |= {int.from_bytes(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False)}
                else:
                    for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                        start, stop = int.from_bytes(low), min(int.from_bytes(high), int.from_bytes(low) + 65_535)
                        self.map |= {c: text(to[c - start]) if isinstance(to, list) else chr(min(ord((text(to) or " ")[-1]) + c - start, 0x10FFFF)) for c in range(start, stop + 1) if not isinstance(to, list) or c - start < len(to)}

    def read(self, raw: bytes) -> tuple[str, float]:
        """The text of a string and its width in units of the size."""
        codes = [int.from_bytes(raw[k : k + 2]) for k in range(0, len(raw), 2)] if self.wide else list(raw)
        width = lambda c: self.widths[c - self.first] if 0 <= c - self.first < len(self.widths) else GLYPH_WIDTH
        plain = "" if self.wide else raw.decode("cp1252", "replace")
        return "".join(self.map.get(c, "" if self.wide else plain[k]) for k, c in enumerate(codes)), sum(width(c) for c in codes) / 1000


def page_spans(doc: Document, page: dict) -> list[tuple[str, str, float, float, float, float]]:
    """Text, font, size, x0, baseline (from the top) and x1 of each shown string."""
    resources = doc.value(page.get("Resources")) or {}
    fonts = {k: Font(doc, doc.value(v) or {}) for k, v in (doc.value(resources.get("Font")) or {}).items()}
    box = [float(doc.value(x)) for x in doc.value(page.get("MediaBox")) or (0, 0, 612, 792)]
    content = page.get("Contents")
    refs = content if isinstance(content, list) else doc.value(content) if isinstance(doc.value(content), list) else [content]
    found, args = [], []
    font, size, leading, at, line = Font(doc, {}), 0.0, 0.0, [1, 0, 0, 1, 0, 0], [1, 0, 0, 1, 0, 0]

    def moved(m: list, x: float, y: float) -> list:
        return [*m[:4], m[4] + x * m[0] + y * m[2], m[5] + x * m[1] + y * m[3]]

    def show(raw: bytes) -> None:
        nonlocal at
        text, width = font.read(raw)
        scale = (at[2] ** 2 + at[3] ** 2) ** 0.5
        after = moved(at, width * size, 0)
        if text:
            found.append((text, font.name, size * scale, at[4] - box[0], box[3] - at[5], after[4] - box[0]))
        at = after

    for word in values(b"\n".join(doc.stream(r) for r in refs if isinstance(r, Ref))):
        if not isinstance(word, bytes) or isinstance(word, String):
            args.append(word)
            continue
        try:
            if word == b"BT":
                at = line = [1, 0, 0, 1, 0, 0]
            elif word == b"Tf":
                font, size = fonts.get(str(args[-2]), font), float(args[-1])
            elif word == b"TL":
                leading = float(args[-1])
            elif word in (b"Td", b"TD"):
                line = at = moved(line, float(args[-2]), float(args[-1]))
                leading = -float(args[-1]) if word == b"TD" else leading
            elif word == b"Tm":
                line = at = [float(x) for x in args[-6:]]
            elif word in (b"T*", b"'", b'"'):
                line = at = moved(line, 0, -leading)
            if word in (b"Tj", b"'", b'"') and isinstance(args[-1], bytes):
                show(args[-1])
            elif word == b"TJ":
                for x in args[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    else:
                        at = moved(at, -float(x) / 1000 * size, 0)
        except (IndexError, TypeError, ValueError):
            pass
        args = []
    return found


def spans_of(data: bytes) -> Iterator[tuple]:
    """Rows of SPANS without the path: strings on one baseline are a line, lines close to each other a block."""
    doc = Document(data)
    for number, (_, page) in enumerate(doc.pages(), 1):
        box = [float(doc.value(x)) for x in doc.value(page.get("MediaBox")) or (0, 0, 612, 792)]
        block = line = span = 0
        before: tuple[float, float] | None = None
        for text, font, size, x0, y, x1 in page_spans(doc, page):
            if before is not None:
                step = abs(y - before[0])
                span = span + 1 if step < LINE_STEP * size else 0
                line += step >= LINE_STEP * size
                block += step > BLOCK_STEP * max(size, before[1]) or y < before[0] - LINE_STEP * size
            before = (y, size)
            flags = 2 if re.search("bold|black|heavy", font, re.I) else 0
            yield number, block, line, span, text, font, size, flags, x0, y - ASCENT * size, x1, y + DESCENT * size, box[2] - box[0], box[3] - box[1]


def files(df: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows of files (``path``, ``content``); files that cannot be read give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, *r) for r in rows_of(bytes(content))] if content is not None else []
                except Exception:  # noqa: BLE001 - a broken file must not stop the others
                    rows = []
                yield pd.DataFrame(rows, columns=names)

    return df.select("path", "content").mapInPandas(run, schema)


def spans(df: DataFrame) -> DataFrame:
    """Positioned text of PDF files (``spark.read.format("binaryFile")``), for ``layout.page_markdown``; ``page_id`` is path and page."""
    found = files(df, spans_of, SPANS)
    return found.withColumn("page_id", F.concat_ws("#", "path", "page_number"))


def page_counts(df: DataFrame) -> DataFrame:
    """``path``, ``pages`` of PDF files."""
    return files(df, lambda data: [(len(Document(data).pages()),)], "path string, pages int")


def outlines(df: DataFrame) -> DataFrame:
    """``path``, ``seq``, ``level``, ``title``, ``page`` of the outlines of PDF files, as ``segments.chapters_of_outline`` takes them."""
    return files(df, lambda data: [(k, *entry) for k, entry in enumerate(Document(data).outline(), 1)], "path string, seq int, level int, title string, page int")
