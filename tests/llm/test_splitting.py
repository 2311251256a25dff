"""Ranges, stitching and pieces against plain code over whole texts; files against rows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import splitting as S

PARTS = st.lists(st.sampled_from(["a", "b c", "\n", "\n\n", ". ", "```", "\n```\n", " ", "x", "! ", "\n  \n", "؟\n", "é "]), max_size=40).map("".join)


def plainly(text):
    blocks, held, fenced = [], [], False
    for line in text.split("\n"):
        fence = line.lstrip().startswith(("```", "~~~"))
        if fenced:
            held.append(line)
            if fence:
                blocks.append("\n".join(held))
                held, fenced = [], False
        elif fence:
            blocks += ["\n".join(held)] * bool(held)
            held, fenced = [line], True
        elif line.strip():
            held.append(line)
        elif held:
            blocks.append("\n".join(held))
            held = []
    blocks += ["\n".join(held)] * bool(held)
    lines = text.split("\n")
    pieces = [p.strip() for x in lines for p in re.split(r"(?<=[.!?؟])\s", x)]
    longest = lambda xs: max(map(len, xs), default=0)
    return {"block": longest(blocks), "line": longest(lines), "sentence": longest(pieces), "space": longest(text.split())}


@settings(max_examples=400, deadline=None)
@given(PARTS, st.sampled_from([1, 2, 3, 7, 50]))
def test_units(text, size):
    assert S.longest_units(S.summary_of(text, size)) == plainly(text)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.sampled_from([(5, 2), (9, 0), (12, 5)]), st.sampled_from([30, 10**9]))
def test_pieces(text, limits, size):
    most, overlap = limits
    end = 0
    for lead, start, stop, _ in S.pieces_of(text, most, overlap, size):
        assert start == end and stop - lead <= most and 0 <= start - lead <= overlap
        end = stop
    assert end == len(text)


@settings(max_examples=500, deadline=None)
@given(PARTS.map(lambda t: t * 3), st.sampled_from([(5, 2), (9, 0), (12, 5)]), st.sampled_from([1, 30, 70]))
def test_long_items_are_cut_like_short_ones(text, limits, size):
    assert list(S.pieces_of(text, *limits, size)) == S.cut(text, *limits)


def test_file_segments_know_code(spark, tmp_path):
    text = "".join(f"Prose number {k}.\n\n```\n" + "code\n\nmore سلام\n\n" * 12 + "```\n\n" for k in range(120))
    path = tmp_path / "long.md"
    path.write_text(text, encoding="utf-8")
    rows = S.file_pieces(spark, [str(path)], 600, 50, size=5000).orderBy("piece_no").collect()
    blocks = {*S.places(text)["block"]}
    assert [r.piece_no for r in rows] == list(range(len(rows))) and len({r.segment for r in rows}) > 5
    for r in rows:
        assert text[r.start : r.start + r.chars] == r.piece
        assert r.cut_at == ("end" if r is rows[-1] else "block") and (r is rows[-1] or r.start + r.chars in blocks)


def test_states_before_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN_IN", 3)
    n = 4 * len(S.OPEN)
    changes = [[(s * (k + 1) + k) % n for s in range(n)] for k in range(20)]
    found = S.incoming_states(spark.createDataFrame([("p", k, c) for k, c in enumerate(changes)], "path string, n bigint, after array<int>"), 20)
    want = [S.START]
    for c in changes:
        want.append(c[want[-1]])
    assert [r.state for r in found.orderBy("n").collect()] == want[:-1]


def test_rows(spark):
    limits = spark.createDataFrame([("pages", "source_text", 20, 5), ("other", "x", 1, 0)], "item_table string, field_name string, max_chars int, overlap_chars int")
    rows = [("a", "para one.\n\npara two is.\n\nthree"), ("a", "para one.\n\npara two is.\n\nthree"), ("b", "x" * 50), ("c", None), ("d", ""), ("e", "short"), ("f", "one two three four five six seven")]
    pages = spark.createDataFrame(rows, "id string, source_text string")
    items = S.oversized({"pages": pages}, limits, {"pages": "id"})
    assert {r.item_id: r.cut_at for r in S.cut_places(items).collect()} == {"a": "block", "b": "none", "f": "space"}
    pieces = S.cut_pieces(items).orderBy("item_id", "piece_no").collect()
    assert max(len(r.piece) for r in pieces) <= 20
    assert "".join(r.piece[r.overlap :] for r in pieces if r.item_id == "a") == rows[0][1]
    assert S.cut_places(S.oversized({"pages": pages}, limits.limit(0), {"pages": "id"})).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        S.cut("x" * 9, 3, 3)


def test_files(spark, tmp_path):
    text = ("Wörter und سلام.\n" * 30 + "\n```\ncode\n\nmore\n```\n\n") * 40
    paths = []
    for k, t in enumerate((text, text.replace("\n", " "), "short", "")):
        path = tmp_path / f"{k}.txt"
        path.write_text(t, encoding="utf-8")
        paths.append(str(path))
    got = {r.path.removeprefix("file:"): r.cut_at for r in S.file_cut_places(spark, paths, 600, 50, size=997).collect()}
    assert got == {p: S.coarsest(S.summary_of(t), 550) for p, t in zip(paths[:2], (text, text.replace("\n", " ")), strict=True)}
    rows = S.file_pieces(spark, paths[:1], 600, 50, size=5000).orderBy("segment", "piece_no").collect()
    raw, end = text.encode(), 0
    for r in rows:
        assert len(r.piece) <= 600 and raw[r.byte_start : r.byte_start + r.bytes].decode() == r.piece and r.byte_start <= end
        end = r.byte_start + r.bytes
    assert end == len(raw)


def test_lines_that_open_with_much_white_space():
    text = "alpha.\n" + " " * 12_288 + "beta\n\n" + " " * 9_000 + "```\ncode\n\nmore\n" + " " * 7_000 + "```\n\n" + " " * 5_000 + "\ngamma"
    for size in (1, 7, 200, 4096, 10**6):
        assert S.longest_units(S.summary_of(text, size)) == plainly(text)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.integers(1, 9), st.integers(1, 4))
def test_trees(text, size, width):
    """Rows of the boundary table combined in a tree, with positions from the begin of each range."""
    rows = [S.unpacked(S.packed(S.moved(part, -k * size))) for k, part in enumerate(S.scanned(text, size))]
    while len(rows) > 1 and width > 1:
        rows = [S.combined(rows[k : k + width]) for k in range(0, len(rows), width)]
    whole = S.finished(S.stitch(S.BEGIN, S.combined(rows))) if rows else S.finished(S.BEGIN)
    assert S.longest_units(whole) == plainly(text)
    state = S.START
    for part in S.scanned(text, size):
        state = S.changes_of(part)[state]
    assert state % 4 == S.combined([S.BEGIN, *rows]).blocks[S.CLOSED].state if rows else state == S.START


def test_places_do_not_depend_on_ranges(spark):
    rows = [(str(k), ("para one.\n\n" * k + "   \n```\ncode\n\nx\n  ```\nlast one here") * 3) for k in range(1, 9)]
    limits = spark.createDataFrame([("pages", "t", 30, 5)], "item_table string, field_name string, max_chars int, overlap_chars int")
    items = S.oversized({"pages": spark.createDataFrame(rows * 2, "id string, t string")}, limits, {"pages": "id"})
    found = [sorted(tuple(r) for r in S.cut_places(items, size).collect()) for size in (3, 50, 10**6)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 8


def test_long_text_in_linear_time():
    text = "word " * 400_000
    assert S.coarsest(S.summary_of(text), 100) == "space"
