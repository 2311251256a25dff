"""Sentences, words and a translation lexicon of texts in two languages.

The lexicon is learned from the corpus itself: sentence pairs that share a number
or a name occurring once on either side, and sentences at the same place of
blocks of equal length, are counted word by word; pairs of words that occur
together far more often than by chance are kept with the strength of their tie.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import looks
from folio.llm.store import spread, written

#: Least number of sentence pairs that hold both words, and least strength of a tie.
TIE_PAIRS = 3
TIE_STRENGTH = 0.2
#: Words in more than this share of all sentence pairs have no ties; a task stops counting their pairs when it has seen somewhat more, and what it has stopped for too early is counted again.
STOP_SHARE, STOP_SEEN = 0.25, 0.3
#: Sentence pairs after which a task first looks for such words.
FIRST_LOOK = 1000
#: Ties that are sent to all tasks at most; a larger lexicon stays a table and is joined by the words of each page, with the same result.
LEXICON_ENTRIES = 200_000
#: Strength of the ties of a glossary.
GLOSSARY_TIE = 0.8
#: Counts a task holds before it hands them on.
HELD = 400_000
#: Stands in counts for words whose pairs a task has stopped counting.
STOPPED = "\0"

FENCE = re.compile(r"^\s*(?:```|~~~)")
IMAGE_LINE = re.compile(r"\s*(?:!\[[^\]\n]*\]\([^)\n]*\)\s*)+")
CUT = re.compile(r"(?<=[.!?؟])\s+")
WORD = re.compile(r"[a-z]+[a-z0-9]*(?:-[0-9]+)?|[0-9]+(?:\.[0-9]+)?|[ء-ۓ]+")


@lru_cache(maxsize=1)
def plain_table() -> dict[int, str | None]:
    """Characters as comparison wants them: one form of digits, letters and spaces, no accents, nothing invisible."""
    table: dict[int, str | None] = {ord(c): " " for c in looks.SPACES}
    table |= {ord(c): t for c, t in {**looks.wide_forms(), **looks.LOOK_ALIKES}.items()}
    table |= {ord(c): t.replace(looks.NON_JOINER, "") for c, t in looks.shaped_forms().items()}
    table |= {0x0660 + k: str(k) for k in range(10)} | {0x06F0 + k: str(k) for k in range(10)}
    table |= {ord("ي"): "ی", ord("ى"): "ی", ord("ك"): "ک", ord("أ"): "ا", ord("إ"): "ا", ord("آ"): "ا", ord("ؤ"): "و", ord("ۀ"): "ه", ord("ة"): "ه", 0x066B: "."}
    for c in map(chr, range(0xC0, 0x250)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1:
            table[ord(c)] = parts[0]
    hidden = [0x00AD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, 0x0640, *range(0x0300, 0x0370), *range(0x064B, 0x0660), 0x0670]
    return table | dict.fromkeys(hidden)


class Text(NamedTuple):
    """Sentences of a text, the number of the block each lies in, and their words."""

    sentences: list[str]
    blocks: list[int]
    words: list[list[str]]


def sentences_of(text: str) -> tuple[list[str], list[int]]:
    """Sentences in order and their blocks: lines outside fenced code, without blank and image lines, cut after end marks."""
    found, blocks, fenced, block, fresh = [], [], False, -1, True
    for line in text.split("\n"):
        if FENCE.match(line):
            fenced, fresh = not fenced, True
            continue
        if fenced:
            continue
        if not line.strip():
            fresh = True
            continue
        if "![" in line and IMAGE_LINE.fullmatch(line):
            fresh = True
            continue
        if fresh:
            block, fresh = block + 1, False
        for s in CUT.split(line.strip()):
            if s:
                found.append(s)
                blocks.append(block)
    return found, blocks


#: What may hold a word: a decimal number, or a run without white space and plain marks.
RUN = re.compile(r"\d+[.٫]\d+|[^\s.,;:!?؟،؛…()\[\]{}«»\"'*#|>]+")
#: Runs met so far with their words, at most so many before the store starts afresh.
KNOWN_RUNS = 200_000
_known: dict[str, tuple[str, ...]] = {}


def words_of(sentence: str) -> list[str]:
    """Words in comparable form. Runs recur, so each is brought to that form once."""
    found: list[str] = []
    for run in RUN.findall(sentence):
        words = _known.get(run)
        if words is None:
            if len(_known) >= KNOWN_RUNS:
                _known.clear()
            words = _known[run] = tuple(WORD.findall(run.translate(plain_table()).lower()))
        found += words
    return found


def read(text: str) -> Text:
    found, blocks = sentences_of(text)
    return Text(found, blocks, [words_of(s) for s in found])


def is_anchor(word: str) -> bool:
    """Numbers of two digits or more; in the target also words in Latin letters."""
    return word[0].isdigit() and len(word) > 1


def anchored(source: Text, target: Text) -> list[tuple[int, int]]:
    """Sentence pairs that share a number or name found once in either text."""

    def once(words: list[list[str]]) -> dict[str, int]:
        places: dict[str, int] = {}
        for k, ws in enumerate(words):
            for w in set(ws):
                places[w] = -1 if w in places else k
        return places

    there = {w: k for w, k in once(target.words).items() if k >= 0 and ("a" <= w[0] <= "z" or is_anchor(w))}
    if not there:
        return []
    here = once(source.words)
    return list({(i, j) for w, j in there.items() if (i := here.get(w, -1)) >= 0})


def block_ends(blocks: list[int]) -> list[int]:
    """Where each block of sentences ends."""
    return [k for k in range(1, len(blocks)) if blocks[k] != blocks[k - 1]] + [len(blocks)] * bool(blocks)


def level_pairs(source: Text, target: Text) -> list[tuple[int, int]]:
    """Sentences at the same place of blocks with equally many sentences, if the texts have equally many blocks."""
    ends, others = block_ends(source.blocks), block_ends(target.blocks)
    if len(ends) != len(others):
        return []
    found, i, j = [], 0, 0
    for a, b in zip(ends, others, strict=True):
        if a - i == b - j:
            found += zip(range(i, a), range(j, b), strict=True)
        i, j = a, b
    return found


def with_both(texts: DataFrame, source: str, target: str) -> DataFrame:
    return texts.where((F.col(source) != "") & (F.col(target) != ""))


Words = tuple[frozenset[str], frozenset[str]]


def counted(pairs: DataFrame, look: int = FIRST_LOOK, only: Words | None = None, never: Words = (frozenset(), frozenset())) -> DataFrame:
    """``e``, ``f``, ``n`` of the texts in the two columns of ``pairs``; with ``f`` or ``e`` empty the counts of single words, both empty that of sentence pairs.

    With STOPPED as ``f`` or ``e``: words whose pairs some task has stopped counting.
    ``only`` counts the pairs of some words alone, to the end, without those in ``never``.
    """
    schema = pa.schema([("e", pa.string()), ("f", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: dict[str, Counter] = {}
        left_ones: Counter = Counter()
        right_ones: Counter = Counter()
        total, next_look, size = 0, look, 0
        stop_e, stop_f = set(never[0]), set(never[1])
        stopped: set[tuple[str, str]] = set()

        def handed() -> pa.RecordBatch:
            rows = [(e, f, n) for e, held in both.items() for f, n in held.items()]
            if only is None:
                rows += [(e, "", n) for e, n in left_ones.items()] + [("", f, n) for f, n in right_ones.items()] + [("", "", total)] + [(e, f, 1) for e, f in stopped]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source, target = read(a), read(b)
                for i, j in {*anchored(source, target), *level_pairs(source, target)}:
                    left = {w for w in source.words[i] if w[0] > "9"}
                    right = {w for w in target.words[j] if w[0] > "~"}
                    if only is None:
                        left_ones.update(left)
                        right_ones.update(right)
                    total += 1
                    left -= stop_e
                    right -= stop_f
                    for e in left:
                        met = right if only is None or e in only[0] else right & only[1]
                        if not met:
                            continue
                        if (held := both.get(e)) is None:
                            held = both[e] = Counter()
                        size -= len(held)
                        held.update(met)
                        size += len(held)
            if only is None and total >= next_look:
                stop_e, stop_f = ({w for w, n in ones.items() if n > STOP_SEEN * total} for ones in (left_ones, right_ones))
                stopped |= {(w, STOPPED) for w in stop_e} | {(STOPPED, w) for w in stop_f}
                next_look = 2 * total
            if size > HELD:
                yield handed()
                both, left_ones, right_ones, total, next_look, size = {}, Counter(), Counter(), 0, look, 0
        if total:
            yield handed()

    return spread(pairs).mapInArrow(run, "e string, f string, n bigint")


class Lexicon(NamedTuple):
    """Ties of source words to target words and the other way round, with the strongest tie of every word."""

    forward: dict[str, dict[str, float]]
    backward: dict[str, dict[str, float]]
    weight_e: dict[str, float]
    weight_f: dict[str, float]


def lexicon_of(rows: list[tuple[str, str, float]]) -> Lexicon:
    forward: dict[str, dict[str, float]] = {}
    backward: dict[str, dict[str, float]] = {}
    for e, f, a in rows:
        forward.setdefault(e, {})[f] = a
        backward.setdefault(f, {})[e] = a
    return Lexicon(forward, backward, {e: max(t.values()) for e, t in forward.items()}, {f: max(t.values()) for f, t in backward.items()})


class Ties:
    """A lexicon as it reaches the rows that need it: sent to all tasks, or, if it is larger, joined to each row by its words."""

    def __init__(self, ties: DataFrame, entries: int) -> None:
        self.table, self.shared = None, None
        if ties.count() <= entries:
            self.shared = ties.sparkSession.sparkContext.broadcast(lexicon_of([tuple(r) for r in ties.select("e", "f", "a").collect()]))
        else:
            self.table = ties

    def __getstate__(self) -> dict:
        return {"shared": self.shared, "table": None}

    def joined(self, rows: DataFrame, source: str, target: str) -> DataFrame:
        """``rows``, with ``_ties`` as their last column if the lexicon is a table: what is known of the words of both texts."""
        rows = spread(rows)
        if self.table is None:
            return rows
        key = F.xxhash64(F.lit(1), source, target), F.xxhash64(F.lit(2), target, source)
        marked = rows.withColumn("_row", F.struct(*(k.alias(f"k{n}") for n, k in enumerate(key))))
        shape = pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("source", pa.bool_()), ("word", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(*k, side, w) for *k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for side, text in ((True, a), (False, b)) for w in {w for ws in read(text or "").words for w in ws}]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], type=f.type) for k, f in enumerate(shape)], schema=shape)

        words = marked.select("_row.k0", "_row.k1", source, target).mapInArrow(run, "k0 bigint, k1 bigint, source boolean, word string")
        of_e = self.table.groupBy(F.col("e").alias("word")).agg(F.max("a").alias("weight"), F.collect_list(F.struct("f", "a")).alias("ties")).withColumn("source", F.lit(True))
        of_f = self.table.groupBy(F.col("f").alias("word")).agg(F.max("a").alias("weight")).withColumns({"ties": F.array().cast("array<struct<f:string,a:double>>"), "source": F.lit(False)})
        known = words.distinct().join(of_e.unionByName(of_f), ["word", "source"]).groupBy(F.struct("k0", "k1").alias("_row")).agg(F.collect_list(F.struct("source", "word", "weight", "ties")).alias("_ties"))
        return marked.join(known, "_row", "left").select(*rows.columns, "_ties")

    def at(self, batch: pa.RecordBatch, row: int) -> Lexicon:
        """The lexicon for a row of a batch as of ``joined``."""
        if self.shared is not None:
            return self.shared.value
        entries = batch.columns[-1][row].as_py() or []
        weights = [{x["word"]: x["weight"] for x in entries if x["source"] == side} for side in (True, False)]
        here = [(x["word"], t["f"], t["a"]) for x in entries for t in x["ties"] if t["f"] in weights[1]]
        return lexicon_of(here)._replace(weight_e=weights[0], weight_f=weights[1])


def ties_of(texts: DataFrame, source: str, target: str, look: int = FIRST_LOOK) -> DataFrame:
    """``e``, ``f``, ``a``: the ties learned from all rows with both texts.

    The strength of a tie is the geometric mean of both conditional shares, damped
    where the words meet hardly more often than by chance.
    """
    pairs = with_both(texts, source, target).select(source, target)
    marks = (F.col("e") == STOPPED) | (F.col("f") == STOPPED)
    sums = written(counted(pairs, look).groupBy("e", "f").agg(F.sum("n").alias("n")).where(marks | (F.col("n") >= TIE_PAIRS)), "word-pairs")
    total = sums.where("e = '' and f = ''").agg(F.sum("n")).first()[0] or 0
    # Fewer than (words of a sentence) / STOP_SHARE words on either side can be that frequent; tasks stop for as few each.
    most = STOP_SHARE * total
    never = tuple(frozenset(r[0] for r in sums.where((F.col(other) == "") & (F.col(own) != "") & (F.col("n") > most)).select(own).collect()) for own, other in (("e", "f"), ("f", "e")))
    missed = tuple(frozenset(r[0] for r in sums.where(F.col(other) == STOPPED).select(own).collect()) - stop for (own, other), stop in zip((("e", "f"), ("f", "e")), never, strict=True))
    both = sums.where(~marks & (F.col("e") != "") & (F.col("f") != ""))
    if missed[0] or missed[1]:
        again = counted(pairs, look, missed, never).groupBy("e", "f").agg(F.sum("n").alias("n")).where(F.col("n") >= TIE_PAIRS)
        both = both.where(~F.col("e").isin(*missed[0]) & ~F.col("f").isin(*missed[1])).unionByName(again)
    ones = sums.where("f = '' and e <> ''").select("e", F.col("n").alias("ne")).where(F.col("ne") <= most)
    others = sums.where("e = '' and f <> ''").select("f", F.col("n").alias("nf")).where(F.col("nf") <= most)
    surprise = F.log(F.col("n") * float(total) / (F.col("ne") * F.col("nf")))
    tie = F.sqrt(F.col("n") / F.col("ne") * F.col("n") / F.col("nf")) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), surprise) / 2.5)
    return both.join(ones, "e").join(others, "f").withColumn("a", tie).where(F.col("a") >= TIE_STRENGTH).select("e", "f", "a")


def glossary_ties(glossary: DataFrame) -> DataFrame:
    """``e``, ``f``, ``a`` of the terms of a glossary (source_term, target_term) that are one word on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [(words_of(a), words_of(b)) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            found = [(e[0], f[0]) for e, f in terms if len(e) == len(f) == 1]
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in found], type=pa.string()), pa.array([f for _, f in found], type=pa.string())], names=["e", "f"])

    made = glossary.select("source_term", "target_term").dropna().mapInArrow(run, "e string, f string")
    return made.distinct().withColumn("a", F.lit(GLOSSARY_TIE))


def learned(texts: DataFrame, source: str, target: str, glossary: DataFrame | None = None, look: int = FIRST_LOOK, entries: int = LEXICON_ENTRIES) -> Ties:
    """The lexicon of all rows of ``texts`` with both texts; terms of ``glossary`` that it lacks are added."""
    ties = ties_of(texts, source, target, look)
    if glossary is not None:
        ties = ties.unionByName(glossary_ties(glossary)).groupBy("e", "f").agg(F.max_by("a", F.col("a") != GLOSSARY_TIE).alias("a"))
    return Ties(written(ties, "ties"), entries)
