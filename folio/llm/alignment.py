"""Alignment of the sentences of rough translations.

Sentence pairs that share numbers, names or tied words (``bitext``) are candidates:
those at the same place of their blocks, those that share a number or name found
once on either side, and, between these, those that choose each other. What is
likely enough among them is an anchor. The best chain of anchors that rises on both
sides (a weighted longest increasing subsequence) is the backbone; its gaps are
aligned by dynamic programming over beads of 1-1, 1-2, 2-1, 1-0 and 0-1 sentences.
Anchors off the backbone were moved and stay; what is left is linked where it
explains words that no other sentence has explained (joined and split sentences).

Scores are looked up through inverted lists of the words of a page, for candidates
and for the pairs of a gap that share something; other pairs cost nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Container, Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm import bitext
from folio.llm.bitext import Lexicon, Text

#: Weight of a shared number or name; words have at most 1, words without a tie hardly any.
ANCHOR_WEIGHT, UNTIED = 1.5, 0.05
#: Least likeness of anchors, of anchors off the backbone, and of pairs found in gaps.
ANCHOR_LIKE, MOVED_LIKE, GAP_LIKE = 0.5, 0.6, 0.4
#: What a bead of two sentences on one side counts for, and what it costs.
BEAD_WORTH, BEAD_COST = 1.2, 0.05
#: Share of a free sentence's weight that must be explained for a further link, the same without a word of its own, and the weight of such a word.
REST_SHARE, NEAR_SHARE, OWN_WORD = 0.45, 0.6, 0.5
#: Tie from which a word counts as explained.
EXPLAINED = 0.3
#: Share of both sentences' weight that must match for a pair at the same place to be an anchor without comparison, and the weight that may be lacking: less than one tied word.
PLAIN_SHARE, PLAIN_LACK = 0.8, 0.35
#: Likeness below which a free sentence is not looked at.
REST_LIKE = 0.25
#: Preference for pairs at like places of both texts.
PLACE_BONUS = 0.03

Pair = tuple[int, int]
NOTHING: dict[str, float] = {}


class Side:
    """The sentences of one text as words that can match, with their weights."""

    def __init__(self, words: list[list[str]], weights: dict[str, float], ties: dict[str, dict[str, float]], shared: Callable[[str], bool], both: Container[str] = ()) -> None:
        self.ties, self.weights = ties, weights
        self.words: list[dict[str, float]] = []
        self.size: list[float] = []
        self.places: dict[str, list[int]] | None = None
        for ws in words:
            own, held = set(ws), {}
            for w in own:
                if w in both or w not in weights and shared(w):
                    held[w] = ANCHOR_WEIGHT
                elif w in weights:
                    held[w] = weights[w]
            self.words.append(held)
            self.size.append(max(sum(held.values()) + UNTIED * (len(own) - len(held)), 1e-6))

    @property
    def at(self) -> dict[str, list[int]]:
        """The inverted list: where each word stands."""
        if self.places is None:
            self.places = {}
            for k, held in enumerate(self.words):
                for w in held:
                    if w in self.places:
                        self.places[w].append(k)
                    else:
                        self.places[w] = [k]
        return self.places

    def within(self, word: str, low: int, high: int) -> list[int]:
        """Sentences from ``low`` to before ``high`` that hold a word."""
        found = self.at.get(word, ())
        return found if low == 0 and high >= len(self.words) else found[bisect_left(found, low) : bisect_left(found, high)]


class Page:
    """Likeness of the sentences of two texts, over the words of this page only."""

    def __init__(self, source: Text, target: Text, lexicon: Lexicon) -> None:
        latin = {w for ws in target.words for w in ws if w < "{"}
        self.both = {w for ws in source.words for w in ws if w in latin and (len(w) > 1 or w > "9")} if latin else set()
        # A source word that stands on both sides weighs as an anchor, whatever its ties.
        self.s = Side(source.words, lexicon.weight_e, lexicon.forward, lambda w: w < ":" and len(w) > 1, self.both)
        self.t = Side(target.words, lexicon.weight_f, lexicon.backward, lambda w: w < "{" and (w > "9" or len(w) > 1))
        self.n, self.m = len(source.words), len(target.words)
        self.known: dict[tuple[int, bool], dict[int, float]] = {}

    def place(self, i: int, j: int) -> float:
        return PLACE_BONUS * (1 - abs((i + 0.5) / self.n - (j + 0.5) / self.m))

    def matches(self, es: Iterable[str], fs: Container[str]) -> tuple[dict[str, float], dict[str, float]]:
        """How firmly each of the words on one side is expected by some word of the other."""
        by_e: dict[str, float] = {}
        by_f: dict[str, float] = {}
        forward, both = self.s.ties, self.both
        for e in es:
            if e in forward:
                top = 0.0
                for f, a in forward[e].items():
                    if f in fs:
                        if a > top:
                            top = a
                        if f not in by_f or a > by_f[f]:
                            by_f[f] = a
                if top:
                    by_e[e] = top
            if e in both and e in fs:
                by_e[e] = by_f[e] = ANCHOR_WEIGHT
        return by_e, by_f

    def like(self, i: int, j: int) -> float:
        """Likeness of a pair; 0 where nothing is shared."""
        by_e, by_f = self.matches(self.s.words[i], self.t.words[j])
        return self.likeness(i, j, by_e, by_f) if by_f else 0.0

    def likeness(self, i: int, j: int, by_e: dict[str, float], by_f: dict[str, float]) -> float:
        return (min(1.0, sum(by_f.values()) / self.t.size[j]) + min(1.0, sum(by_e.values()) / self.s.size[i])) / 2 + self.place(i, j)

    def cover(self, i: list[int], j: list[int]) -> float:
        """Likeness of several sentences taken together."""
        es, fs = {w for a in i for w in self.s.words[a]}, {w for b in j for w in self.t.words[b]}
        by_e, by_f = self.matches(es, fs)
        got = sum(min(weight, by_f.get(f, 0.0)) for b in j for f, weight in self.t.words[b].items())
        held = sum(min(weight, by_e.get(e, 0.0)) for a in i for e, weight in self.s.words[a].items())
        return (got / sum(self.t.size[b] for b in j) + held / sum(self.s.size[a] for a in i)) / 2

    def all_likes(self, k: int, of_source: bool) -> dict[int, float]:
        """Likeness of one sentence to all of the other side that share something with it."""
        found = self.known.get((k, of_source))
        if found is None:
            found = self.known[k, of_source] = self.likes(k, of_source, 0, self.m if of_source else self.n)
        return found

    def likes(self, k: int, of_source: bool, low: int, high: int) -> dict[int, float]:
        """Likeness of one sentence to those from ``low`` to before ``high`` of the other side that share something with it."""
        side, other = (self.s, self.t) if of_source else (self.t, self.s)
        places, whole = other.at, low == 0 and high >= len(other.words)
        there: dict[int, float] = {}
        back: dict[int, float] = {}
        firm: dict[str, float] = {}
        for w in side.words[k]:
            tied = side.ties.get(w, NOTHING)
            if w in self.both:
                tied = {**tied, w: ANCHOR_WEIGHT}
            best: dict[int, float] = {}
            for o, a in tied.items():
                if o not in places:
                    continue
                if o not in firm or a > firm[o]:
                    firm[o] = a
                for x in places[o] if whole else other.within(o, low, high):
                    if x not in best or a > best[x]:
                        best[x] = a
            for x, a in best.items():
                there[x] = there[x] + a if x in there else a
        for o, a in firm.items():
            for x in places[o] if whole else other.within(o, low, high):
                back[x] = back[x] + a if x in back else a
        own, sizes, n, m = side.size[k], other.size, self.n, self.m
        if of_source:
            return {x: (min(1.0, a / own) + min(1.0, back[x] / sizes[x])) / 2 + PLACE_BONUS * (1 - abs((k + 0.5) / n - (x + 0.5) / m)) for x, a in there.items()}
        return {x: (min(1.0, a / own) + min(1.0, back[x] / sizes[x])) / 2 + PLACE_BONUS * (1 - abs((x + 0.5) / n - (k + 0.5) / m)) for x, a in there.items()}

    def plain(self, i: int, j: int) -> float:
        """Likeness of two sentences that match in full, else 0."""
        by_e, by_f = self.matches(self.s.words[i], self.t.words[j])
        for side, k, got in ((self.s, i, by_e), (self.t, j, by_f)):
            of, words = side.size[k], side.words[k]
            if sum([words[w] for w in got]) < max(PLAIN_SHARE * of, of - PLAIN_LACK):
                return 0.0
        return self.likeness(i, j, by_e, by_f)


def best_chain(pairs: list[tuple[int, int, float]]) -> list[Pair]:
    """The heaviest chain of pairs that rises on both sides; ``pairs`` have distinct numbers on each side."""
    pairs = sorted(pairs)
    if all(a[1] < b[1] for a, b in pairwise(pairs)):
        return [p[:2] for p in pairs]
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(pairs) + 1)
    ranks = sorted({j for _, j, _ in pairs})
    came = [-1] * len(pairs)
    for k, (_, j, weight) in enumerate(pairs):
        at = rank = bisect_left(ranks, j)
        best = (0.0, -1)
        while at > 0:
            best = max(best, tree[at])
            at -= at & -at
        came[k] = best[1]
        value, at = (best[0] + weight, k), rank + 1
        while at <= len(pairs):
            tree[at] = max(tree[at], value)
            at += at & -at
    at, best = len(pairs), (0.0, -1)
    while at > 0:
        best = max(best, tree[at])
        at -= at & -at
    chain, k = [], best[1]
    while k >= 0:
        chain.append(pairs[k][:2])
        k = came[k]
    return chain[::-1]


def level_pairs(page: Page, source: Text, target: Text) -> dict[Pair, float]:
    """Pairs that match in full at the same place from the begin or the end of their block (of the text, if the blocks differ in number)."""
    ends_s, ends_t = bitext.block_ends(source.blocks), bitext.block_ends(target.blocks)
    if len(ends_s) != len(ends_t):
        ends_s, ends_t = [page.n], [page.m]
    found: dict[Pair, float] = {}
    i = j = 0
    for a, b in zip(ends_s, ends_t, strict=True):
        if a - i == b - j:
            for x, y in zip(range(i, a), range(j, b), strict=True):
                if v := page.plain(x, y):
                    found[x, y] = v
        else:
            x, y, stop_x, stop_y = i, j, a, b
            while x < a and y < b and (v := page.plain(x, y)):
                found[x, y] = v
                x, y = x + 1, y + 1
            while stop_x > x and stop_y > y and (v := page.plain(stop_x - 1, stop_y - 1)):
                stop_x, stop_y = stop_x - 1, stop_y - 1
                found[stop_x, stop_y] = v
        i, j = a, b
    return found


def mutual(found: dict[Pair, float], least: float) -> list[tuple[int, int, float]]:
    """Pairs that are the best of both their sentences and likely enough."""
    best_s: dict[int, tuple[float, int]] = {}
    best_t: dict[int, tuple[float, int]] = {}
    for (i, j), v in found.items():
        # Of equal ones the first.
        if (v, -j) > best_s.get(i, (0.0, 0)):
            best_s[i] = (v, -j)
        if (v, -i) > best_t.get(j, (0.0, 0)):
            best_t[j] = (v, -i)
    return [(i, -j, v) for i, (v, j) in best_s.items() if v >= least and best_t[-j] == (v, -i)]


def anchors_of(page: Page, source: Text, target: Text) -> list[tuple[int, int, float]]:
    """Anchors of a whole text: pairs that match in full at the same place, and pairs around a number or name found once on either side."""
    plain = level_pairs(page, source, target)
    free_s, free_t = {i for i, _ in plain}, {j for _, j in plain}
    if len(free_s) == page.n or len(free_t) == page.m:
        return [(i, j, v) for (i, j), v in plain.items()]
    others = {(i, j): page.like(i, j) for i, j in bitext.anchored(source, target) if i not in free_s and j not in free_t}
    return [(i, j, v) for (i, j), v in plain.items()] + mutual(others, ANCHOR_LIKE)


def gap_likes(page: Page, rows: list[int], columns: list[int]) -> dict[Pair, float]:
    """Likeness of the pairs of a gap that share something."""
    if len(rows) * len(columns) <= 16:
        return {(i, j): v for i in rows for j in columns if (v := page.like(i, j))}
    inside = set(rows)
    low, high = rows[0], rows[-1] + 1
    return {(i, j): v for j in columns for i, v in page.likes(j, False, low, high).items() if i in inside}


def fill_gap(page: Page, rows: list[int], columns: list[int], found: dict[Pair, float]) -> list[Pair]:
    """Pairs of a gap by dynamic programming over beads.

    Skipped sentences cost nothing, so the best path is the heaviest rising chain
    of the beads that gain something; all others may be left out.
    """
    x_of, y_of = {i: x for x, i in enumerate(rows)}, {j: y for y, j in enumerate(columns)}
    beads: list[tuple[int, int, int, int, float]] = []
    seen: set[tuple[int, int, int, int]] = set()
    for (i, j), v in found.items():
        x, y = x_of[i], y_of[j]
        if v > GAP_LIKE:
            beads.append((x, y, x, y, v - GAP_LIKE))
        for a, b, c, d in ((x, y - 1, x, y), (x, y, x, y + 1), (x - 1, y, x, y), (x, y, x + 1, y)):
            if a < 0 or b < 0 or c >= len(rows) or d >= len(columns) or (a, b, c, d) in seen:
                continue
            seen.add((a, b, c, d))
            # Two sentences cover no more than each of them does.
            if found.get((rows[a], columns[b]), 0.0) + found.get((rows[c], columns[d]), 0.0) > GAP_LIKE:
                gain = BEAD_WORTH * (page.cover(rows[a : c + 1], columns[b : d + 1]) - GAP_LIKE) - BEAD_COST
                if gain > 0:
                    beads.append((a, b, c, d, gain))
    if not beads:
        return []
    # Beads in order of their begin; a bead may follow those that have ended before it on both sides.
    beads.sort()
    by_end = sorted(range(len(beads)), key=lambda k: beads[k][2])
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(columns) + 1)
    value, came, done = [0.0] * len(beads), [-1] * len(beads), 0
    for k, (a, b, _, _, gain) in enumerate(beads):
        while done < len(by_end) and beads[by_end[done]][2] < a:
            q = by_end[done]
            at, entry = beads[q][3] + 1, (value[q], q)
            while at <= len(columns):
                tree[at] = max(tree[at], entry)
                at += at & -at
            done += 1
        at, best = b, (0.0, -1)
        while at > 0:
            best = max(best, tree[at])
            at -= at & -at
        value[k], came[k] = best[0] + gain, best[1]
    links, k = [], max(range(len(beads)), key=lambda k: value[k])
    while k >= 0:
        a, b, c, d, _ = beads[k]
        links += [(rows[x], columns[y]) for x in range(a, c + 1) for y in range(b, d + 1)]
        k = came[k]
    return links


def gaps(chain: list[Pair], n: int, m: int, taken: set[Pair]) -> Iterator[tuple[list[int], list[int]]]:
    """Free sentences between the neighbours of a chain."""
    taken_s, taken_t = {i for i, _ in taken}, {j for _, j in taken}
    i = j = 0
    for a, b in [*chain, (n, m)]:
        rows, columns = [x for x in range(i, a) if x not in taken_s], [y for y in range(j, b) if y not in taken_t]
        if rows and columns:
            yield rows, columns
        i, j = a + 1, b + 1


def aligned(source: Text, target: Text, lexicon: Lexicon) -> list[Pair]:
    """Pairs of corresponding sentences of two texts."""
    if not source.sentences or not target.sentences:
        return []
    page = Page(source, target, lexicon)
    found = anchors_of(page, source, target)
    # Between the anchors of the whole text, pairs that choose each other are anchors too.
    first = best_chain(found)
    count = len(found)
    for rows, columns in gaps(first, page.n, page.m, {(i, j) for i, j, _ in found}):
        found += mutual(gap_likes(page, rows, columns), ANCHOR_LIKE)
    chain = best_chain(found) if len(found) > count else first
    links = set(chain)
    # Plain pairs are sure off the chain as well.
    moved = {(i, j) for i, j, v in found if v >= MOVED_LIKE} - links
    moved |= moved_pairs(page, links | moved)
    for rows, columns in gaps(chain, page.n, page.m, links | moved):
        links.update(fill_gap(page, rows, columns, gap_likes(page, rows, columns)))
    return sorted(rest(page, links | moved))


def moved_pairs(page: Page, links: set[Pair]) -> set[Pair]:
    """Sentences without a link that choose each other across the whole text."""
    free_s, free_t = set(range(page.n)) - {i for i, _ in links}, set(range(page.m)) - {j for _, j in links}
    if not free_s or not free_t:
        return set()
    found = {(i, j): v for j in free_t for i, v in page.all_likes(j, False).items() if i in free_s}
    return {(i, j) for i, j, _ in mutual(found, MOVED_LIKE)}


def rest(page: Page, links: set[Pair]) -> set[Pair]:
    """Add links that explain what is not yet explained: halves of split sentences, parts of joined ones, moved sentences."""
    by_s: dict[int, set[int]] = {}
    by_t: dict[int, set[int]] = {}
    for i, j in links:
        by_s.setdefault(i, set()).add(j)
        by_t.setdefault(j, set()).add(i)
    candidates = [(v, i, j) for j in range(page.m) if j not in by_t for i, v in page.all_likes(j, False).items() if v >= REST_LIKE]
    candidates += [(v, i, j) for i in range(page.n) if i not in by_s for j, v in page.all_likes(i, True).items() if v >= REST_LIKE and j in by_t]
    for like, i, j in sorted(candidates, reverse=True):
        if i in by_s and j in by_t:
            continue
        es, fs = page.s.words[i], page.t.words[j]
        by_e, by_f = page.matches(es, fs)
        if i in by_s:
            known = page.matches(es, {w for b in by_s[i] for w in page.t.words[b]})[0]
            by_e = {e: a for e, a in by_e.items() if known.get(e, 0.0) < EXPLAINED}
        if j in by_t:
            known = page.matches({w for a in by_t[j] for w in page.s.words[a]}, fs)[1]
            by_f = {f: a for f, a in by_f.items() if known.get(f, 0.0) < EXPLAINED}
        got_t, got_s = sum(min(fs[f], a) for f, a in by_f.items()), sum(min(es[e], a) for e, a in by_e.items())
        # The free sentence must be explained, by a word that nothing else explains or by the neighbour of what is linked already.
        free_t, free_s = j not in by_t, i not in by_s
        if free_t and free_s:
            good = like >= ANCHOR_LIKE
        elif free_t:
            near = any(abs(j - other) == 1 for other in by_s[i])
            good = got_t >= REST_SHARE * page.t.size[j] and got_s >= OWN_WORD or near and got_t >= NEAR_SHARE * page.t.size[j]
        else:
            near = any(abs(i - other) == 1 for other in by_t[j])
            good = got_s >= REST_SHARE * page.s.size[i] and got_t >= OWN_WORD or near and got_s >= NEAR_SHARE * page.s.size[i]
        if good:
            links.add((i, j))
            by_s.setdefault(i, set()).add(j)
            by_t.setdefault(j, set()).add(i)
    return links


def align(pages: DataFrame, ties: bitext.Ties, key: str = "id", source: str = "source_text", target: str = "approved_text") -> DataFrame:
    """``page_id``, ``source_sentence``, ``target_sentence`` (from 0) of rows with both texts.

    Null and empty texts give nothing; rows repeated verbatim count once; other
    columns are left out. One pass over the scan; only the pairs are shuffled, to
    drop the pairs of repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, left, right = [], [], []
            for k, (page, a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                found = aligned(bitext.read(a), bitext.read(b), ties.at(batch, k))
                keys += [page] * len(found)
                left += [i for i, _ in found]
                right += [j for _, j in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string()), pa.array(left, type=pa.int32()), pa.array(right, type=pa.int32())], names=["page_id", "source_sentence", "target_sentence"])

    cases = ties.joined(bitext.with_both(pages, source, target).select(key, source, target), source, target)
    return cases.mapInArrow(run, "page_id string, source_sentence int, target_sentence int").distinct()


def sentence_pairs(pages: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Pairs of corresponding sentences of every page with an approved text."""
    return align(pages, bitext.learned(pages, "source_text", "approved_text", glossary))
