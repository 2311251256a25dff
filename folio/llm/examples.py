"""Labelled documents from which the rule list is fitted.

Each line of a document is labelled by what it is made of; a document whose
characters lie almost wholly in lines of one kind gets that label. Whether its
letters are a language at all is told by a trigram model of the documents
themselves, which no statistic of the rules knows. Documents of
two kinds are made by joining unanimous ones in known proportions and get the
label of the larger part, so that the thresholds lie where most of the text
changes kind and not somewhere between the extremes.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable

SENTENCE_END = re.compile(r"[.!?؟…][\"'”’»)\]*_`]*$")
MARK = re.compile(r"^(?:[-*+•◦▪‣·–—]|\[[ xX]\]|[(\[]?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,5})[.)\]]|\d{1,3}(?:\.\d{1,3})+\.?)\s+")
LEADER = re.compile(r"(?:\.{4,}|…{2,}|(?:\. ){3,})\s*\d*$")
INDEX = re.compile(r"^[^,]{1,60}(?:, ?\d+(?:[–-]\d+)?)+$")
REFERENCE = re.compile(r"^\[\d+\] ")
LINK = re.compile(r"^(?:[-*+•] +)?\[[^\]]*\]\([^)]*\)$")
HEX = re.compile(r"^(?:[0-9a-f]{6,8}:?\s+)?(?:[0-9a-f]{2}\s+){6,}[0-9a-f]{2}", re.I)
BROKEN = re.compile("[�─-▟\u0080-\u009f]")


def line_kind(line: str) -> str:
    s = line.strip()
    solid = re.sub(r"\s", "", s)
    letters = sum(c.isalpha() for c in s)
    if HEX.match(s) or len(BROKEN.findall(s)) > 0.08 * len(solid):
        return "junk"
    if LEADER.search(s) or INDEX.match(s) or REFERENCE.match(s) or LINK.match(s):
        return "list"
    if re.fullmatch(r"[-+=|: ]{3,}", s) and "-" in s:
        return "table"
    symbols = sum(not c.isalnum() and not c.isspace() and c != "‌" for c in s)
    barred = len(re.findall(r"(?:^|\s)\|(?=\s|$)", s))
    if barred >= 2 or s.count("\t") >= 2:
        return "table"
    for mark in ",;":
        cells = s.split(mark)
        if len(cells) >= 3 and mark + " " not in s and max(map(len, cells)) < 40 and symbols < 0.4 * len(solid):
            return "table"
    if len(re.findall(r"\S {3,}(?=\S)", s)) >= 2:
        return "table"
    if symbols > 0.3 * len(solid) or (len(solid) > 30 and max(map(len, s.split())) > 40 and "://" not in s) or letters < 0.3 * len(solid):
        return "junk"
    words = s.split()
    if MARK.match(s):
        return "prose" if SENTENCE_END.search(s) and len(words) > 5 else "list"
    if re.match(r"^[^:.!?]{1,40}: \S[^.!?؟]{0,60}$", s) and len(words) <= 9:
        return "list"
    if len(words) <= 4 and not SENTENCE_END.search(s):
        return "short"
    return "prose"


def shares(text: str) -> Counter:
    """Characters by kind; short lines without an end mark are entries if most lines are like them, else they belong to their surroundings."""
    lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()]
    kinds = [line_kind(x) for x in lines]
    found: Counter = Counter()
    for line, kind in zip(lines, kinds, strict=True):
        found[kind] += len(line.strip())
    others = found["prose"] + found["table"] + found["junk"]
    if found["short"]:
        found["list" if len(lines) > 3 and found["short"] + found["list"] > others else "prose" if found["prose"] or len(lines) <= 3 else "list"] += found["short"]
        del found["short"]
    return found


def odd_words(text: str) -> bool:
    """Readable characters without a readable text: one word over and over, or hardly any distinct words."""
    words = text.split()
    return len(words) >= 20 and len(set(words)) < 0.12 * len(words)


def unanimous(text: str) -> str | None:
    found = shares(text)
    total = sum(found.values())
    if not total:
        return None
    if odd_words(text):
        return "junk"
    kind, held = found.most_common(1)[0]
    return kind if held >= 0.9 * total else None


def labelled(texts: list[str], seed: int = 11, unreadable: Callable[[str], bool] = lambda _: False) -> tuple[list[str], list[str]]:
    """Texts and labels: the unanimous ones of ``texts`` and joins of prose with the other kinds. Prose that is ``unreadable`` is junk."""
    by: dict[str, list[str]] = {"prose": [], "list": [], "table": [], "junk": []}
    for t in texts:
        if (kind := unanimous(t)) == "prose" and unreadable(t):
            kind = "junk"
        if kind is not None:
            by[kind].append(t)
    out = [(t, kind) for kind, held in by.items() for t in held]
    chance = random.Random(seed)
    for kind in ("list", "table"):
        for other in by[kind]:
            if not by["prose"]:
                break
            prose = chance.choice(by["prose"])
            lines = [x for x in other.split("\n") if x.strip()][: chance.randint(2, 20)]
            part = "\n".join(lines)
            text = "\n\n".join((prose, part) if chance.random() < 0.5 else (part, prose))
            share = len(part) / max(1, len(part) + len(prose))
            if abs(share - 0.5) > 0.08:
                out.append((text, kind if share > 0.5 else "prose"))
    # Prose without its usual marks: a single sentence, one without its end mark, and capitals.
    for prose in by["prose"]:
        sentence = re.split(r"(?<=[.!?؟])\s", prose.strip())[-1]
        out.append((chance.choice((sentence, sentence.rstrip(".!?؟"), " ".join(sentence.split()[:6]), prose.upper())), "prose"))
    return [t for t, _ in out], [k for _, k in out]
