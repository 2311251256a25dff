"""Byte-level BPE encoding with batched numpy merge rounds.

The vocabulary and merge order come from a public tokenizer file; nothing is
trained. Texts are cut into words by the tokenizer's own pattern, each distinct
word of a batch is encoded once, and all words that are not yet known are merged
together: their symbols lie in one flat array, each round looks up the rank of
every adjacent pair by binary search over the sorted pair keys, takes the lowest
rank of each word and merges its occurrences from left to right.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from folio.llm.store import spread

#: Default file; a parameter everywhere. Never copied into the repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Words kept between batches by one Python worker before the store starts afresh.
KNOWN_WORDS = 200_000
#: Characters of text encoded at once by one Python worker.
BATCH_CHARS = 2_000_000
#: The pattern of this tokenizer family (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Encodes words; holds the sorted pair table and the words met so far."""

    def __init__(self, raw: bytes) -> None:
        model = json.loads(raw)["model"]
        vocabulary, alphabet = model["vocab"], byte_alphabet()
        self.of_byte = np.zeros(256, dtype=np.int64)
        for letter, byte in alphabet.items():
            self.of_byte[byte] = vocabulary[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        keys, ranks = (left << 32) | right, np.arange(len(pairs), dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], ranks[order]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.words = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, all merged together in rounds."""
        raw = [w.encode("utf-8") for w in words]
        symbols = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(b) for b in raw])
        done_symbols, done_owner = [], []
        while symbols.size:
            keys = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
            rank = np.where((self.keys[at] == keys) & (owner[:-1] == owner[1:]), self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
            lengths = np.diff(np.r_[starts, symbols.size])
            of_symbol = np.repeat(lowest, lengths)
            ended = of_symbol == NO_RANK
            if ended.any():
                done_symbols.append(symbols[ended])
                done_owner.append(owner[ended])
                if ended.all():
                    break
            hit = np.r_[rank == of_symbol[:-1], False] & ~ended
            # In a run of overlapping hits (a a a) only every second one merges, from the left.
            run_start = hit & ~np.r_[False, hit[:-1]]
            position = np.arange(hit.size)
            first = np.maximum.accumulate(np.where(run_start, position, 0))
            hit &= ((position - first) & 1) == 0
            symbols = np.where(hit, self.merged[np.where(hit, of_symbol, 0)], symbols)
            keep = ~np.r_[False, hit[:-1]] & ~ended
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return [np.empty(0, dtype=np.int32) for _ in words]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(words))
        return np.split(symbols[order].astype(np.int32), np.cumsum(counts)[:-1])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text in them."""
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        cut = [self.words.findall(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in cut for w in words if w not in self.known))
        for first in range(0, len(new), 50_000):
            part = new[first : first + 50_000]
            self.known.update(zip(part, self.merge(part), strict=True))
        known = self.known
        found = [[known[w] for w in words] for words in cut]
        sizes = [sum(map(len, ids)) for ids in found]
        flat = [ids for text in found for ids in text]
        return (np.concatenate(flat) if flat else np.empty(0, dtype=np.int32)), np.cumsum([0, *sizes], dtype=np.int64)


def read_tokenizer(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as file:
        return file.read()


#: Encoders of this Python worker by the file they come from.
_encoders: dict[str, Encoder] = {}


def encoder(path: str, raw: Callable[[], bytes]) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(raw())
    return _encoders[path]


def shipped(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """The encoder of a tokenizer file that the driver reads; workers get its few megabytes, they need no file."""
    shared = spark.sparkContext.broadcast(read_tokenizer(path))
    return lambda: encoder(path, lambda: shared.value)


def portions(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters, one text at least."""
    first, total = 0, 0
    for k, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row.

    Empty and null texts give an empty list; text that looks like a special token
    is ordinary text; rows are neither joined nor dropped, so repeated rows give
    repeated results; other columns are left out. One pass over the scan without a shuffle (but see ``store.spread``).
    """
    source = spread(documents.select(key, text))
    own = shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = own()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in portions(texts, BATCH_CHARS):
                ids, offsets = tool.encode(texts[first:last])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, keys: list[str], text: str = "text", path: str = TOKENIZER, name: str = "tokens") -> DataFrame:
    """``keys`` and the number of tokens of every row; 0 for empty and null texts."""
    source = spread(documents.select(*keys, text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + f", `{name}` bigint"
    own = shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = own()
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            for first, last in portions(texts, BATCH_CHARS):
                sizes = pa.array(np.diff(tool.encode(texts[first:last])[1]), type=pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(len(keys))), sizes], names=[*keys, name])

    return source.mapInArrow(run, schema)
