"""Mixing sources to target shares of the total number of tokens.

The tokens of each source form one stream (its records in order of their id) that
is cut into blocks of a fixed length. The number of blocks a source contributes
follows from its target share, its size and how often a record may be used. Output
shards lie in groups that get equal parts of every source; each shard of a group
draws its source counts from a multinomial distribution conditioned on the group's
totals (a multivariate hypergeometric draw). The slots of a source run
through one pseudorandom permutation of its block numbers per repeat, and blocks
join slots by their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.store import written
from folio.llm.tokens import TOKENIZER, encode_ids

#: Tokens of a block; the last block of a source may be shorter.
BLOCK_TOKENS = 512
#: Slots (blocks) of an output shard; shards of a group, which one task draws.
SHARD_SLOTS = 4096
GROUP_SHARDS = 4096
#: Slots that one task writes out.
TASK_SLOTS = 1 << 18
#: Records that one task orders when the streams are laid out.
RECORDS_PER_BUCKET = 50_000


@dataclass(frozen=True)
class Share:
    """What one source has and what it contributes."""

    source: str
    target: float
    most: int
    tokens: int
    blocks: int
    slots: int


def source_name(column: str) -> F.Column:
    """Sources that differ only in case or outer white space are one."""
    return F.lower(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def encoded(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``source``, ``ids`` of the records whose source has a target."""
    wanted = targets.select(source_name("source").alias("source")).distinct()
    # The targets are one row per source, a table that a person writes; the join brings no text along.
    kept = documents.select("doc_id", "text", source_name("source").alias("source")).join(F.broadcast(wanted), "source", "left_semi")
    keyed = kept.select(F.struct("doc_id", "source").alias("k"), "text")
    return encode_ids(keyed, "k", "text", path).select("k.doc_id", "k.source", "ids").where(F.size("ids") > 0)


def laid_out(sizes: DataFrame, records: int) -> DataFrame:
    """``sizes`` (doc_id, source, tokens) with ``start``, the place in the source's stream.

    A prefix sum in two levels, so that a source that holds a third of all records
    is ordered by many tasks: records are hashed into buckets, summed inside their
    bucket, and moved by the sum of the buckets before.
    """
    buckets = max(1, -(-records // RECORDS_PER_BUCKET))
    cut = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    inside = W.partitionBy("source", "bucket").orderBy("doc_id", "tokens").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (
        cut.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(offsets, ["source", "bucket"])
        .select("doc_id", "source", "tokens", (F.col("base") + F.col("inner")).alias("start"))
    )


def allocate(sources: list[tuple[str, float, int, int]], total: int | None = None, block: int = BLOCK_TOKENS) -> list[Share]:
    """Slots of each source for a mix of ``total`` tokens (default: what the sources hold once).

    ``sources``: name, target share, most repeats, tokens. A source that cannot
    reach its share within its repeats contributes all of them; what it lacks is
    spread over the others in proportion to their targets, again and again until
    nothing is lacking or everything is used up.
    """
    total = sum(n for *_, n in sources) if total is None else total
    cap = {s: most * n for s, _, most, n in sources}
    given = {s: 0.0 for s, *_ in sources}
    open_ = {s: w for s, w, _, n in sources if w > 0 and cap[s] > 0}
    rest = float(total)
    while open_ and rest > 0.5:
        weight = sum(open_.values())
        full = {s for s, w in open_.items() if given[s] + rest * w / weight >= cap[s]}
        if not full:
            given |= {s: given[s] + rest * w / weight for s, w in open_.items()}
            break
        for s in full:
            rest -= cap[s] - given[s]
            given[s] = float(cap[s])
            del open_[s]
    result = []
    for s, w, most, n in sources:
        blocks = -(-n // block)
        slots = min(round(given[s] * blocks / n), most * blocks) if n else 0
        result.append(Share(s, w, most, n, blocks, slots))
    return result


def groups(shares: list[Share], seed: int, most: int = GROUP_SHARDS * SHARD_SLOTS) -> list[tuple[int, int, list[int], list[int]]]:
    """Rows (group, first shard, slots of each source, slots of each source before): equal parts of every source, what does not divide at random."""
    total = sum(s.slots for s in shares)
    count = max(1, -(-total // most))
    generator = np.random.default_rng(seed)
    parts = np.zeros((count, len(shares)), dtype=np.int64)
    for k, s in enumerate(shares):
        parts[:, k] = s.slots // count
        parts[generator.permutation(count)[: s.slots % count], k] += 1
    used = np.cumsum(parts, axis=0) - parts
    shards = [max(1, -(-int(n) // SHARD_SLOTS)) for n in parts.sum(axis=1)]
    return list(zip(range(count), np.cumsum([0, *shards[:-1]]).tolist(), parts.tolist(), used.tolist(), strict=True))


def shards_of(group: int, first_shard: int, counts: list[int], used: list[int], seed: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Rows (shard, source number, slots, first slot of the source, first place in the shard) of one group."""
    left, used = np.array(counts, dtype=np.int64), np.array(used, dtype=np.int64)
    count = max(1, -(-int(left.sum()) // SHARD_SLOTS))
    generator = np.random.default_rng([seed, group])
    for shard in range(count):
        size = int(left.sum()) // (count - shard)
        drawn = generator.multivariate_hypergeometric(left, size, method="marginals") if size else np.zeros_like(left)
        place = 0
        for k, n in enumerate(drawn.tolist()):
            if n:
                yield first_shard + shard, k, n, int(used[k]), place
                place += n
        used += drawn
        left = left - drawn


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of 0 … size-1.

    A four-round Feistel network over the next even number of bits; values beyond
    ``size`` walk on along their cycle until they fall inside.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 62, size=4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (outside := out >= size).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def slots(spark, shares: list[Share], seed: int) -> DataFrame:
    """``shard``, ``slot``, ``source``, ``epoch``, ``block`` of every slot of the mix."""
    names, sizes = [s.source for s in shares], [s.blocks for s in shares]
    drawn_of = groups(shares, seed) if shares else []
    total = sum(s.slots for s in shares)
    schema = pa.schema([("shard", pa.int64()), ("k", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("place", pa.int64())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, first_shard, counts, used in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(shards_of(group, first_shard, counts, used, seed))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)

    plan = spark.createDataFrame(drawn_of, "group_no bigint, first_shard bigint, counts array<bigint>, used array<bigint>").repartition(max(1, len(drawn_of)))
    plan = plan.mapInArrow(draw, "shard bigint, k int, n bigint, first bigint, place bigint").repartition(max(1, -(-total // TASK_SLOTS)), "shard", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, k, n, first, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low in range(0, n, 100_000):
                    number = np.arange(first + low, first + min(n, low + 100_000), dtype=np.int64)
                    epoch, inner = number // sizes[k], number % sizes[k]
                    block = np.empty_like(inner)
                    for e in np.unique(epoch):
                        at = epoch == e
                        block[at] = permuted(inner[at], sizes[k], seed * 1_000_003 + k * 1009 + int(e))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(number.size, shard, dtype=np.int64)), pa.array(np.arange(place + low, place + low + number.size)), pa.array([names[k]] * number.size, type=pa.string()), pa.array(epoch.astype(np.int32)), pa.array(block)],
                        names=["shard", "slot", "source", "epoch", "block"],
                    )

    made = plan.mapInArrow(run, "shard bigint, slot bigint, source string, epoch int, block bigint")
    # Inside a shard the sources come in runs; readers take slots in the order of ``place``.
    return made.withColumn("place", F.xxhash64(F.lit(seed), "shard", "slot"))


class Mix:
    """All stages of one mix over ``documents`` and ``targets``."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, path: str = TOKENIZER) -> None:
        self.seed = seed
        goal = targets.groupBy(source_name("source").alias("source")).agg(F.sum("target_share").alias("target"), F.min("max_repeats").alias("most")).where("source is not null")
        self.ids = written(encoded(documents, targets, path), "encoded")
        sizes = self.ids.select("doc_id", "source", F.size("ids").cast("bigint").alias("tokens"))
        held = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))
        # One row per source of the target table, whatever the number of records.
        rows = goal.join(held, "source", "left").fillna(0, ["tokens", "records"]).orderBy("source").collect()
        self.shares = allocate([(r["source"], float(r["target"] or 0), int(r["most"] or 0), int(r["tokens"])) for r in rows], total)
        self.starts = laid_out(sizes, sum(r["records"] for r in rows))

    def slots(self) -> DataFrame:
        return slots(self.ids.sparkSession, self.shares, self.seed)

    def pieces(self) -> DataFrame:
        """Which part of which record lies in which block: ``doc_id``, ``source``, ``block``, ``start``, ``first``, ``length``."""
        end = F.col("start") + F.col("tokens")
        cut = self.starts.withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK_TOKENS}"), F.expr(f"(start + tokens - 1) div {BLOCK_TOKENS}"))))
        low = F.greatest("start", F.col("block") * BLOCK_TOKENS)
        high = F.least(end, (F.col("block") + 1) * BLOCK_TOKENS)
        return cut.select("doc_id", "source", "block", low.alias("at"), (low - F.col("start")).alias("first"), (high - low).alias("length"))

    def blocks(self) -> DataFrame:
        """``source``, ``block``, ``ids`` of every block; a block gathers at most BLOCK_TOKENS tokens."""
        place = self.starts.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), "start")
        whole = self.ids.join(place, (F.col("doc_id") == F.col("d")) & (F.col("source") == F.col("s"))).select("source", "ids", "start", F.size("ids").alias("tokens"))
        cut = whole.withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK_TOKENS}"), F.expr(f"(start + tokens - 1) div {BLOCK_TOKENS}"))))
        low = F.greatest("start", F.col("block") * BLOCK_TOKENS)
        high = F.least(F.col("start") + F.col("tokens"), (F.col("block") + 1) * BLOCK_TOKENS)
        part = cut.select("source", "block", low.alias("at"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("ids"))
        gathered = part.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        return gathered.select("source", "block", F.flatten(F.col("parts.ids")).alias("ids"))

    def mixed(self) -> DataFrame:
        """The mix: ``shard``, ``place``, ``source``, ``epoch``, ``block``, ``ids``."""
        return self.slots().join(self.blocks(), ["source", "block"]).select("shard", "place", "source", "epoch", "block", "ids")

    def used(self) -> DataFrame:
        """``source``, ``block``, ``times``: how often each block is used."""
        return self.slots().groupBy("source", "block").agg(F.count("*").alias("times"))

    def repeats(self) -> DataFrame:
        """Per record: ``tokens``, ``repeats`` (most uses of any of its tokens), ``used_tokens``."""
        joined = self.pieces().join(self.used(), ["source", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
        return joined.groupBy("doc_id", "source").agg(F.sum("length").alias("tokens"), F.max("times").alias("repeats"), F.sum(F.col("length") * F.col("times")).alias("used_tokens"))

    def report(self) -> DataFrame:
        """Per source of the targets: what it holds, its target and the share it really got.

        A source without tokens gets 0; an empty mix gives null shares.
        """
        spark = self.ids.sparkSession
        rows = [(s.source, s.target, s.most, s.tokens) for s in self.shares]
        goal = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens bigint")
        got = self.repeats().groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"), F.max("repeats").alias("repeats"), F.count("*").alias("records"))
        joined = goal.join(got, "source", "left").fillna(0, ["used_tokens", "repeats", "records"])
        total = F.sum("used_tokens").over(W.partitionBy())
        return joined.withColumn("actual_share", F.col("used_tokens") / F.nullif(total, F.lit(0))).select("source", "target_share", "actual_share", "max_repeats", "repeats", "records", "tokens", "used_tokens")
