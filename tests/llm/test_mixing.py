"""Shares, repeats and permutations of mixes."""

import numpy as np
import pytest

from folio.llm import mixing


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(size):
    image = mixing.permuted(np.arange(size), size, 5)
    assert sorted(image.tolist()) == list(range(size))
    if size > 60:
        assert (image != np.arange(size)).mean() > 0.9


def test_allocation_reaches_targets_or_caps():
    shares = {s.source: s for s in mixing.allocate([("a", 0.5, 1, 512_000), ("b", 0.3, 2, 512_000), ("c", 0.2, 4, 5_120), ("d", 0.0, 9, 512_000), ("e", 0.1, 3, 0)], total=512_000)}
    assert shares["c"].slots == 4 * shares["c"].blocks and shares["d"].slots == 0 and shares["e"].slots == 0
    assert abs(shares["a"].slots / shares["b"].slots - 5 / 3) < 0.01
    assert all(s.slots <= s.most * s.blocks for s in shares.values())
    assert mixing.allocate([]) == []


def test_draw_is_exact():
    shares = mixing.allocate([("a", 0.7, 1, 5_000_000), ("b", 0.3, 2, 2_000_000)])
    for most in (10**9, 5000, 700):
        groups = mixing.groups(shares, 3, most)
        rows = [r for g in groups for r in mixing.shards_of(*g, 3)]
        assert len(groups) == max(1, -(-sum(s.slots for s in shares) // most))
        assert [*dict.fromkeys(r[0] for r in rows)] == list(range(rows[-1][0] + 1))
        for k, s in enumerate(shares):
            own = [r for r in rows if r[1] == k]
            assert sum(r[2] for r in own) == s.slots
            assert [r[3] for r in own] == np.cumsum([0, *(r[2] for r in own)])[:-1].tolist()


def test_many_slots():
    """More slots than one draw can take, and more shards than one group has."""
    shares = mixing.allocate([("a", 0.7, 1, 3 * 10**12), ("b", 0.3, 2, 10**12)])
    groups = mixing.groups(shares, 3)
    assert len(groups) > 400 and [sum(g[2][k] for g in groups) for k in (0, 1)] == [s.slots for s in shares]
    assert max(sum(g[2]) for g in groups) - min(sum(g[2]) for g in groups) <= 2


def frames(spark, documents, targets):
    return spark.createDataFrame(documents, "doc_id bigint, text string, source string, tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix(spark):
    documents = [(k, f"word {k} " * 60, ["A", "a ", "B", None, "x"][k % 5], 1) for k in range(100)] + [(200, None, "A", 1), (201, "", "b", 1)]
    d, t = frames(spark, documents, [("a", 0.5, 2), ("B", 0.5, 3), ("none", 0.0, 1)])
    mix = mixing.Mix(d, t)
    report = {r.source: r for r in mix.report().collect()}
    assert set(report) == {"a", "b", "none"} and report["none"].used_tokens == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert all(r.repeats <= r.max_repeats for r in report.values())
    blocks = mix.mixed().collect()
    assert sum(len(r.ids) for r in blocks) == sum(r.used_tokens for r in report.values())
    uses = {}
    for r in blocks:
        uses[r.source, r.block] = uses.get((r.source, r.block), 0) + 1
        assert len(r.ids) <= mixing.BLOCK_TOKENS
    # Every token of a source lies in exactly one of its blocks.
    whole = {(r.source, r.block): len(r.ids) for r in mix.blocks().collect()}
    for source in ("a", "b"):
        assert sum(n for (s, _), n in whole.items() if s == source) == report[source].tokens
    assert max(uses.values()) <= 3
    assert sorted(r.ids for r in mixing.Mix(d, t).mixed().collect()) == sorted(r.ids for r in blocks)


def test_empty(spark):
    d, t = frames(spark, [], [("a", 1.0, 2)])
    mix = mixing.Mix(d, t)
    assert mix.mixed().count() == 0 and mix.report().first().actual_share is None
