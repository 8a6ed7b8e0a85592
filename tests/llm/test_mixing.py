from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelwise.llm import mixing
from panelwise.llm.base import stage
from panelwise.llm.mixing import mix_documents, mixed_rows, shard_of, source_targets, split_quotas


def filled(words, weights=(5, 2, 1), most=3):
    """Targets by sharing out again until no source is above its limit."""
    names = sorted(words, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(words.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * words[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * words[s]
            left -= target[s]
        open_ -= over


@pytest.mark.parametrize(
    "words",
    [
        {"a": 10, "b": 1000, "c": 1000},
        {"a": 1, "b": 1, "c": 1, "d": 10_000, None: 3},
        {"z": 7},
        {"a": 0, "b": 5},
        {f"s{i}": (i * 37) % 101 for i in range(40)},
    ],
)
def test_targets(spark, words):
    rows = [("0" if s is None else f"1{s}", s, n) for s, n in words.items()]
    got = source_targets(spark.createDataFrame(rows, "source_key string, source string, words long"), (5, 2, 1), 3).collect()
    want = filled(words)
    assert {r.source_key: pytest.approx(r.target) for r in got} == {("0" if s is None else f"1{s}"): t for s, t in want.items()}


def test_tree_splits_exact_quotas(spark):
    rows = [("1a", 500, 640.0), ("1b", 90, 250.0), ("1c", 10, 30.0), ("1d", 5, 0.0)]
    got = split_quotas(spark.createDataFrame(rows, "source_key string, words long, target double"), 12, 16, "s").collect()
    total = Counter()
    for r in got:
        if r.target:
            assert len(r.shards) * r.block_words == pytest.approx(r.target)
            total.update(r.shards)
        else:
            assert r.shards is None
    assert len(total) == 12 and max(total.values()) - min(total.values()) <= 2
    halves = [sum(total[i] for i in range(k, k + 6)) for k in (0, 6)]
    assert abs(halves[0] - halves[1]) <= 1


def leaves(slots: int, low: int, high: int) -> list[int]:
    """Slots of each leaf, by halving."""
    if high - low < 2:
        return [slots]
    middle = (low + high) // 2
    share = slots * (middle - low) / (high - low)
    left = int(share + 0.5)
    return leaves(left, low, middle) + leaves(slots - left, middle, high)


@pytest.mark.parametrize(("slots", "shards"), [(100, 64), (7, 12), (2049, 40), (5, 1), (1, 3), (1000, 7)])
def test_leaves_of_the_tree(spark, slots, shards):
    got = spark.range(slots).select(shard_of(F.col("id"), F.lit(slots), shards).alias("s")).collect()
    want = [s for s, n in enumerate(leaves(slots, 0, shards)) for _ in range(n)]
    assert [r.s for r in got] == want


def test_a_node_splits_by_the_hypergeometric_law(spark):
    """Over many seeds, a source's blocks in the left half have the law's mean and variance."""
    rows = [("1a", 300, 300.0), ("1b", 700, 700.0)]
    sources = stage(spark.createDataFrame(rows, "source_key string, words long, target double"), "law")
    left = []
    for seed in range(12):
        found = {r.source_key: r.shards for r in split_quotas(sources, 4, 10, f"s{seed}").collect()}
        n = {k: len(v) for k, v in found.items()}
        left.append(sum(s < 2 for s in found["1a"]))
    total, own, drawn = sum(n.values()), n["1a"], round(sum(n.values()) / 2)
    mean = drawn * own / total
    variance = mean * (1 - own / total) * (total - drawn) / (total - 1)
    assert abs(sum(left) / len(left) - mean) < 4 * (variance / len(left)) ** 0.5
    assert variance / 3 < sum((x - mean) ** 2 for x in left) / len(left) < 3 * variance


def test_blocks_are_not_dealt_in_turn(spark):
    """The shards of a source's blocks, one after the other, are no rotation or stride."""
    one = spark.createDataFrame([("1a", 4096, 4096.0)], "source_key string, words long, target double")
    shards = split_quotas(one, 16, 16, "s").first().shards
    steps = Counter((b - a) % 16 for a, b in zip(shards, shards[1:], strict=False))
    assert len(shards) == 256 and max(steps.values()) < 50


def test_the_tree_decides_what_is_taken(small, monkeypatch):
    """Without the leaves of some shards, the documents of their blocks are not taken."""
    whole = {r.doc_id: len(r.draws) for r in mix_documents(small, shards=8, blocks_per_shard=8).collect()}
    monkeypatch.setattr(mixing, "shard_of", lambda slot, slots, shards: F.when(shard_of(slot, slots, shards) != 3, shard_of(slot, slots, shards)))
    fewer = {r.doc_id: len(r.draws) for r in mix_documents(small, shards=8, blocks_per_shard=8).collect()}
    assert all(fewer[d] <= n for d, n in whole.items()) and sum(fewer.values()) < sum(whole.values())


def test_draws(small):
    rows = mix_documents(small, shards=8, blocks_per_shard=8).collect()
    assert len(rows) == small.count()
    taken, target, biggest, block_shard = defaultdict(int), {}, defaultdict(int), {}
    for r in rows:
        target[r.source] = r.target
        taken[r.source] += r["size"] * len(r.draws)
        biggest[r.source] = max(biggest[r.source], r["size"])
        assert [d.epoch for d in r.draws] == list(range(len(r.draws))) and len(r.draws) <= 3
        for d in r.draws:
            assert 0 <= d.shard < 8
            assert block_shard.setdefault((r.source, d.block), d.shard) == d.shard
    for s, t in target.items():
        assert abs(taken[s] - t) <= biggest[s] / 2 + 1e-6
    again = mix_documents(small.repartition(7), shards=8, blocks_per_shard=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_rows_of_the_mix(small):
    mixed = mix_documents(small, shards=4)
    rows = mixed_rows(mixed)
    assert rows.count() == sum(len(r.draws) for r in mixed.select("draws").collect())
    assert rows.columns == [*small.columns, "epoch", "shard", "place"]


def test_odd_documents(odd, none):
    rows = mix_documents(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r["size"] for r in rows if r.doc_id in (1, 2, 3, 4, 5, 7)} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 9, 7: 120_000}
    assert sum(r.source_size for r in rows if r.source is None) == 0
    assert mix_documents(none).count() == 0
    assert mix_documents(odd.where("text IS NULL")).select("draws").where("size(draws) > 0").count() == 0
