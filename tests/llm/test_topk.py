import math
import re

import numpy as np
from pyspark.sql import functions as F

from panelwise.llm import topk
from panelwise.llm.topk import exact_top_k, segment_features


def test_features_bound_products():
    draw = np.random.default_rng(4)
    for dim in (1, 3, 16, 50):
        a, b = draw.normal(size=(2, 40, dim)) * draw.choice([1, 100], (2, 40, dim))
        exact, last = a @ b.T, None
        for segments in (1, 4, 16):
            bound = segment_features(a, segments) @ segment_features(b, segments).T
            assert (bound >= exact - 1e-6 * np.abs(bound) - 1e-9).all()
            if last is not None and dim % 16 == 0:
                assert (bound <= last + 1e-6).all()
            last = bound


def test_bounds_prune():
    """Random directions, the hardest case: the finest level spares two of five exact products."""
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(6000, 64))
    numbers = np.floor(1024 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    block = lambda a, b: topk._Block(64, np.arange(a, b).astype("<i8").tobytes(), numbers[a:b].astype("<f8").tobytes())
    best = topk._Best(block(0, 50), 10, None)
    for at in range(0, 6000, 500):
        best.look(block(at, at + 500))
    scores = numbers[:50] @ numbers.T
    for q in range(50):
        scores[q, q] = -np.inf
        assert best.ids[q].tolist() == np.lexsort((np.arange(6000), -scores[q]))[:10].tolist()
    assert best.computed < 0.6 * best.pairs, best.computed / best.pairs


def brute(rows, k=10):
    valid = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for q, a in valid:
        if q % 100 == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in valid if i != q and len(a) == len(b)))
            out += [(q, n + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(9)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 8) / 64]) for i in range(0, 1500, 5)]  # many ties
    rows += [(None, [1.0] * 8), (1600, None), (1601, [1.0, None] * 4), (1700, [math.nan] * 8), (1701, [math.inf] + [0.0] * 7)]
    rows += [(1800, []), (1801, []), (1900, [1.0, 2.0]), (1901, [0.5, -1.0]), (2000, [3.0]), (2100, [1e30] * 3), (2101, [-1e30] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS block", "4 AS id")
    got = exact_top_k(df, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert exact_top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_rows(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == sorted([(100, n, 1, 1 << 20) for n in (1, 2)] * 2)


def test_blocks_meet_in_rounds(spark, monkeypatch):
    """Queries beyond a round's deals, vectors of several parts, a bound that overflows, and no join of blocks."""
    for name, size in (("BLOCK", 16), ("QUERY_BLOCK", 3), ("HELD_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, size)
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 8) / 64]) for i in range(0, 4000, 10)]
    rows += [(4100, [1e200, -1e200]), (4101, [1e200, 1e200])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), F.col("vec_id") % 100 == 0)
    joins = re.findall(r"(\w+Join) \[(\w+)#", got._jdf.queryExecution().executedPlan().toString())
    assert joins == [("BroadcastHashJoin", "task")], joins  # of the counts of blocks; blocks are dealt
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
