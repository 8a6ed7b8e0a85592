"""Operators whose plan matters as much as their result: no grid, group or table in one task."""

from __future__ import annotations

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from panelwise.operators import grid, selection
from panelwise.operators.flags import flag_panel
from panelwise.operators.groups import add_cum_share, display_rank, list_rank, running_sum, shares_of, top_n_ties
from panelwise.operators.joins import anti_join, difference, join_crowded
from panelwise.operators.selection import exact_median, nth_value
from panelwise.operators.sketches import distinct_sketches, merged_count
from panelwise.plans import catalog
from panelwise.sources.readers import partition_values, read_latest
from panelwise.sources.stages import stage
from panelwise.sources.writers import write_by

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# -- set difference -----------------------------------------------------------


def pairs(spark, rows):
    return spark.createDataFrame(rows, "k string, n int, other int")


def test_difference_as_a_set(spark):
    a = pairs(spark, [("a", 1, 0), ("a", 1, 1), ("b", 2, 0), (None, 1, 0), (None, None, 0), ("c", None, 0), ("c", None, 1)])
    b = pairs(spark, [("b", 2, 9), ("b", 2, 8), (None, 1, 0), ("c", 3, 0)])
    got = sorted(map(str, difference(a, b, ["k", "n"]).collect()))
    assert got == sorted(["Row(k='a', n=1)", "Row(k=None, n=None)", "Row(k='c', n=None)"])
    assert sorted(r.other for r in anti_join(a, b, ["k", "n"]).collect()) == [0, 0, 0, 1, 1]
    assert difference(a, a, ["k", "n"]).isEmpty() and difference(a.limit(0), b, ["k"]).isEmpty()
    assert difference(a, b.limit(0), ["k"]).count() == 4


def test_difference_as_a_bag(spark):
    draw = random.Random(2)
    rows = [[(draw.choice(["x", "y", None]), draw.choice([1, None]), i) for i in range(n)] for n in (400, 300)]
    a, b = (pairs(spark, r) for r in rows)
    keys = ["k", "n"]
    want = a.select(*keys).exceptAll(b.select(*keys))
    assert sorted(map(str, difference(a, b, keys, bag=True).collect())) == sorted(map(str, want.collect()))
    assert difference(a, a, keys, bag=True).isEmpty()


# -- completion ---------------------------------------------------------------


def test_complete_with_repeated_and_null_keys(spark):
    rows = [("a", "x", 1, 1.0), ("a", "x", 1, 2.0), (None, "x", 2, None), ("b", None, 3, 4.0), ("c", "y", None, 5.0)]
    df = spark.createDataFrame(rows, "k string, g string, t int, v double")
    got = sorted(((r.k, r.g, r.t, r.v) for r in grid.complete(df, "t", ["k", "g"], {"v": 0.0}).collect()), key=str)
    want = [("a", "x", 1, 1.0), ("a", "x", 1, 2.0), ("a", "x", 2, 0.0), ("a", "x", 3, 0.0)]
    want += [(None, "x", t, 0.0) for t in (1, 2, 3)] + [("b", None, t, 4.0 * (t == 3)) for t in (1, 2, 3)]
    want += [("c", "y", t, 0.0) for t in (1, 2, 3)]
    assert got == sorted(want, key=str)
    assert grid.complete(df.limit(0), "t", ["k"]).isEmpty()


def test_completion_does_not_move_the_grid(spark):
    """One exchange by key, of partial sets, and none above the rows that are made from them."""
    text = plan(catalog.densify_panel(spark, SMALL))
    assert len(re.findall(r"Exchange hashpartitioning\(orgunituid", text)) == 1
    made = text.index("Generate explode")
    assert "Exchange" not in text[:made] and "Join" not in text


# -- order statistics ---------------------------------------------------------


@pytest.mark.parametrize("few", [1024, 4])
def test_median_by_counting(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BUCKETS", 16)
    draw = random.Random(5)
    values = [lambda: draw.gauss(0, 1), lambda: float(draw.randrange(5)), lambda: math.exp(draw.gauss(0, 9)), lambda: draw.choice([1e308, -1e308, 0.0])]
    rows = [(None if i % 3 == 0 else f"k{draw.randrange(40)}", draw.randrange(3), draw.choice(values)()) for i in range(3000)]
    rows += [("inf", 0, x) for x in (math.inf, -math.inf, 1.0, 2.0, math.inf)] + [("nan", 0, x) for x in (math.nan, 1.0, math.nan)]
    rows += [("none", 0, None), ("one", 0, 7.0), ("two", 0, 1.0), ("two", 0, 2.0), ("two", 0, None)]
    df = stage(spark.createDataFrame(rows, "k string, g int, v double"), "values")
    for keys in (["k"], ["k", "g"]):
        want = {tuple(r[k] for k in keys): r.m for r in df.groupBy(*keys).agg(F.median("v").alias("m")).collect()}
        made = exact_median(df, keys, "v", "m")
        got = {tuple(r[k] for k in keys): r.m for r in made.collect()}
        assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
        assert "percentile" not in plan(made) and "median" not in plan(made).replace("m#", "")


def test_nth_value(spark):
    df = spark.range(10_000).selectExpr("id % 2 AS k", "cast(hash(id) AS double) AS v")
    want = {k: sorted(r.v for r in df.where(f"k = {k}").collect()) for k in (0, 1)}
    got = {r.k: (r.nth, r.size) for r in nth_value(df, ["k"], "v", lambda n: n - 3).collect()}
    assert got == {k: (v[-3], 5000) for k, v in want.items()}


def test_rank_by_median(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id % 50) AS k", "cast((id * 37) % 101 AS double) AS v")
    medians = sorted({r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}, reverse=True)
    own = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    got = {r.k: r.display_rank for r in display_rank(df, "k", "v", "median", desc=True).collect()}
    assert got == {k: medians.index(m) + 1 for k, m in own.items()}


def test_rank_from_a_list(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), ("z",)], "k string")
    order = spark.createDataFrame([("c", 10), ("a", 30), ("unused", 20), ("c", 40)], "k string, at int")
    assert {r.k: r.place for r in list_rank(df, "k", order, "at", "place").collect()} == {"c": 1, "a": 2, "b": 3, None: 3, "z": 3}
    assert {r.place for r in list_rank(df, "k", order.limit(0), "at", "place").collect()} == {1}


# -- running sums and largest rows --------------------------------------------


def test_running_sums_of_many_keys(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("id AS k", "cast(id % 3 AS long) AS v")
    order = [F.desc("v"), F.asc("k")]
    summed = running_sum(df, {"v": "upto"}, order)
    thirds = [n // 3 + (i < n % 3) for i in range(3)]  # how many have 0, 1, 2
    checked = summed.agg(F.max("upto").alias("all"), F.count(F.lit(1)).alias("n"), F.countDistinct("upto").alias("kinds"))
    assert tuple(checked.first()) == (thirds[1] + 2 * thirds[2], n, thirds[1] + thirds[2])
    some = {r.k: r.upto for r in summed.where("k IN (2, 5, 1, 4, 0)").collect()}
    assert some == {2: 2, 5: 4, 1: 2 * thirds[2] + 1, 4: 2 * thirds[2] + 2, 0: thirds[1] + 2 * thirds[2]}
    # a window without partitions runs over the ranges' totals alone
    text = plan(summed)
    assert text.count("Window") == 2 and text.count("SinglePartition") == 1
    below = text[text.index("SinglePartition") :]
    assert "_sum_v" in below.split("\n")[1] and "HashAggregate" in below.split("\n")[1]


def test_shares_with_ties_and_nulls(spark):
    rows = [(f"k{i}", v) for i, v in enumerate([5, 5, None, 0, 5, 1])]
    df = spark.createDataFrame(rows, "k string, v long")
    got = [(r.k, r.share, r.cum_share) for r in add_cum_share(df, "v", [F.desc("v"), F.asc("k")]).orderBy(F.desc("v"), "k").collect()]
    want = [("k0", 5, 5), ("k1", 5, 10), ("k4", 5, 15), ("k5", 1, 16), ("k3", 0, 16), ("k2", None, 16)]
    assert got == [(k, None if a is None else a / 16, b / 16) for k, a, b in want]
    assert shares_of(df.limit(0), "k").isEmpty()


def test_largest_rows_without_a_rank_of_all(spark):
    df = spark.range(1_000_000).selectExpr("id", "cast(id % 1000 AS int) AS v")
    top = top_n_ties(df, "v", 1001)
    assert top.count() == 2000 and top.agg(F.min("v")).first()[0] == 998
    assert "Window" not in plan(top)
    few = spark.createDataFrame([(3,), (None,), (1,), (None,)], "v int")
    assert [top_n_ties(few, "v", n).count() for n in (0, 1, 2, 3, 9)] == [0, 1, 2, 4, 4]


# -- files --------------------------------------------------------------------


def test_sink_writes_few_files(spark, tmp_path):
    df = spark.range(0, 20_000, numPartitions=200).selectExpr("id", "concat('unit ', id % 50) AS unit")
    write_by(df, "unit", str(tmp_path / "by"))
    files = [f for _, _, names in os.walk(tmp_path / "by") for f in names if f.startswith("part-")]
    assert 50 <= len(files) <= 100
    back = spark.read.parquet(str(tmp_path / "by"))
    assert sorted(map(tuple, back.select("id", "unit").collect())) == sorted(map(tuple, df.collect()))


def test_large_unit_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(0, 300_000, numPartitions=20).selectExpr("sha2(cast(id AS string), 512) AS x", "if(id % 3 = 0, 'small', 'large') AS unit")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        write_by(df, "unit", str(tmp_path / "by"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes") if old is None else spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert sum(f.startswith("part-") for f in os.listdir(tmp_path / "by" / "unit=large")) > 2


@pytest.mark.parametrize("names", [["2021-02-01", "2021-11-30", "2020-12-31"], ["9", "10", "8"], ["Q1 a:b", "Q4 x=y%", "Q2 [z]"]])
def test_newest_snapshot_by_its_folder(spark, tmp_path, names):
    rows = [(i, n) for i, n in enumerate(names)]
    root = str(tmp_path)
    write_by(spark.createDataFrame([*rows, (99, None)], "i int, snapshot string"), "snapshot", f"{root}/set")
    (tmp_path / "set" / "_temporary").mkdir()
    assert sorted(partition_values(spark, f"{root}/set", "snapshot")) == sorted(names)
    newest = max(rows, key=lambda r: int(r[1]) if r[1].isdecimal() else r[1])
    found = read_latest(spark, root, "set")
    assert [r.i for r in found.collect()] == [newest[0]] and "snapshot" in found.columns
    assert len(found.inputFiles()) == 1
    assert re.search(r"PartitionFilters: \[[^\]]*snapshot", plan(found))
    with pytest.raises(ValueError, match="holds no"):
        (tmp_path / "empty").mkdir()
        read_latest(spark, root, "empty")


# -- sketches -----------------------------------------------------------------


def test_sketches_of_parts_count_the_whole(spark):
    df = spark.range(300_000).selectExpr("id % 20 AS part", "id % 70000 AS k", "if(id % 5 = 0, null, id % 7) AS g")
    sketches = stage(distinct_sketches(df, ["part"], ["k", "g"]), "sketches")
    want = df.select("k", "g").distinct().count()
    got = merged_count(sketches, []).first().n
    assert abs(got - want) < 0.05 * want
    parts = {r.part: r.n for r in merged_count(sketches, ["part"]).collect()}
    exact = {r.part: r.n for r in df.groupBy("part").agg(F.countDistinct(F.struct("k", "g")).alias("n")).collect()}
    assert all(abs(parts[p] - n) < 0.06 * n for p, n in exact.items())


# -- crowded keys -------------------------------------------------------------


def test_flags_of_a_crowded_site_period(spark):
    """A site-period with a third of all rows: the same flags, whether split off or not."""
    draw = random.Random(5)
    rows = [("hot", f"o{i}", "g", "u", 8004, 1.0) for i in range(400)] + [("hot", "o1", "g", "u", 8005, 2.0), ("hot", "o1", "g", "u", 8003, None)]
    seen = {(f"s{draw.randrange(90)}", f"o{draw.randrange(4)}", 8000 + draw.randrange(8)) for _ in range(900)}
    rows += [(s, o, "g", "u", p, None if draw.random() < 0.1 else 1.0) for s, o, p in sorted(seen)]
    schema = "orgunituid string, mech_code string, fundingagency string, operatingunit string, period_idx int, value double"
    panel = stage(spark.createDataFrame(rows, schema), "crowded-panel")
    want = sorted(map(str, flag_panel(panel).collect()))
    assert len(want) > 1000
    for bound in (100, 3, 10**6):  # one crowded key, many, none
        assert sorted(map(str, flag_panel(panel, stage=stage, crowded=bound).collect())) == want


def test_rows_of_a_crowded_key_spread(spark):
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    rows = stage(spark.range(60_000).select(hot.alias("k"), F.col("id").alias("owner")), "crowded-rows")
    rows = rows.unionByName(spark.range(10).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("owner")))
    dim = stage(rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")), "crowded-dim")
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        split = join_crowded(rows, dim, ["k"], F.col("n") > 1000, ["owner"])
        even, uneven = sizes(split), sizes(rows.join(dim, "k"))
        assert sum(even) == sum(uneven) == 60_000
        assert even[-1] <= 2 * even[len(even) // 2] < uneven[-1]
        same = ["k", "owner", "n"]
        assert split.select(same).exceptAll(rows.join(dim, "k").select(same)).isEmpty()
        assert sizes(join_crowded(rows, dim, ["k"], F.col("n") > 1, ["owner"], most=5)) == uneven  # too many to broadcast
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
