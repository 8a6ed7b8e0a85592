"""Net change of a panel that is dealt by site once, with crowded sites apart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelwise.operators.flags import flag_panel
from panelwise.operators.joins import crowded_keys, join_within
from panelwise.operators.net_change import net_change_panel
from panelwise.operators.ratio import merge_ratio_numerator
from panelwise.plans import pipeline
from panelwise.sources import testbed as tb
from panelwise.sources.stages import stage, stage_by

SCHEMA = "orgunituid long, mech_code string, fundingagency string, period_idx int, value double"


def panel(spark, seed):
    draw, rows = random.Random(seed), {}
    for _ in range(400):
        site = draw.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, None])
        owner = draw.choice([None, *"abcdefgh"] if site == 1 else "ab")
        at = draw.choice([8, 9, 10, 11, 13, 14, 15, None])
        rows[site, owner, at] = (site, owner, draw.choice(["x", "y", None]), at, draw.choice([None, 0.0, 1.0, 2.5, 7.0]))
    return spark.createDataFrame(list(rows.values()), SCHEMA)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("most, lag_mode, lag", [(100_000, "rows", 2), (12, "rows", 3), (12, "periods", 1)])
def test_same_rows_wherever_a_site_is_dealt(spark, most, lag_mode, lag):
    df = panel(spark, most + lag)
    want = rows_of(net_change_panel(flag_panel(df), lag_mode=lag_mode, lag=lag))
    assert want and rows_of(pipeline.net_change_stage(df, lag_mode=lag_mode, lag=lag, most=most)) == want


def test_no_row_moves_after_the_panel_is_dealt(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pipeline.net_change_stage(panel(spark, 1))
        text = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() and "SortMergeJoin" in text and "Exchange hashpartitioning" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_within(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, None, 1), (2, "a", 1), (None, "a", 1)], "s int, o string, p int")
    facts = spark.createDataFrame([(1, "a", 1, 5.0), (1, None, 1, 6.0), (1, None, 1, 7.0), (None, "a", 1, 8.0)], "s int, o string, p int, v double")
    for how in ("left", "inner"):
        assert rows_of(join_within(rows, facts, "s", ["o", "p"], how)) == rows_of(rows.join(facts, ["s", "o", "p"], how))


def test_crowded_keys_and_bucketed_stages(spark):
    df = panel(spark, 3)
    counts = {r[0]: r[1] for r in df.groupBy("orgunituid").count().collect()}
    want = {k for k, n in counts.items() if k is not None and n > 12}
    assert 1 in want and {r[0] for r in crowded_keys(df, "orgunituid", 12).collect()} == want
    kept = stage_by(df, "some-panel", "orgunituid")
    assert rows_of(kept) == rows_of(df)
    plan = kept.groupBy("orgunituid").agg(F.count("value"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


RATIO = "orgunituid long, mech_code string, fundingagency string, period_idx int, indicator string, numeratordenom string, value double"


def ratio_rows(spark, seed):
    """Rows of sites with and without a panel, and some that differ from the panel's in one key or have none."""
    draw, rows = random.Random(seed), {}
    for _ in range(500):
        site, owner = draw.choice([1, 1, 2, 3, 4, 5, 8, 9, 9, None]), draw.choice([None, *"abz"])
        key = (site, owner, draw.choice(["x", "y", None]), draw.choice([8, 9, 10, 11, 13, 14, 15, None]), "TX_PVLS", draw.choice("ND"))
        rows[key] = (*key, draw.choice([None, 0.0, -1.0, -2.5, 7.0]))
    for at in ((20, "a", "x", 8), (20, "b", None, 8), (None, "c", "x", 8), (21, "c", "x", None)):  # corrections alone in their period
        rows[at] = (*at, "TX_PVLS", "D", -3.0)
    return spark.createDataFrame(list(rows.values()), RATIO)


@pytest.mark.parametrize("most", [100_000, 12])
def test_same_ratio_rows_wherever_a_site_is_dealt(spark, most):
    df, vl = panel(spark, most), ratio_rows(spark, most)
    nn = stage(net_change_panel(flag_panel(df)), "whole")
    merged = stage(merge_ratio_numerator(nn, vl), "merged")
    own = merged.where("vlc_valid AND method = 'no TX_CURR reported'").groupBy("orgunituid").count()
    assert (20, 2) in [tuple(r) for r in own.collect()]
    assert rows_of(merge_ratio_numerator(nn, vl, within=True)) == rows_of(merged)
    dealt = [stage_by(t, "dealt", "orgunituid") for t in (df, vl)]
    assert rows_of(pipeline._merged_by_site(*dealt, pipeline.DEFAULT_SPEC, most)) == rows_of(merged)


def test_two_net_changes_of_a_key_are_an_error(spark):
    nn = net_change_panel(flag_panel(panel(spark, 1)))
    with pytest.raises(Exception, match="several rows for"):
        merge_ratio_numerator(nn.union(nn), ratio_rows(spark, 1), within=True).collect()


def test_rows_move_once_between_dealt_tables_and_the_named_merge(spark):
    """Panel, net change and ratio rows meet in one exchange, by site; the paths come to them, and nothing is dealt by owner."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = [stage_by(t, "dealt", "orgunituid") for t in (panel(spark, 1), ratio_rows(spark, 1))]
        out = pipeline._merged_by_site(*dealt, pipeline.DEFAULT_SPEC, 100_000)
        text = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() and text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sums_of_dealt_tables_leave_the_rows_where_they_are(spark):
    """The fiscal table moves sums per unit, and no panel row to its site's path."""
    d = "/root/testdata/sf0.001"
    stock = stage_by(tb.orders_panel(spark, d), "dealt", "orgunituid")
    ratio = stage_by(tb.ratio_panel(spark, d, by_site=True), "dealt", "orgunituid", deal=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = tb.fiscal_wide(spark, d, stock, ratio)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [part.split("FileScan")[1].split("]")[0] for part in text.split("Exchange hashpartitioning(orgunituid")[1:]]
    assert moved and all("c_custkey" in columns for columns in moved)
    assert rows_of(tb.fiscal_wide(spark, d, stock, ratio)) == rows_of(tb.fiscal_wide(spark, d))
