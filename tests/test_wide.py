"""Wide tables and the ratio panel: rows meet in all shuffle partitions."""

from __future__ import annotations

import pytest

from panelwise.operators.shape import to_wide
from panelwise.sources.testbed import ratio_panel


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_are_dealt_once_into_all_partitions(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "b", None), (None, "a", 3.0), (2, "b", None)], "k int, n string, v double")
    wide = to_wide(df, ["k"], "n", "v", ["a", "b"])
    assert plan(wide).count("Exchange ") == plan(wide).count("REPARTITION_BY_NUM") == 1
    assert {tuple(r) for r in wide.collect()} == {(1, 1.0, 2.0), (None, 3.0, None), (2, None, None)}
    with pytest.raises(Exception, match="several values"):
        to_wide(df.union(df), ["k"], "n", "v", ["a", "b"]).collect()


def test_ratio_items_meet_orders_in_all_partitions(spark):
    assert plan(ratio_panel(spark, "/root/testdata/sf0.001")).count("REPARTITION_BY_NUM") == 1
