"""Filling: one sort, in all shuffle partitions."""

from __future__ import annotations

from panelwise.operators.grid import fill_down_up


def test_fill_sorts_once_in_all_partitions(spark):
    seen = {(k, g): {t: None if (t + k) % 4 else float(t) for t in range(9)} for k in range(4) for g in "ab"}
    seen[9, None] = {0: None, 1: None}
    seen[None, None] = {0: None, 1: 5.0, 2: None}
    rows = [(k, g, t, v) for (k, g), cells in seen.items() for t, v in cells.items()]
    out = fill_down_up(spark.createDataFrame(rows, "k int, g string, t int, v double"), ["v"], ["k", "g"], ["t"])
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == text.count("Exchange ") == text.count("Sort [") == 1
    want = set()
    for (k, g), cells in seen.items():
        for t in cells:
            near = [v for u, v in sorted(cells.items()) if u <= t and v is not None][-1:] or [v for u, v in sorted(cells.items()) if v is not None][:1]
            want.add((k, g, t, near[0] if near else None))
    assert {tuple(r) for r in out.collect()} == want and len(want) == len(rows)
