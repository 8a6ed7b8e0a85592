"""Flags and net change on small panels: a worked example, and random panels
against the long-form SQL (full grids, row-stepping lags)."""

from __future__ import annotations

import random
import re

import duckdb
import pandas as pd
import pytest
from compare import rows_of

from panelwise.operators import flags as fl
from panelwise.operators import net_change as nc
from panelwise.plans.oracle import FLAG_LIST, FLAGS, MEASURES, NET, label, q

SCHEMA = "orgunituid string, mech_code string, fundingagency string, period_idx int, value double"
BASE = 8000  # FY99Q4; index 8001 is FY00Q1

TOY = """
S1 A X 1 100; S1 A X 2 110; S1 B X 3 120; S1 B X 4 125; S2 A X 1 50; S2 C Y 2 60; S2 C Y 3 60;
S2 C Y 4 66; S3 A X 1 30; S3 A X 2 31; S4 A X 1 10; S4 B X 1 5; S4 A X 2 16; S4 A X 3 17;
S4 A X 4 18; S5 A X 2 7"""

# site, period, owner, stock, net new, lag1, adjusted, adj_plus, transfer, method, lag2 rows, lag2 periods
TOY_ROWS = """
S1 1 A 100 - - - - - adjusted - -
S1 2 A 110 10 100 10 10 - adjusted - -
S1 3 A - -110 - - - -110 adjusted - -
S1 3 B 120 120 110 10 10 110 adjusted 110 100
S1 4 B 125 5 120 5 5 - adjusted 120 110
S2 1 A 50 - - - - - adjusted - -
S2 2 A - -50 - - - -50 adjusted - -
S2 2 C 60 60 50 10 10 50 adjusted - -
S2 3 C 60 0 60 0 0 - adjusted 60 50
S2 4 C 66 6 60 6 6 - adjusted 60 60
S3 1 A 30 - - - - - adjusted - -
S3 2 A 31 1 30 1 1 - adjusted - -
S3 3 A - -31 31 -31 -31 - adjusted - -
S4 1 A 10 - - - - - standard - -
S4 1 B 5 - - - - - standard - -
S4 2 A 16 6 - 16 6 - standard - -
S4 2 B - -5 - - -5 - standard - -
S4 3 A 17 1 16 1 1 - adjusted - -
S4 4 A 18 1 17 1 1 - adjusted 16 16
S5 2 A 7 7 - 7 7 - adjusted - -
S5 3 A - -7 7 -7 -7 - adjusted - -"""


def toy_rows():
    rows = [r.split() for r in TOY.replace("\n", " ").split(";")]
    return [(s, m, g, BASE + int(p), float(v)) for s, m, g, p, v in rows]


def number(text):
    return None if text == "-" else float(text)


@pytest.mark.parametrize("mode", ["rows", "periods"])
def test_toy_net_change(spark, mode):
    panel = spark.createDataFrame(toy_rows(), SCHEMA)
    out = nc.net_change_panel(fl.flag_panel(panel), lag_mode=mode)
    got = {
        (r.orgunituid, r.period_idx - BASE, r.mech_code): (
            r.tx_curr,
            r.tx_net_new,
            r.tx_curr_lag_site,
            r.tx_net_new_adj,
            r.tx_net_new_adj_plus,
            r.tx_xfer,
            r.method,
            r.tx_curr_lag2_site,
        )
        for r in out.collect()
    }
    want = {}
    for line in TOY_ROWS.strip().splitlines():
        s, p, m, *v = line.split()
        back = v[7] if mode == "rows" else v[8]
        want[(s, int(p), m)] = (*[number(x) for x in v[:6]], v[6], number(back))
    assert got == want


def test_toy_flags(spark):
    panel = spark.createDataFrame(toy_rows(), SCHEMA)
    rows = {(r.orgunituid, r.period_idx - BASE, r.mech_code): r for r in fl.flag_panel(panel).collect()}
    types = {k: r.end_type for k, r in rows.items() if r.flag_end_sitexmech}
    assert types == {
        ("S1", 2, "A"): "Transition to other mechanism",
        ("S2", 1, "A"): "Transition to other agency",
        ("S3", 2, "A"): "Transition out of PEPFAR",
        ("S4", 1, "B"): "Consolidate multi-mechanism site",
        ("S5", 2, "A"): "Transition out of PEPFAR",
    }
    moved = rows[("S2", 1, "A")]
    assert (moved.agency_exiting, moved.agency_inheriting) == ("X", "Y")
    assert [k for k, r in rows.items() if r.flag_loneobs] == [("S5", 2, "A")]
    assert {k for k, r in rows.items() if r.vlc_valid} == {
        ("S1", 3, "B"),
        ("S1", 4, "B"),
        ("S2", 3, "C"),
        ("S2", 4, "C"),
        ("S4", 4, "A"),
    }
    assert {k for k, r in rows.items() if r.method == "standard"} == {
        ("S4", 1, "A"),
        ("S4", 1, "B"),
        ("S4", 2, "A"),
    }


def random_rows(seed: int):
    """Gaps, zeros, nulls, owners that change group, a hot site with many owners,
    and (for odd seeds) a period in which every site has several owners."""
    rnd = random.Random(seed)
    periods = [p for p in range(1, 10) if p != 5 or seed % 3]
    crowded = 4 if seed % 2 else None
    rows = []
    for s in range(25):
        for m in range(rnd.choice([1, 2, 3]) if s else 30):
            changes = rnd.random() < 0.2
            for p in periods:
                if rnd.random() > (0.35 if s % 2 else 0.6) and p != crowded:
                    continue
                group = "XY"[(m + (changes and p > 4)) % 2]
                value = rnd.choice([None, 0.0, 0.0] + [float(rnd.randint(1, 40)) for _ in range(8)])
                if p == crowded:
                    value = float(rnd.randint(1, 40))
                rows.append((f"S{s:02d}", f"M{m:02d}", group, BASE + p, value))
        if crowded:
            rows.append((f"S{s:02d}", "M99", "X", BASE + crowded, 3.0))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_random_panels_agree_with_sql(spark, seed):
    rows = random_rows(seed)
    panel = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    pdf = pd.DataFrame(rows, columns=["orgunituid", "mech_code", "fundingagency", "period_idx", "value"])
    pdf = pdf.astype({"value": "Float64"})
    con.register("panel", pdf)
    flags = fl.flag_panel(panel)
    got = fl.label_periods(flags).drop("period_idx")
    rel = con.sql(q(f"SELECT orgunituid, mech_code, fundingagency, {label()} AS period, value, {FLAG_LIST} FROM flags", FLAGS))
    assert rows_of(got.columns, got.collect()) == rows_of(rel.columns, rel.fetchall())

    nn = fl.label_periods(nc.net_change_panel(flags)).drop("period_idx")
    rel = con.sql(
        q(f"SELECT orgunituid, mech_code, fundingagency, period, {MEASURES}, {FLAG_LIST} FROM nn", FLAGS, NET)
    )
    assert rows_of(nn.columns, nn.collect()) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_sparse_and_dense_agree(spark, seed):
    flags = fl.flag_panel(spark.createDataFrame(random_rows(seed), SCHEMA))
    both = []
    for dense in (False, True):
        std = nc.net_change_standard(flags, dense=dense)
        out = nc.combine_net_change(std, nc.net_change_adjusted(flags, dense=dense))
        both.append(
            out.select("orgunituid", "mech_code", "period_idx", "tx_curr", "tx_net_new", "tx_curr_lag_site", "tx_net_new_adj")
        )
    sparse, dense = [rows_of(d.columns, d.collect()) for d in both]
    assert sparse == dense


def test_single_steps_match_the_whole(spark):
    panel = spark.createDataFrame(random_rows(2), SCHEMA)
    key = ["orgunituid", "mech_code", "period_idx"]
    whole = fl.flag_panel(panel)
    steps = {
        "flag_loneobs": fl.flag_lone_obs(panel),
        "flag_multimech_site": fl.flag_multi_owner(panel),
        "flag_end_sitexmech": fl.flag_end(panel),
        "end_type": fl.classify_end(panel),
        "agency_inheriting": fl.transition_parties(panel),
        "method": fl.assign_method(panel),
        "vlc_valid": fl.flag_ratio_valid(panel),
    }
    for c, df in steps.items():
        a, b = df.select(*key, c), whole.select(*key, c)
        assert rows_of(a.columns, a.collect()) == rows_of(b.columns, b.collect()), c


def test_plan_has_no_unbounded_group(spark):
    """Windows run per (site, owner) or per site on one row per period; no cross joins."""
    panel = spark.createDataFrame(toy_rows(), SCHEMA)
    query = nc.net_change_panel(fl.flag_panel(panel))._jdf.queryExecution()
    plan = query.executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for line in query.optimizedPlan().toString().splitlines():
        if "Window [" in line:
            keys = re.findall(r"\], \[((?:orgunituid|mech_code)#\d+[^\]]*)\]", line)
            assert keys, line
            if "mech_code" not in keys[0]:
                assert "windowspecdefinition(orgunituid" in line
