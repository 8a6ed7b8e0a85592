"""Single operators on small tables: null, number, text and period rules, sources and sinks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwise.functions import columns as c
from panelwise.functions import periods as p
from panelwise.operators import clean, grid, groups, joins, ratio, review, shape
from panelwise.plans import reports
from panelwise.sources import readers, stages, writers
from panelwise.sources.stages import clear_stages, run_folder, stage
from panelwise.spec import PanelSpec


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_if_else_na(spark):
    null = F.lit(None).cast("boolean")
    assert value(spark, c.if_else_na(null, F.lit(1), F.lit(2))) is None
    assert value(spark, c.if_else_na(F.lit(False), F.lit(1), F.lit(2))) == 2


def test_sums(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.5), ("b", None)], "k string, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(c.sum0("v").alias("s")).collect()}
    assert got == {"a": 0.0, "b": 1.5}


@pytest.mark.parametrize(
    "values", [[0.125] * 3, [2e16], [1 / 3, 1e-13, 2.0], [1e300, 1.0], [float("inf"), 1.0], [None, None], [0.1] * 10]
)
def test_sums_lose_nothing(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.agg(c.exact_sum("v")).first()[0]
    known = [v for v in values if v is not None]
    assert got == (pytest.approx(sum(known), rel=1e-15) if known else None)
    if values == [0.1] * 10:
        assert got == 1.0  # exact in decimals, where doubles give 0.9999999999999999


def test_ratio_zero_denominator(spark):
    five, zero = F.lit(5.0), F.lit(0.0)
    assert value(spark, c.ratio(five, zero)) is None
    assert value(spark, c.ratio(five, zero, keep_inf=True)) == float("inf")
    assert value(spark, c.ratio(zero, zero, keep_inf=True)) is None


def test_numbers_and_text(spark):
    assert value(spark, c.to_number(F.lit("n/a"))) is None
    assert value(spark, c.round_half_even(F.lit(0.125))) == 0.12
    assert value(spark, c.comma_text(F.lit(1234567.4))) == "1,234,567"
    assert value(spark, c.percent_text(F.lit(0.256))) == "26%"
    assert value(spark, c.recode(F.lit("HHS/CDC"), {"HHS/CDC": "CDC"})) == "CDC"
    assert value(spark, c.indicator_code(F.lit("TX_PVLS"), F.lit("D"))) == "TX_PVLS_D"
    assert value(spark, c.any_nonzero(F.lit(None), F.lit(0.0))) is False


@pytest.mark.parametrize(
    "text, want", [("Oct to Dec 2019", "FY20Q1"), ("Jul to Sep 2019", "FY19Q4"), ("soon", None)]
)
def test_period_text(spark, text, want):
    assert value(spark, p.fiscal_label(p.period_text_date(F.lit(text)))) == want


def test_period_order_and_labels(spark):
    df = spark.createDataFrame([("1999-08-01",), ("1999-11-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    top = df.agg(F.max(p.fiscal_index("d")).alias("i")).select(p.index_label("i").alias("l"))
    assert top.first().l == "FY00Q1"
    days = [(dt.date(y, m, 15),) for y in (1999, 2000) for m in range(1, 13)]
    got = spark.createDataFrame(days, "d date").select(
        "d", p.fiscal_index("d").alias("i"), p.fiscal_index("d", 1).alias("cal")
    )
    for r in got.collect():
        shifted = r.d.month + 2
        year, quarter = r.d.year + shifted // 12, shifted % 12 // 3 + 1
        assert r.i == year * 4 + quarter
        assert r.cal == r.d.year * 4 + (r.d.month - 1) // 3 + 1


def test_quarter_list(spark):
    got = [r.quarter for r in p.quarter_list(spark, "2018Q1", "2021Q4").orderBy("quarter").collect()]
    assert (len(got), got[0], got[-1]) == (15, "2018Q2", "2021Q4")


def test_complete_fills_existing_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 5.0), (None, 2, 7.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in grid.complete(df, "t", ["k"], {"v": 0.0}).collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 0.0, ("b", 1): 0.0, ("b", 2): 5.0, (None, 1): 0.0, (None, 2): 7.0}


def test_fill_down_up(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, "y")], "t int, v string").withColumn(
        "k", F.lit(1)
    )
    got = [r.v for r in grid.fill_down_up(df, ["v"], ["k"], ["t"]).orderBy("t").collect()]
    assert got == ["x", "x", "x", "y"]


def test_exits_step_along_observed_periods(spark):
    rows = [("a", 8001, 10.0), ("a", 8003, 0.0), ("b", 8005, 1.0)]
    df = spark.createDataFrame(rows, "k string, period_idx int, value double")
    out = grid.with_exits(df, ["k"], grid.period_table(df))
    got = {(r.k, r.period_idx): (r.value, r.prior, r.observed) for r in out.collect()}
    assert got == {
        ("a", 8001): (10.0, None, True),
        ("a", 8003): (0.0, 10.0, True),
        ("a", 8005): (0.0, 0.0, False),
        ("b", 8005): (1.0, 0.0, True),
    }


def test_null_keys_match(spark):
    a = spark.createDataFrame([("s", None, 1)], "site string, snu1 string, x int")
    b = spark.createDataFrame([("s", None, 2)], "site string, snu1 string, y int")
    got = joins.join_nullsafe(a, b, ["site", "snu1"], "full").collect()
    assert [tuple(r) for r in got] == [("s", None, 1, 2)]


def test_keep_keys_and_labels(spark):
    df = spark.createDataFrame([(1, "u"), (2, "v")], "k int, ag string")
    keys = spark.createDataFrame([(2,)], "k int")
    dim = spark.createDataFrame([("v", "Agency V")], "id string, item string")
    out = joins.replace_by_label(joins.keep_keys(df, keys, "k"), dim, "ag", "id", "item")
    assert [tuple(r) for r in out.collect()] == [(2, "Agency V")]


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(n,) for n in (9, 8, 7, 6, 5, 5)], "n int")
    assert groups.top_n_ties(df, "n", 5).count() == 6


@pytest.mark.parametrize("desc", [False, True])
def test_display_rank_is_a_dense_rank(spark, desc):
    values = [-3.5, -3.4999, 0.0, 0.001, 0.0011, 1.0, 1.0, 1e9, 1e9 + 1, 5e17, None]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    got = {r.k: r.display_rank for r in groups.display_rank(df, "k", "v", desc=desc).collect()}
    ordered = sorted({v for v in values if v is not None}, reverse=desc)
    want = {k: ordered.index(v) + 1 for k, v in enumerate(values) if v is not None}
    assert {k: r for k, r in got.items() if values[k] is not None} == want


def test_display_rank_splits_close_statistics(spark):
    """100,000 statistics between 1,000 and 1,010: ranks are right and no bucket holds many of them."""
    df = spark.range(100_000).selectExpr("id AS k", "1000 + id / 10000D AS v")
    ranks = groups.display_rank(df, "k", "v")
    assert ranks.where("display_rank <> k + 1").isEmpty()
    bounds = df.agg(F.percentile_approx("v", [i / groups.RANK_BUCKETS for i in range(1, groups.RANK_BUCKETS)])).first()[0]
    assert max(b - a for a, b in zip(bounds, bounds[1:], strict=False)) < 0.1


def test_wide_columns_come_from_the_data(spark):
    rows = [("s", f"FY{y}Q{q}", y * 4 + q, y + q) for y in (98, 99, 10) for q in (1, 2)]
    df = spark.createDataFrame(rows, "k string, period string, idx int, v int")
    wide = shape.to_wide(df, ["k"], "period", "v", order="idx")
    assert wide.columns == ["k", "FY10Q1", "FY10Q2", "FY98Q1", "FY98Q2", "FY99Q1", "FY99Q2"]
    with pytest.raises(Exception, match="without a column: FY10Q1"):
        shape.to_wide(df, ["k"], "period", "v", ["FY98Q1", "FY98Q2", "FY99Q1", "FY99Q2", "FY10Q2"]).collect()
    with pytest.raises(Exception, match="several values of v"):
        shape.to_wide(df.union(df), ["k"], "period", "v", order="idx").collect()
    with pytest.raises(ValueError, match="too many"):
        shape.names_of(df, "period", most=5)
    assert shape.to_wide(df.limit(0), ["k"], "period", "v").columns == ["k"]


def test_seven_owners_are_counted(spark):
    rows = [("K", "s1", str(i), 8001) for i in range(7)] + [("K", "s2", "1", 8001), ("K", "s2", "1", 8002)]
    df = spark.createDataFrame(rows, "operatingunit string, orgunituid string, mech_code string, period_idx int")
    wide = reports.multi_owner_histogram(df.withColumn("period", p.index_label("period_idx")))
    got = {r.period: (r.owners_1, r.owners_7) for r in wide.collect()}
    assert got == {"FY00Q1": (1, 1), "FY00Q2": (1, None)}


def test_repeated_keys_are_errors(spark):
    dim = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, x int")
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(Exception, match=r"several rows for \['k'\] = b"):
        joins.enrich(df, dim, "k", ["x"]).collect()
    assert joins.enrich(df, dim.where("x < 3"), "k", ["x"]).count() == 2
    panel = spark.createDataFrame([("s", "m", i, float(i)) for i in (8001, 8002, 8002)], "orgunituid string, mech_code string, period_idx int, value double")
    with pytest.raises(Exception, match="several rows for .* = s, m, 8002"):
        grid.with_exits(panel, ["orgunituid", "mech_code"], grid.period_table(panel)).collect()


def test_fill_down_up_of_texts(spark):
    rows = [("k", i, v) for i, v in enumerate([None, None, "a", None, "b", None])] + [("n", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    got = [r.v for r in grid.fill_down_up(df, ["v"], ["k"], ["i"]).orderBy("k", "i").collect()]
    assert got == ["a", "a", "a", "a", "b", "b", None]


def test_month_names_in_any_case(spark):
    for text in ("Oct to DEC 2019", "DEC 2019", "dec 2019", "Dec 2019"):
        month = p.month_date(p.period_text_month(F.lit(text)))
        assert value(spark, month) == dt.date(2019, 12, 1)


def test_shares(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    got = [(r.k, r.n, r.share, r.cum_share) for r in groups.shares_of(df, "k").collect()]
    assert got == [("a", 2, 0.5, 0.5), ("b", 1, 0.25, 0.75), ("c", 1, 0.25, 1.0)]


def test_group_filters_and_last_value(spark):
    rows = [("a", 1, 5.0), ("a", 2, 3.0), ("b", 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, period_idx int, v double")
    assert groups.filter_group(df, ["k"], F.count(F.lit(1)), 1).count() == 2
    assert [r.k for r in groups.filter_extreme(df, "period_idx").collect()] == ["a"]
    got = {(r.k, r.period_idx): r.last for r in groups.last_value_of_group(df, "v", ["k"], "last").collect()}
    assert got == {("a", 1): 3.0, ("a", 2): 3.0, ("b", 1): 4.0}
    assert groups.count_distinct_by(df, [], ["k"]).first().n == 2
    assert groups.count_distinct_by(df, [], ["k"], approx=True).first().n == 2


def test_join_ordered_sorts_by_value_not_text(spark):
    rows = [("s", i, f"v{i}") for i in range(12, 0, -1)] + [("s", 13, None)]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = groups.join_ordered(df, ["k"], "v", ["o"], "|", "all").first()["all"]
    assert got == "|".join(f"v{i}" for i in range(1, 13))


def test_columns_and_shapes(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert shape.arrange_columns(df, front=["c"], drop=["b"]).columns == ["c", "a"]
    assert shape.arrange_columns(df, after=("a", ["c"])).columns == ["a", "c", "b"]
    assert shape.columns_like(df, starts="b") == ["b"]
    assert shape.stack(df, df.drop("c")).where("c IS NULL").count() == 1
    long = shape.to_long(df, ["a"], ["b", "c"])
    assert shape.to_wide(long, ["a"], "indicator", "value", ["b", "c", "d"], fill=0).first()["d"] == 0
    wide = spark.createDataFrame([(2020, "x", 1.0, 2.0, 3.0, 4.0)], "fiscal_year int, k string, qtr1 double, qtr2 double, qtr3 double, qtr4 double")
    got = {r.period: r.value for r in shape.quarters_to_periods(wide, ["k"]).collect()}
    assert got == {"FY20Q1": 1.0, "FY20Q2": 2.0, "FY20Q3": 3.0, "FY20Q4": 4.0}


def test_clean_extract_levels(spark):
    names = ["Period", "orglvl_1", "orglvl_2", "orglvl_3", "orglvl_4", "orglvl_5", "Organisation unit", "orgunituid", "Funding Agency", "Funding Mechanism", "Technical Area", "Top Level", "Value"]
    base = ["Oct to Dec 2019", "G", "W", "Kenya", "North", "N1", "clinic", "u1", "id1", "17 - 00042 - M", "TX_CURR", "Top Level Numerator", "7"]
    region = [*base[:3], "Asia Region", "Nepal", "K1", "clinic", "u2", "id9", "00000 De-dup", "TX_PVLS", "Top Level Denominator", "n/a"]
    none = [*base[:3], "Togo", "X", "Y", "clinic", "u3", *base[8:]]
    raw = spark.createDataFrame([base, region, none], ", ".join(f"`{n}` string" for n in names))
    countries = spark.createDataFrame([("Kenya", 4), ("Nepal", 5), ("Togo", 0)], "countryname string, psnu_lvl int")
    agencies = spark.createDataFrame([("id1", "Agency U")], "id string, item string")
    out = clean.clean_extract(raw, countries, agencies)
    got = {r.orgunituid: r for r in out.collect()}
    assert set(got) == {"u1", "u2"}
    assert out.columns[:7] == clean.PANEL_FRONT
    kenya, nepal = got["u1"], got["u2"]
    assert (kenya.period, kenya.psnu, kenya.fundingagency, kenya.mech_code, kenya.value) == ("FY20Q1", "North", "Agency U", "00042", 7.0)
    assert (nepal.countryname, nepal.psnu, nepal.mech_code, nepal.numeratordenom) == ("Nepal", "K1", "00000", "D")
    assert nepal.fundingagency is None and nepal.value is None


def test_dimensions(spark):
    df = spark.createDataFrame([("K", "K", "u", 4, 6, "x")], "operatingunit string, countryname string, countryname_uid string, psnu_lvl int, facility_lvl int, other string")
    assert clean.country_dim(df).columns == ["operatingunit", "countryname", "countryname_uid", "psnu_lvl", "site_lvl"]
    units = spark.createDataFrame([("u1", "OU"), ("u2", "Country")], "uid string, type string")
    hier = spark.createDataFrame([("u1", "a"), ("u2", "b")], "uid string, name string")
    assert [r.name for r in clean.org_hierarchy(units, hier).collect()] == ["a"]
    levels = spark.createDataFrame([("Asia Region", "Nepal", 7)], "name3 string, country_name string, facility int")
    ids = spark.createDataFrame([("Nepal", "n1")], "displayName string, id string")
    assert tuple(clean.country_dim_from(levels, ids).first()) == ("Asia Region", "n1", "Nepal", 7)


def merge(spark, nn_rows, vl_rows):
    nn = spark.createDataFrame(nn_rows, "orgunituid string, mech_code string, period_idx int, vlc_valid boolean, method string")
    vl = spark.createDataFrame(vl_rows, "orgunituid string, mech_code string, period_idx int, indicator string, numeratordenom string, value double")
    out = ratio.merge_ratio_numerator(nn, vl)
    return {r.mech_code: (r.vlc_valid, r.method, r.tx_pvls_d) for r in out.collect()}


def test_ratio_only_correction_is_valid(spark):
    got = merge(spark, [("x", "m", 1, True, "adjusted")], [("s", "00000", 8001, "TX_PVLS", "D", -3.0)])
    assert got["00000"] == (True, "no TX_CURR reported", -3.0)
    assert got["m"] == (True, "adjusted", None)


def test_ratio_correction_beside_unknown_denominator(spark):
    rows = [("s", "00000", 8001, "TX_PVLS", "D", -3.0), ("s", "b", 8001, "TX_PVLS", "N", 1.0)]
    got = merge(spark, [("x", "m", 1, True, "adjusted")], rows)
    assert (got["00000"][0], got["b"][0]) == (False, False)


def test_ratio_correction_takes_the_site_validity(spark):
    rows = [("s", "00000", 8001, "TX_PVLS", "D", -3.0)]
    got = merge(spark, [("s", "m", 8001, False, "standard")], rows)
    assert got["00000"][0] is False
    got = merge(spark, [("s", "m", 8001, True, "adjusted")], rows)
    assert got["00000"][0] is True


def test_review_sheet(spark):
    rows = [
        ("K", "s1", "n", "n", "c1", "HHS/CDC", "2", 8002, True),
        ("K", "s1", "n", "n", "c1", "Dedupe adjustments Agency", "1", 8002, True),
        ("K", "s1", "n", "n", "c1", "HHS/CDC", "2", 8003, True),
        ("K", "s1", "n", "n", "c1", "Dedupe adjustments Agency", "1", 8003, True),
        ("K", "s2", "n", "n", "c2", "Agency U", "3", 8001, True),
        ("K", "s2", "n", "n", "c2", "Agency U", "3", 8002, False),
    ]
    df = spark.createDataFrame(rows, "operatingunit string, orgunituid string, snu1 string, psnu string, facility string, fundingagency string, mech_code string, period_idx int, flag_multimech_site boolean").withColumn("period", p.index_label("period_idx"))
    pairs = review.multi_owner_pairs(df).collect()
    assert [(r.mechs, r.period) for r in pairs] == [("Dedupe 1|CDC 2", "FY00Q2,FY00Q3")]
    assert pairs[0][review.CONTEXT_TITLE] is None
    sites = review.multi_owner_sites(df, ["FY00Q2", "FY00Q3"]).collect()
    assert [(r.orgunituid, r.FY00Q2, r.FY00Q3) for r in sites] == [("s1", "Dedupe 1|CDC 2", "Dedupe 1|CDC 2")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("00001", "", 1.5, True), ("2", None, None, None)], "code string, t string, v double, b boolean")
    writers.write_csv(df, str(tmp_path / "x"))
    back = readers.read_typed(spark, str(tmp_path / "x"), ["code", "t", "v", "b"], ("v",), ("b",))
    assert sorted(tuple(r) for r in back.collect()) == [("00001", None, 1.5, True), ("2", None, None, None)]
    extract = readers.read_extract(spark, [str(tmp_path / "x")], back.schema)
    assert extract.count() == 2
    assert readers.FINAL_SCHEMA["tx_xfer"].dataType.simpleString() == "double"


def test_write_by_value_and_latest(spark, tmp_path):
    df = spark.createDataFrame([("TX_CURR", 1), ("TX_PVLS", 2)], "indicator string, v int")
    writers.write_by(df, "indicator", str(tmp_path / "by"), "csv")
    assert {f.name for f in (tmp_path / "by").iterdir() if f.is_dir()} == {"indicator=TX_CURR", "indicator=TX_PVLS"}
    snaps = spark.createDataFrame([("2021-01-01", 1), ("2021-06-01", 2)], "snapshot string, v int")
    writers.write_by(snaps, "snapshot", str(tmp_path / "root" / "OU_IM"))
    assert [r.v for r in readers.read_latest(spark, str(tmp_path / "root"), "OU_IM").collect()] == [2]
    writers.write_extracts({"a": df, "b": df}, str(tmp_path / "extracts"))
    assert (tmp_path / "extracts" / "b").is_dir()


def test_scope_by_list(spark):
    rows = [("Oct to Dec 2019", "TX_CURR", "N"), ("Jan to Mar 2020", "TX_CURR", "N"), ("Oct to Dec 2019", "TX_PVLS", "N")]
    df = spark.createDataFrame(rows, "`Period` string, `Technical Area` string, `Top Level` string")
    assert readers.scope_extract(df, ["2019Q4"], ["TX_CURR"]).count() == 1


def test_stage_uses_the_shared_folder(spark):
    df = spark.range(5).withColumn("s", F.lit("a"))
    staged = stage(df, "t")
    assert staged.dtypes == df.dtypes
    assert staged.count() == 5
    folder = spark.conf.get("spark.checkpoint.dir").replace("file:", "")
    assert any(folder in f for f in staged.inputFiles())


def test_clear_stages_leaves_nothing(spark, tmp_path, monkeypatch):
    assert run_folder(spark).endswith(f"panelwise-{spark.sparkContext.applicationId}")
    monkeypatch.setattr(stages, "run_folder", lambda s: str(tmp_path / "run"))
    stage(spark.range(5), "t")
    assert len(list((tmp_path / "run").iterdir())) == 1
    clear_stages(spark)
    assert not list(tmp_path.iterdir())


def test_spec_names(spark):
    assert PanelSpec().key == ["orgunituid", "mech_code", "period_idx"]
    assert PanelSpec(site="clinic").key[0] == "clinic"
