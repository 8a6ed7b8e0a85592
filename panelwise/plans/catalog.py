"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.columns import any_nonzero, percent_text
from panelwise.functions.periods import (
    calendar_quarter,
    fiscal_index,
    fiscal_label,
    index_label,
    quarter_list,
)
from panelwise.operators import flags as fl
from panelwise.operators import net_change as nc
from panelwise.operators.clean import clean_extract, country_dim, country_dim_from, org_hierarchy
from panelwise.operators.grid import (
    complete,
    fill_down_up,
    period_bound,
    period_table,
    with_exits,
)
from panelwise.operators.groups import display_rank, shares_of, top_n_ties
from panelwise.operators.joins import difference
from panelwise.operators.ratio import ratio_aggregate, ratio_compare, ratio_validated
from panelwise.operators.review import multi_owner_pairs, multi_owner_sites
from panelwise.operators.shape import arrange_columns, stack
from panelwise.plans import pipeline, reports
from panelwise.sources import testbed as tb
from panelwise.sources.readers import (
    FLAGS_SCHEMA,
    latest_snapshot,
    read_extract,
    read_latest,
    scope_extract,
    typed_schema,
)
from panelwise.sources.stages import run_folder, stage, stage_by
from panelwise.sources.writers import write_by, write_extracts
from panelwise.spec import FLAG_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]

PAIR = ["orgunituid", "mech_code", "period"]
OWNER = ["mech_code", "fundingagency"]
# Parameters the published reports set as literals, for the test panel.
UNIT = "ASIA"
COUNTRY = "NATION_7"
QUARTER = "FY98Q4"
FISCAL_YEAR = "FY99"
STOPPED_IN = "FY99Q1"
UNIT_NAMES = {"MIDDLE EAST": "ME", "AMERICA": "AM"}
REGIONAL = "AMERICA|ASIA"
PSEUDO = ("5",)
LISTED = ["FY97Q4", "FY98Q1", "FY98Q2", "FY98Q3", "FY98Q4", "FY99Q1", "FY99Q2", "FY99Q3"]
SINCE, SKIP, DROP = 1996, ("FY96Q1", "FY96Q2"), "FY96"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return tb.orders_panel(spark, d)


def _labelled(df: DataFrame, *columns: str) -> DataFrame:
    """Period labels instead of indexes, at the very end of a plan."""
    out = fl.label_periods(df)
    return out.select(*columns) if columns else out.drop("period_idx")


def _staged_panel(spark: SparkSession, d: str) -> DataFrame:
    return stage(_panel(spark, d), "panel")


def _named_panel(spark: SparkSession, d: str) -> DataFrame:
    return fl.label_periods(tb.with_names(spark, d, _panel(spark, d)))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.flags_stage(_panel(spark, d))


def _name(spark: SparkSession, d: str, flags: DataFrame) -> DataFrame:
    return fl.label_periods(
        fl.attach_metadata(flags, tb.owner_dim(spark, d), tb.org_dim(spark, d))
    )


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return _name(spark, d, _flags(spark, d))


def _flagged_with_start(spark: SparkSession, d: str):
    """Flagged rows, and the first period as the staged panel has it.

    Reading the bound from the panel keeps the flags out of the subquery.
    """
    panel = _staged_panel(spark, d)
    first = period_bound(panel.where(F.col("value").isNotNull()), "min")
    return _name(spark, d, fl.flag_panel(panel, stage=stage)), first


def _review(spark: SparkSession, d: str) -> DataFrame:
    flagged, first = _flagged_with_start(spark, d)
    return reports.after_first_period(flagged, first_period=first)


def _extracts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    flagged, first = _flagged_with_start(spark, d)
    return fl.transition_extracts(flagged, excluded_groups=(tb.DEDUP,), first_period=first)


def _ends(spark: SparkSession, d: str) -> DataFrame:
    return _extracts(spark, d)["ends"]


def _staged_flags(spark: SparkSession, d: str) -> DataFrame:
    return stage(_flags(spark, d), "flags")


def _combined(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both net changes, and the period table they were stepped along."""
    flags = _staged_flags(spark, d)
    periods = stage(nc.net_change_periods(flags), "periods")
    std, adj = nc.net_change_standard(flags, periods=periods), nc.net_change_adjusted(flags, periods=periods)
    return nc.combine_net_change(std, adj), periods


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    combined, periods = _combined(spark, d)
    return nc.attribute_transfers(stage(combined, "net_change"), periods=periods)


def _net_change(spark: SparkSession, d: str, lag_mode: str = "rows", lag: int = 2) -> DataFrame:
    return pipeline.net_change_stage(_panel(spark, d), lag_mode=lag_mode, lag=lag)


def _review_net_change(spark: SparkSession, d: str) -> DataFrame:
    panel = _staged_panel(spark, d)
    nn = nc.net_change_panel(stage(fl.flag_panel(panel, stage=stage), "flags"), stage=stage)
    first = period_bound(panel.where(F.col("value").isNotNull()), "min")
    return reports.after_first_period(_name(spark, d, nn), first_period=first)


def _by_site(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Panel and ratio rows, dealt by site, and the owners.

    Sums are dealt: a site has at most two rows per owner and quarter, however many orders.
    The owners are written so that the planner knows their size; else it would deal the
    rows by owner to meet them.
    """
    return {
        "panel": stage_by(_panel(spark, d), "panel", "orgunituid"),
        "ratio": stage_by(tb.ratio_panel(spark, d, by_site=True), "ratio_panel", "orgunituid", deal=False),
        "owners": stage(tb.owner_dim(spark, d), "owners"),
    }


def _final(spark: SparkSession, d: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    tables = _by_site(spark, d) if tables is None else tables
    return pipeline.final_stage(
        tables["panel"], tables["ratio"], tables["owners"], tb.org_dim(spark, d), dealt=True
    )


# -- extract and panel ----------------------------------------------------------


def fiscal_periods(spark, d):
    date = F.col("o_orderdate").cast("date")
    return (
        tb.table(spark, d, "orders")
        .groupBy(fiscal_label(date).alias("period"), calendar_quarter(date).alias("quarter"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quarters(spark, d):
    """Orders per quarter of the generated quarter list."""
    wanted = quarter_list(spark, "1995Q1", "2001Q3")
    rows = tb.table(spark, d, "orders").select(calendar_quarter("o_orderdate").alias("quarter"))
    return wanted.join(reports.count_by(rows, ["quarter"]), "quarter", "left")


def orders_panel(spark, d):
    return _labelled(_panel(spark, d))


def clean_extract_query(spark, d):
    clean = clean_extract(
        tb.raw_extract(spark, d), tb.country_list(spark, d), tb.agency_list(spark, d)
    )
    return clean.drop("period_idx")


def scope_extract_query(spark, d):
    scoped = scope_extract(
        tb.raw_extract(spark, d),
        quarter_list(spark, "1996Q1", "1998Q4"),
        ["TX_CURR", "TX_PVLS"],
        ["Top Level Numerator"],
    )
    return reports.count_by(scoped, ["Period", "Technical Area", "Top Level"])


def latest_snapshot_query(spark, d):
    orders = tb.table(spark, d, "orders").withColumn("snapshot", fiscal_index("o_orderdate"))
    newest = latest_snapshot(orders)
    return newest.select("o_orderkey", index_label("snapshot").alias("snapshot"), "o_totalprice")


def densify_panel(spark, d):
    narrow = _panel(spark, d).select("orgunituid", "mech_code", "period_idx", "value")
    grid = complete(stage(narrow, "panel"), "period_idx", ["orgunituid", "mech_code"], {"value": 0.0})
    return _labelled(grid)


def fill_down_up_query(spark, d):
    narrow = stage(_panel(spark, d).select("orgunituid", "mech_code", "period_idx", "value"), "panel")
    keys = ["orgunituid", "mech_code"]
    filled = fill_down_up(complete(narrow, "period_idx", keys), ["value"], keys, ["period_idx"])
    return _labelled(filled)


def sparse_exits(spark, d):
    panel = _staged_panel(spark, d)
    rows = with_exits(panel, ["orgunituid", "mech_code"], period_table(panel))
    return _labelled(rows, *PAIR, "value", "prior", "observed")


# -- flags ----------------------------------------------------------------------


def lone_obs(spark, d):
    return _labelled(fl.flag_lone_obs(_staged_panel(spark, d)), *PAIR, "flag_loneobs")


def multi_owner(spark, d):
    rows = fl.flag_multi_owner(_staged_panel(spark, d))
    return _labelled(rows, *PAIR, "flag_multimech_site")


def end_flags(spark, d):
    rows = fl.flag_end(_staged_panel(spark, d))
    return _labelled(rows, *PAIR, "last_obs_site", "last_obs_sitexmech", "flag_end_sitexmech")


def end_types(spark, d):
    rows = fl.classify_end(_staged_panel(spark, d))
    return _labelled(rows, *PAIR, "flag_end_sitexmech", "end_type")


def transition_parties(spark, d):
    out = fl.transition_parties(_staged_panel(spark, d))
    return _labelled(out, *PAIR, "end_type", "agency_exiting", "agency_inheriting")


def method_validity(spark, d):
    return _labelled(_flags(spark, d), *PAIR, "method", "vlc_valid")


def attach_metadata(spark, d):
    return _flagged(spark, d).drop("period_idx")


def part_supplier_flags(spark, d):
    return _labelled(pipeline.flags_stage(tb.lineitem_panel(spark, d)))


def crowded_supplier_flags(spark, d):
    """The same flags; rows of part-periods with several rows are dealt by supplier as well."""
    panel = stage(tb.lineitem_panel(spark, d), "panel")
    return _labelled(fl.flag_panel(panel, stage=stage, crowded=1))


def part_supplier_net_change(spark, d):
    return _labelled(pipeline.net_change_stage(tb.lineitem_panel(spark, d)))


def ends_out(spark, d):
    return _extracts(spark, d)["out"]


def ever_multi_sites(spark, d):
    flags = _staged_flags(spark, d)
    multi = fl.transition_extracts(flags, excluded_groups=(tb.DEDUP,))["multi"]
    return _labelled(multi, *PAIR, "value", "flag_multimech_site")


# -- net change -----------------------------------------------------------------


def net_change_standard(spark, d):
    rows = nc.net_change_standard(_staged_flags(spark, d))
    return _labelled(rows.where(any_nonzero("tx_curr", "tx_net_new")), *PAIR, "tx_curr", "tx_net_new")


def net_change_adjusted(spark, d):
    return _labelled(nc.net_change_adjusted(_staged_flags(spark, d)))


def net_change_combined(spark, d):
    rows = nc.net_change_plus(_combined(spark, d)[0])
    return _labelled(
        rows,
        *PAIR,
        "tx_curr",
        "tx_net_new",
        "tx_curr_lag_site",
        "tx_net_new_adj",
        "tx_net_new_adj_plus",
    )


def transfers(spark, d):
    return _labelled(_transfers(spark, d), *PAIR, "tx_xfer")


def flags_propagated(spark, d):
    return _labelled(nc.propagate_flags(_transfers(spark, d)), *PAIR, "tx_xfer", *FLAG_COLUMNS)


def net_change_full(spark, d):
    return _labelled(_net_change(spark, d))


def lag2_rows(spark, d):
    return _labelled(_net_change(spark, d), *PAIR, "tx_curr_lag2_site")


def lag2_periods(spark, d):
    return _labelled(_net_change(spark, d, "periods"), *PAIR, "tx_curr_lag2_site")


def lag1_periods(spark, d):
    return _labelled(_net_change(spark, d, "periods", 1), *PAIR, "tx_curr_lag1_site")


def lag3_rows(spark, d):
    return _labelled(_net_change(spark, d, "rows", 3), *PAIR, "tx_curr_lag3_site")


def ratio_valid(lag):
    return lambda spark, d: _labelled(
        fl.flag_ratio_valid(_staged_panel(spark, d), lag=lag), *PAIR, "vlc_valid"
    )


def ratio_merge(spark, d):
    return _final(spark, d).select(
        *PAIR, "tx_curr", "tx_net_new", "tx_pvls_d", "tx_pvls", "method", "vlc_valid"
    )


# -- reports --------------------------------------------------------------------

SHARES = ("share", "cum_share")


def owner_pairs(spark, d):
    flagged, first = _flagged_with_start(spark, d)
    return multi_owner_pairs(flagged, group_strip="De|up", first_period=first, stage=stage)


def owner_sites(spark, d):
    flagged, first = _flagged_with_start(spark, d)
    return multi_owner_sites(flagged, group_strip="De|up", first_period=first, stage=stage)


def sites_with_owners(spark, d):
    out = reports.multi_owner_histogram(_named_panel(spark, d), stage=stage)
    return out.drop("period_idx")


def multi_share_by_period(spark, d):
    return rounded(reports.multi_share(fl.label_periods(_panel(spark, d)), ["period"]), "share_multi")


def multi_share_wide(spark, d):
    out = reports.multi_share_wide(_named_panel(spark, d), stage=stage)
    return rounded(out, *[c for c in out.columns if c != "operatingunit"])


def multi_share_labels(spark, d):
    """Units in the order of their latest stock."""
    order = reports.unit_order(tb.with_names(spark, d, _staged_panel(spark, d)), UNIT_NAMES)
    return reports.multi_share_labels(_named_panel(spark, d), UNIT_NAMES, unit_order=order)


def pairs_lost(spark, d):
    return _labelled(reports.pairs_lost(_staged_panel(spark, d)))


def orders_moved(spark, d):
    """How many more orders of an owner a customer has in one quarter than in the next: a bag difference."""
    orders = tb.table(spark, d, "orders").select(
        F.col("o_custkey").alias("orgunituid"), F.substring("o_orderpriority", 1, 1).alias("mech_code"), fiscal_index("o_orderdate").alias("period_idx")
    )
    keys = ["orgunituid", "mech_code", "period_idx"]
    more = difference(orders, orders.withColumn("period_idx", F.col("period_idx") - 1), keys, bag=True)
    return _labelled(reports.count_by(more, keys))


def median_order_rank(spark, d):
    """Customers by the median of their orders' totals, which is found by counting."""
    orders = tb.table(spark, d, "orders")
    return display_rank(orders, "o_custkey", "o_totalprice", "median", desc=True, name="customer_rank")


def customers_by_orders(spark, d):
    """Running share of orders over all customers, many of which tie."""
    return rounded(shares_of(tb.table(spark, d, "orders"), "o_custkey"), *SHARES)


def largest_customers(spark, d):
    """The ten customers with most orders, and all that tie with the last of them."""
    return top_n_ties(reports.count_by(tb.table(spark, d, "orders"), ["o_custkey"]), "n", 10)


def trailing_sites(spark, d):
    """Sites of the last four quarters, with a flag that the sketches agree to 5 %."""
    out = reports.trailing_sites(_staged_panel(spark, d), 4, stage=stage)
    near = F.abs(F.col("approx_sites") - F.col("sites")) <= 0.05 * F.col("sites")
    return _labelled(out.withColumn("near", near), "period", "sites", "near")


def multi_rows_one_unit(spark, d):
    multi = tb.with_names(spark, d, reports.multi_rows(_staged_panel(spark, d)))
    out = fl.label_periods(reports.rows_of_unit(multi, UNIT))
    return out.select("period", "operatingunit", "facility", "orgunituid", "mech_code", "fundingagency", "value")


def multi_counts_ranked(spark, d):
    out = reports.multi_counts_ranked(_named_panel(spark, d), REGIONAL, stage=stage)
    return out.drop("period_idx")


def multi_unit_count(spark, d):
    return reports.multi_unit_count(reports.multi_counts_ranked(_named_panel(spark, d), REGIONAL, stage=stage))


def largest_countries(spark, d):
    sites = _review(spark, d).select("period_idx", "countryname", "orgunituid")
    return rounded(reports.largest_countries(stage(sites, "review")), *SHARES)


def transition_share(spark, d):
    return rounded(reports.transition_share(_review(spark, d)).drop("period_idx"), "share")


def transition_headline(spark, d):
    out = reports.transition_headline(_review(spark, d), QUARTER)
    text = out.withColumn("quarter_percent", percent_text("quarter_share"))
    return rounded(text, "quarter_share", "mean_share_not_q4")


def multi_site_share(spark, d):
    return rounded(reports.multi_site_share(_review(spark, d)).drop("period_idx"), "share")


def multi_site_share_mean(spark, d):
    return rounded(reports.multi_site_share_mean(_review(spark, d)), "share")


def site_type_shares(spark, d):
    out = reports.site_type_shares(_review(spark, d)).drop("period_idx")
    return rounded(out, "share_result", "share_sites")


def site_type_multi(spark, d):
    rows = stage(_review(spark, d).select(
        "operatingunit", "period_idx", "period", "method", "value"), "review")
    out = reports.site_type_multi(rows, LISTED, UNIT_NAMES).drop("period_idx", "tx_curr")
    return rounded(out, "share_result", "share_sites")


CHANGES = ("tx_net_new", "tx_net_new_adj_plus")  # differences of doubles


def net_change_by_owner(spark, d):
    out = reports.net_change_by_owner(_review_net_change(spark, d), stage=stage)
    return rounded(out.drop("period_idx"), *CHANGES)


def _by_owner(spark, d):
    return reports.net_change_by_owner(_review_net_change(spark, d), PSEUDO, stage=stage)


def net_change_by_true_owner(spark, d):
    return rounded(_by_owner(spark, d).drop("period_idx"), *CHANGES)


def net_change_delta_long(spark, d):
    return rounded(reports.net_change_delta_long(_by_owner(spark, d), FISCAL_YEAR, STOPPED_IN), "value")


def net_change_labels(spark, d):
    long = reports.net_change_delta_long(_by_owner(spark, d), FISCAL_YEAR, STOPPED_IN)
    return rounded(reports.net_change_labels(long, PSEUDO, stage=stage), "value", "match")


def _aggregate(spark, d, lag_keys=None, wide=None):
    return ratio_aggregate(
        stage(tb.fiscal_wide(spark, d), "fiscal") if wide is None else wide,
        since=SINCE,
        skip_periods=SKIP,
        drop_year=DROP,
        excluded_group=tb.DEDUP,
        lag_keys=lag_keys,
    )


def ratio_aggregate_query(spark, d):
    return _aggregate(spark, d).drop("period_idx")


def ratio_aggregate_by_partner(spark, d):
    return _aggregate(spark, d, ["primepartner"]).drop("period_idx")


def ratio_aggregate_stacked(spark, d):
    """The wide table as it comes: a current and a historic one, put under each other."""
    wide = stage(tb.fiscal_wide(spark, d), "fiscal")
    historic, current = (wide.where(c) for c in ("fiscal_year < 1998", "fiscal_year >= 1998"))
    return _aggregate(spark, d, wide=stack(current, historic)).drop("period_idx")


def _validated(spark, d, tables=None):
    return ratio_validated(_final(spark, d, tables), drop_year=DROP, excluded_group=tb.DEDUP)


def ratio_validated_query(spark, d):
    return _validated(spark, d).drop("period_idx")


def _compare(spark, d):
    tables = _by_site(spark, d)
    wide = stage(tb.fiscal_wide(spark, d, tables["panel"], tables["ratio"], tables["owners"]), "fiscal")
    validated = stage(_validated(spark, d, tables), "validated")
    out = ratio_compare(_aggregate(spark, d, wide=wide), validated, stage=stage)
    return rounded(out.drop("period_idx"), "vlc", "top_ln", "pd_min", "pd_max")


def ratio_compare_one_unit(spark, d):
    return _compare(spark, d).where(F.col("operatingunit") == UNIT)


def site_history_wide(spark, d):
    nn = stage(_net_change(spark, d), "net_change_full")
    return reports.site_history_wide(fl.label_periods(nn))


# -- files ----------------------------------------------------------------------


def landed_extract(spark, d):
    """The raw extract, landed as text files split by indicator, read back and cleaned."""
    raw = tb.raw_extract(spark, d)
    path = f"{run_folder(spark)}/landed-{uuid4().hex}"
    write_by(raw, "Technical Area", path, "csv", compression="gzip")
    landed = read_extract(spark, path, typed_schema(raw.columns))
    clean = clean_extract(landed, tb.country_list(spark, d), tb.agency_list(spark, d))
    return clean.drop("period_idx")


def landed_by_unit(spark, d):
    """The review sheet of sites with several owners, a folder per operating unit, read back."""
    flagged, first = _flagged_with_start(spark, d)
    rows = reports.after_first_period(flagged, first_period=first).where("flag_multimech_site")
    rows = rows.select("operatingunit", "orgunituid", "snu1", "psnu", "facility", *OWNER, "period", "value")
    path = f"{run_folder(spark)}/review-{uuid4().hex}"
    write_by(rows, "operatingunit", path)
    return spark.read.schema(rows.schema).parquet(path)


def landed_snapshot(spark, d):
    """Orders landed as a snapshot per fiscal quarter; the newest is read by its folder's name."""
    root = f"{run_folder(spark)}/snapshots-{uuid4().hex}"
    orders = tb.table(spark, d, "orders").withColumn("snapshot", fiscal_index("o_orderdate"))
    write_by(orders.select("o_orderkey", "o_totalprice", "snapshot"), "snapshot", f"{root}/orders")
    newest = read_latest(spark, root, "orders")
    return newest.select("o_orderkey", index_label("snapshot").alias("snapshot"), "o_totalprice")


def landed_flags(spark, d):
    """The flags as a text file, read back with their schema."""
    path = f"{run_folder(spark)}/extracts-{uuid4().hex}"
    write_extracts({"flags": _flagged(spark, d).select(*FLAGS_SCHEMA.names)}, path)
    return read_extract(spark, f"{path}/flags", FLAGS_SCHEMA)


def country_levels(spark, d):
    nation, region = tb.table(spark, d, "nation"), tb.table(spark, d, "region")
    levels = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("country_name"), F.col("r_name").alias("name3"), (F.col("n_nationkey") % 3 + 4).alias("facility")
    )
    supplying = nation.join(tb.table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    units = supplying.select(F.col("n_name").alias("displayName"), F.format_string("id%d", "n_nationkey").alias("id"))
    return country_dim_from(levels, units)


def country_list_query(spark, d):
    """Countries with the levels of their units and facilities, these next to the unit's name."""
    nation, region = tb.table(spark, d, "nation"), tb.table(spark, d, "region")
    raw = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("operatingunit"),
        F.col("n_name").alias("countryname"),
        F.format_string("id%d", "n_nationkey").alias("countryname_uid"),
        (F.col("n_nationkey") % 2 + 3).alias("psnu_lvl"),
        (F.col("n_nationkey") % 3 + 4).alias("facility_lvl"),
        F.lit("unused").alias("comment"),
    )
    return arrange_columns(country_dim(raw), after=("operatingunit", ["psnu_lvl", "site_lvl"]))


def unit_hierarchy(spark, d):
    units = tb.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("uid"), F.when(F.col("n_nationkey") % 2 == 0, "OU").otherwise("region").alias("type")
    )
    sites = tb.table(spark, d, "customer").select(F.col("c_nationkey").alias("uid"), F.col("c_custkey").alias("site"))
    return org_hierarchy(units, sites)


def queries() -> dict[str, Query]:
    def on_ends(key):
        return lambda s, d: rounded(reports.ends_by(_ends(s, d), key), *SHARES)

    return {
        "fiscal_periods": fiscal_periods,
        "quarter_list": quarters,
        "orders_panel": orders_panel,
        "clean_extract": clean_extract_query,
        "scope_extract": scope_extract_query,
        "latest_snapshot": latest_snapshot_query,
        "densify_panel": densify_panel,
        "fill_down_up": fill_down_up_query,
        "sparse_exits": sparse_exits,
        "lone_obs": lone_obs,
        "multi_owner": multi_owner,
        "end_flags": end_flags,
        "end_types": end_types,
        "transition_parties": transition_parties,
        "method_validity": method_validity,
        "attach_metadata": attach_metadata,
        "part_supplier_flags": part_supplier_flags,
        "crowded_supplier_flags": crowded_supplier_flags,
        "part_supplier_net_change": part_supplier_net_change,
        "ends_out": ends_out,
        "ever_multi_sites": ever_multi_sites,
        "ends_by_unit": on_ends("operatingunit"),
        "ends_by_period": on_ends("period"),
        "ends_by_type": on_ends("end_type"),
        "agencies_losing": lambda s, d: reports.ends_by_party(_ends(s, d), "agency_exiting"),
        "agencies_gaining": lambda s, d: reports.ends_by_party(_ends(s, d), "agency_inheriting"),
        "net_change_standard": net_change_standard,
        "net_change_adjusted": net_change_adjusted,
        "net_change_combined": net_change_combined,
        "transfers": transfers,
        "flags_propagated": flags_propagated,
        "net_change_full": net_change_full,
        "lag2_rows": lag2_rows,
        "lag2_periods": lag2_periods,
        "lag1_periods": lag1_periods,
        "lag3_rows": lag3_rows,
        "ratio_valid_lag1": ratio_valid(1),
        "ratio_valid_lag3": ratio_valid(3),
        "ratio_merge": ratio_merge,
        "multi_owner_pairs": owner_pairs,
        "multi_owner_sites": owner_sites,
        "multi_owner_histogram": sites_with_owners,
        "multi_share_by_period": multi_share_by_period,
        "multi_share_wide": multi_share_wide,
        "multi_share_labels": multi_share_labels,
        "multi_rows_one_unit": multi_rows_one_unit,
        "multi_counts_ranked": multi_counts_ranked,
        "multi_unit_count": multi_unit_count,
        "units_by_latest_stock": lambda s, d: reports.units_by_latest_stock(
            tb.with_names(s, d, _staged_panel(s, d)), UNIT_NAMES
        ),
        "sites_per_period": lambda s, d: reports.sites_per_period(
            reports.after_first_period(fl.label_periods(_staged_panel(s, d)))
        ).drop("period_idx"),
        "sites_headline": lambda s, d: rounded(
            reports.sites_headline(
                reports.after_first_period(fl.label_periods(_staged_panel(s, d)))
            ), "mean_sites"
        ),
        "largest_countries": largest_countries,
        "transition_share": transition_share,
        "transition_headline": transition_headline,
        "ends_period_type": lambda s, d: reports.ends_period_type(_review(s, d)).drop("period_idx"),
        "multi_site_share": multi_site_share,
        "multi_site_share_mean": multi_site_share_mean,
        "multi_site_share_without_owner": lambda s, d: rounded(
            reports.multi_site_share(reports.after_first_period(_flagged(s, d), excluded_owners=PSEUDO)).drop("period_idx"),
            "share",
        ),
        "site_type_shares": site_type_shares,
        "site_type_multi": site_type_multi,
        "net_change_by_owner": net_change_by_owner,
        "net_change_by_true_owner": net_change_by_true_owner,
        "net_change_delta_long": net_change_delta_long,
        "net_change_labels": net_change_labels,
        "ratio_aggregate": ratio_aggregate_query,
        "ratio_aggregate_by_partner": ratio_aggregate_by_partner,
        "ratio_aggregate_stacked": ratio_aggregate_stacked,
        "ratio_validated": ratio_validated_query,
        "ratio_compare": _compare,
        "ratio_compare_one_unit": ratio_compare_one_unit,
        "lone_obs_wide": lambda s, d: reports.lone_obs_wide(_review(s, d), None, PSEUDO, stage=stage),
        "exits_by_country": lambda s, d: reports.exits_by_country(_review(s, d)),
        "country_type_shares": lambda s, d: rounded(
            reports.country_type_shares(_review(s, d), COUNTRY, QUARTER), "share"
        ),
        "country_pairs": lambda s, d: reports.country_pairs(_review(s, d)),
        "site_history_wide": site_history_wide,
        "pairs_lost": pairs_lost,
        "orders_moved": orders_moved,
        "median_order_rank": median_order_rank,
        "customers_by_orders": customers_by_orders,
        "largest_customers": largest_customers,
        "trailing_sites": trailing_sites,
        "landed_by_unit": landed_by_unit,
        "landed_snapshot": landed_snapshot,
        "landed_extract": landed_extract,
        "landed_flags": landed_flags,
        "country_levels": country_levels,
        "country_list": country_list_query,
        "unit_hierarchy": unit_hierarchy,
    }
