"""Report tables on the flagged panel and the net-change table.

Every report aggregates first; windows and ranks then run on tables with one row
per unit, country, period or owner.  An aggregate that is used more than once is
staged, so that the panel behind it is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import (
    display_name,
    null_if_zero,
    ratio,
    recode,
    round_half_even,
    sum0,
)
from panelwise.functions.periods import index_label
from panelwise.operators.clean import country_name
from panelwise.operators.grid import complete, period_bound
from panelwise.operators.groups import (
    add_cum_share,
    add_share,
    count_by,
    count_distinct_by,
    display_rank,
    filter_extreme,
    filter_group,
    list_rank,
    shares_of,
    sum0_by,
    top_n_ties,
)
from panelwise.operators.joins import difference, join_nullsafe
from panelwise.operators.shape import to_long, to_wide
from panelwise.operators.sketches import distinct_sketches, merged_count
from panelwise.spec import (
    ADJUSTED,
    AGENCY_NAMES,
    DEFAULT_SPEC,
    PSEUDO_OWNERS,
    UNIT_NAMES,
    EndLabels,
    PanelSpec,
)

S = DEFAULT_SPEC
NOISE = 6  # decimals beyond which a difference of doubles is noise


def as_is(df: DataFrame, name: str) -> DataFrame:
    """In the place of ``stage``: the plan goes on."""
    return df


def after_first_period(
    df: DataFrame,
    spec: PanelSpec = S,
    excluded_owners: tuple[str, ...] = (),
    first_period: Column | int | None = None,
) -> DataFrame:
    """Rows the reviews look at: without the first period and the listed owners."""
    first = period_bound(df, "min", spec) if first_period is None else first_period
    out = df.where(F.col(spec.index) != first)
    return out.where(~F.col(spec.owner).isin(*excluded_owners)) if excluded_owners else out


# -- ends ---------------------------------------------------------------------


def ends_by(ends: DataFrame, key: str) -> DataFrame:
    """Ends per unit, period or type, largest first, with running share."""
    return shares_of(ends, key)


def ends_by_party(ends: DataFrame, party: str, labels: EndLabels = EndLabels()) -> DataFrame:
    """Group changes per group that leaves or takes over."""
    return count_by(ends.where(F.col("end_type") == labels.agency), [party])


def ends_period_type(df: DataFrame, spec: PanelSpec = S) -> DataFrame:
    """Ends per period and type."""
    keys = [spec.index, spec.period, "end_type"]
    rows = df.where("flag_end_sitexmech")
    return count_distinct_by(rows, keys, [spec.owner, spec.site], "trans_mech_sites")


def transition_share(df: DataFrame, spec: PanelSpec = S) -> DataFrame:
    """Share of (site, owner) pairs that end, per period with any end."""
    keys = [spec.index, spec.period]
    pairs = df.groupBy(*keys, spec.owner, spec.site).agg(F.max("flag_end_sitexmech").alias("ends"))
    counts = pairs.groupBy(*keys).agg(
        F.count_if("ends").alias("trans_mech_sites"), F.count(F.lit(1)).alias("all_mech_sites")
    )
    ended = counts.where(F.col("trans_mech_sites") > 0)
    return ended.withColumn("share", ratio("trans_mech_sites", "all_mech_sites"))


def transition_headline(df: DataFrame, quarter: str, spec: PanelSpec = S) -> DataFrame:
    """One quarter's share, and the mean share outside fourth quarters."""
    per = transition_share(df, spec)
    label = F.col(spec.period)
    return per.agg(
        F.max(F.when(label == quarter, F.col("share"))).alias("quarter_share"),
        F.avg(F.when(~label.contains("Q4"), F.col("share"))).alias("mean_share_not_q4"),
    )


def exits_by_country(
    df: DataFrame, quarter: str | None = None, spec: PanelSpec = S, labels: EndLabels = EndLabels()
) -> DataFrame:
    """Pairs that leave the programme, per country and period, largest first."""
    rows = df.where(F.col("end_type") == labels.out)
    if quarter:
        rows = rows.where(F.col(spec.period) == quarter)
    keys = ["countryname", spec.period, "end_type"]
    out = count_distinct_by(rows, keys, [spec.site, spec.owner], "exit_sites")
    return out.orderBy(F.desc("exit_sites"), "countryname", spec.period)


def country_type_shares(df: DataFrame, country: str, quarter: str, spec: PanelSpec = S) -> DataFrame:
    """Share of each end type (and of no end) in one country and quarter."""
    rows = df.where((F.col("countryname") == country) & (F.col(spec.period) == quarter))
    keys = ["countryname", spec.period, "end_type"]
    return add_share(count_distinct_by(rows, keys, [spec.site, spec.owner]), "n")


def country_pairs(df: DataFrame, country: str | None = None, spec: PanelSpec = S) -> DataFrame:
    """(site, owner) pairs per country and period."""
    rows = df if country is None else df.where(F.col("countryname") == country)
    return count_distinct_by(rows, ["countryname", spec.period], [spec.site, spec.owner])


def lone_obs_wide(
    df: DataFrame,
    periods: list[str] | None = None,
    pseudo_owners: tuple[str, ...] = PSEUDO_OWNERS,
    spec: PanelSpec = S,
    stage=as_is,
) -> DataFrame:
    """Lone observations per owner, one column per period, largest owner first."""
    rows = df.where(F.col("flag_loneobs") & ~F.col(spec.owner).isin(*pseudo_owners))
    counts = stage(count_distinct_by(rows, [spec.owner, spec.index, spec.period], [spec.site]), "lone_counts")
    top = counts.groupBy(spec.owner).agg(F.max("n").alias("max"))
    wide = to_wide(counts, [spec.owner], spec.period, "n", periods, order=spec.index)
    return wide.join(top, spec.owner).orderBy(F.desc("max"), spec.owner)


# -- sites with several owners ------------------------------------------------


def multi_owner_histogram(
    panel: DataFrame, sizes: list[int] | None = None, spec: PanelSpec = S, stage=as_is
) -> DataFrame:
    """Sites by number of owners, per period and unit, one column per number that occurs."""
    keys = [spec.index, spec.period, spec.unit]
    owners = count_distinct_by(panel, [*keys, spec.site], [spec.owner], "owners")
    sites = stage(count_by(owners, [*keys, "owners"], name="sites"), "owner_counts")
    return to_wide(sites, keys, "owners", "sites", sizes, prefix="owners_")


def multi_share(panel: DataFrame, keys: list[str], spec: PanelSpec = S) -> DataFrame:
    """Sites with one and with several owners, and the share of the latter."""
    owners = count_distinct_by(panel, [*keys, spec.site], [spec.owner], "owners")
    sizes = owners.groupBy(*keys).agg(
        F.count_if(F.col("owners") == 1).alias("single"),
        F.count_if(F.col("owners") > 1).alias("multi"),
    )
    return sizes.withColumn("share_multi", ratio("multi", F.col("single") + F.col("multi")))


def multi_share_wide(
    panel: DataFrame, periods: list[str] | None = None, spec: PanelSpec = S, stage=as_is
) -> DataFrame:
    """Share of sites with several owners, units by periods."""
    long = stage(multi_share(panel, [spec.unit, spec.index, spec.period], spec), "unit_shares")
    return to_wide(long, [spec.unit], spec.period, "share_multi", periods, order=spec.index)


def multi_share_labels(
    panel: DataFrame,
    names: dict[str, str] = UNIT_NAMES,
    spec: PanelSpec = S,
    unit_order: DataFrame | None = None,
    by: str = "unit_rank",
) -> DataFrame:
    """The same in long form, rounded, zeros as null, units by display name.

    ``unit_order`` (display name, ``by``) gives the place of each unit in the chart.
    """
    long = multi_share(panel, [spec.unit, spec.period], spec)
    named = long.withColumns(
        {
            "share_multi": null_if_zero(round_half_even("share_multi", 2)),
            spec.unit: recode(spec.unit, names),
        }
    )
    if unit_order is None:
        return named
    return join_nullsafe(named, list_rank(named, spec.unit, unit_order, by, "unit_rank"), [spec.unit])


def unit_order(df: DataFrame, names: dict[str, str] = UNIT_NAMES, spec: PanelSpec = S) -> DataFrame:
    """Display names of units with their rank by stock in the latest period."""
    return display_rank(units_by_latest_stock(df, names, spec), spec.unit, "n", "max", desc=True, name="unit_rank")


def pairs_lost(panel: DataFrame, spec: PanelSpec = S) -> DataFrame:
    """(site, owner) pairs of each period that the next one on the calendar lacks."""
    keys = [spec.site, spec.owner, spec.index]
    rows = panel.where(F.col(spec.value).isNotNull())
    last = period_bound(panel, "max", spec)
    before = rows.select(spec.site, spec.owner, (F.col(spec.index) - 1).alias(spec.index))
    return difference(rows.where(F.col(spec.index) < last), before, keys)


def trailing_sites(panel: DataFrame, periods: int = 4, spec: PanelSpec = S, stage=as_is) -> DataFrame:
    """Distinct sites in the last ``periods`` periods up to each, exactly and from stored sketches.

    Each period's sketch is made once and counts for the periods that look back on it.
    """
    ends = F.explode(F.sequence(F.col(spec.index), F.col(spec.index) + (periods - 1)))
    sketches = stage(distinct_sketches(panel, [spec.index], [spec.site]), "site_sketches")
    known = sketches.select(F.col(spec.index).alias("_known"))
    near = merged_count(sketches.withColumn(spec.index, ends), [spec.index], name="approx_sites")
    pairs = panel.select(spec.site, spec.index).distinct().withColumn(spec.index, ends)
    exact = count_distinct_by(pairs, [spec.index], [spec.site], "sites")
    return exact.join(near, spec.index).join(known, F.col(spec.index) == F.col("_known"), "left_semi")


def multi_rows(panel: DataFrame, spec: PanelSpec = S) -> DataFrame:
    """Rows of site-periods with several rows."""
    return filter_group(panel, [spec.index, spec.site], F.count(F.lit(1)), 1)


def rows_of_unit(rows: DataFrame, unit: str, spec: PanelSpec = S) -> DataFrame:
    """One unit's rows, sorted."""
    return rows.where(F.col(spec.unit) == unit).orderBy(spec.site, spec.index, spec.owner)


def multi_counts_ranked(
    panel: DataFrame, regional: str = "Region", spec: PanelSpec = S, stage=as_is
) -> DataFrame:
    """Sites with one and several rows per country and period, for countries with
    more than one such case, with the country's rank by their total."""
    country = country_name(F.col(spec.unit), F.col("snu1"), regional)
    keys = [spec.index, spec.period, spec.unit, "country"]
    rows = count_by(panel.withColumn("country", country), [*keys, spec.site], name="rows")
    sizes = rows.groupBy(*keys).agg(
        F.count_if(F.col("rows") > 1).alias("multiple"),
        F.count_if(F.col("rows") == 1).alias("single"),
    )
    sizes = stage(sizes, "country_sizes")
    chosen = filter_group(sizes, [spec.unit, "country"], F.sum("multiple"), 1)
    ranks = display_rank(chosen, "country", "multiple", "sum", desc=True, name="country_rank")
    return join_nullsafe(chosen, ranks, ["country"]).withColumn("lab", null_if_zero("multiple"))


def multi_unit_count(ranked: DataFrame, spec: PanelSpec = S) -> DataFrame:
    return ranked.agg(F.countDistinct(spec.unit).alias("n"))


def multi_site_share(df: DataFrame, spec: PanelSpec = S) -> DataFrame:
    """Share of sites with several owners, per period."""
    keys = [spec.index, spec.period]
    flag = "flag_multimech_site"
    sites = count_distinct_by(df, [*keys, flag], [spec.site])
    return add_share(sites, "n", keys).where(flag)


def multi_site_share_mean(df: DataFrame, spec: PanelSpec = S) -> DataFrame:
    return multi_site_share(df, spec).agg(F.avg("share").alias("share"))


# -- sites and units ----------------------------------------------------------


def units_by_latest_stock(
    df: DataFrame, names: dict[str, str] = UNIT_NAMES, spec: PanelSpec = S
) -> DataFrame:
    """Units by stock in the latest period, largest first."""
    latest = filter_extreme(df, spec.index)
    total = count_by(latest, [spec.unit], wt=spec.value)
    return total.withColumn(spec.unit, recode(spec.unit, names)).orderBy(F.desc("n"), spec.unit)


def sites_per_period(df: DataFrame, spec: PanelSpec = S) -> DataFrame:
    return count_distinct_by(df, [spec.index, spec.period], [spec.site], "all_sites")


def sites_headline(df: DataFrame, spec: PanelSpec = S) -> DataFrame:
    """First and last period and the mean number of sites per period."""
    return sites_per_period(df, spec).agg(
        index_label(F.min(spec.index)).alias("first_period"),
        index_label(F.max(spec.index)).alias("last_period"),
        F.avg("all_sites").alias("mean_sites"),
    )


def largest_countries(df: DataFrame, n: int = 5, spec: PanelSpec = S) -> DataFrame:
    """Countries with most sites in the latest period, ties with the last included."""
    latest = filter_extreme(df, spec.index)
    sites = count_distinct_by(latest, ["countryname"], [spec.site])
    shares = add_cum_share(sites, "n", [F.desc("n"), F.asc("countryname")])
    return top_n_ties(shares, "n", n)


def site_type_shares(df: DataFrame, spec: PanelSpec = S) -> DataFrame:
    """Stock and rows by site type, with their shares per unit and period."""
    site_type = F.when(F.col("method") == ADJUSTED, "single").otherwise("multi")
    keys = [spec.unit, spec.index, spec.period]
    sums = (
        df.withColumn("site_type", site_type)
        .groupBy(*keys, "site_type")
        .agg(sum0(spec.value).alias("tx_curr"), F.count(F.lit(1)).alias("site_count"))
    )
    shares = add_share(sums, "tx_curr", keys, "share_result")
    return add_share(shares, "site_count", keys, "share_sites")


def site_type_multi(
    df: DataFrame,
    periods: list[str],
    names: dict[str, str] = UNIT_NAMES,
    spec: PanelSpec = S,
) -> DataFrame:
    """The multi part of the shares, 0 where a unit has none, with the unit's rank
    by stock in the latest period."""
    keys = [spec.unit, spec.index, spec.period]
    shares = site_type_shares(df, spec)
    full = complete(
        shares, "site_type", keys, {"share_result": 0.0, "share_sites": 0.0, "site_count": 0}
    )
    ranks = display_rank(
        filter_extreme(df, spec.index), spec.unit, spec.value, "sum", desc=True, name="unit_rank"
    )
    rows = full.where((F.col("site_type") == "multi") & F.col(spec.period).isin(*periods))
    ranked = join_nullsafe(rows, ranks, [spec.unit])
    return ranked.withColumn(spec.unit, recode(spec.unit, names))


# -- net change ---------------------------------------------------------------

MEASURES = ["tx_curr", "tx_net_new", "tx_net_new_adj_plus"]


def net_change_by_owner(
    nn: DataFrame, excluded_owners: tuple[str, ...] = (), spec: PanelSpec = S, stage=as_is
) -> DataFrame:
    """Stock and both net changes per unit, group, owner, partner and period.

    Owners whose last period is the table's first are left out.  ``order`` is the
    stock in the owner's last period (else 0), ``group_rank`` ranks the label by
    its largest ``order``.
    """
    rows = nn.where(~F.col(spec.owner).isin(*excluded_owners)) if excluded_owners else nn
    keys = [spec.unit, spec.group, spec.owner, "primepartner", spec.index, spec.period]
    named = rows.withColumn(spec.group, recode(spec.group, AGENCY_NAMES))
    sums = stage(sum0_by(named, keys, MEASURES), "owner_sums")
    last = sums.groupBy(spec.owner).agg(F.max(spec.index).alias("_last"))
    first = period_bound(sums, "min", spec)
    out = join_nullsafe(sums, last.where(F.col("_last") != first), [spec.owner], "inner").select(
        *sums.columns,
        index_label("_last").alias("max_pd"),
        F.when(F.col(spec.index) == F.col("_last"), F.col("tx_curr")).otherwise(0.0).alias("order"),
        display_name(spec.group, spec.owner, "primepartner").alias("group"),
    )
    ranks = display_rank(out, "group", "order", "max", desc=True, name="group_rank")
    return join_nullsafe(out, ranks, ["group"])


def net_change_delta_long(
    by_owner: DataFrame, fiscal_year: str, stopped_in: str, spec: PanelSpec = S
) -> DataFrame:
    """One fiscal year's totals of both measures, their difference, in long form.

    Owners whose last period is ``stopped_in`` are left out.
    """
    keys = [spec.unit, spec.group, spec.owner, "primepartner", "group"]
    rows = by_owner.where(
        F.col(spec.period).contains(fiscal_year) & (F.col("max_pd") != stopped_in)
    )
    both = MEASURES[1:]
    totals = rows.groupBy(*keys).agg(
        *[sum0(c).alias(c) for c in both], F.max("order").alias("order")
    )
    delta = F.round(F.col("tx_net_new_adj_plus") - F.col("tx_net_new"), NOISE)
    return to_long(totals.withColumn("delta", delta), [*keys, "order", "delta"], both)


def net_change_labels(
    long: DataFrame, excluded_owners: tuple[str, ...] = PSEUDO_OWNERS, spec: PanelSpec = S, stage=as_is
) -> DataFrame:
    """Labels and display order for the two measures; ``match`` where they agree."""
    rows = stage(long.where(~F.col(spec.owner).isin(*excluded_owners)), "owner_deltas")
    agrees = (F.col("delta") == 0) & (F.col("indicator") == "tx_net_new")
    labelled = rows.withColumns(
        {
            "mech_agency": F.concat(F.col(spec.group), F.lit(" "), F.col(spec.owner), F.lit(" ")),
            "match": F.when(agrees, F.col("value")),
        }
    )
    owners = display_rank(labelled, "mech_agency", "delta", "median", name="owner_rank")
    units = display_rank(labelled, spec.unit, "order", "sum", desc=True, name="unit_rank")
    return join_nullsafe(join_nullsafe(labelled, owners, ["mech_agency"]), units, [spec.unit])


def site_history_wide(
    nn: DataFrame, periods: list[str] | None = None, site: object | None = None, spec: PanelSpec = S
) -> DataFrame:
    """Stock and both net changes of a site's owners, one column per period."""
    measures = ["tx_curr", "tx_net_new", "tx_net_new_adj"]
    rows = nn if site is None else nn.where(F.col(spec.site) == site)
    long = to_long(rows, [spec.site, spec.owner, spec.index, spec.period], measures)
    return to_wide(long, [spec.site, spec.owner, "indicator"], spec.period, "value", periods, order=spec.index)
