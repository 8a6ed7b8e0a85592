"""Flags on a stock panel: lone observations, several owners, ends and their
type, net-change method and ratio validity.

Periods stay integer indexes here, also in ``last_obs_site`` and
``last_obs_sitexmech``; ``label_periods`` turns them into labels at the end.

A site may hold any number of owners, so no window here runs over the owners of
a site.  What is known per (site, owner) comes from windows over the periods of
that pair; what is known per site comes from a table with one row per (site,
period), built by a partial aggregate.  Both kinds of window hold at most one
row per period.  The two are joined on (site, period).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.functions.columns import false_if_null
from panelwise.functions.periods import index_label
from panelwise.operators.grid import on_periods, period_bound, period_table
from panelwise.operators.joins import enrich, join_crowded, join_within, keep_keys
from panelwise.spec import (
    ADJUSTED,
    DEDUP_AGENCY,
    DEFAULT_SPEC,
    FLAG_COLUMNS,
    STANDARD,
    EndLabels,
    PanelSpec,
)


def panel_periods(panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Period table of all rows (``all``) and of those with a value (``seen``)."""
    return period_table(panel, spec, seen=F.col(spec.value).isNotNull())


def _seen(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    return panel.where(F.col(spec.value).isNotNull())


def flag_lone_obs(
    panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC, periods: DataFrame | None = None
) -> DataFrame:
    """Rows with a value whose neighbours on the period grid have none.

    The grid holds one row per period for every (unit, group) seen for a (site,
    owner), so a pair that changes its group has several rows per period; ``_seq``
    is the place of a row on that grid.  Rows without a value are dropped after
    they have counted for the grid.  First and last period are never lone.
    """
    pair = W.partitionBy(spec.site, spec.owner)
    tuple_cols = [c for c in (spec.unit, spec.group) if c in panel.columns]
    tup = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in tuple_cols])
    tuples = F.sort_array(F.collect_set(tup).over(pair))
    idx, seq = F.col(spec.index), F.col("_seq")
    placed = (
        on_periods(panel, panel_periods(panel, spec) if periods is None else periods, spec)
        .withColumn("_tuples", tuples)
        .where(F.col(spec.value).isNotNull())
        .select(
            *panel.columns,
            (F.col("all_pos") * F.size("_tuples") + F.array_position("_tuples", tup)).alias("_seq"),
            ((idx == F.col("all_first")) | (idx == F.col("all_last"))).alias("_edge"),
        )
    )
    w = pair.orderBy("_seq")
    near = false_if_null(F.lead("_seq").over(w) == seq + 1) | false_if_null(
        F.lag("_seq").over(w) == seq - 1
    )
    return placed.select(*panel.columns, (~F.col("_edge") & ~near).alias("flag_loneobs"))


def site_periods(
    panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC, periods: DataFrame | None = None, lag: int = 2
) -> DataFrame:
    """One row per (site, period) with a value: what the flags need of the site.

    ``flag_multimech_site``, ``last_obs_site``, the first owner and group of the
    site's next observed period, whether the period before had several owners,
    whether the row ``lag`` steps back has a value and is alone in its period, and
    whether this is the last period of the table.

    Steps go over rows; a period without rows counts as one.  Seen from a row that is
    alone in its period, the row ``lag`` steps back lies in the first period back up to
    which the periods between hold ``lag`` rows.
    """
    w = W.partitionBy(spec.site).orderBy("seen_pos")
    multi = F.col("flag_multimech_site")
    back = lambda c, k: F.max(c).over(w.rangeBetween(-k, -k))
    rows, alone = F.lit(0).cast("long"), F
    for k in range(1, lag + 1):
        rows = rows + F.coalesce(back("_rows", k), F.lit(1))
        alone = alone.when(rows >= lag, F.coalesce(back("_rows", k) == 1, F.lit(False)))
    first = F.struct(F.col(spec.owner).alias("owner"), F.col(spec.group).alias("group"))
    per_site = _seen(panel, spec).groupBy(spec.site, spec.index).agg(
        (F.count(F.lit(1)) > 1).alias("flag_multimech_site"), F.count(F.lit(1)).alias("_rows"), F.min(first).alias("_first")
    )
    periods = panel_periods(panel, spec) if periods is None else periods
    return on_periods(per_site, periods, spec).select(
        spec.site,
        spec.index,
        "_rows",
        multi,
        F.max(spec.index).over(W.partitionBy(spec.site)).alias("last_obs_site"),
        F.lead("_first").over(w).alias("_next"),
        false_if_null(back(multi, 1)).alias("_multi_1"),
        alone.alias("_alone_back"),
        (F.col(spec.index) == F.col("seen_last")).alias("_final"),
    )


def _on_site_period(
    rows: DataFrame, panel: DataFrame, spec: PanelSpec, periods: DataFrame | None = None, lag: int = 2
) -> DataFrame:
    """Join on (site, period).  Where one site-period holds much of the panel,
    adaptive execution splits its partition and repeats the one matching row."""
    return rows.join(site_periods(panel, spec, periods, lag), [spec.site, spec.index])


def _public(df: DataFrame, *drop: str) -> DataFrame:
    return df.drop(*drop, *[c for c in df.columns if c.startswith("_")])


def flag_multi_owner(panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Flag site-periods with more than one row."""
    rows = _seen(panel, spec)
    per_site = rows.groupBy(spec.site, spec.index).agg(
        (F.count(F.lit(1)) > 1).alias("flag_multimech_site")
    )
    return rows.join(per_site, [spec.site, spec.index])


def _end_column(spec: PanelSpec) -> Column:
    return (F.col(spec.index) == F.col("last_obs_sitexmech")) & ~F.col("_final")


def _with_last_pair(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    last = F.max(spec.index).over(W.partitionBy(spec.site, spec.owner))
    return rows.withColumn("last_obs_sitexmech", last)


def _with_ends(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    pairs = _with_last_pair(_seen(panel, spec), spec)
    return _on_site_period(pairs, panel, spec).withColumn("flag_end_sitexmech", _end_column(spec))


def flag_end(panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Last period of the site and of the pair; the pair ends before the table does."""
    return _public(_with_ends(panel, spec), "flag_multimech_site")


def _type_columns(spec: PanelSpec, labels: EndLabels) -> dict[str, Column]:
    """Type of an end and the groups on both sides of a group change.

    The third and fourth type only arise on rows that are alone in their
    site-period, so "the next row of the site" is the first row of the site's
    next observed period.
    """
    end = F.col("flag_end_sitexmech")
    group, owner, nxt = F.col(spec.group), F.col(spec.owner), F.col("_next")
    end_type = (
        F.when(end & (F.col("last_obs_sitexmech") == F.col("last_obs_site")), labels.out)
        .when(end & F.col("flag_multimech_site"), labels.consolidate)
        .when(end & (group != nxt["group"]), labels.agency)
        .when(end & (owner != nxt["owner"]), labels.owner)
    )
    changed = F.col("end_type") == labels.agency
    return {
        "end_type": end_type,
        "agency_exiting": F.when(changed, group),
        "agency_inheriting": F.when(changed, nxt["group"]),
    }


def _with_end_types(rows: DataFrame, spec: PanelSpec, labels: EndLabels) -> DataFrame:
    for name, c in _type_columns(spec, labels).items():
        rows = rows.withColumn(name, c)
    return rows


def classify_end(
    panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC, labels: EndLabels = EndLabels()
) -> DataFrame:
    """``end_type`` of every row that ends a (site, owner) pair."""
    out = _with_end_types(_with_ends(panel, spec), spec, labels)
    return _public(out, "agency_exiting", "agency_inheriting")


def transition_parties(
    panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC, labels: EndLabels = EndLabels()
) -> DataFrame:
    """``end_type`` with the group that leaves and the group that takes over."""
    return _public(_with_end_types(_with_ends(panel, spec), spec, labels))


def _method_column() -> Column:
    """Own or previous row several owners: the standard method.

    Seen from a row that is alone in its site-period, the previous row of the
    site's period grid is the last one of the period before.
    """
    return F.when(F.col("flag_multimech_site") | F.col("_multi_1"), STANDARD).otherwise(ADJUSTED)


def _valid_column() -> Column:
    """Valid when neither the row nor the row ``lag`` steps back has several owners,
    and the latter has a value."""
    return ~F.col("flag_multimech_site") & F.col("_alone_back")


def assign_method(panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    out = _on_site_period(_seen(panel, spec), panel, spec)
    return _public(out.withColumn("method", _method_column()), "last_obs_site")


def flag_ratio_valid(panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC, lag: int = 2) -> DataFrame:
    out = _on_site_period(_seen(panel, spec), panel, spec, lag=lag)
    return _public(out.withColumn("vlc_valid", _valid_column()), "last_obs_site")


def flag_panel(
    panel: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    labels: EndLabels = EndLabels(),
    stage=lambda df, name: df,
    lag: int = 2,
    crowded: int | None = None,
    periods: DataFrame | None = None,
    within: bool = False,
) -> DataFrame:
    """All flags in one pass: windows per pair, one site-period table, one join.

    The period table is used twice; ``stage`` writes it in between.  ``crowded``: rows of
    site-periods with more rows than this spread over all tasks in the join, whatever the
    thresholds of adaptive execution; the site-period table is staged for it.  ``periods``
    is the period table of the whole panel, if this is a part of it.  ``within``: the panel
    is dealt by site (``stage_by``) and no site is crowded, so that no row has to move.
    """
    periods = stage(panel_periods(panel, spec), "periods") if periods is None else periods
    pairs = _with_last_pair(flag_lone_obs(panel, spec, periods), spec)
    if within:
        per_site = site_periods(panel, spec, periods, lag)
        joined = join_within(pairs, per_site, spec.site, [spec.index], "inner")
    elif crowded is None:
        joined = _on_site_period(pairs, panel, spec, periods, lag)
    else:
        per_site = stage(site_periods(panel, spec, periods, lag), "site-periods")
        joined = join_crowded(pairs, per_site, [spec.site, spec.index], F.col("_rows") > crowded, [spec.owner])
    ends = joined.withColumns(
        {
            "flag_end_sitexmech": _end_column(spec),
            "method": _method_column(),
            "vlc_valid": _valid_column(),
        }
    )
    return _with_end_types(ends, spec, labels).select(*panel.columns, *FLAG_COLUMNS)


def label_periods(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Labels for the period and for the last observed periods."""
    last = [c for c in ("last_obs_site", "last_obs_sitexmech") if c in df.columns]
    return df.withColumns(
        {spec.period: index_label(spec.index), **{c: index_label(c) for c in last}}
    )


def attach_metadata(
    flags: DataFrame,
    owner_dim: DataFrame,
    org_dim: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Official owner name and partner, then the organisation path of the site."""
    named = enrich(flags.drop(*spec.owner_attrs), owner_dim, spec.owner, list(spec.owner_attrs))
    placed = enrich(named.drop(*spec.org), org_dim, spec.site, list(spec.org))
    front = [*spec.org, spec.site, spec.group, spec.owner, *spec.owner_attrs]
    measures = [c for c in flags.columns if c not in front and c not in FLAG_COLUMNS]
    return placed.select(*front, *measures, *[c for c in FLAG_COLUMNS if c in flags.columns])


def transition_extracts(
    flags: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    excluded_groups: tuple[str, ...] = (DEDUP_AGENCY,),
    first_period: Column | int | None = None,
    labels: EndLabels = EndLabels(),
) -> dict[str, DataFrame]:
    """Three subsets of the flagged panel.

    ``ends``: ends outside the excluded groups and the first period;
    ``out``: those that leave the programme, 7 columns;
    ``multi``: all rows of sites that had several owners after the first period.
    """
    first = period_bound(flags, "min", spec) if first_period is None else first_period
    later = F.col(spec.index) != first
    ends = flags.where(~F.col(spec.group).isin(*excluded_groups) & F.col("flag_end_sitexmech") & later)
    narrow = [spec.site, spec.group, spec.owner, *spec.owner_attrs, spec.period, spec.value]
    out = ends.where(F.col("end_type") == labels.out).select(
        *[c for c in narrow if c in flags.columns]
    )
    ever = flags.where(later & F.col("flag_multimech_site")).select(spec.site).distinct()
    return {"ends": ends, "out": out, "multi": keep_keys(flags, ever, spec.site)}
