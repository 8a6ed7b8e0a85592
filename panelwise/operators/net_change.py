"""Net change of the stock, per owner and per site, and what builds on it.

The reference semantics complete the panel over all periods before taking
differences.  Almost all of that grid is zero and is dropped again, so the
default here adds only the rows that can survive (see ``with_exits``).
``dense=True`` builds the full grid; both give the same rows after
``combine_net_change``.

Facts about a (site, period) come from partial aggregates.  They are joined back
on (site, owner, period), which is unique, so a site-period with very many
owners is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.functions.columns import (
    any_nonzero,
    false_if_null,
    if_else_na,
    null_if_zero,
    sum0,
)
from panelwise.operators.grid import (
    complete,
    explode_periods,
    fill_down_up,
    on_periods,
    period_arrays,
    with_exits,
)
from panelwise.operators.joins import join_within
from panelwise.spec import ADJUSTED, DEFAULT_SPEC, FLAG_COLUMNS, STANDARD, PanelSpec

MULTI = "flag_multimech_site"
EARLY_FLAGS = ["flag_loneobs", MULTI, "last_obs_site", "last_obs_sitexmech"]


def _single(flags: DataFrame) -> DataFrame:
    return flags.where(~F.col(MULTI))


def net_change_periods(flags: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Period table for all steps below, from one pass over the flags.

    Axes: ``all`` periods; those with a ``single``-owner row; and ``kept``, those
    that hold a row after ``combine_net_change``.  A period is kept if it has a
    stock; if the period before has one (then something fell to 0); or, for the
    site measure, if the single-owner period before has one.
    """
    has_stock, single = F.col(spec.value) != 0, ~F.col(MULTI)
    arrays = period_arrays(
        flags, spec, single=single, stock=has_stock, single_stock=single & has_stock
    )

    def had(p: Column, axis: str, stock: str) -> Column:
        before = F.array_max(F.filter(axis, lambda q: q < p))
        return F.coalesce(F.array_contains(stock, before), F.lit(False))

    def kept(p: Column) -> Column:
        site = F.array_contains("single", p) & had(p, "single", "single_stock")
        return F.array_contains("stock", p) | had(p, "all", "stock") | site

    return explode_periods(arrays.select("all", "single", F.filter("all", kept).alias("kept")), spec)


def net_change_standard(
    flags: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    dense: bool = False,
    periods: DataFrame | None = None,
) -> DataFrame:
    """Change against the same owner's stock one period earlier.

    An absent pair counts as 0; in the first period the change is null.  All
    other columns of an added row are those of the pair's last observed row.
    """
    keys = [spec.site, spec.owner]
    if dense:
        rest = [c for c in flags.columns if c not in (*spec.key, spec.value)]
        seen = flags.withColumn("observed", F.lit(True))
        grid = complete(seen, spec.index, keys, {spec.value: 0.0, "observed": False})
        filled = fill_down_up(grid, rest, keys, [spec.index])
        prior = F.lag(spec.value).over(W.partitionBy(*keys).orderBy(spec.index))
        rows = filled.withColumn("prior", prior)
    else:
        periods = net_change_periods(flags, spec) if periods is None else periods
        rows = with_exits(flags, keys, periods, spec, also="single")
    same = [c for c in rows.columns if c not in (spec.period, spec.value, "prior")]
    return rows.select(
        *same,
        F.col(spec.value).alias(spec.stock),
        (F.col(spec.value) - F.col("prior")).alias("tx_net_new"),
    )


def net_change_adjusted(
    flags: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    dense: bool = False,
    periods: DataFrame | None = None,
) -> DataFrame:
    """Change against the site's stock one period earlier, whoever owned it.

    Only rows that are alone in their site-period take part, and only periods in
    which any such row exists, so a quarter with several owners counts as 0.  The
    owner on an added row is the site's last single owner.  Rows in which both
    measures are null or 0 are left out.
    """
    cols = [spec.site, spec.index, spec.owner, spec.value]
    single = _single(flags).select(*cols)
    if dense:
        grid = complete(single, spec.index, [spec.site], {spec.value: 0.0})
        filled = fill_down_up(grid, [spec.owner], [spec.site], [spec.index])
        prior = F.lag(spec.value).over(W.partitionBy(spec.site).orderBy(spec.index))
        rows = filled.withColumn("prior", prior)
    else:
        periods = net_change_periods(flags, spec) if periods is None else periods
        rows = with_exits(single, [spec.site], periods, spec, axis="single")
    return (
        rows.select(
            *spec.key,
            F.col("prior").alias("tx_curr_lag_site"),
            (F.col(spec.value) - F.col("prior")).alias("tx_net_new_adj"),
        )
        .where(any_nonzero("tx_curr_lag_site", "tx_net_new_adj"))
    )


def _on_key(rows: DataFrame, facts: DataFrame, spec: PanelSpec, within: bool) -> DataFrame:
    if within:
        return join_within(rows, facts, spec.site, [spec.owner, spec.index])
    return rows.join(facts, spec.key, "left")


def combine_net_change(
    std: DataFrame, adj: DataFrame, spec: PanelSpec = DEFAULT_SPEC, within: bool = False
) -> DataFrame:
    """Both measures side by side; rows without any stock or change are dropped.

    ``within``: both tables are dealt by site, and the join leaves them so.
    """
    joined = _on_key(std, adj, spec, within)
    return joined.where(any_nonzero(spec.stock, "tx_net_new", "tx_net_new_adj")).withColumns(
        {c: null_if_zero(c) for c in (spec.stock, "tx_curr_lag_site")}
    )


CONTEXT = ["_n", "_other_exit", "_lag_rows", "_lag_periods"]


def site_context(
    nn: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    periods: DataFrame | None = None,
    lag: int = 2,
    within: bool = False,
) -> DataFrame:
    """Facts about the site-period, for rows of site-periods with one or two rows.

    ``_n``: number of rows; ``_other_exit``: negative change of a row that left;
    ``_lag_rows`` / ``_lag_periods``: the site's total stock ``lag`` rows / periods
    back.  Site-periods with more rows get no match: no transfer is attributed
    there, and a row that is valid for the lag never sits in one.

    Rows of a site are ordered by period and owner, and a period without rows
    counts as one row.  With ``k`` rows of the same period before a row, the row
    ``lag`` steps back lies in the first period back up to which there are
    ``lag - k`` rows, or in the same period if ``k >= lag``.
    """
    if periods is None:
        every = period_arrays(nn, spec)
        periods = explode_periods(every.select("all", F.col("all").alias("kept")), spec)
    stock, change = F.col(spec.stock), F.col("tx_net_new")
    w = W.partitionBy(spec.site).orderBy("kept_pos")

    def back(c: str, steps: int, absent: float | int) -> Column:
        found = F.max(c).over(w.rangeBetween(-steps, -steps))
        return F.when(F.col("kept_pos") > steps, F.coalesce(found, F.lit(absent)))

    per_site = nn.groupBy(spec.site, spec.index).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(spec.owner).alias("_first"),
        F.max(spec.owner).alias("_last"),
        F.max(F.when(stock.isNull() & (change < 0), change)).alias("_other_exit"),
        sum0(spec.stock).alias("_total"),
    )
    per_site = (
        on_periods(per_site, periods, spec)
        .select(
            *per_site.columns,
            *[back("_total", k, 0.0).alias(f"_total_{k}") for k in range(1, lag + 1)],
            *[F.coalesce(back("_n", k, 1), F.lit(1)).alias(f"_rows_{k}") for k in range(1, lag)],
        )
        .where(F.col("_n") <= 2)
    )
    owners = F.array_distinct(F.array("_first", "_last"))
    rows = (F.col(spec.owner) > F.col("_first")).cast("int")
    rows_back = F.when(rows >= lag, F.col("_total"))
    for k in range(1, lag):
        rows = rows + F.col(f"_rows_{k}")
        rows_back = rows_back.when(rows >= lag, F.col(f"_total_{k}"))
    facts = per_site.withColumn(spec.owner, F.explode(owners)).select(
        *spec.key,
        "_n",
        "_other_exit",
        rows_back.otherwise(F.col(f"_total_{lag}")).alias("_lag_rows"),
        F.col(f"_total_{lag}").alias("_lag_periods"),
    )
    return _on_key(nn, facts, spec, within)


def attribute_transfers(
    nn: DataFrame, spec: PanelSpec = DEFAULT_SPEC, periods: DataFrame | None = None
) -> DataFrame:
    """Stock that moved from one owner to another.

    Where a site-period has exactly two rows and one of them left, the amount
    that left goes on both rows, with the sign turned where the row grew.  Null
    where the row's own change is null.
    """
    had_context = set(CONTEXT) <= set(nn.columns)
    stock, change = F.col(spec.stock), F.col("tx_net_new")
    own = F.when(stock.isNull() & (change < 0), change)
    amount = F.when(F.col("_n") == 2, F.coalesce(own, F.col("_other_exit")))
    out = (nn if had_context else site_context(nn, spec, periods)).withColumn(
        "tx_xfer", if_else_na(change > 0, -amount, amount)
    )
    return out if had_context else out.drop(*CONTEXT)


def propagate_flags(nn: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Flags on every row, transfers only where the adjusted method applies.

    Added rows already carry the columns of the pair's last observed row: that
    is the fill for the early flags and the method.  What describes the observed
    row itself (validity, end, type, parties) does not carry over.
    """
    seen = F.col("observed")
    own_only = {
        "vlc_valid": seen & false_if_null("vlc_valid"),
        "flag_end_sitexmech": seen & false_if_null("flag_end_sitexmech"),
        "end_type": F.when(seen, F.col("end_type")),
        "agency_exiting": F.when(seen, F.col("agency_exiting")),
        "agency_inheriting": F.when(seen, F.col("agency_inheriting")),
    }
    out = nn.withColumns(own_only).drop("observed")
    return out.withColumn(
        "tx_xfer", if_else_na(F.col("method") == STANDARD, F.lit(None), F.col("tx_xfer"))
    )


def net_change_plus(nn: DataFrame) -> DataFrame:
    """Adjusted change where that method applies, else the owner's change.

    Stays null on exit rows whose site change sits on the new owner's row.
    """
    return nn.withColumn(
        "tx_net_new_adj_plus",
        if_else_na(F.col("method") == ADJUSTED, F.col("tx_net_new_adj"), F.col("tx_net_new")),
    )


def lag_stock(
    nn: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    n: int = 2,
    lag_mode: str = "rows",
    periods: DataFrame | None = None,
) -> DataFrame:
    """The site's total stock ``n`` steps back, on rows valid for the ratio.

    ``lag_mode="rows"`` steps over the rows of the site, as the published
    figures do; an exit row on the way then counts as a step.  ``"periods"`` always
    steps ``n`` periods.  The column is named after ``n``.  Rows that already carry a
    context (``site_context``) must carry one of the same lag.
    """
    if n < 1 or lag_mode not in ("rows", "periods"):
        raise ValueError("lag_stock steps back 1 or more, with lag_mode 'rows' or 'periods'")
    out = nn if set(CONTEXT) <= set(nn.columns) else site_context(nn, spec, periods, n)
    value = F.when(F.col("vlc_valid"), F.col(f"_lag_{lag_mode}"))
    return out.withColumn(f"tx_curr_lag{n}_site", value).drop(*CONTEXT)


def net_change_panel(
    flags: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    lag_mode: str = "rows",
    stage=lambda df, name: df,
    lag: int = 2,
    periods: DataFrame | None = None,
    within: bool = False,
) -> DataFrame:
    """From flags to the full net-change table.

    ``stage`` is called on the period table and on the combined rows, which are
    used more than once; pass ``sources.stages.stage`` to write them to the shared
    folder in between.  ``periods`` is the period table of all flags, if these are a part of
    them.  ``within``: the flags are dealt by site, ``stage`` keeps rows where they are,
    and no site is crowded.
    """
    periods = stage(net_change_periods(flags, spec), "periods") if periods is None else periods
    std = net_change_standard(flags, spec, periods=periods)
    adj = net_change_adjusted(flags, spec, periods=periods)
    nn = stage(combine_net_change(std, adj, spec, within), "net_change")
    rows = site_context(nn, spec, periods, lag, within)
    rows = propagate_flags(attribute_transfers(rows, spec), spec)
    rows = lag_stock(net_change_plus(rows), spec, lag, lag_mode)
    measures = [
        spec.stock,
        "tx_net_new",
        "tx_curr_lag_site",
        f"tx_curr_lag{lag}_site",
        "tx_net_new_adj",
        "tx_net_new_adj_plus",
        "tx_xfer",
    ]
    front = [c for c in flags.columns if c not in (*FLAG_COLUMNS, spec.value)]
    return rows.select(*front, *measures, *FLAG_COLUMNS)
