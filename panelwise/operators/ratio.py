"""Coverage ratio: numerator panel merged onto the net-change table, and the
comparison of a ratio from aggregates with one from validated sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.functions.columns import comma_text, false_if_null, indicator_code, ratio, recode
from panelwise.operators.groups import display_rank, last_value_of_group, sum0_by
from panelwise.operators.joins import enrich, join_nullsafe
from panelwise.operators.shape import quarters_to_periods, stack, to_wide
from panelwise.sources.stages import tasks_of
from panelwise.spec import (
    AGENCY_NAMES,
    DEFAULT_SPEC,
    DENOMINATOR_ROWS,
    NO_STOCK,
    STOCK_ROWS,
    PanelSpec,
)

RATIO_COLUMNS = ["tx_pvls", "tx_pvls_d"]


def widen_ratio(
    vl: DataFrame, owner_dim: DataFrame | None = None, spec: PanelSpec = DEFAULT_SPEC, within: bool = False
) -> DataFrame:
    """Numerator and denominator as columns, one row per site, owner and period.

    ``within``: the rows are dealt by site and stay where they are.
    """
    coded = vl.withColumn(
        "indicator", F.lower(indicator_code("indicator", "numeratordenom"))
    )
    keys = [c for c in vl.columns if c not in ("mech", "numeratordenom", "indicator", spec.value)]
    wide = to_wide(coded, keys, "indicator", spec.value, RATIO_COLUMNS, within=within)
    if owner_dim is None:
        return wide
    return enrich(wide.drop(*spec.owner_attrs), owner_dim, spec.owner, list(spec.owner_attrs))


def merge_ratio_numerator(
    nn: DataFrame,
    vl: DataFrame,
    owner_dim: DataFrame | None = None,
    spec: PanelSpec = DEFAULT_SPEC,
    stage=lambda df, name: df,
    within: bool = False,
) -> DataFrame:
    """Full join on all shared columns, null keys matching null keys.

    Rows that only the ratio panel has come without validity.  They take the
    site-period's validity (true if it has none) when such a row is a negative
    correction and none lacks a denominator; else false.  Only rows without validity are
    aggregated for that, and only the site-periods they concern are read again.

    ``within``: both tables are dealt by site (``stage_by``) and no site is crowded.  Then rows
    move once, by site, and nothing is written in between.
    """
    wide = widen_ratio(vl, owner_dim, spec, within)
    shared = [c for c in wide.columns if c in nn.columns]
    if within:
        return _merge_within(nn, wide, shared, spec)
    merged = stage(join_nullsafe(nn, wide, shared, "full"), "ratio_merge")
    valid, den = F.col("vlc_valid"), F.col("tx_pvls_d")
    missing = valid.isNull()
    keys = [spec.site, spec.index]
    concerned = (
        merged.where(missing)
        .groupBy(*keys)
        .agg(F.count_if(den.isNull()).alias("_unknown"), F.count_if(den < 0).alias("_negative"))
        .where((F.col("_unknown") == 0) & (F.col("_negative") > 0))
        .select(*keys)
    )
    rows = merged.select(*keys, "vlc_valid").join(concerned, keys, "left_semi")
    facts = rows.groupBy(*keys).agg(F.coalesce(F.max("vlc_valid"), F.lit(True)).alias("_fill"))
    out = merged.join(facts, keys, "left")
    columns = [*nn.columns, *[c for c in wide.columns if c not in nn.columns]]
    changed = {
        "vlc_valid": F.coalesce(valid, false_if_null("_fill")).alias("vlc_valid"),
        "method": F.coalesce(F.col("method"), F.lit(NO_STOCK)).alias("method"),
    }
    return out.select(*[changed.get(c, F.col(c)) for c in columns])


def _merge_within(nn: DataFrame, wide: DataFrame, shared: list[str], spec: PanelSpec) -> DataFrame:
    """The merge inside the site: rows of both tables meet in groups, null keys with null keys.

    Both tables have one row per key, so a group's first values are those of its two rows.
    They are dealt by site alone, which is what windows and the join with the sites' paths need.
    """
    valid, missing, den = F.col("vlc_valid"), F.col("vlc_valid").isNull(), F.col("tx_pvls_d")
    columns = [*nn.columns, *[c for c in wide.columns if c not in nn.columns]]
    cells = {c: F.first(c, ignorenulls=True) for c in columns if c not in shared}
    named = F.concat_ws(", ", *[F.col(c).cast("string") for c in shared])
    cells["vlc_valid"] = F.when(
        F.count("_nn") > 1, F.raise_error(F.concat(F.lit(f"several rows for {shared} = "), named))
    ).otherwise(cells["vlc_valid"])
    both = stack(nn.withColumn("_nn", F.lit(1)), wide).repartition(tasks_of(nn.sparkSession), spec.site)
    merged = both.groupBy(*shared).agg(*[v.alias(c) for c, v in cells.items()])
    w = W.partitionBy(spec.site, spec.index)
    concerned = (
        F.col(spec.site).isNotNull()
        & F.col(spec.index).isNotNull()
        & (F.count_if(missing & den.isNull()).over(w) == 0)
        & (F.count_if(missing & (den < 0)).over(w) > 0)
    )
    fill = concerned & F.coalesce(F.max(valid).over(w), F.lit(True))
    changed = {
        "vlc_valid": F.coalesce(valid, fill).alias("vlc_valid"),
        "method": F.coalesce(F.col("method"), F.lit(NO_STOCK)).alias("method"),
    }
    return merged.select(*[changed.get(c, F.col(c)) for c in columns])


def ratio_aggregate(
    wide: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    since: int | None = None,
    skip_periods: tuple[str, ...] = (),
    drop_year: str | None = None,
    excluded_group: str | None = None,
    lag_keys: list[str] | None = None,
) -> DataFrame:
    """Denominator and lag-2 stock per unit, group and partner, from the wide table.

    Nothing is left out unless asked for: fiscal years before ``since``, a group,
    periods that take no part, and a year that only serves the lag.  ``lag_keys``
    defaults to unit, group and partner; the published figures
    lagged within the partner alone, across units.
    """
    partner = "primepartner"
    keys = [spec.unit, spec.group, partner]
    named = F.struct("indicator", "standardizeddisaggregate")
    rows = wide.where(named.isin(*[F.struct(F.lit(i), F.lit(d)) for i, d in (STOCK_ROWS, DENOMINATOR_ROWS)]))
    if since is not None:
        rows = rows.where(F.col("fiscal_year") >= since)
    if excluded_group is not None:
        rows = rows.where(F.col(spec.group) != excluded_group)
    coded = rows.withColumn("indicator", F.lower(indicator_code("indicator", "numeratordenom")))
    sums = sum0_by(
        coded, ["fiscal_year", *keys, "indicator"], [f"qtr{q}" for q in (1, 2, 3, 4)]
    )
    long = quarters_to_periods(sums, [*keys, "indicator"], spec=spec)
    by_period = to_wide(
        long.where(~F.col(spec.period).isin(*skip_periods)) if skip_periods else long,
        [spec.index, spec.period, *keys],
        "indicator",
        "value",
        ["tx_curr", "tx_pvls_d"],
    )
    by = lag_keys or keys
    order = [spec.index, *[k for k in keys if k not in by]]
    lag2 = F.lag("tx_curr", 2).over(W.partitionBy(*by).orderBy(*order))
    lagged = by_period.withColumn("tx_curr_lag2", lag2).drop("tx_curr").withColumn("source", F.lit("MSD"))
    return lagged if drop_year is None else lagged.where(~F.col(spec.period).startswith(drop_year))


def ratio_validated(
    final: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    drop_year: str | None = None,
    excluded_group: str | None = None,
) -> DataFrame:
    """Denominator and lag-2 stock per unit, group and partner, valid rows only."""
    rows = final.where("vlc_valid")
    if drop_year is not None:
        rows = rows.where(~F.col(spec.period).contains(drop_year))
    if excluded_group is not None:
        rows = rows.where(~F.col(spec.group).contains(excluded_group))
    keys = [spec.index, spec.period, spec.unit, spec.group, "primepartner"]
    return (
        sum0_by(rows, keys, ["tx_pvls_d", "tx_curr_lag2_site"])
        .withColumnRenamed("tx_curr_lag2_site", "tx_curr_lag2")
        .withColumn("source", F.lit("Adjusted"))
    )


def ratio_compare(
    aggregate: DataFrame,
    validated: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    keep_inf: bool = False,
    stage=lambda df, name: df,
) -> DataFrame:
    """Both ratios stacked, with the latest stock, its rank and the band between them.

    ``stage`` is called on the labelled rows, which the ranks read once more.  A
    window here holds at most two rows per period of one unit, group and
    partner.  Rows with a zero stock drop out unless ``keep_inf``.
    """
    keys = [spec.unit, spec.group, "primepartner"]
    both = stack(aggregate, validated).withColumns(
        {
            spec.group: recode(spec.group, AGENCY_NAMES),
            "vlc": ratio("tx_pvls_d", "tx_curr_lag2", keep_inf),
        }
    )
    both = last_value_of_group(
        both.where(F.col("vlc").isNotNull()), "tx_curr_lag2", keys, "latest_tx", spec
    )
    band = W.partitionBy(*keys, spec.index)
    label = F.concat(
        F.col(spec.group), F.lit("/"), F.col("primepartner"), F.lit("\nTX_CURR = "), comma_text("latest_tx")
    )
    labelled = both.withColumns(
        {
            "facet_label": label,
            "top_ln": F.when(F.col("source") == "Adjusted", F.col("vlc")),
            "pd_min": F.min("vlc").over(band),
            "pd_max": F.max("vlc").over(band),
        }
    )
    labelled = stage(labelled, "ratio_rows")
    ranks = display_rank(labelled, "facet_label", "latest_tx", desc=True, name="facet_rank")
    return join_nullsafe(labelled, ranks, ["facet_label"])


def wide_fiscal_table(long: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Long measures (with ``fiscal_year`` and ``quarter``) as ``qtr1`` .. ``qtr4``."""
    keys = [c for c in long.columns if c not in ("quarter", spec.value)]
    quarters = [str(q) for q in (1, 2, 3, 4)]
    return to_wide(
        long.withColumn("quarter", F.col("quarter").cast("string")),
        keys,
        "quarter",
        spec.value,
        quarters,
        prefix="qtr",
    )


