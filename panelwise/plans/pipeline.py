"""The four stages end to end: clean panel, flags, net change, ratio merge."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators.flags import attach_metadata, flag_panel, label_periods, panel_periods
from panelwise.operators.joins import crowded_keys
from panelwise.operators.net_change import net_change_panel, net_change_periods
from panelwise.operators.ratio import merge_ratio_numerator
from panelwise.sources.stages import stage, stage_by
from panelwise.spec import DEFAULT_SPEC, PanelSpec

#: Rows of a site that one task may hold.
MOST_ROWS = 100_000


def flags_stage(panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Flags on a narrow panel.  The panel is read several times, so it is staged."""
    return flag_panel(stage(panel, "panel"), spec, stage=stage)


def flagged_stage(
    panel: DataFrame, owner_dim: DataFrame, org_dim: DataFrame, spec: PanelSpec = DEFAULT_SPEC
) -> DataFrame:
    """Flags with owner names, the organisation path and period labels."""
    return label_periods(attach_metadata(flags_stage(panel, spec), owner_dim, org_dim, spec), spec)


def net_change_stage(
    panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC, lag_mode: str = "rows", lag: int = 2, most: int = MOST_ROWS
) -> DataFrame:
    """Net change on a narrow panel.

    Names and paths depend on the owner or the site alone, so they are attached
    at the end instead of going through every shuffle.

    Everything but the period tables is about one site, so the panel is dealt by site
    once, and all steps run inside the site.  Sites of more than ``most`` rows do not fit
    one task: their rows go through the same steps dealt by owner and period as well.
    """
    panel = stage(panel, "panel")
    crowded = stage(crowded_keys(panel, spec.site, most), "crowded")
    inside, spread = _net_change_parts(panel, crowded, spec, lag_mode, lag)
    return inside if spread is None else inside.unionByName(spread)


def _net_change_parts(
    panel: DataFrame, crowded: DataFrame, spec: PanelSpec, lag_mode: str = "rows", lag: int = 2, dealt: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """Net change of the sites that fit one task, dealt by site, and of the crowded ones, if any.

    ``dealt``: the panel is dealt by site already (``stage_by``).
    """
    periods = stage(panel_periods(panel, spec), "periods")
    calm = panel.where(F.col(spec.site).isNotNull())
    keep = partial(_keep, spec)
    none = crowded.isEmpty()
    crowded = F.broadcast(crowded)  # at most one of ``most`` rows of the panel
    if not none:
        calm = calm.join(crowded, spec.site, "left_anti")
    inside = calm if dealt else stage_by(calm, "panel", spec.site)
    flags = keep(flag_panel(inside, spec, periods=periods, within=True), "flags")
    if none:
        steps = stage(net_change_periods(flags, spec), "periods")
        return net_change_panel(flags, spec, lag_mode, keep, lag, steps, within=True), None
    spread = stage(flag_panel(panel.join(crowded, spec.site, "left_semi"), spec, stage=stage, periods=periods), "flags")
    steps = stage(net_change_periods(flags.unionByName(spread), spec), "periods")
    return (
        net_change_panel(flags, spec, lag_mode, keep, lag, steps, within=True),
        net_change_panel(spread, spec, lag_mode, stage, lag, steps),
    )


def _keep(spec: PanelSpec, df: DataFrame, name: str) -> DataFrame:
    """Write a table that is dealt by site without moving its rows."""
    return stage_by(df, name, spec.site, deal=False)


def final_stage(
    panel: DataFrame,
    ratio_rows: DataFrame,
    owner_dim: DataFrame,
    org_dim: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    dealt: bool = False,
    most: int = MOST_ROWS,
) -> DataFrame:
    """Net change with the ratio numerator and denominator, named and labelled.

    Names and paths are the same on both sides of the full join, so it runs on
    site, owner, group and period, and they are attached to its result.

    ``dealt``: panel and ratio rows are tables dealt by site (``stage_by``).  Then rows move
    once more up to the result, by site, except those of sites with more than ``most`` rows
    in one of the tables, which go apart.
    """
    if dealt:
        merged = _merged_by_site(panel, ratio_rows, spec, most)
    else:
        merged = merge_ratio_numerator(net_change_stage(panel, spec), ratio_rows, None, spec, stage)
    return label_periods(attach_metadata(merged, owner_dim, org_dim, spec), spec)


def _merged_by_site(panel: DataFrame, ratio_rows: DataFrame, spec: PanelSpec, most: int) -> DataFrame:
    """The merge of two tables that are dealt by site; crowded sites are dealt by all keys."""
    each = [crowded_keys(rows, spec.site, most) for rows in (panel, ratio_rows)]
    crowded = stage(each[0].union(each[1]).distinct(), "crowded")
    inside, spread = _net_change_parts(panel, crowded, spec, dealt=True)
    if spread is None:
        return merge_ratio_numerator(inside, ratio_rows, None, spec, within=True)
    calm, apart = (ratio_rows.join(F.broadcast(crowded), spec.site, how) for how in ("left_anti", "left_semi"))
    return merge_ratio_numerator(inside, calm, None, spec, within=True).unionByName(
        merge_ratio_numerator(spread, apart, None, spec, stage)
    )
