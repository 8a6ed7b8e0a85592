"""Review sheet of site-periods that have several owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.operators.grid import period_bound
from panelwise.operators.groups import join_ordered
from panelwise.operators.shape import to_wide
from panelwise.spec import DEFAULT_SPEC, PanelSpec

# Parts removed from agency names, and the title of the empty column.
AGENCY_STRIP = "HHS/| adjustments Agency"
CONTEXT_TITLE = "rationale/context for multi mechs? full duplication?"


def strip_first(c: Column, pattern: str) -> Column:
    """Remove the first match of a pattern."""
    return F.regexp_replace(c, f"^(.*?)(?:{pattern})", "$1")


def _owners(flags: DataFrame, spec: PanelSpec, first_period, group_strip: str, sep: str, stage) -> DataFrame:
    """One row per site-period with several owners, and the owners as one text.

    A set of owners is known by its size and two 64-bit fingerprints, which are partial
    aggregates; so a crowded site-period is never gathered to compare it.  Only one
    site-period of each distinct set is gathered, to write the set's text once.
    """
    first = period_bound(flags, "min", spec) if first_period is None else first_period
    multi = flags.where((F.col(spec.index) != first) & F.col("flag_multimech_site"))
    owner = F.concat_ws(" ", strip_first(F.col(spec.group), group_strip), F.col(spec.owner))
    site = [c for c in ("snu1", "psnu", "facility") if c in flags.columns]
    keys = [spec.unit, spec.site, spec.index, spec.period, *site]
    rows = stage(multi.select(*keys, F.col(spec.owner).alias("_owner"), owner.alias("_text")), "multi_owners")
    prints = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bit_xor(F.xxhash64("_owner", "_text")).alias("_x"),
        F.bit_xor(F.xxhash64(F.lit("second"), "_text", "_owner")).alias("_y"),
    )
    prints = stage(prints, "owner_sets")
    one = prints.groupBy("_n", "_x", "_y").agg(F.min(F.struct(spec.site, spec.index)).alias("_one"))
    one = one.select("_n", "_x", "_y", F.col("_one")[spec.site].alias(spec.site), F.col("_one")[spec.index].alias(spec.index))
    chosen = rows.join(one, [spec.site, spec.index])
    texts = join_ordered(chosen, ["_n", "_x", "_y"], "_text", ["_owner"], sep, "mechs")
    return prints.join(texts, ["_n", "_x", "_y"]).select(*keys, "mechs")


def multi_owner_pairs(
    flags: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    group_strip: str = AGENCY_STRIP,
    sep: str = "|",
    first_period: Column | int | None = None,
    stage=lambda df, name: df,
) -> DataFrame:
    """Distinct owner combinations per unit, with the periods they occur in."""
    owners = _owners(flags, spec, first_period, group_strip, sep, stage)
    distinct = owners.select(spec.unit, spec.index, spec.period, "mechs").distinct()
    pairs = join_ordered(distinct, [spec.unit, "mechs"], spec.period, [spec.index], ",", "periods")
    return pairs.select(
        spec.unit,
        "mechs",
        F.col("periods").alias(spec.period),
        F.lit(None).cast("string").alias(CONTEXT_TITLE),
    )


def multi_owner_sites(
    flags: DataFrame,
    periods: list[str] | None = None,
    spec: PanelSpec = DEFAULT_SPEC,
    group_strip: str = AGENCY_STRIP,
    sep: str = "|",
    first_period: Column | int | None = None,
    stage=lambda df, name: df,
) -> DataFrame:
    """One row per site, one column per period, each the owners of that quarter.

    Periods are those that occur, unless a list is given.
    """
    owners = _owners(flags, spec, first_period, group_strip, sep, stage)
    keys = [c for c in owners.columns if c not in (spec.index, spec.period, "mechs")]
    owners = stage(owners, "owner_texts")
    wide = to_wide(owners, keys, spec.period, "mechs", periods, order=spec.index)
    return wide.withColumn(
        "why multi mechs? pops serving? full duplication?", F.lit(None).cast("string")
    )
