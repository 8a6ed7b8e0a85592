"""From the raw long extract to a clean panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import if_else_na, to_number
from panelwise.functions.periods import fiscal_index, index_label, month_date, period_text_month
from panelwise.operators.joins import enrich, replace_by_label
from panelwise.operators.shape import WORD_BREAK, arrange_columns, pick_level
from panelwise.spec import DEFAULT_SPEC, PanelSpec

# Column names of the raw extract and of the clean panel.
RAW_COLUMNS = {
    "orglvl_3": "operatingunit",
    "Funding Agency": "fundingagency",
    "Organisation unit": "facility",
    "Funding Mechanism": "mech",
    "Technical Area": "indicator",
    "Top Level": "numeratordenom",
    "Value": "value",
}
DENOMINATOR = "Top Level Denominator"
REGIONAL = "Region"
PANEL_FRONT = [
    "period",
    "operatingunit",
    "countryname",
    "snu1",
    "psnu",
    "facility",
    "orgunituid",
]


def country_name(unit: Column, snu1: Column, regional: str = REGIONAL) -> Column:
    """Regional units stand for several countries, named one level below."""
    return if_else_na(unit.rlike(regional), snu1, unit)


def country_dim(df: DataFrame) -> DataFrame:
    """Country list with the levels of its planning units and facilities."""
    return df.select(
        "operatingunit",
        "countryname",
        "countryname_uid",
        "psnu_lvl",
        F.col("facility_lvl").alias("site_lvl"),
    )


def country_dim_from(levels: DataFrame, units: DataFrame) -> DataFrame:
    """The country list joined from a level table and a unit table."""
    right = units.select(F.col("displayName").alias("country_name"), F.col("id"))
    return levels.join(right, "country_name", "left").select(
        F.col("name3").alias("operatingunit"),
        F.col("id").alias("operatingunituid"),
        F.col("country_name").alias("countryname"),
        F.col("facility").alias("site_lvl"),
    )


def org_hierarchy(units: DataFrame, hierarchy: DataFrame, unit_id: str = "uid") -> DataFrame:
    """Hierarchy rows of the units that are operating units."""
    chosen = units.where(F.col("type") == "OU").select(unit_id).distinct()
    return hierarchy.join(chosen, unit_id, "left_semi")


def owner_text(mech: Column | str) -> Column:
    """Owner text; pseudo owners get a prefix so that they split like the others."""
    return F.regexp_replace(mech, "^0000(0|1)", "ZZZ - 0000$1 -")


def clean_extract(
    raw: DataFrame,
    countries: DataFrame,
    agencies: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    regional: str = REGIONAL,
) -> DataFrame:
    """Typed panel rows from the all-text extract, in one pass over the rows.

    The country and agency lists are joined without a hint; both are a few
    hundred rows, far below the planner's broadcast threshold.
    """
    named = raw.drop("orglvl_1", "orglvl_2").withColumnsRenamed(RAW_COLUMNS)
    # One step per derived value: the next step reads it instead of parsing again.
    dated = (
        named.withColumn("_month", period_text_month("Period"))
        .withColumn("_date", month_date("_month"))
        .withColumn(spec.index, fiscal_index("_date"))
        .withColumn("mech", owner_text(F.col("mech")))
    )
    recoded = dated.withColumns(
        {
            spec.period: index_label(spec.index),
            "snu1": F.col("orglvl_4"),
            "countryname": country_name(F.col("operatingunit"), F.col("orglvl_4"), regional),
            "numeratordenom": if_else_na(F.col("numeratordenom") == DENOMINATOR, "D", "N"),
            "_parts": F.split("mech", WORD_BREAK, 3),
        }
    )
    levelled = enrich(recoded, countries, "countryname", ["psnu_lvl"])
    placed = pick_level(levelled, "psnu_lvl")
    labelled = replace_by_label(placed, agencies, "fundingagency", "id", "item")
    gone = ("mech", "value", "Period", "_month", "_date", "_parts")
    rest = [c for c in labelled.columns if c not in gone]
    out = labelled.select(
        *rest,
        "mech",
        F.get("_parts", F.lit(1)).alias("mech_code"),
        F.get("_parts", F.lit(2)).alias("mech_name"),
        to_number("value").alias("value"),
    )
    return arrange_columns(out, front=PANEL_FRONT)
