"""Panels derived from the order and line-item test tables.

A customer is a site, the order priority its owner; the stock of a quarter is
the order value.  Regions are operating units, nations countries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.columns import exact_sum, sum0
from panelwise.functions.periods import fiscal_index
from panelwise.operators.ratio import wide_fiscal_table
from panelwise.sources.stages import tasks_of
from panelwise.spec import DENOMINATOR_ROWS, STOCK_ROWS

DEDUP = "Dedup"


# Schemas of the test tables read here; naming them saves a job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
        "l_returnflag string, l_shipdate timestamp_ntz"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _agency(owner: Column) -> Column:
    return (
        F.when(owner.isin("1", "2"), "A").when(owner.isin("3", "4"), "B").otherwise(DEDUP)
    )


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow stock panel: site, owner, group, period, value."""
    owner = F.substring("o_orderpriority", 1, 1)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("orgunituid"),
        owner.alias("mech_code"),
        fiscal_index("o_orderdate").alias("period_idx"),
        F.col("o_totalprice"),
    )
    panel = rows.groupBy("orgunituid", "mech_code", "period_idx").agg(
        exact_sum("o_totalprice").alias("value")
    )
    return panel.select(
        "orgunituid",
        "mech_code",
        _agency(F.col("mech_code")).alias("fundingagency"),
        "period_idx",
        "value",
    )


def org_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site: region > nation > customer."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("orgunituid"),
            F.col("r_name").alias("operatingunit"),
            F.col("n_name").alias("countryname"),
            F.col("n_name").alias("snu1"),
            F.col("n_name").alias("psnu"),
            F.col("c_name").alias("facility"),
        )
    )


def owner_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per owner: name and partner; owners 1 and 2 share a partner."""
    code = F.substring("o_orderpriority", 1, 1)
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderpriority")
        .distinct()
        .select(
            code.alias("mech_code"),
            F.substring("o_orderpriority", 3, 100).alias("mech_name"),
            F.concat(F.lit("Partner "), F.when(code == "2", "1").otherwise(code)).alias(
                "primepartner"
            ),
        )
    )


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress panel: a part is a site, a supplier its owner, the nation the group."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("orgunituid"),
        F.col("l_suppkey").alias("mech_code"),
        fiscal_index("l_shipdate").alias("period_idx"),
        "l_quantity",
    )
    panel = items.groupBy("orgunituid", "mech_code", "period_idx").agg(
        exact_sum("l_quantity").alias("value")
    )
    supplier = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left"
    )
    named = supplier.select(
        F.col("s_suppkey").alias("mech_code"), F.col("n_name").alias("fundingagency")
    )
    return panel.join(named, "mech_code", "left").select(
        "orgunituid",
        "mech_code",
        "fundingagency",
        "period_idx",
        "value",
    )


def ratio_panel(spark: SparkSession, sf_dir: str, by_site: bool = False) -> DataFrame:
    """Long numerator (N) and denominator (D) rows of the ratio, per site, owner, period.

    The denominator of the pseudo owner is negative, as a correction is.  Items and orders
    meet in all shuffle partitions, whatever their compressed size.  ``by_site`` deals the
    sums by site, before each becomes two rows.
    """
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        fiscal_index("l_shipdate").alias("period_idx"),
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
        (F.col("l_returnflag") == "A").alias("counted"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("orgunituid"),
        F.substring("o_orderpriority", 1, 1).alias("mech_code"),
    )
    sums = (
        items.repartition(tasks_of(spark), "l_orderkey")
        .join(orders, "l_orderkey")
        .groupBy("orgunituid", "mech_code", "period_idx")
        .agg(
            sum0("qty").alias("d"),
            exact_sum(F.when(F.col("counted"), F.col("qty"))).alias("n"),
        )
    )
    if by_site:
        sums = sums.repartition(tasks_of(spark), "orgunituid")
    den = F.when(F.col("mech_code") == "5", -F.col("d")).otherwise(F.col("d"))
    parts = F.array(
        F.struct(F.lit("N").alias("numeratordenom"), F.col("n").alias("value")),
        F.struct(F.lit("D").alias("numeratordenom"), den.alias("value")),
    )
    return (
        sums.select("orgunituid", "mech_code", "period_idx", F.explode(parts).alias("p"))
        .select(
            "orgunituid",
            "mech_code",
            _agency(F.col("mech_code")).alias("fundingagency"),
            "period_idx",
            F.lit("TX_PVLS").alias("indicator"),
            "p.*",
        )
        .where(F.col("value").isNotNull())
    )


def with_names(spark: SparkSession, sf_dir: str, rows: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Add the organisation path and the owner's name and partner.

    ``owners`` is the owner table, if the caller has it written: the planner then knows its size.
    """
    owners = owner_dim(spark, sf_dir) if owners is None else owners
    return rows.join(org_dim(spark, sf_dir), "orgunituid", "left").join(owners, "mech_code", "left")


def country_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries with their planning level: regional units by nation, others whole.

    Nations with an even key plan at level 4, with an odd key at level 5.  EUROPE
    plans at level 5, AFRICA at 4, and the rest have no planning level (0).
    """
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    regional = F.col("r_name").isin("AMERICA", "ASIA")
    level = (
        F.when(regional, F.col("n_nationkey") % 2 + 4)
        .when(F.col("r_name") == "AFRICA", 4)
        .when(F.col("r_name") == "EUROPE", 5)
        .otherwise(0)
    )
    unit = F.when(regional, F.concat("r_name", F.lit(" Region"))).otherwise(F.col("r_name"))
    return joined.select(
        unit.alias("operatingunit"),
        F.when(regional, F.col("n_name")).otherwise(F.col("r_name")).alias("countryname"),
        level.cast("int").alias("psnu_lvl"),
    ).distinct()


def agency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agency ids of the raw extract and their labels."""
    item = _agency(F.substring("o_orderpriority", 1, 1))
    return (
        table(spark, sf_dir, "orders")
        .select(F.concat(F.lit("id"), item).alias("id"), item.alias("item"))
        .distinct()
    )


def raw_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel and the ratio rows as an all-text extract, the way one is landed."""
    stock = orders_panel(spark, sf_dir).withColumns(
        {"indicator": F.lit("TX_CURR"), "numeratordenom": F.lit("N")}
    )
    rows = with_names(spark, sf_dir, stock.unionByName(ratio_panel(spark, sf_dir)))
    quarter = (F.col("period_idx") - 1) % 4
    year = ((F.col("period_idx") - 1 - quarter) / 4).cast("int") - (quarter == 0).cast("int")
    months = F.array(*[F.lit(m) for m in ("Oct to Dec", "Jan to Mar", "Apr to Jun", "Jul to Sep")])
    regional = F.col("operatingunit").isin("AMERICA", "ASIA")
    owner = F.when(
        F.col("mech_code") == "5", F.concat(F.lit("00000 De-dup - "), "mech_name")
    ).otherwise(F.concat_ws(" - ", F.lit("17"), "mech_code", "mech_name"))
    return rows.select(
        F.concat_ws(" ", F.get(months, quarter), year.cast("string")).alias("Period"),
        F.lit("Global").alias("orglvl_1"),
        F.lit("World").alias("orglvl_2"),
        F.when(regional, F.concat("operatingunit", F.lit(" Region")))
        .otherwise(F.col("operatingunit"))
        .alias("orglvl_3"),
        F.col("snu1").alias("orglvl_4"),
        F.concat_ws(" ", "snu1", F.lit("district"), (F.col("orgunituid") % 10).cast("string")).alias(
            "orglvl_5"
        ),
        F.col("facility").alias("Organisation unit"),
        F.col("orgunituid").cast("string").alias("orgunituid"),
        F.concat(F.lit("id"), "fundingagency").alias("Funding Agency"),
        owner.alias("Funding Mechanism"),
        F.col("indicator").alias("Technical Area"),
        F.when(F.col("numeratordenom") == "D", "Top Level Denominator")
        .otherwise("Top Level Numerator")
        .alias("Top Level"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("Value"),
    )


def fiscal_wide(
    spark: SparkSession,
    sf_dir: str,
    stock: DataFrame | None = None,
    ratio: DataFrame | None = None,
    owners: DataFrame | None = None,
) -> DataFrame:
    """Stock and denominator sums by unit, group, owner and partner, quarters as columns.

    ``stock`` and ``ratio`` are the two panels, ``owners`` the owner table, if the caller has them at hand.
    """
    stock = orders_panel(spark, sf_dir) if stock is None else stock
    ratio = ratio_panel(spark, sf_dir) if ratio is None else ratio
    stock = stock.withColumns(
        {
            "indicator": F.lit(STOCK_ROWS[0]),
            "numeratordenom": F.lit("N"),
            "standardizeddisaggregate": F.lit(STOCK_ROWS[1]),
        }
    )
    den = ratio.where(F.col("numeratordenom") == "D").withColumn(
        "standardizeddisaggregate", F.lit(DENOMINATOR_ROWS[1])
    )
    quarter = (F.col("period_idx") - 1) % 4 + 1
    keys = [
        "fiscal_year",
        "operatingunit",
        "fundingagency",
        "mech_code",
        "primepartner",
        "indicator",
        "standardizeddisaggregate",
        "numeratordenom",
    ]
    year = ((F.col("period_idx") - quarter) / 4).cast("int")

    def summed(rows: DataFrame) -> DataFrame:
        named = with_names(spark, sf_dir, rows, owners)
        placed = named.withColumns({"fiscal_year": year, "quarter": quarter.cast("string")})
        return placed.groupBy(*keys, "quarter").agg(exact_sum("value").alias("value"))

    # the indicator is a key: each panel is summed where it lies, and only sums are stacked
    return wide_fiscal_table(summed(stock).unionByName(summed(den)))
