"""Reading landed extracts, typed CSV tables and dated snapshots."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from panelwise.functions.periods import calendar_quarter, period_text_date
from panelwise.spec import FLAG_COLUMNS


def typed_schema(
    columns: list[str], doubles: tuple[str, ...] = (), bools: tuple[str, ...] = ()
) -> StructType:
    """All columns text, but for the named doubles and booleans."""
    kinds = {**dict.fromkeys(doubles, DoubleType()), **dict.fromkeys(bools, BooleanType())}
    return StructType([StructField(c, kinds.get(c, StringType())) for c in columns])


# Columns of the published tables, in their order.
ORG_COLUMNS = ["operatingunit", "countryname", "snu1", "psnu", "facility", "orgunituid"]
OWNER_COLUMNS = ["fundingagency", "mech_code", "mech_name", "primepartner"]
MEASURE_COLUMNS = [
    "tx_curr",
    "tx_net_new",
    "tx_curr_lag_site",
    "tx_curr_lag2_site",
    "tx_net_new_adj",
    "tx_net_new_adj_plus",
    "tx_xfer",
    "tx_pvls_d",
    "tx_pvls",
]
BOOL_FLAGS = ("flag_loneobs", "flag_multimech_site", "flag_end_sitexmech", "vlc_valid")
FLAGS_SCHEMA = typed_schema(
    [*ORG_COLUMNS, *OWNER_COLUMNS, "period", "value", *FLAG_COLUMNS], ("value",), BOOL_FLAGS
)
FINAL_SCHEMA = typed_schema(
    [*ORG_COLUMNS, *OWNER_COLUMNS, "period", *MEASURE_COLUMNS, *FLAG_COLUMNS],
    tuple(MEASURE_COLUMNS),
    BOOL_FLAGS,
)


def read_extract(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Landed extract files of all countries; every file has the same columns."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_typed(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str],
    doubles: tuple[str, ...] = (),
    bools: tuple[str, ...] = (),
) -> DataFrame:
    """CSV with a fixed schema: codes such as ``00001`` stay text, empty is null."""
    schema = typed_schema(columns, doubles, bools)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def latest_snapshot(df: DataFrame, col: str = "snapshot") -> DataFrame:
    """Rows of the newest snapshot; on a partition column only its files are read."""
    return df.where(F.col(col) == df.agg(F.max(col)).scalar())


def partition_values(spark: SparkSession, path: str, col: str) -> list[str]:
    """Values of a partition column from the names of a dataset's folders; no file is opened."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(root) if f.isDirectory()]
    values = [unquote(n.removeprefix(f"{col}=")) for n in names if n.startswith(f"{col}=")]
    return [v for v in values if v != "__HIVE_DEFAULT_PARTITION__"]


def read_latest(spark: SparkSession, root: str, dataset: str, col: str = "snapshot") -> DataFrame:
    """Newest snapshot of a dataset laid out as ``root/dataset/snapshot=.../``.

    The newest is the largest number if all names are whole numbers, else the last
    name as text (dates in year-month-day order).  It is found by the folders' names, and
    only its folder is listed and read.
    """
    path = f"{root}/{dataset}"
    values = partition_values(spark, path, col)
    if not values:
        raise ValueError(f"{path} holds no {col}")
    numbers = all(v.lstrip("-").isdecimal() for v in values)
    newest = max(values, key=int if numbers else str)
    glob = "".join(f"[{c}]" if c in "*?[]{}" else c for c in quote(newest, safe=" -._~,;@&()+!$"))
    found = spark.read.option("basePath", path).parquet(f"{path}/{col}={glob}")
    return found.where(F.col(col).cast("string") == newest) if not numbers else found.where(F.col(col) == int(newest))


def scope_extract(
    df: DataFrame,
    periods: DataFrame | list[str],
    indicators: list[str],
    parts: list[str] | None = None,
) -> DataFrame:
    """Rows of the listed calendar quarters, indicators and numerator/denominator parts.

    ``periods`` may be a list or a one-column table of ``yyyyQq`` quarters.
    """
    chosen = df.where(F.col("Technical Area").isin(*indicators))
    if parts is not None:
        chosen = chosen.where(F.col("Top Level").isin(*parts))
    quarter = calendar_quarter(period_text_date("Period"))
    if isinstance(periods, list):
        return chosen.where(quarter.isin(*periods))
    wanted = periods.toDF("_quarter").distinct()
    return chosen.join(wanted, quarter == F.col("_quarter"), "left_semi")
