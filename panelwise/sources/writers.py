"""Writing tables for people and other tools.  Between stages use Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, null as empty text; one file per task."""
    df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_by(
    df: DataFrame, col: str, path: str, fmt: str = "parquet", mode: str = "errorifexists", compression: str | None = None
) -> None:
    """One folder per value of a column (indicator, operating unit).

    Rows are dealt into ranges of the column, of the task that made the row and of a hash of
    the row first: a large value then lies in several ranges and several small ones in one,
    by their numbers of rows, so a folder gets about as many files as its size asks for,
    however many tasks made the rows, and no task reads more than its range of a large
    value.  Adaptive execution joins ranges that are small.  ``compression`` is the files'
    codec; text has none unless named.
    """
    names = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    # a task's rows stay together: they are often alike, and both the shuffle and the files compress better
    ranges = df.repartitionByRange(F.col(f"`{col}`"), F.spark_partition_id(), F.xxhash64(*names))
    out = ranges.write.mode(mode).partitionBy(col)
    if fmt == "csv":
        out = out.option("header", True).option("nullValue", "").option("emptyValue", "")
    if compression:
        out = out.option("compression", compression)
    out.format(fmt).save(path)


def write_extracts(extracts: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each named subset as CSV under its own folder."""
    for name, df in extracts.items():
        write_csv(df, f"{path}/{name}", mode)
