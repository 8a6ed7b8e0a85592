"""Fiscal quarters: labels for display, an integer index for order.

The index is ``fiscal year * 4 + quarter``.  Labels (``FY20Q1``) carry two year
digits, so they sort wrongly across a century; nothing here sorts by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.columns import as_col


def fiscal_index(date: Column | str, start_month: int = 10) -> Column:
    """Index of the fiscal quarter that holds a date."""
    d = as_col(date)
    months = F.year(d) * 12 + F.month(d) - 1 + (13 - start_month) % 12
    return (F.floor(months / 3) + 1).cast("int")


def fiscal_year(index: Column | str) -> Column:
    i = as_col(index)
    return ((i - fiscal_quarter(i)) / 4).cast("int")


def fiscal_quarter(index: Column | str) -> Column:
    return ((as_col(index) - 1) % 4 + 1).cast("int")


def index_label(index: Column | str) -> Column:
    """``FYyyQq`` label of an index; null for a null index."""
    i = as_col(index)
    year = F.substring(fiscal_year(i).cast("string"), 3, 2)
    return F.concat(F.lit("FY"), year, F.lit("Q"), fiscal_quarter(i).cast("string"))


def fiscal_label(date: Column | str, start_month: int = 10) -> Column:
    return index_label(fiscal_index(date, start_month))


def period_text_month(text: Column | str) -> Column:
    """The first ``Mon YYYY`` in a text, null when there is none."""
    return F.nullif(F.regexp_extract(as_col(text), r"\p{Alpha}{3} [0-9]{4}", 0), F.lit(""))


def month_date(month: Column | str) -> Column:
    """First day of a ``Mon YYYY`` month; null when the name is no month."""
    m = as_col(month)
    at = F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.initcap(F.substring(m, 1, 3)))
    number = F.when((at - 1) % 3 == 0, ((at + 2) / 3).cast("int"))
    return F.make_date(F.substring(m, 5, 4).cast("int"), number, F.lit(1))


def period_text_date(text: Column | str) -> Column:
    """First day of the first month named in a period text."""
    return month_date(period_text_month(text))


def quarter_list(spark: SparkSession, start: str, end: str, drop_first: bool = True) -> DataFrame:
    """Calendar quarters ``yyyyQq`` from ``start`` to ``end``; the first is left out."""
    first, last = [int(s[:4]) * 4 + int(s[5:]) - 1 for s in (start, end)]
    q = F.col("id")
    return spark.range(first + int(drop_first), last + 1).select(
        F.format_string("%dQ%d", F.floor(q / 4), q % 4 + 1).alias("quarter")
    )


def calendar_quarter(date: Column | str) -> Column:
    d = as_col(date)
    return F.format_string("%dQ%d", F.year(d), F.quarter(d))
