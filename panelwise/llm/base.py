"""What the operators share: staged tables, names that cannot clash, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.sources.stages import clear_stages, run_folder, stage

__all__ = ["clear_stages", "fresh", "hash60", "longs", "quoted", "read_table", "run_folder", "stage", "without", "word_count"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of the table has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns of these names, whatever their case."""
    gone = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in gone]
    return df if len(kept) == len(df.columns) else df.select(*[quoted(c) for c in kept])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(c: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a long that is not negative."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(spark: SparkSession, rows: list[tuple[int, ...]], names: str) -> DataFrame:
    """A few rows of whole numbers as a table."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'{x}L' for x in r) + ')' for r in rows)} AS t({names})")
