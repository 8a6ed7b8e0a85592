"""Column order, splitting, stacking, wide and long."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.periods import index_label
from panelwise.sources.stages import tasks_of
from panelwise.spec import DEFAULT_SPEC, PanelSpec


def arrange_columns(
    df: DataFrame,
    front: list[str] | None = None,
    drop: list[str] | None = None,
    after: tuple[str, list[str]] | None = None,
) -> DataFrame:
    """Drop columns, put some first, or move some behind another one."""
    cols = [c for c in df.columns if c not in (drop or [])]
    if front:
        cols = [*front, *[c for c in cols if c not in front]]
    if after:
        anchor, moved = after
        cols = [c for c in cols if c not in moved]
        at = cols.index(anchor) + 1
        cols = [*cols[:at], *moved, *cols[at:]]
    return df.select(*cols)


def columns_like(df: DataFrame, contains: str = "", starts: str = "") -> list[str]:
    return [c for c in df.columns if contains in c and c.startswith(starts)]


def pick_level(
    df: DataFrame, level_col: str, prefix: str = "orglvl_", out: str = "psnu"
) -> DataFrame:
    """Take ``out`` from the hierarchy column a row's level names.

    Rows without a level, or with level 0, are dropped; so are the level columns.
    """
    levels = sorted(int(c[len(prefix) :]) for c in columns_like(df, starts=prefix))
    level = F.col(level_col)
    picked = F.coalesce(*[F.when(level == k, F.col(f"{prefix}{k}")) for k in levels])
    gone = {level_col, *columns_like(df, contains="lvl")}
    rest = [c for c in df.columns if c not in gone]
    return df.where(level.isin(*[k for k in levels if k != 0])).select(*rest, picked.alias(out))


# Any run of characters that are neither letters nor digits.
WORD_BREAK = r"[^\p{Alnum}]+"


def stack(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def names_of(df: DataFrame, name: str, order: str | None = None, most: int = 2000) -> list:
    """Distinct values of a column that are to become columns, in order.

    Reads one row per value to the driver, so the table should be a small or staged
    aggregate; more than ``most`` values are an error, since no table is that wide.
    """
    by = order or name
    found = df.where(F.col(name).isNotNull()).select(*dict.fromkeys([name, by])).distinct()
    names = list(dict.fromkeys(r[name] for r in found.orderBy(by).limit(most + 1).collect()))
    if len(names) > most:
        raise ValueError(f"{name} has more than {most} values, too many for columns")
    return names


def to_wide(
    df: DataFrame,
    keys: list[str],
    name: str,
    value: str,
    names: list | None = None,
    fill: object | None = None,
    prefix: str = "",
    order: str | None = None,
    within: bool = False,
) -> DataFrame:
    """One column per value of ``name``.

    Without ``names`` they are read from the data, in the order of ``order``.  A value
    that is not among given names is an error, and so are two values for one cell.

    Rows are dealt by ``keys`` into all shuffle partitions and aggregated there: a cell has
    one value, so nothing would combine before, and adaptive execution would judge the
    many cells of a row by their compressed size.  ``within``: the table is dealt by some of
    ``keys`` already (``stage_by``), and its rows stay where they are.
    """
    names = names_of(df, name, order) if names is None else list(names)
    if not names:
        return df.select(*keys).distinct()
    text = F.coalesce(F.col(name).cast("string"), F.lit("null"))
    known = F.when(F.col(name).isin(*names), F.col(name)).otherwise(
        F.raise_error(F.concat(F.lit(f"{name} has a value without a column: "), text))
    )
    cell = F.when(
        F.count(value) > 1, F.raise_error(F.lit(f"several values of {value} for one of {keys} and {name}"))
    ).otherwise(F.first(value, ignorenulls=True))
    dealt = df.withColumn(name, known)
    if not within:
        dealt = dealt.repartition(tasks_of(df.sparkSession), *keys)
    wide = dealt.groupBy(*keys).pivot(name, names).agg(cell)
    cols = [F.col(f"`{n}`") for n in names]
    if fill is not None:
        cols = [F.coalesce(c, F.lit(fill)) for c in cols]
    return wide.select(*keys, *[c.alias(f"{prefix}{n}") for c, n in zip(cols, names, strict=True)])


def to_long(
    df: DataFrame, keys: list[str], cols: list[str], name: str = "indicator", value: str = "value"
) -> DataFrame:
    """One row per key and listed column."""
    return df.unpivot(keys, cols, name, value)


def quarters_to_periods(
    df: DataFrame,
    keys: list[str],
    year: str = "fiscal_year",
    value: str = "value",
    spec: PanelSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Columns ``qtr1`` .. ``qtr4`` of a fiscal year as one row per period."""
    quarters = F.array(
        *[F.struct((F.col(year) * 4 + q).cast("int").alias("i"), F.col(f"qtr{q}").alias("v")) for q in (1, 2, 3, 4)]
    )
    long = df.select(*keys, F.explode(quarters).alias("_q"))
    placed = long.select(*keys, F.col("_q")["i"].alias(spec.index), F.col("_q")["v"].alias(value))
    return placed.select(*keys, spec.index, index_label(spec.index).alias(spec.period), value)
