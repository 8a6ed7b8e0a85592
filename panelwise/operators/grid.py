"""Periods of a panel, completion, filling and exit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.sources.stages import tasks_of
from panelwise.spec import DEFAULT_SPEC, PanelSpec


def period_arrays(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, **axes: Column) -> DataFrame:
    """One row: the sorted distinct periods as ``all``, and for each named
    condition those with a row that meets it.

    There are four fiscal quarters a year, so the arrays follow the calendar and
    not the row count.
    """
    idx = F.col(spec.index)
    named = {"all": idx, **{name: F.when(cond, idx) for name, cond in axes.items()}}
    return df.where(idx.isNotNull()).agg(
        *[F.array_sort(F.collect_set(c)).alias(name) for name, c in named.items()]
    )


def explode_periods(arrays: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Period table from ``period_arrays``: one row per period of ``all``.

    For each axis: ``_pos`` (place on it, null when not on it), ``_next`` (first
    later period on it), ``_first`` and ``_last``.
    """
    idx = F.col(spec.index)
    columns = []
    for axis in arrays.columns:
        later = F.filter(axis, lambda p: p > F.col(spec.index))
        columns += [
            F.nullif(F.array_position(axis, idx), F.lit(0)).cast("int").alias(f"{axis}_pos"),
            F.array_min(later).alias(f"{axis}_next"),
            F.array_min(axis).alias(f"{axis}_first"),
            F.array_max(axis).alias(f"{axis}_last"),
        ]
    return arrays.withColumn(spec.index, F.explode("all")).select(spec.index, *columns)


def period_table(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, **axes: Column) -> DataFrame:
    """One row per distinct period, with its place among the others.

    A step along the grid is a lookup in this table.  It holds one row per
    quarter, whatever the size of the panel, which makes it safe to broadcast.
    """
    return explode_periods(period_arrays(df, spec, **axes), spec)


def on_periods(df: DataFrame, periods: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Join a period table; rows of periods that are not in it get nulls."""
    return df.join(F.broadcast(periods), spec.index, "left")


def period_bound(df: DataFrame, how: str = "max", spec: PanelSpec = DEFAULT_SPEC) -> Column:
    """Smallest or largest period index of a table, as a scalar subquery."""
    return df.agg({"max": F.max, "min": F.min}[how](spec.index)).scalar()


def complete(
    df: DataFrame,
    over: str,
    nesting: list[str],
    fill: dict[str, object] | None = None,
) -> DataFrame:
    """Every distinct value of ``over`` for every observed tuple of ``nesting``.

    Tuples that are missing come in with nulls; ``fill`` then replaces nulls,
    also those that were in the input.  ``over`` must have few distinct values; rows
    without one are left out, but their ``nesting`` counts.  Null keys are keys, and
    repeated rows stay.

    The rows themselves do not move: each key gathers the values it has (partial sets,
    no more than there are values), and the others come out of that one row.  The table
    is read three times, so it should be staged.
    """
    values = df.agg(F.array_sort(F.collect_set(over))).scalar()
    seen = df.groupBy(*nesting).agg(F.collect_set(over).alias("_seen"))
    absent = seen.select(*nesting, F.explode(F.array_except(values, "_seen")).alias(over))
    given = [*nesting, over]
    kinds = {f.name: f.dataType for f in df.schema}
    absent = absent.select(*[F.col(c) if c in given else F.lit(None).cast(kinds[c]).alias(c) for c in df.columns])
    out = df.where(F.col(over).isNotNull()).unionByName(absent)
    for c, v in (fill or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def fill_down_up(
    df: DataFrame, cols: list[str], keys: list[str], order: list[str]
) -> DataFrame:
    """Replace nulls by the last value before, else by the first value after.

    A row without a value before it lies before the first value of its key, which is then the
    first one after it.  So one sort does for both: a running frame, and the whole key, which
    is read once.  Rows are dealt into all shuffle partitions: a filled grid compresses so
    well that adaptive execution would crowd millions of its rows into a task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(whole))
    dealt = df.repartition(tasks_of(df.sparkSession), *keys)
    return dealt.withColumns({c: fill(c) for c in cols})


def with_exits(
    df: DataFrame,
    keys: list[str],
    periods: DataFrame,
    spec: PanelSpec = DEFAULT_SPEC,
    axis: str = "all",
    also: str | None = None,
) -> DataFrame:
    """Observed rows plus one row in the period after a run of observations ends.

    Adds ``prior`` (stock one period earlier, 0 when absent, null in the first
    period) and ``observed``.  On exit rows the stock is 0.  This is all of the
    completed grid that can have a non-zero change, at most three times the input.

    Two rows of a key in one period are an error.

    ``axis`` names the periods to step along.  Where the next period on the axis
    ``also`` lies beyond that step and the key is still absent there, it gets a
    row there too.  Each window holds one row per period of one key.
    """
    idx, val = F.col(spec.index), F.col(spec.value)
    nxt, seen_next = F.col(f"{axis}_next"), F.col("_seen_next")
    w = W.partitionBy(*keys).orderBy(spec.index)
    named = F.concat_ws(", ", *[F.col(c).cast("string") for c in (*keys, spec.index)])
    prior = (
        F.when(F.lag(idx).over(w) == idx, F.raise_error(F.concat(F.lit(f"several rows for {[*keys, spec.index]} = "), named)))
        .when(F.lag(nxt).over(w) == idx, F.lag(spec.value).over(w))
        .when(idx != F.col(f"{axis}_first"), 0.0)
    )
    steps = [nxt] if also is None else [nxt, F.col(f"{also}_next")]
    placed = on_periods(df, periods, spec).select(
        *df.columns,
        *steps,
        F.lead(spec.index).over(w).alias("_seen_next"),
        prior.alias("_prior"),
    )

    def row(index: Column, stock, before, seen: bool) -> Column:
        return F.struct(
            index.alias(spec.index),
            F.lit(stock).alias(spec.value),
            F.lit(before).alias("prior"),
            F.lit(seen).alias("observed"),
        )

    exits = nxt.isNotNull() & (seen_next.isNull() | (seen_next > nxt))
    rows = [row(idx, val, F.col("_prior"), True), F.when(exits, row(nxt, 0.0, val, False))]
    if also is not None:
        later = F.col(f"{also}_next")
        still_absent = (later > nxt) & (seen_next.isNull() | (seen_next > later))
        rows.append(F.when(exits & still_absent, row(later, 0.0, 0.0, False)))
    rest = [c for c in df.columns if c not in (spec.index, spec.value)]
    return (
        placed.select(*rest, F.explode(F.array(*rows)).alias("_row"))
        .where(F.col("_row").isNotNull())
        .select(*rest, "_row.*")
    )
