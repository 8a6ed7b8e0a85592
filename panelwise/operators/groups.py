"""Counts, sums, shares, ranks and group filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.functions.columns import sum0
from panelwise.operators.joins import join_nullsafe
from panelwise.operators.selection import exact_median
from panelwise.sources.stages import stage as staged
from panelwise.spec import DEFAULT_SPEC, PanelSpec

Stage = Callable[[DataFrame, str], DataFrame]


def count_by(
    df: DataFrame, keys: list[str], wt: str | None = None, name: str = "n"
) -> DataFrame:
    """Rows per key, or the sum of a weight per key."""
    n = F.count(F.lit(1)) if wt is None else sum0(wt)
    return df.groupBy(*keys).agg(n.alias(name))


def count_distinct_by(
    df: DataFrame, keys: list[str], what: list[str], name: str = "n", approx: bool = False
) -> DataFrame:
    """Distinct combinations of ``what`` per key.

    The exact form is distinct, then count: both steps combine before their
    shuffle, so a key with very many combinations is counted by many tasks.
    """
    if approx:
        return df.groupBy(*keys).agg(F.approx_count_distinct(F.struct(*what)).alias(name))
    return count_by(df.select(*keys, *what).distinct(), keys, name=name)


def sum0_by(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Sums that skip nulls and are 0 for groups without values."""
    return df.groupBy(*keys).agg(*[sum0(c).alias(c) for c in cols])


def add_share(df: DataFrame, col: str, keys: list[str] | None = None, name: str = "share") -> DataFrame:
    """Share of a column in its group total, or in the grand total.

    Meant for aggregated tables: the window holds the rows of one group.
    """
    w = W.partitionBy(*(keys or []))
    return df.withColumn(name, F.try_divide(F.col(col), F.sum(col).over(w)))


_RANGE = "_range"


def _in_ranges(df: DataFrame, order: list[Column], stage: Stage) -> DataFrame:
    """The table dealt into ranges of a total order, with the number of each row's range.

    It is written, since drawing the ranges again might cut elsewhere.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(ranges, *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")


def _summed_up(dealt: DataFrame, cols: dict[str, str], order: list[Column]) -> DataFrame:
    totals = dealt.groupBy(_RANGE).agg(*[F.sum(c).alias(f"_sum_{c}") for c in cols])
    ahead = W.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)  # one row per range
    before = totals.select(_RANGE, *[F.coalesce(F.sum(f"_sum_{c}").over(ahead), F.lit(0)).alias(f"_before_{c}") for c in cols])
    so_far = W.partitionBy(_RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(before), _RANGE)
    sums = [(F.coalesce(F.sum(c).over(so_far), F.lit(0)) + F.col(f"_before_{c}")).alias(name) for c, name in cols.items()]
    return out.select(*[c for c in dealt.columns if c != _RANGE], *sums)


def running_sum(df: DataFrame, cols: dict[str, str], order: list[Column], stage: Stage = staged) -> DataFrame:
    """Running sums of columns in the given (total) order: {column: name of its running sum}.

    Two levels, so no task sees the whole table: rows are dealt into ranges of the
    order, rows of a range are summed up in order, and each range gets the totals of the
    ranges before it (one row per range).  Ties of a first column do not crowd a range
    as long as the order is total.  Nulls add nothing; sums of whole numbers are exact.
    """
    return _summed_up(_in_ranges(df, order, stage), cols, order)


def add_cum_share(
    df: DataFrame, col: str, order: list[Column], share: str = "share", name: str = "cum_share", stage: Stage = staged
) -> DataFrame:
    """Share of the grand total and its running sum, in the given (total) order; keys may be many."""
    dealt = _in_ranges(df, order, stage)
    total = dealt.agg(F.sum(col)).scalar()
    summed = _summed_up(dealt, {col: name}, order)
    return summed.select(*df.columns, F.try_divide(F.col(col), total).alias(share), F.try_divide(F.col(name), total).alias(name))


def shares_of(df: DataFrame, key: str, name: str = "n", stage: Stage = staged) -> DataFrame:
    """Count by key, largest first, with share and running share."""
    order = [F.desc(name), F.asc(key)]
    return add_cum_share(count_by(df, [key], name=name), name, order, stage=stage).orderBy(*order)


def top_n_ties(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` largest rows and all rows that tie with the last of them; nulls come last.

    The n-th value is a scalar (every task sends its n largest), not a rank of all rows.
    """
    top = df.select(col).orderBy(F.desc(col)).limit(n)
    last = top.agg(F.struct(F.min(col).alias("value"), F.count_if(F.col(col).isNull()).alias("nulls"))).scalar()
    return df.where((F.col(col) >= last["value"]) | (F.col(col).isNull() & (last["nulls"] > 0)))


RANK_BUCKETS = 256
_STATS = {"sum": sum0, "max": F.max}


def display_rank(
    df: DataFrame,
    key: str | list[str],
    stat: str,
    fun: str = "median",
    desc: bool = False,
    name: str = "display_rank",
    stage: Stage = staged,
) -> DataFrame:
    """Rank of each key by a statistic over its rows (1, 2, ... with ties equal).

    The statistic is ``sum``, ``max`` or ``median``; medians are found by counting, so a
    key may hold any share of the rows.

    Keys may be many, so the ranking is not one sort in one task: distinct statistics
    are ranked inside RANK_BUCKETS buckets that hold about equally many of them, and
    each bucket gets the number of values in the buckets before it.  The bounds of the
    buckets are quantiles of the statistics, so they follow the data, however close
    together it lies; the table of buckets has at most RANK_BUCKETS rows.
    """
    keys = [key] if isinstance(key, str) else key
    sign = -1 if desc else 1
    if fun == "median":
        per_key = exact_median(df, keys, stat, "_stat", stage)
    else:
        per_key = df.groupBy(*keys).agg(_STATS[fun](stat).cast("double").alias("_stat"))
    per_key = stage(per_key, "statistics")
    values = per_key.select("_stat").distinct()
    shares = [F.lit(i / RANK_BUCKETS) for i in range(1, RANK_BUCKETS)]
    bounds = values.agg(F.percentile_approx(F.col("_stat") * sign, F.array(*shares))).scalar()
    below = F.size(F.filter("_bounds", lambda b: b < F.col("_stat") * sign))
    values = values.withColumn("_bounds", bounds).withColumn("_bucket", F.when(F.col("_stat").isNotNull(), below))
    before = W.orderBy(F.col("_bucket").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        values.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("_bucket").orderBy(F.col("_stat") * sign)
    ranked = (
        values.withColumn("_in", F.row_number().over(inside))
        .join(
            F.broadcast(offsets.withColumnRenamed("_bucket", "_b")),
            F.col("_bucket").eqNullSafe(F.col("_b")),
        )
        .select(F.col("_stat").alias("_s"), (F.col("_in") + F.col("_offset")).alias(name))
    )
    return per_key.join(ranked, F.col("_stat").eqNullSafe(F.col("_s"))).select(*keys, name)


def list_rank(df: DataFrame, key: str, order: DataFrame, by: str, name: str = "display_rank") -> DataFrame:
    """Rank of each key by its position in another table, which has a row for each listed key.

    ``order`` holds ``key`` and its position ``by``; positions need not be without gaps
    (ranks are: 1, 2, ... with ties equal), and listed keys that do not occur take no
    rank.  Of a key that is listed more than once the first place counts.  Keys that
    are not listed, null among them unless listed, share the rank after the last.
    """
    places = order.groupBy(key).agg(F.min(by).alias("_stat"))
    found = join_nullsafe(df.select(key).distinct(), places, [key])
    return display_rank(found, key, "_stat", "max", name=name)


def filter_extreme(df: DataFrame, col: str, how: str = "max", of: DataFrame | None = None) -> DataFrame:
    """Rows at the largest or smallest value of a column of the whole table.

    The bound is a scalar subquery; over files it becomes a filter on the scan.
    """
    bound = (df if of is None else of).agg({"max": F.max, "min": F.min}[how](col)).scalar()
    return df.where(F.col(col) == bound)


def filter_group(df: DataFrame, keys: list[str], agg: Column, gt: float) -> DataFrame:
    """All rows of the groups whose aggregate exceeds a bound."""
    chosen = df.groupBy(*keys).agg(agg.alias("_agg")).where(F.col("_agg") > gt)
    return df.join(chosen.select(*keys), keys, "left_semi")


def last_value_of_group(
    df: DataFrame, col: str, keys: list[str], name: str, spec: PanelSpec = DEFAULT_SPEC
) -> DataFrame:
    """The group's value in its own last period, on every row; at least 0.

    Meant for aggregated tables whose groups hold a few rows per period.
    """
    w = W.partitionBy(*keys)
    last = F.max(spec.index).over(w)
    marked = df.withColumn("_last", F.when(F.col(spec.index) == last, F.col(col)).otherwise(0.0))
    return marked.withColumn(name, F.max("_last").over(w)).drop("_last")


def join_ordered(
    df: DataFrame, keys: list[str], value: Column | str, order: list[str], sep: str, name: str
) -> DataFrame:
    """Values of each group as one text, in the given order, nulls skipped."""
    item = F.struct(*[F.col(c) for c in order], (F.col(value) if isinstance(value, str) else value).alias("_v"))
    ordered = F.array_sort(F.collect_list(item))
    return df.groupBy(*keys).agg(
        F.concat_ws(sep, F.transform(ordered, lambda s: s["_v"])).alias(name)
    )
