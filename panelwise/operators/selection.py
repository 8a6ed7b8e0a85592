"""Order statistics of groups by counting, without the group's values in one task.

A bracket per group holds the value looked for.  In each round the bracket's values are
counted in BUCKETS equal parts (partial counts, one row per group and part after the
shuffle), and the part that holds the place becomes the new bracket, drawn in to its
smallest and largest value.  When few values are left they are sorted.  A group may thus
hold any share of the table, and a round moves counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.operators.joins import join_nullsafe
from panelwise.sources.stages import stage as staged

BUCKETS = 256
FEW = 1024  # distinct values of a bracket that one row may hold

Stage = Callable[[DataFrame, str], DataFrame]


def _part(v: Column, low: Column, high: Column) -> Column:
    """Number of the equal part of [low, high] that holds v; never falls as v grows.

    Halves keep the width finite.  A bracket with an end that is infinite or no number
    has the parts: minus infinity, numbers, infinity, no number.
    """
    inf = float("inf")
    odd = F.isnan(high) | (high == inf) | (low == -inf)
    kind = F.when(F.isnan(v), 3).when(v == inf, 2).when(v == -inf, 0).otherwise(1)
    at = F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS).cast("int")
    return F.when(odd, kind).otherwise(F.least(at, F.lit(BUCKETS - 1)))


def nth_value(df: DataFrame, keys: list[str], value: str, place: Callable[[Column], Column], stage: Stage = staged) -> DataFrame:
    """(keys, nth, size): the value at a place (from 0) of each group's sorted non-null values.

    ``place`` gives the place from the group's size.  Groups without a value have a null;
    infinities and NaN sort as Spark sorts them.  Null keys are keys.
    """
    of_all = df.select(*keys).distinct()
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = stage(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "value-counts")
    whole = counts.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_c").alias("size"), F.count(F.lit(1)).alias("_kinds"))
    state = stage(whole.withColumn("_at", place(F.col("size")).cast("long")), "brackets")
    found = []
    while True:
        is_open = (F.col("_low") != F.col("_high")) & (F.col("_kinds") > FEW)
        found.append(state.where(~is_open))
        brackets = state.where(is_open)
        if brackets.isEmpty():
            break
        inside = join_nullsafe(counts, brackets, keys, "inner").where(F.col("_v").between(F.col("_low"), F.col("_high")))
        parts = inside.withColumn("_part", _part(F.col("_v"), F.col("_low"), F.col("_high"))).groupBy(*keys, "_part")
        parts = parts.agg(
            F.sum("_c").alias("_n"),
            F.count(F.lit(1)).alias("_kinds"),
            F.min("_v").alias("_low"),
            F.max("_v").alias("_high"),
            F.first("size").alias("size"),
            F.first("_at").alias("_at"),
        )
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")  # BUCKETS rows a key at most
        placed = parts.withColumn("_before", before)
        holds = (F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n"))
        chosen = placed.where(holds).withColumn("_at", F.col("_at") - F.col("_before"))
        state = stage(chosen.select(*keys, "_low", "_high", "size", "_kinds", "_at"), "brackets")
    ends = found[0]
    for more in found[1:]:
        ends = ends.unionByName(more)
    one = F.col("_low") == F.col("_high")
    left = join_nullsafe(counts, ends.where(~one), keys, "inner").where(F.col("_v").between(F.col("_low"), F.col("_high")))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")) - F.col("_c")  # FEW rows a key at most
    left = left.withColumn("_before", before)
    sorted_ = left.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c")))
    both = ends.where(one).select(*keys, F.col("_low").alias("nth"), "size").unionByName(sorted_.select(*keys, F.col("_v").alias("nth"), "size"))
    return join_nullsafe(of_all, stage(both, "nth-values"), keys)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median", stage: Stage = staged) -> DataFrame:
    """The median of each group's non-null values, as ``F.median`` gives it; null without any.

    Of an even number it is the mean of the two in the middle: the lower one is found by
    counting, the upper one is the same or the next larger value.
    """
    lower = nth_value(df, keys, value, lambda n: F.floor((n - 1) / 2), stage)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    upper = join_nullsafe(rows, lower, keys, "inner").groupBy(*keys).agg(
        F.first("nth").alias("_lower"),
        F.first("size").alias("_size"),
        F.count_if(F.col("_v") <= F.col("nth")).alias("_upto"),
        F.min(F.when(F.col("_v") > F.col("nth"), F.col("_v"))).alias("_next"),
    )
    in_upper = F.col("_upto") > F.floor(F.col("_size") / 2)
    second = F.when(in_upper | (F.col("_size") % 2 == 1), F.col("_lower")).otherwise(F.col("_next"))
    # as F.median interpolates: lower + (upper - lower) / 2 in equal weights
    return upper.select(*keys, (F.col("_lower") * 0.5 + second * 0.5).alias(name))
