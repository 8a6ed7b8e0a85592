"""Joins of a panel with dimensions, key lists and other panels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_nullsafe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join in which null keys match null keys; key columns appear once."""
    right = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
    cond = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    joined = a.join(right, cond, how)
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        out_keys = [F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) for c in keys]
    else:
        out_keys = [F.col(c) for c in keys]
    rest_a = [c for c in a.columns if c not in keys]
    rest_b = [c for c in b.columns if c not in keys]
    return joined.select(*out_keys, *rest_a, *rest_b)


def enrich(df: DataFrame, dim: DataFrame, key: str, cols: list[str], dim_key: str | None = None) -> DataFrame:
    """Left join that adds ``cols`` of a dimension; two dimension rows of a key are an error.

    No broadcast hint: dimensions of owners or sites grow with the data, so the
    planner compares their size with its broadcast threshold.
    """
    return df.join(one_per_key(dim.select(F.col(dim_key or key).alias(key), *cols), [key]), key, "left")


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table as it is, if every key has one row; else an error that names a key.

    The check is part of a partial aggregate that the join after it would shuffle for.
    """
    rest = [c for c in df.columns if c not in keys]
    text = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit(f"several rows for {keys} = "), text)))
    checked = df.groupBy(*keys).agg(one.otherwise(F.first(F.struct(*rest))).alias("_row"))
    return checked.select(*keys, "_row.*")


def join_crowded(rows: DataFrame, dim: DataFrame, keys: list[str], crowded: Column, spread: list[str], most: int = 100_000) -> DataFrame:
    """Inner join with a table of one row per key, in which the rows of a crowded key spread over all tasks.

    ``crowded`` marks the rows of ``dim`` whose key very many rows have.  They are counted;
    up to ``most`` of them are broadcast, and rows that have met theirs are dealt by ``spread``
    as well in the join with the other keys.  With none or more it is a plain join.  ``dim``
    is read more than once and should be a written table.  Null keys match nothing.
    """
    hot = dim.where(crowded)
    if not 0 < hot.limit(most + 1).count() <= most:
        return rows.join(dim, keys)
    attrs = F.struct(*[c for c in dim.columns if c not in keys])
    marked = rows.dropna(subset=keys).join(F.broadcast(hot.select(*keys, attrs.alias("_hot"))), keys, "left")
    salt = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*spread))
    # a column, not a constant: a constant would be taken out of the keys that rows are dealt by
    plain = F.when(crowded, F.lit(1)).otherwise(F.lit(0)).cast("long")
    cold = dim.select(*keys, plain.alias("_salt"), attrs.alias("_cold"))
    joined = marked.withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    found = joined.withColumn("_found", F.coalesce("_hot", "_cold")).where(F.col("_found").isNotNull())
    return found.select(*keys, *[c for c in rows.columns if c not in keys], "_found.*")


def join_within(rows: DataFrame, facts: DataFrame, site: str, rest: list[str], how: str = "left") -> DataFrame:
    """Join with a table of one row per (site, *rest), in which the rows of a site do not move.

    The facts of a site are gathered in one map, and the join is on the site alone: tables
    that are dealt by it need no exchange.  For sites with few facts.  Two facts of a
    key are an error, null keys match nothing.  ``how`` is left or inner.
    """
    key, attrs = F.struct(*rest), F.struct(*[c for c in facts.columns if c not in (site, *rest)])
    entries = F.map_from_entries(F.collect_list(F.struct(key.alias("k"), attrs.alias("v"))))
    by_site = facts.dropna(subset=[site, *rest]).groupBy(site).agg(entries.alias("_facts"))
    known = reduce(and_, [F.col(c).isNotNull() for c in rest])
    found = rows.join(by_site, site, how).withColumn("_found", F.when(known, F.try_element_at("_facts", key)))
    if how == "inner":
        found = found.where(F.col("_found").isNotNull())
    return found.select(*rows.columns, "_found.*")


def crowded_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """Keys with more than ``most`` rows; partial counts are shuffled, and null is no key."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > most).select(key)


def replace_by_label(df: DataFrame, dim: DataFrame, col: str, dim_key: str, label: str) -> DataFrame:
    """Replace an id column by its label from a dimension."""
    right = dim.select(F.col(dim_key).alias(col), F.col(label).alias("_label"))
    joined = df.join(right, col, "left")
    return joined.select(
        *[F.col("_label").alias(c) if c == col else F.col(c) for c in df.columns]
    )


def keep_keys(df: DataFrame, keys_df: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in another table."""
    return df.join(keys_df, on, "left_semi")


def anti_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``; null keys match null keys.

    Repeated keys of ``b`` are one, and combine before the shuffle.
    """
    right = b.select(*[F.col(c).alias(f"_r_{c}") for c in keys]).distinct()
    return a.join(right, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]), "left_anti")


def difference(a: DataFrame, b: DataFrame, keys: list[str], bag: bool = False) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks, as a set or as a bag.

    The set holds each key once.  The bag holds a key as many times as ``a`` has it more
    often than ``b``.  Null keys match null keys.  Only counts of keys are shuffled, so
    a key that most rows have costs no more than any other.
    """
    left, right = a.select(*keys), b.select(*keys)
    if not bag:
        return anti_join(left.distinct(), right, keys)
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    more = both.groupBy(*keys).agg(F.sum("_n").alias("_n")).where(F.col("_n") > 0)
    return more.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*keys)
