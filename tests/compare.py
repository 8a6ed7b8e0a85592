"""Run registered queries and their SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]
import __spark_entry__ as entry  # noqa: E402
from local_session import session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


KINDS = {
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def check(spark: SparkSession, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    want_cols = rel.columns
    want = rows_of(want_cols, rel.fetchall())
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} against {sorted(want_cols)}"
    kinds = dict(df.dtypes)
    other = {c: KINDS.get(str(t), str(t)) for c, t in zip(want_cols, rel.types, strict=True)}
    differ = {c: (kinds[c], other[c]) for c in want_cols if kinds[c] != other[c]}
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ, types {differ}, first {bad[0]}"
    if differ:
        return f"types {differ}"
    return None if want else "no rows"


if __name__ == "__main__":
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark, con = session(), connect(sf_dir)
    failed = 0
    for n in names:
        start = time.time()
        try:
            problem = check(spark, con, n, sf_dir)
        except Exception as e:  # report every query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{n:32s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
