"""Tables written between two steps of a job."""

from __future__ import annotations

import tempfile
import warnings
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local_folder: list[str] = []
_TABLES = "panelwise_stage_"


def run_folder(spark: SparkSession) -> str:
    """This application's folder for staged tables, below the one the session names.

    ``spark.checkpoint.dir`` names a folder that the driver and all executors share.
    A local session may do without: it gets a temporary folder, and a warning.
    Elsewhere a folder is required, since executors do not see each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("staged tables need a shared folder: set spark.checkpoint.dir")
        if not _local_folder:
            _local_folder.append(tempfile.mkdtemp(prefix="panelwise-"))
            warnings.warn(f"spark.checkpoint.dir is not set, staging in {_local_folder[0]}", stacklevel=3)
        folder = _local_folder[0]
    return f"{folder.rstrip('/')}/panelwise-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the run's folder and go on from the written copy.

    Cuts the lineage: a lost executor costs a re-read, and a table that is used
    twice is computed once.  The copies stay until ``clear_stages``.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for rows that adaptive execution must not crowd into fewer tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage_by(df: DataFrame, name: str, *keys: str, deal: bool = True) -> DataFrame:
    """Like ``stage``, as a table bucketed by ``keys``: later steps by them need no exchange.

    ``deal=False`` leaves rows in the tasks they are in, for tables that are dealt by
    ``keys`` already.  The table is in the session's catalog until ``clear_stages``.
    """
    spark = df.sparkSession
    table, n = f"{_TABLES}{name.replace('-', '_')}_{uuid4().hex}", tasks_of(spark)
    dealt = df.repartition(n, *keys) if deal else df
    dealt.write.bucketBy(n, *keys).option("path", f"{run_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def clear_stages(spark: SparkSession) -> None:
    """Remove all staged tables of this application; call it once their results are written."""
    for table in spark.catalog.listTables(pattern=f"{_TABLES}*"):
        spark.sql(f"DROP TABLE {table.name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
