"""Writing by a column: no task reads a large value whole, whoever made it."""

from __future__ import annotations

import gzip
import os
from glob import glob

from pyspark.sql import functions as F

from panelwise.plans import catalog
from panelwise.sources.stages import run_folder
from panelwise.sources.testbed import raw_extract
from panelwise.sources.writers import write_by

SMALL = "/root/testdata/sf0.001"


def test_a_large_value_of_one_task_is_written_by_several(spark, tmp_path):
    """Its rows came from a single task, which the writing tasks could not share before."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        large = spark.range(60_000, numPartitions=1).select(F.lit("large").alias("unit"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
        copies = spark.range(60_000, numPartitions=6).select(F.lit("copies").alias("unit"), F.lit("x").alias("t"))
        df = large.union(copies).union(spark.createDataFrame([("small", "y"), (None, "z")], "unit string, t string"))
        write_by(df, "unit", str(tmp_path / "by"), "csv")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {d.split("=")[-1]: sum(f.startswith("part-") for f in names) for d, _, names in os.walk(tmp_path / "by")}
    assert files["large"] >= 2 and files["small"] == 1 and files["copies"] >= 2, files
    back = spark.read.option("header", True).csv(str(tmp_path / "by")).groupBy("unit").agg(F.countDistinct("t"), F.count("t")).collect()
    assert {r[0]: (r[1], r[2]) for r in back} == {"large": (60_000, 60_000), "copies": (1, 60_000), "small": (1, 1), None: (1, 1)}


def test_rows_of_a_task_stay_together(spark, tmp_path):
    """A file held rows of all tasks before, and alike rows lay far apart in shuffle and files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(40_000, numPartitions=8).select(F.lit("v").alias("unit"), (F.col("id") / 5_000).cast("int").alias("task"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
        write_by(rows, "unit", str(tmp_path / "by"), "csv")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.option("header", True).csv(str(tmp_path / "by"))
    files = back.groupBy(F.input_file_name()).agg(F.countDistinct("task"), F.count("t")).collect()
    assert len(files) >= 3 and max(r[1] for r in files) <= 4 and sum(r[2] for r in files) == 40_000, files


def test_the_landed_extract_is_compressed_text(spark):
    found = set(glob(f"{run_folder(spark)}/landed-*"))
    catalog.landed_extract(spark, SMALL)
    (landed,) = set(glob(f"{run_folder(spark)}/landed-*")) - found
    files = glob(f"{landed}/*/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files), files
    raw = raw_extract(spark, SMALL)
    lines = 0
    for f in files:
        with gzip.open(f) as text:
            lines += sum(1 for _ in text) - 1
    assert lines == raw.count()
    assert {os.path.basename(os.path.dirname(f)) for f in files} == {"Technical Area=TX_CURR", "Technical Area=TX_PVLS"}
