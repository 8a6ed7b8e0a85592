"""Every registered query against its SQL, and the expected counts of the panel."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import check, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelwise.operators.net_change import net_change_adjusted, net_change_standard
from panelwise.plans import catalog, oracle
from panelwise.sources.stages import stage

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


ROOT = Path(__file__).resolve().parents[1]


def in_child(script: str, root: Path) -> subprocess.CompletedProcess:
    """Runs Python that sees the repository at ``root`` and all that this process sees."""
    path = [str(root), str(root / "tests"), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(path), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", script], env=env, cwd=root, capture_output=True, text=True, timeout=900)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())


#: Its SQL names the columns that the tables of this size have.
AT = {"multi_owner_histogram": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, con, name):
    there = AT.get(name, SMALL)
    assert check(spark, connect(there) if name in AT else con, name, there) is None


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_sql_can_be_a_view(con, name):
    con.execute(f"CREATE OR REPLACE VIEW as_view AS {oracle.oracle_sql()[name]}")


@pytest.mark.parametrize("gone", [("panelwise/llm", "tests/llm"), ("panelwise/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_stands_without_the_training_data_part(tmp_path, gone):
    skip = {ROOT / g for g in gone} | {ROOT / ".git"}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: {n for n in names if Path(d) / n in skip or n == "__pycache__"})
    run = in_child("import __spark_entry__ as e; print(*sorted({*e.queries()} ^ {*e.oracle_sql()}), len(e.queries()))", tmp_path / "copy")
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.split() == [str(len(catalog.queries()))]


def test_no_query_falls_back_from_compiled_code():
    """A stage whose generated code does not compile only logs it and runs slowly."""
    script = (
        "from local_session import session; import __spark_entry__ as e\n"
        "spark = session(4)\n"
        "for n in ('ratio_compare', 'ratio_aggregate', 'multi_owner_sites', 'net_change_by_owner'):\n"
        f"    e.queries()[n](spark, '{SMALL}').write.format('noop').mode('overwrite').save()\n"
    )
    run = in_child(script, ROOT)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "Failed to compile" not in run.stderr + run.stdout


def test_entry(spark):
    assert entry.entry(spark).count() == 2759


@pytest.fixture(scope="module")
def flags(spark):
    return stage(catalog._flags(spark, SMALL), "flags")


def test_flag_counts(flags):
    got = flags.agg(
        F.count(F.lit(1)),
        F.count_if("flag_loneobs"),
        F.count_if("flag_multimech_site"),
        F.count_if("flag_end_sitexmech"),
        F.count_if("vlc_valid"),
    ).first()
    assert tuple(got) == (1453, 1151, 362, 612, 255)


def test_end_type_counts(flags):
    got = {r.end_type: r["count"] for r in flags.where("flag_end_sitexmech").groupBy("end_type").count().collect()}
    assert got == {
        "Transition to other agency": 278,
        "Transition out of PEPFAR": 145,
        "Consolidate multi-mechanism site": 119,
        "Transition to other mechanism": 70,
    }


def test_method_counts(flags):
    got = {(r.method, r.vlc_valid): r["count"] for r in flags.groupBy("method", "vlc_valid").count().collect()}
    assert got == {("adjusted", False): 788, ("adjusted", True): 255, ("standard", False): 410}


def test_grid_and_pruned_sizes(flags):
    assert net_change_standard(flags, dense=True).count() == 17388
    assert net_change_adjusted(flags).count() == 1818


def test_net_change_totals(spark):
    nn = catalog._net_change(spark, SMALL)
    got = {
        r.method: (r.n, r.x, round(r.s, 2), round(r.a, 2), round(r.p, 2))
        for r in nn.groupBy("method")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("tx_xfer").alias("x"),
            F.sum("tx_net_new").alias("s"),
            F.sum("tx_net_new_adj").alias("a"),
            F.sum("tx_net_new_adj_plus").alias("p"),
        )
        .collect()
    }
    assert got == {
        "adjusted": (1974, 445, -530555.84, -2210295.13, -2210295.13),
        "standard": (785, 0, -7420435.60, -3525986.68, -7420435.60),
    }


def test_standard_changes_add_up_to_the_site(spark):
    """The owners' changes of a site-period sum to the change of the site's total."""
    nn = catalog._net_change(spark, SMALL)
    sites = nn.groupBy("orgunituid", "period_idx").agg(
        F.sum(F.coalesce("tx_curr", F.lit(0.0))).alias("total"), F.sum("tx_net_new").alias("change")
    )
    before = sites.select("orgunituid", (F.col("period_idx") + 1).alias("period_idx"), F.col("total").alias("was"))
    off = (
        sites.where("change IS NOT NULL")
        .join(before, ["orgunituid", "period_idx"], "left")
        .where(F.abs(F.col("total") - F.coalesce("was", F.lit(0.0)) - F.col("change")) > 1e-6)
    )
    assert off.count() == 0
