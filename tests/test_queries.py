"""Every registered query at the smallest size, against its SQL twin where it has one."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import check
from panelwright.plans.oracles import ORACLES
from panelwright.plans.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    outcome = check.compare(spark, "/root/testdata/sf0.001", name)
    assert outcome.startswith("ok"), outcome


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "entity" and df.count() > 0


def test_a_plain_session_without_settings(tmp_path):
    """No spark-defaults.conf: a temporary folder of this process takes the place of the shared one."""
    code = (
        "from panelwright.session import local_session, scratch_base, materialise\n"
        "spark = local_session('2', partitions=2, memory='1g')\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert materialise(spark.range(5), 'x').count() == 5\n"
        "print('FOLDER', scratch_base(spark))\n"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not os.path.exists(done.stdout.split("FOLDER ")[1].strip())


def test_discarded_tables_are_gone(spark):
    from panelwright.session import discard, materialise

    df = materialise(spark.range(5), "gone")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    discard(df)
    assert not os.path.exists(folder)


def test_spread_never_lowers_the_partition_count(spark):
    from panelwright.session import spread

    df = spark.range(0, 100, 1, 6)
    assert spread(df, 5.0, 1.0) is df
    assert spread(df, 12_000.0, 1.0).rdd.getNumPartitions() == 12_000
