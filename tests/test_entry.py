"""The entry from another folder: workers get the package; and a broken lineage stops its query."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.queries()["tk11_distinct_palettes"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in got.stdout and int(got.stdout.split("ROWS")[1]) > 0, got.stderr[-2000:]


def test_broken_lineage_stops(spark):
    from huestrata.operators import relations as rel

    base = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "cluster long, member long")
    whole = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "cluster long, member long")
    assert sorted(map(tuple, rel.lineage(base, whole).collect())) == [(1, 9, 2), (2, 9, 1)]
    for torn in ([(9, 1), (8, 2), (8, 3)], [(9, 1), (9, 2), (7, 3), (9, 3)]):  # a cluster that was split, a member in two
        with pytest.raises(Exception, match="descendants"):
            rel.lineage(base, spark.createDataFrame(torn, "cluster long, member long")).collect()
