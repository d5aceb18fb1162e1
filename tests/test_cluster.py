"""Queries on executors that are processes of their own."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyspark

from pelagraph.plans import registry

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
RUN = """
import json, sys
from pyspark.sql import SparkSession
from pelagraph.plans import registry
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
print("rows", json.dumps(sorted(map(list, registry.QUERIES[sys.argv[1]](spark, sys.argv[3]).collect()))))
"""


def test_scan_jdbc_reads_its_database_from_every_executor(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors write to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", RUN, "scan_jdbc", f"file://{tmp_path}/shared", SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    got = [x for x in done.stdout.splitlines() if x.startswith("rows ")]
    assert got, done.stderr[-2000:]
    sql = registry.ORACLE["scan_jdbc"].replace("FROM supplier", f"FROM '{SF}/supplier.parquet'")
    assert json.loads(got[0][5:]) == sorted(map(list, duckdb.sql(sql).fetchall()))
