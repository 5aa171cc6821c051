"""The executors get the package from the session, not from where the job was started."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
queries = entry.queries()
for name in ("corr_matrix", "report_correlation"):
    print(name, queries[name](spark, "/root/testdata/sf0.001").count())
"""


def test_matrices_from_another_folder(tmp_path):
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=bare, capture_output=True, text=True, timeout=300)
    found = dict(line.split() for line in out.stdout.splitlines() if len(line.split()) == 2)
    assert found.keys() == {"corr_matrix", "report_correlation"}, out.stderr[-2000:]
    assert all(int(n) > 0 for n in found.values())
