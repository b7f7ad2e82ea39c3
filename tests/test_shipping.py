"""Tasks carry the library's functions with them: executors need no copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HEAD = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
"""


def run_apart(code: str, folder) -> str:
    """What code prints in a process whose workers don't find the package."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", HEAD + code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.strip()


def test_metrics_run_without_the_package_on_executors(tmp_path):
    code = """
from corpusloom.operators import metrics
rows = spark.createDataFrame([("a b c d e", "a b c d e")], "hyp string, ref string")
print(round(metrics.statistics(rows, "hyp", "ref", "bleu").select(metrics.bleu()).first()[0]))
"""
    assert run_apart(code, tmp_path) == "100"
