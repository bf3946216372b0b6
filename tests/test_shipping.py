"""Python workers find the package even where neither path nor folder shows it to them."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["p5_totals"](spark, "/root/testdata/sf0.001").count(), entry.queries()["cc_weak"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_import_the_package(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={"PATH": "/usr/bin:/bin", **{k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}})
    assert "rows" in done.stdout, done.stderr[-2000:]
