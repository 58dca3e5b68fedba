"""Tables that are kept by name belong to the application that keeps them."""

import subprocess
import sys

_TWO = """
from pyspark.sql import SparkSession
from veldt.registry import kept
for n in (3, 5):
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    first, second = kept("t", spark.range(n)), kept("t", spark.range(n + 1))
    assert second.count() == n + 1 and not first.is_cached and second.is_cached
    spark.stop()
print("both")
"""


def test_a_second_application_in_one_process():
    done = subprocess.run([sys.executable, "-c", _TWO], capture_output=True, text=True, timeout=300, check=False)
    assert done.stdout.strip().endswith("both"), done.stderr[-2000:]
