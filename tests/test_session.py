import os
import subprocess
import sys
from pathlib import Path

from folioscope.session import checkpoint, materialize, ship

FOREIGN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from folioscope.operators.encoders import HashEncoder, encode_column
from folioscope.session import ship
ship(spark)
rows = spark.createDataFrame([("a b",)], "text string")
print("rows", encode_column(rows, "text", "v", HashEncoder(4)).where("size(v) = 4").count())
"""


def test_workers_get_the_package(tmp_path):
    """Workers started elsewhere, without the repository on their path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", FOREIGN, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in done.stdout, done.stderr[-2000:]


def test_cut_lineage(spark):
    ship(spark)
    ship(spark)
    rows = spark.range(10).selectExpr("id", "id * 2 as twice")
    assert checkpoint(rows).count() == materialize(rows).where("twice = id * 2").count() == 10
