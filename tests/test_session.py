"""A session without a checkpoint folder: local runs get one, clusters must name one."""

import os
import subprocess
import sys

from places import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from pubsift.session import ensure_checkpoint_dir, materialize
assert materialize(spark.range(3)).count() == 3
assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
import __spark_entry__ as E
assert E.queries()["attach_rank"](spark, %r).count() >= 0
print("fine")
"""


def test_entry_runs_without_a_configured_checkpoint_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE % SF_SMALL], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
