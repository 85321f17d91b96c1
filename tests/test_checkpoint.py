"""Queries that cut lineage work in a plain local session without a preset folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLAIN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from barograph.plans import load
from barograph.sources.checkpoint import cut, shared_folder, stored

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark)
df = spark.range(5)
assert stored(df, "five").count() == 5 and cut(df).count() == 5
assert load()["s4_aligned_panel"].run(spark, "/root/testdata/sf0.001").count() > 0
assert load()["k16_full_correlation"].run(spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


def test_plain_local_session(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run(
        [sys.executable, "-c", PLAIN.format(root=ROOT)], env=env, capture_output=True, text=True, timeout=300
    )
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_stored_tables_leave_no_shuffle_files(spark):
    import glob
    import time

    from barograph.sources.checkpoint import CLEANUP, stored

    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before = shuffles()
    table = stored(spark.range(20_000).selectExpr("id % 1000 AS k").groupBy("k").count(), "counts")
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert table.count() == 1000 and spark.conf.get(CLEANUP) == "false"
