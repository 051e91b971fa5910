"""The shared folder and tables that are written once."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from gradeworks.session import input_state, staged


def test_a_changed_input_is_read_again(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(f"{folder}/t.parquet")

    def total():
        return staged(spark, folder, "sum", lambda: spark.read.parquet(f"{folder}/t.parquet").agg(F.sum("id").alias("s"))).first()["s"]

    before = input_state(spark, folder)
    assert total() == 3 and total() == 3 and input_state(spark, folder) == before
    spark.range(10).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert input_state(spark, folder) != before and total() == 45
    assert input_state(spark, str(tmp_path / "none")) == ()


WITHOUT_DEFAULTS = """
from gradeworks.session import build_session, shared_dir, write_table
spark = build_session("alone", "local[1]", 1)
assert write_table(spark.range(4), "t").count() == 4
assert shared_dir(spark) == shared_dir(spark)
print("fine")
"""


def test_a_folder_of_its_own_where_none_is_named(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", WITHOUT_DEFAULTS], env=env, capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr[-2000:]
