import os
import subprocess
import sys

from kinweave import storage
from kinweave.operators import bronze
from kinweave.sources.tables import exists
from pyspark.sql import functions as F

from .conftest import ROOT


def test_tables_in_the_shared_folder(spark):
    root = storage.shared_root(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = storage.materialize(spark.range(5), "kept")
    gone = storage.materialize(spark.range(7), "gone")
    folder = gone.inputFiles()[0].rsplit("/", 1)[0]
    assert kept.count() == 5 and exists(spark, folder)
    storage.discard(gone)
    assert not exists(spark, folder) and kept.count() == 5
    assert "Range" not in kept._jdf.queryExecution().toString()
    empty = storage.materialize(spark.range(0), "empty")
    assert empty.count() == 0 and empty.columns == ["id"]


def test_discard_leaves_other_tables_alone(spark, tmp_path):
    path = f"file://{tmp_path}/own"
    spark.range(3).write.parquet(path)
    storage.discard(spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 3


def test_rows_without_party(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    parties = bronze.simple_parties(rows.filter("k = 1"), "S", "t", "k", "TBL", "PT", F.lit("2026-01-01").cast("timestamp"))
    assert [r.k for r in bronze.rows_without_party(rows, parties, "k", "TBL").collect()] == [2]
    assert bronze.rows_without_party(rows, parties, "k", "OTHER").count() == 2


def test_the_folder_goes_when_the_driver_ends(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from kinweave.storage import materialize
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
assert materialize(spark.range(3), "t").count() == 3
import os
assert len([n for n in os.listdir("{tmp_path}/shared") if n.startswith("kinweave-")]) == 1
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
    assert not [n for n in os.listdir(tmp_path / "shared") if n.startswith("kinweave-")]
