"""The registered queries against their SQL, at the smallest scale."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from .conftest import ROOT, SF

NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")
#: Queries that may find nothing in the smallest tables.
SPARSE = {"ui_entity_filter_sort"}


def canonical(frame):
    columns = sorted(frame.columns)
    plain = lambda v: "NULL" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(map(plain, row)) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = canonical(entry.queries()[name](spark, SF).toPandas())
    assert got == canonical(duck.execute(entry.oracle_sql()[name]).df())
    assert got[1] or name in SPARSE


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_split_entities_hold_no_edge_between_their_conflicts(spark):
    whole, parts = (entry.queries()[n](spark, SF) for n in ("entities", "conflict_split"))
    against = entry.queries()["transitive_conflicts"](spark, SF)
    assert parts.count() == whole.count()
    assert parts.select("master_entity_id").distinct().count() >= whole.select("master_entity_id").distinct().count() + against.select("master_entity_id").distinct().count()


def test_the_rest_works_without_the_llm_folders(tmp_path):
    kept = tmp_path / "copy"
    left_out = {ROOT / "kinweave" / "llm", ROOT / "tests" / "llm", ROOT / "corpus_pipeline.py", ROOT / ".git"}
    shutil.copytree(ROOT, kept, ignore=lambda folder, names: [n for n in names if Path(folder) / n in left_out or n == "__pycache__"])
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [n for n in q if n[:2] == 'op' or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=kept, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
