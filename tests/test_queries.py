"""Every query against its SQL, and the contract module without the training-data subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessel.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    result = duck.execute(ORACLES[name])
    named = [c[0] for c in result.description]
    assert sorted(named) == columns
    want = sorted(repr(tuple(row[named.index(c)] for c in columns)) for row in result.fetchall())
    got = sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect())
    assert got == want and got


def test_entry_and_import_without_subpackage(spark, tmp_path):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 8
    assert set(contract.oracle_sql()) <= set(contract.queries())
    root = Path(contract.__file__).parent
    for x in root.iterdir():
        if x.name in ("tessel", "__spark_entry__.py"):
            (tmp_path / x.name).symlink_to(x) if x.is_file() else (tmp_path / x.name).mkdir()
    for x in (root / "tessel").iterdir():
        if x.name != "llm":
            (tmp_path / "tessel" / x.name).symlink_to(x)
    code = "import __spark_entry__ as e; assert 'search_topk' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
