"""The driver contract, and each query against its SQL on the smallest tables."""

import glob
import os
import subprocess
import sys

import pytest

from weftline.plans import catalog


def test_entry(spark, tiny):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.queries()) <= set(e.queries())


def test_entry_without_a_package():
    # a package that only the training-data operators need is missing: the core queries stay
    code = "import sys; sys.modules.update(ahocorasick=None, regex=None, xxhash=None); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))], out.stderr


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tiny, name):
    duckdb = pytest.importorskip("duckdb")
    df = catalog.queries()[name](spark, tiny)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    db = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    answer = db.execute(sql)
    names = [x[0] for x in answer.description]
    assert sorted(names) == sorted(df.columns)
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else repr(v)
    order = sorted(df.columns)
    assert sorted(tuple(show(r[c]) for c in order) for r in got) == sorted(tuple(show(r[names.index(c)]) for c in order) for r in answer.fetchall())
