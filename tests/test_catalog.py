"""Every catalogued query against its SQL over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from geoframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        raise TypeError("SQL gives a decimal where a double is meant")
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return v if not isinstance(v, datetime.datetime) else v.isoformat()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    out = catalog.QUERIES[name](spark, sf)
    names = sorted(out.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in out.collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    r = duck.execute(catalog.ORACLES[name])
    have = [d[0] for d in r.description]
    assert sorted(have) == names
    order = [have.index(c) for c in names]
    assert rows == sorted(repr(tuple(plain(x[i]) for i in order)) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_llm_is_not_needed(tmp_path):
    """Without the subpackage and the pipeline the entry still imports, and nothing else imports them."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/geoframe", tmp_path / "geoframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; import geoframe.sources.vector, geoframe.sources.raster, geoframe.streaming, geoframe.functions.sql"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
