"""The driver contract: entry() runs, queries() and oracle_sql() agree."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_and_registry(spark):
    m = _entry_module()
    df = m.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 20
    assert df.columns == ["symbol", "freq", "idx"]
    q, sql = m.queries(), m.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 150
