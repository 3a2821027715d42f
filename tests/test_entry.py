import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    for name in ("p3_found", "p4_found", "p5_found"):
        assert name in q


def test_core_stands_alone():
    code = """
import sys, importlib.abc
class No(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith('waygraph.llm'):
            raise ImportError(name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
assert 'p4_found' in e.queries() and 'p1_percentiles' not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_of_the_core_imports_llm():
    for f in (ROOT / "waygraph").rglob("*.py"):
        if "llm" not in f.parts:
            assert ".llm" not in f.read_text(), f


def test_flagship(spark):
    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["query_id", "status", "distance", "hops", "path"]
