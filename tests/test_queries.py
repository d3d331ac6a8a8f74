"""Every core query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from pagewright.plans import catalogue

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(round(v, 9)))
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, str(SF))
    rows = sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in catalogue.oracle_sql():
        assert rows
        return
    rel = con.execute(catalogue.oracle_sql()[name])
    cols = [x[0] for x in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall()) == rows


def test_core_does_not_need_the_llm_folder():
    root = Path(catalogue.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert ".llm" not in f.read_text() and "import llm" not in f.read_text(), f
