"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gridsense.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twin(spark, con, name):
    ours, twin = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(twin.columns)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(ours) == rows(twin)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_subpackage():
    root = Path(entry.__file__).parent
    for p in (root / "gridsense").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
