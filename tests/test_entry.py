"""The driver contract on the smallest tables."""

import importlib
import importlib.util
import sys

import duckdb
import pandas as pd
import pytest

from longtext.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def values(df: pd.DataFrame) -> list:
    cells = lambda r: tuple("null" if v is None or (isinstance(v, float) and v != v) else round(v, 6) if isinstance(v, float) else str(v) for v in r)
    return sorted(map(str, map(cells, df[sorted(df.columns)].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), duck.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_other_queries_run(spark, name):
    assert core.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_optional_parts(monkeypatch):
    """Without the training-data parts the entry still imports and has the core queries."""
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("longtext.llm", "corpus_pipeline") else real(name, *a))
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    found = importlib.import_module("__spark_entry__")
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    assert set(found.queries()) == set(core.QUERIES)
