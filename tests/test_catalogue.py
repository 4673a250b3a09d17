"""Every query of the catalogue against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tessel.plans import catalogue


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>" else round(float(v), 5) + 0.0 if type(v).__name__ not in ("bool", "bool_", "str") and hasattr(v, "__float__") else str(v) for v in r))
    return sorted(out, key=str)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.sql(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, sf_dir, name):
    ours, theirs = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_golden_diff_compares_whole_texts(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(catalogue.E, "dataset_diff", lambda old, new, *a: seen.extend((old, new)))
    catalogue.golden_diff(spark, sf_dir)
    texts = {str(r.doc_id): r.text for r in catalogue.read(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    assert any(len(t or "") > 80 for t in texts.values())
    for side in seen:
        assert all(r.question == texts[r.id] for r in side.collect())
    assert len(seen) == 2
