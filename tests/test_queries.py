"""Every query against its SQL in DuckDB, on the smallest tables; those without SQL must run and keep their schema."""

import glob
import math
import os
import re

import duckdb
import pandas as pd
import pytest

from folioflow.plans import catalogue


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    return round(float(v), 6) if isinstance(v, float) else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    frame = catalogue.QUERIES[name](spark, data).toPandas()
    if name not in catalogue.ORACLES:
        assert len(frame.columns)
        return
    columns, mine = rows(frame)
    names, want = rows(duck.execute(catalogue.ORACLES[name]).df())
    assert columns == names and len(mine) == len(want)
    for a, b in zip(mine, want, strict=True):
        assert all(x == y or isinstance(x, float) and y is not None and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_rest_works_without_training_text_operators():
    """Nothing outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(catalogue.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
