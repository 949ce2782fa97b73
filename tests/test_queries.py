"""Every core query that has SQL is compared with it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from facetrail.plans import registry
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, sorted(tuple("NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert canon(registry.queries()[name](spark, SF).toPandas()) == canon(duck.execute(registry.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
