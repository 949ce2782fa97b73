import glob
import os

import duckdb
import pytest

from facetrail.llm import queries
from tests.conftest import SF
from tests.test_queries import canon


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.oracle_sql():
        assert canon(got) == canon(duck.execute(queries.oracle_sql()[name]).df())


def test_lift_of_every_pair(spark, tmp_path):
    photos = [("u", "p1", ["a", "b"]), ("u", "p2", ["a", "c"]), ("u", "p3", ["a"]), ("u", "p4", ["b"])]
    spark.createDataFrame(photos, "user_id string, photo_id string, visible_face_ids array<string>").write.parquet(f"{tmp_path}/photos.parquet")
    spark.createDataFrame([], "user_id string, photo_id string, face_id string, co_faces array<string>").write.parquet(f"{tmp_path}/face_units.parquet")
    got = sorted(tuple(r) for r in queries.p4_lift(spark, str(tmp_path)).collect())
    assert got == [("u", "a", "b", 1, 3, 2, 4, 0.666667), ("u", "a", "c", 1, 3, 1, 4, 1.333333)]
