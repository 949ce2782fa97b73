import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetrail.operators import profiles as P
from facetrail.operators.graph import bridge_score
from tests.conftest import rows_of


def test_surname_fits():
    assert P.surname_fits("kim", "kim") and P.surname_fits("k.", "kim") and P.surname_fits("", "kim") and not P.surname_fits("kim", "king")


def test_surfaces_merge_behind_the_most_frequent():
    pdf = pd.DataFrame({"user_id": "u", "first": "ann", "surface": ["Ann Kim", "Ann K.", "Ann Lee", "Ann"], "n": [5, 2, 3, 9], "is_full": [True, True, True, False], "size": [7, 6, 7, 3]})
    got = dict(P.merge_surfaces(pdf)[["surface", "leader"]].itertuples(index=False))
    # two full names share the given name, so the given name alone stays alone
    assert got == {"Ann Kim": "Ann Kim", "Ann K.": "Ann Kim", "Ann Lee": "Ann Lee", "Ann": "Ann"}
    one = pdf[pdf.surface.isin(["Ann Kim", "Ann"])].assign(is_full=[True, False])
    assert dict(P.merge_surfaces(one)[["surface", "leader"]].itertuples(index=False)) == {"Ann Kim": "Ann Kim", "Ann": "Ann Kim"}


def test_name_clusters_of_dirty_units(spark):
    rows = [("u", "t1", "p1", ["ann  kim", "Ann Kim", None, ""]), ("u", "t1", "p1", ["ann  kim", "Ann Kim", None, ""]), ("u", "t2", "p2", ["ANN K."]), ("u", "t3", None, None), ("v", "t4", "p1", ["Ann"])]
    df = spark.createDataFrame(rows, "user_id string, unit_id string, photo_id string, person_surfaces array<string>")
    got = {(r.user_id, r.leader): (r.surfaces, r.n_mentions, r.n_photos) for r in P.name_clusters(df).collect()}
    assert got == {("u", "Ann Kim"): (["Ann K.", "Ann Kim"], 3, 2), ("v", "Ann"): (["Ann"], 1, 1)}
    assert P.name_clusters(df.where("false")).count() == 0


def test_near_given_names(spark):
    df = spark.createDataFrame([("u", "jonathn", ["jonathan", "maria"]), ("u", "mari", ["maria", "marie"]), ("u", "ann", ["anna"])], "user_id string, short string, firsts array<string>")
    assert rows_of(P.near_given_names(df)) == [("u", "jonathn", "jonathan")]


def test_model_calls_go_only_to_misses(spark):
    req = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", None), ("d", " ")], "key string, prompt string")
    cache = spark.createDataFrame([("a", "old"), ("z", "other")], "key string, response string")
    got = {r.key: (r.response, r.cached) for r in P.call_model(req, cache, lambda p: p.upper()).collect()}
    assert got == {"a": ("old", True), "b": ("Y", False), "c": (None, False), "d": (None, False)}
    k = spark.createDataFrame([("1", "2")], "a string, b string").select(P.request_key("judge", "a", "b").alias("k")).first()[0]
    assert len(k) == 40


def test_redaction(spark):
    t = spark.createDataFrame([("u", "Ann Kim-Lee and Ann (x) met Bo."), ("v", "Ann")], "user_id string, caption string")
    n = spark.createDataFrame([("u", "Ann"), ("u", "Ann Kim-Lee"), ("u", "Ann (x)"), ("u", "Bo"), ("u", None), ("u", " ")], "user_id string, name string")
    assert rows_of(P.redacted(t, n, "caption").select("user_id", "caption")) == [("u", "[NAME] and [NAME] met [NAME]."), ("v", "Ann")]


@pytest.mark.parametrize(
    "row,want",
    [(("person_name", 1.0, "A", 1, True, "why", True, False), 1.0), (("person_name", 1.0, "A", 1, True, "", False, True), 0.5), (("person_name", 1.0, "A", 0, True, "why", True, True), 0.0), (("person_name", 1.0, "", 2, True, "why", True, True), 0.0), (("owner_fact_atom", 0.5, "A", 1, True, "", False, False), 0.5), (("person_relation", 1.0, "A", 1, False, "why", True, True), 0.0)],
)
def test_faithfulness(spark, row, want):
    df = spark.createDataFrame([row], "k string, c double, p string, n int, ok boolean, w string, f boolean, t boolean")
    assert df.select(P.faithfulness(F.col("k"), F.col("c"), F.col("c"), F.lit(True), F.col("p"), F.col("n"), F.col("ok"), F.col("w"), F.col("f"), F.col("t"))).first()[0] == want


def test_bridge_score(spark):
    one = lambda *v: spark.range(1).select(bridge_score(*[F.lit(x) for x in v])).first()[0]
    assert one(2, 1, 1, False, 0, 2, False) == pytest.approx(0.28 + 0.18 + 0.08 + 0.08 + 0.03)
    assert one(0, 0, 1, True, 2, 5, False) == pytest.approx(max(0.0, 0.35 * 0.18 - 0.04 - 0.06), abs=1e-4)
