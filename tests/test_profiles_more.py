import random

import pytest

from facetrail.operators import evaluation as E
from facetrail.operators import profiles as P


def test_redaction(spark):
    texts = [("u", 1, "The Annual dinner of ann, ANN'S  cake; annex"), ("u", 2, "Ann Lee’s boat and Ann"), ("u", 3, "Bo (B.O.) [x]"), ("v", 4, "Ann"), ("u", 5, None), ("u", 6, ""), ("u", 7, "Li, Renée and Li-Na")]
    df = spark.createDataFrame(texts, "user_id string, k int, t string")
    names = spark.createDataFrame([("u", "Ann Lee", "the owner"), ("u", "Ann", "the owner"), ("u", "B.O.", "someone"), ("u", "Li", "someone"), ("u", "Renée", "someone"), ("u", None, "x"), ("u", " ", "x")], "user_id string, name string, mark string")
    got = {r.k: r.t for r in P.redacted(df, names, "t", "k").collect()}
    assert got == {1: "The Annual dinner of the owner, the owner's cake; annex", 2: "the owner's boat and the owner", 3: "Bo (someone) [x]", 4: "Ann", 5: None, 6: "", 7: "someone, someone and someone-Na"}
    allowed = spark.createDataFrame([("u", 2, "a boat for ann lee")], "user_id string, k int, allowed string")
    assert {r.k: r.t for r in P.redacted(df, names, "t", "k", allowed=allowed).collect()}[2] == "Ann Lee’s boat and Ann"


def test_bootstrap_of_a_clear_and_of_no_difference(spark):
    rng = random.Random(1)
    rows = [(f"u{i:03d}", 0.6 + 0.1 * rng.random(), 0.5 + 0.1 * rng.random()) for i in range(60)]
    df = spark.createDataFrame([*rows, ("x", None, 0.5)], "user_id string, a double, b double")
    r = E.paired_bootstrap(df, "user_id", "a", "b", 400, 5).first()
    mean = sum(a - b for _, a, b in rows) / 60
    assert r.n_pairs == 60 and r.mean_delta == pytest.approx(mean, abs=1e-6) and r.ci_low < mean < r.ci_high and r.ci_low > 0 and r.p_two_sided == 0
    assert r.ci_high - r.ci_low == pytest.approx(4 * (sum((a - b - mean) ** 2 for _, a, b in rows) / 60) ** 0.5 / 60**0.5, rel=0.25)
    same = E.paired_bootstrap(df, "user_id", "a", "a", 50, 5).first()
    assert (same.mean_delta, same.p_two_sided) == (0.0, 1.0)
    assert E.paired_bootstrap(df.where("false"), "user_id", "a", "b", 50, 5).count() == 0


def test_kendall_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(30) / 10, rng.randrange(4) / 2, rng.randrange(1, 4)) for _ in range(60)]
    agree = against = 0
    for i, (x, y, n) in enumerate(rows):
        for u, v, m in rows[:i]:
            s = (x - u) * (y - v)
            agree, against = agree + (s > 0) * n * m, against + (s < 0) * n * m
    got = E.kendall(spark.createDataFrame(rows, "x double, y double, n long"), "x", "y", "n").first()["tau"]
    assert got == pytest.approx((agree - against) / (agree + against))


def test_surnames_are_merged_as_if_one_by_one():
    import pandas as pd

    rng = random.Random(5)
    for _ in range(60):
        names = {f"Ann {rng.choice(['Kim', 'King', 'K.', 'Lee', 'L', 'Le', 'Moe'])}" for _ in range(rng.randrange(1, 7))} | ({"Ann"} if rng.random() < 0.5 else set())
        rows = [("u", "ann", s, rng.randrange(1, 4), " " in s, len(s)) for s in sorted(names)]
        pdf = pd.DataFrame(rows, columns=["user_id", "first", "surface", "n", "is_full", "size"])
        want: dict = {}
        full = [r[2] for r in sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -r[5], r[2]))]
        for s in full:
            if s not in want:
                want[s] = s
                for o in full:
                    if o not in want and P.surname_fits(s.split()[-1].lower(), o.split()[-1].lower()):
                        want[o] = s
        leads = list(dict.fromkeys(want[s] for s in full))
        if "Ann" in names:
            want["Ann"] = leads[0] if len(leads) == 1 else "Ann"
        assert dict(P.merge_surfaces(pdf)[["surface", "leader"]].itertuples(index=False)) == want


def test_clusters_of_near_given_names(spark):
    units = [("u", "1", "p1", ["Jonathan Kim", "Kitchen"]), ("u", "2", "p2", ["Jonathn"]), ("u", "3", "p3", ["Jonathan K."]), ("v", "4", "p4", ["Jonathn"])]
    df = spark.createDataFrame(units, "user_id string, unit_id string, photo_id string, person_surfaces array<string>")
    got = {(r.user_id, r.leader): (r.surfaces, r.n_mentions) for r in P.name_clusters(df).collect()}
    assert got == {("u", "Jonathan Kim"): (["Jonathan K.", "Jonathan Kim", "Jonathn"], 3), ("v", "Jonathn"): (["Jonathn"], 1)}
