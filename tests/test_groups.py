import random

from pyspark.sql import functions as F

from facetrail.operators import groups as G


def test_overlaps_are_suppressed_as_if_in_turn(spark):
    rng = random.Random(4)
    rows = []
    for u in "uvw":
        for i in range(60):
            faces = sorted(rng.sample([f"f{k}" for k in range(9)], rng.randrange(2, 5)))
            names = sorted(rng.sample([f"n{k}" for k in range(8)], rng.randrange(1, 5)))
            rows.append((u, f"g{i:02d}", faces, names, round(rng.random(), 1)))
    want = set()
    for u in "uvw":
        kept = []
        for r in sorted((r for r in rows if r[0] == u), key=lambda r: (-r[4], r[1])):
            over = lambda a, b: len(set(a) & set(b)) / max(1, min(len(a), len(b)))
            if not any(over(r[2], k[2]) >= 0.7 and over(r[3], k[3]) >= 0.45 for k in kept):
                kept.append(r)
                want.add((u, r[1]))
    df = spark.createDataFrame(rows, "user_id string, group_id string, faces array<string>, names array<string>, priority double")
    got = {(r.user_id, r.group_id) for r in G.suppress_overlaps(df).collect()}
    assert got == want and G.suppress_overlaps(df.where("false")).count() == 0


def test_reserved_rows(spark):
    rows = [("u", i, i in (4, 6, 7)) for i in range(9)] + [("v", 0, True), ("v", 1, False), ("w", 0, False)]
    df = spark.createDataFrame(rows, "g string, i int, s boolean")
    got = {}
    for r in G.reserved_first(df, ["g"], [F.col("i")], F.col("s"), 4, 2).collect():
        got.setdefault(r.g, {})[r.place] = r.i
    assert got == {"u": {1: 0, 2: 1, 3: 4, 4: 6}, "v": {1: 0, 2: 1}, "w": {1: 0}}


def test_choices_are_applied_once(spark):
    rows = [("u", "a", "x", 0.5), ("u", "a", "y", 0.6), ("u", "b", "x", 0.7), ("u", "c", "z", 0.3)]
    ranked = spark.createDataFrame(rows, "user_id string, face_id string, name string, score double")
    chosen = spark.createDataFrame([("u", "a", "x", 0.9), ("u", "b", "x", 0.8), ("u", "c", "q", 0.9), ("u", "c", "z", 0.4)], "user_id string, face_id string, name string, confidence double")
    got = {(r.face_id, r.name): (r.score, r.chosen, r["rank"]) for r in G.applied(ranked, chosen).collect()}
    assert got == {("a", "x"): (0.9, True, 1), ("a", "y"): (0.55, False, 2), ("b", "x"): (0.65, False, 1), ("c", "z"): (0.3, False, 1)}
