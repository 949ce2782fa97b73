import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrail.functions import text as X
from facetrail.functions.timestamps import instant_micros
from facetrail.operators import albums, evaluation, perturb, relational
from facetrail.operators.sessions import sessions
from tests.conftest import SF, rows_of

UTC = dt.timezone.utc


def micros(y, mo, d, h, mi, s=0, f=0):
    return int(dt.datetime(y, mo, d, h, mi, s, tzinfo=UTC).timestamp()) * 1_000_000 + f


@pytest.mark.parametrize("partitions", [1, 7])
def test_sessions_match_a_plain_scan(spark, partitions):
    rng = random.Random(5)
    rows, t = [], {}
    for i in range(3000):
        u = "hot" if rng.random() < 0.4 else f"u{rng.randrange(20)}"
        t[u] = t.get(u, 0) + rng.choice([0, 60, 5400, 5401, 9000])
        rows.append((u, t[u], f"e{i:05d}"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "user string, s long, id string").withColumn("at", F.timestamp_seconds("s"))
    got = {(r["user_id"], r["first_id"], r["last_id"], r["n_events"], r["duration_s"]) for r in sessions(df, "user", "at", "id", 5400, partitions=partitions).collect()}
    want = set()
    for u in {r[0] for r in rows}:
        own = sorted((s, i) for v, s, i in rows if v == u)
        start = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or own[k][0] - own[k - 1][0] > 5400:
                want.add((u, own[start][1], own[k - 1][1], k - start, float(own[k - 1][0] - own[start][0])))
                start = k
    assert got == want


def many_events(spark, n=20_000, seed=0):
    """Events of a few busy streams, by hash."""
    h = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k + seed)), F.lit(m))
    return spark.range(n).select(F.when(h(1, 3) == 0, "hot").otherwise(F.concat(F.lit("u"), h(2, 5))).alias("user"), F.timestamp_micros(h(3, 40_000_000_000_000) - 5_000_000_000_000).alias("at"), F.lpad("id", 9, "0").alias("id"))


def by_windows(events, gap):
    from pyspark.sql import Window as W

    w = W.partitionBy("user").orderBy("at", "id")
    us = F.unix_micros("at")
    marked = events.withColumn("fresh", F.coalesce((us - F.lag(us).over(w) > gap * 1_000_000).cast("int"), F.lit(1)))
    return marked.withColumn("g", F.sum("fresh").over(w)).groupBy("user", "g").agg(F.min("id").alias("x"), F.count("*").alias("n")).select("user", "n")


@pytest.mark.parametrize("gap,stretch", [(2000, 32), (20_000, 2)])
def test_sessions_in_larger_plans(spark, gap, stretch):
    a, b = many_events(spark), many_events(spark, 9_000, 9)
    got = lambda df: df.select("user_id", "n_events")
    one = lambda e: got(sessions(e, "user", "at", "id", gap, stretch=stretch))
    want_a, want_b = (sorted(map(tuple, by_windows(e, gap).collect())) for e in (a, b))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for parts, coalesce, size in ((4, "true", "64MB"), (13, "true", "10KB")):
            for k, v in zip(old, (parts, coalesce, size)):
                spark.conf.set(k, v)
            assert sorted(map(tuple, one(a).collect())) == want_a
            both = one(a).withColumn("side", F.lit("a")).unionByName(one(b).withColumn("side", F.lit("b"))).collect()
            assert [sorted((r[0], r[1]) for r in both if r["side"] == s) for s in "ab"] == [want_a, want_b]
            total = a.groupBy(F.col("user").alias("user_id")).agg(F.count("*").alias("n"))
            joined = one(a).join(total, "user_id").collect()
            assert sorted((r[0], r[1]) for r in joined) == want_a and sum(r["n_events"] for r in joined) == a.count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sessions_that_span_stretches(spark):
    rows = [("u", dt.datetime(1969, 12, 31, 23, 0) + dt.timedelta(seconds=9 * i), f"{i:04d}") for i in range(2000)] + [("u", dt.datetime(1971, 1, 1), "z")]
    got = sessions(spark.createDataFrame(rows, "user string, at timestamp, id string"), "user", "at", "id", 10, stretch=1).collect()
    assert sorted((r.first_id, r.last_id, r.n_events) for r in got) == [("0000", "1999", 2000), ("z", "z", 1)]


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from facetrail.session import checkpoint_dir

    context = type("C", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()
    session = type("S", (), {"sparkContext": context, "conf": type("K", (), {"get": lambda self, k, d=None: d})()})()
    with pytest.raises(RuntimeError):
        checkpoint_dir(session)


def test_written_tables_can_be_forgotten(spark):
    from facetrail.session import cut, forget, written_bytes

    df = cut(spark.range(10))
    assert df.count() == 10 and written_bytes(df) > 0
    forget(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._facetrail_path).count()


def test_sessions_of_nulls_ties_and_nothing(spark):
    schema = "user string, at timestamp, id string, stream string, start string"
    empty = spark.createDataFrame([], schema)
    assert sessions(empty, "user", "at", "id", 10, "stream").count() == 0
    t0 = dt.datetime(2020, 1, 1)
    rows = [("a", t0, "2", "x", "q"), ("a", t0, "1", "x", "q"), ("a", None, "3", "x", "q"), (None, t0, None, None, "q"), ("a", t0, "1", None, "q")]
    got = {(r.user_id, r.stream, r.first_id, r.last_id, r.n_events) for r in sessions(spark.createDataFrame(rows, schema), "user", "at", "id", 10, "stream").collect()}
    assert got == {("a", "x", "1", "2", 2), (None, None, None, None, 1), ("a", None, "1", "1", 1)}


def test_timestamps(spark):
    cases = {
        "2018-04-22T14:26:52Z": micros(2018, 4, 22, 14, 26, 52), "2019-09-02T06:11:06+02:00": micros(2019, 9, 2, 4, 11, 6), "2021-07-01T04:23:31-0500": micros(2021, 7, 1, 9, 23, 31),
        "20180817T205241Z": micros(2018, 8, 17, 20, 52, 41), "2019-05-26T15:01:12.076": micros(2019, 5, 26, 15, 1, 12, 76000), "2018-10-02T04:42": micros(2018, 10, 2, 4, 42), "2022-01-18 23:23:21": micros(2022, 1, 18, 23, 23, 21),
        "0000-00-00T00:00:00": None, "2021-02-29T10:00:00": None, "2024-07": None, "2021-06-11": None, "T12:30:00": None, "yesterday 10:15": None, "n/a": None, "": None, None: None, "2021-06-11T24:00": None, "2021-06-11T10:60": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", instant_micros("t").alias("us"))
    assert {r.t: r.us for r in df.collect()} == cases


def test_text_functions(spark):
    df = spark.createDataFrame([(" Élan  Vital-2 ", '{"a": 1} tail', "x photo 12, PHOTO_00012 photo-7"), (None, None, None), ("", "", "")], "a string, j string, p string")
    got = df.select(X.fold(F.col("a")), X.json_field(F.col("j"), "a"), X.photo_ids_in(F.col("p")), X.bounded(F.lit("oops"), 0.5), X.first_words(F.lit("a b, c"), 2), X.shorten(F.lit("abcdefgh"), 6)).collect()
    assert tuple(got[0]) == ("elan vital 2", "1", ["photo_00007", "photo_00012"], 0.5, "a b.", "abc...")
    assert got[1][0] is None and got[2][2] == []


def test_unit_interval_is_the_same_as_in_python(spark):
    import hashlib

    v = spark.range(1).select(X.unit_interval(F.lit("1::s::u"))).first()[0]
    assert v == int(hashlib.sha256(b"1::s::u").hexdigest()[:12], 16) / 16.0**12


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 100), (2, "a", 5), (3, "b", 50), (4, None, 7), (5, "a", 90_000)], "id int, k string, s long").withColumn("at", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("a", 100, "x", 1), ("a", 100, "y", 2), ("a", 101, "z", 3), ("b", 51, "w", 4)], "k string, s long, v string, t int").withColumn("at", F.timestamp_seconds("s"))
    got = {r.id: r.v for r in relational.asof_join(left, right, "k", "at", "v", "t", 60).collect()}
    assert got == {1: "y", 2: None, 3: None, 4: None, 5: "z"}


def test_numbering_and_evictions(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in random.Random(1).sample(range(500), 500)], "k string")
    assert all(r.k == f"k{r.n:03d}" for r in relational.numbered(df, ["k"], "n").collect())
    e = spark.createDataFrame([(i, 10, dt.datetime(2020, 1, 1 + i // 3)) for i in range(9)], "id int, size int, at timestamp")
    assert sorted(r.id for r in relational.evictions(e, "size", "at", "id", 50).collect()) == [0, 1, 2, 3, 4]
    assert relational.evictions(e, "size", "at", "id", 90).count() == 0


def test_assignment_matches_taking_turns(spark):
    rng = random.Random(3)
    rows = [(u, f"f{f}", f"c{c}", round(rng.random(), 1), rng.choice([0.0, 0.05])) for u in ("u", "v") for f in range(25) for c in rng.sample(range(20), 6)]
    df = spark.createDataFrame(rows, "user_id string, face string, cluster string, score double, margin double")
    got = {(r.user_id, r.face, r.cluster) for r in relational.assign_one_to_one(df, "user_id", "face", "cluster", "score", "margin").collect()}
    want = set()
    for u in ("u", "v"):
        by = {}
        for r in rows:
            if r[0] == u:
                by.setdefault(r[1], []).append(r)
        used = set()
        for f in sorted(by, key=lambda f: (-max(r[3] for r in by[f]), f)):
            for r in sorted(by[f], key=lambda r: (-r[3], -r[4], r[2])):
                if r[2] not in used and r[3] >= 0.34 and not (r[4] < 0.03 and r[3] < 0.34 + 0.08):
                    used.add(r[2])
                    want.add((u, f, r[2]))
                    break
    assert got == want


def test_kappa_kendall_and_ece(spark):
    cells = spark.createDataFrame([(0, 0, 5), (1, 1, 3), (2, 2, 2), (0, 2, 1)], "i int, j int, n long")
    n = 11
    o = 1 * 1 / n
    r, c = {0: 6, 1: 3, 2: 2}, {0: 5, 1: 3, 2: 3}
    e = sum((i - j) ** 2 / 4 * r[i] * c[j] for i in r for j in c) / n**2
    assert evaluation.weighted_kappa(cells).first()["kappa"] == pytest.approx(1 - o / e, abs=1e-6)
    t = spark.createDataFrame([(1.0, 1.0, 2), (2.0, 3.0, 1), (3.0, 2.0, 1)], "x double, y double, n long")
    assert evaluation.kendall(t, "x", "y", "n").first()["tau"] == pytest.approx((2 + 2 - 1) / 5)
    q = spark.createDataFrame([(1.0, 1.0), (0.95, 0.0), (0.05, 0.0), (None, 1.0)], "c double, y double")
    assert evaluation.calibration_error(q, [], "c", "y").first()["ece"] == pytest.approx(2 / 3 * abs(0.975 - 0.5) + 1 / 3 * 0.05)


def test_set_f1(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b", "c"]), ([], None), (["a"], []), ([" "], [""])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(evaluation.set_f1(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 1.0]


def test_masks_and_stress_keep_what_they_should(spark):
    p = spark.read.parquet(f"{SF}/photos.parquet")
    assert perturb.album_counts(perturb.mask(p, "face_off")).first()["faces"] == 0
    assert perturb.album_counts(perturb.mask(p, "text_off")).first()["entities"] == 0
    with pytest.raises(ValueError):
        perturb.mask(p, "nothing")
    before = perturb.album_counts(p).first()
    after = perturb.album_counts(perturb.stress(p, albums.owner_faces(p), "combined_mild")).first()
    assert after["n_photos"] == before["n_photos"] and 0 < after["faces"] < before["faces"]


def test_appearances_of_dirty_lists(spark):
    schema = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("photo_id", T.StringType()), T.StructField("visible_face_ids", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([("u", "p", ["b", "a", "a", None]), ("u", "p", ["a", "b"]), ("u", "q", None), ("u", "r", [])], schema)
    assert rows_of(albums.appearances(df)) == [("u", "p", "a"), ("u", "p", "b")]
