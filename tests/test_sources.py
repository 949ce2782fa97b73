import json

from pyspark.sql import functions as F

from facetrail.sources import files as S
from facetrail.streaming.sessions import face_counts, session_stream
from tests.conftest import SF, rows_of


def test_albums_round_trip(spark, tmp_path):
    for u in ("user_0001", "user_0002"):
        (tmp_path / "in" / u).mkdir(parents=True)
        doc = {"photos": [{"photo_id": "photo_0002", "caption": "é", "extra": 1}, {"photo_id": "photo_0001", "metadata": {"gps_city": "X"}}]}
        (tmp_path / "in" / u / "album.json").write_text(json.dumps(doc, indent=1))
    p = S.read_albums(spark, f"{tmp_path}/in/*/album.json")
    assert rows_of(p.select("user_id", "ord", "photo_id", "caption", "metadata.gps_city"))[0] == ("user_0001", 0, "photo_0002", "é", None)
    assert S.read_albums(spark, f"{tmp_path}/in/*/album.json", ["user_0002"]).count() == 2
    S.write_albums(p.drop("ord"), f"{tmp_path}/out")
    again = S.read_albums(spark, f"{tmp_path}/out/*/*.json")
    assert rows_of(again.select("user_id", "photo_id", "caption")) == rows_of(p.select("user_id", "photo_id", "caption"))


def test_bad_documents_and_missing_files(spark, tmp_path):
    (tmp_path / "user_0003").mkdir()
    (tmp_path / "user_0003" / "album.json").write_text("{not json")
    assert S.read_albums(spark, f"{tmp_path}/*/album.json", strict=False).count() == 0
    try:
        S.read_albums(spark, f"{tmp_path}/*/album.json").collect()
        raised = False
    except Exception:
        raised = True
    assert raised
    assert S.read_optional(spark, f"{tmp_path}/nothing.json", "a int").count() == 0


def test_first_of_checksums_csv_and_markdown(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert rows_of(S.first_of([a, b], "k").select("k", "v")) == [(1, "a"), (2, "b")]
    S.write_csv([a, spark.createDataFrame([(3, True)], "k int, z boolean")], f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["k", "v", "z"]
    (tmp_path / "f.txt").write_text("hello")
    want = spark.createDataFrame([("f.txt", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"), ("g.txt", "00")], "file string, sha256 string")
    assert {r["file"]: r["ok"] for r in S.checksums(spark, f"{tmp_path}/*.txt", want).collect()} == {"f.txt": True, "g.txt": False}
    assert S.read_texts(spark, f"{tmp_path}/*.txt").first()["text"] == "hello"
    assert S.markdown(a) == "| k | v |\n|---|---|\n| 1 | a |"


def test_streams(spark, tmp_path):
    rows = [("u", 0, "a"), ("u", 5400, "b"), ("u", 5400, "b"), ("u", 10801, "c"), ("v", 0, "d"), ("w", 10_000_000, "z")]
    spark.createDataFrame(rows, "user string, s long, id string").withColumn("at", F.timestamp_seconds(F.col("s") + 1_000_000_000)).write.parquet(f"{tmp_path}/e")
    src = spark.readStream.schema("user string, s long, id string, at timestamp").parquet(f"{tmp_path}/e")
    q = session_stream(src, "user", "at", "id").writeStream.outputMode("append").format("memory").queryName("sess").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert rows_of(spark.sql("select user_id, n_events from sess")) == [("u", 1), ("u", 2), ("v", 1)]
    spark.read.parquet(f"{SF}/photos.parquet").write.parquet(f"{tmp_path}/p")
    photos = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/p").schema).parquet(f"{tmp_path}/p")
    q = face_counts(photos).writeStream.outputMode("complete").format("memory").queryName("faces").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from faces").first()[0] > 0


def test_reports_configurations_and_lists(spark, tmp_path):
    for u, v in (("user_0001", 0.5), ("user_0002", 0.25)):
        (tmp_path / "runs" / u).mkdir(parents=True)
        (tmp_path / "runs" / u / "report.json").write_text(json.dumps({"metrics": {"pir": v}, "other": 1}, indent=1))
    got = S.read_reports(spark, f"{tmp_path}/runs/*/report.json", "metrics struct<pir:double>")
    assert rows_of(got.select("user_id", "metrics.pir")) == [("user_0001", 0.5), ("user_0002", 0.25)]
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(True, 2)], "z boolean, k int")
    S.write_csv_as_first([a, b], f"{tmp_path}/first")
    back = spark.read.option("header", True).csv(f"{tmp_path}/first")
    assert back.columns == ["k", "v"] and rows_of(back) == [("1", "x"), ("2", None)]
    (tmp_path / "c.json").write_text('{"n": "7", "on": "yes", "url": "${HOST:local}/${NONE}", "extra": 1}')
    defaults = {"n": 1, "on": False, "url": "", "rate": 0.5, "names": None}
    assert S.read_config(f"{tmp_path}/c.json", defaults, {}) == {"n": 7, "on": True, "url": "local/", "rate": 0.5, "names": None}
    assert S.read_config(f"{tmp_path}/none.json", defaults) == defaults and S.expanded(["${HOST:local}"], {"HOST": "h"}) == ["h"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(['["a", " ", "b"]', "plain", " ", None, "[broken"])], "i int, t string")
    assert [r[0] for r in texts.orderBy("i").select(S.text_list(F.col("t"))).collect()][:4] == [["a", "b"], ["plain"], [], []]
