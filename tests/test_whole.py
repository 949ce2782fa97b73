"""Queries take in all rows of their tables: long texts, names of any letters, rare pairs, compact dates, long labels."""

import pytest

from facetrail.operators.albums import bridges
from facetrail.plans import derivations, search
from facetrail.streaming.sessions import face_counts


def test_signatures_of_long_texts(spark, tmp_path):
    long = "Harbour " * 100
    spark.createDataFrame([("d1", long), ("d2", long.upper()), ("d3", "short one"), ("d4", None), ("d5", long + "x")], "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["signature"]: (r["n"], r["first_doc"]) for r in derivations.fact_signatures(spark, str(tmp_path)).collect()}
    assert got == {long.lower().strip(): (2, "d1"), "short one": (1, "d3"), long.lower() + "x": (1, "d5")}


NAMES = {
    "Renée Ulvmerel": "Renée Ulvmerel", "ÉLODIE ÖSTVAL": "Élodie Östval", "žofia van Íñdal": "Žofia van Íñdal", "o'neil-smith d. VAN hale": "O'Neil-Smith D. van Hale", 'Margaret "Peggy" TOLGRAVET': 'Margaret "Peggy" Tolgravet',
    "#@ ana DE bri": "Ana de Bri", "@kestrel_99": "kestrel_99", "J0rdan McVale": "J0rdan Mcvale", "BORN 1987": "Born 1987", "Aunt Zoë (left)": "Aunt Zoë", "  MÁRTA\tlind !": "Márta Lind", "###": "",
}


def test_written_names_of_any_letters_and_signs(spark, tmp_path):
    rows = [(str(i), s) for i, s in enumerate(NAMES)] + [("none", None)]
    spark.createDataFrame(rows, "cluster_id string, primary_surface string").write.parquet(f"{tmp_path}/name_clusters.parquet")
    got = {r["cluster_id"]: r for r in derivations.written_names(spark, str(tmp_path)).collect()}
    assert {s: got[i]["written"] for i, s in rows if s is not None} == NAMES and set(got) == {i for i, s in rows if s is not None}
    assert (got["9"]["bare"], got["9"]["relation"]) == ("Zoë (left)", "aunt") and got["0"]["relation"] is None


def test_written_names_and_synonyms_of_any_length(spark):
    from pyspark.sql import functions as F

    from facetrail.operators import derive as D

    long = "x" * 1500
    df = spark.createDataFrame([("aunt " + " ".join(["ann"] * 1200), long)], "many string, one string")
    row = df.select(D.written_name(F.col("one")).alias("w"), D.without_relation(F.col("many"))[0].alias("b")).first()
    assert len(row["w"]) == 1500 and len(row["b"].split()) == 1200
    phrase = "friend of the family from the old house"
    got = D.canonical_terms(spark.createDataFrame([(f"My {phrase}!",), ("friend",), (None,)], "t string"), "t", spark.createDataFrame([(phrase, "friend"), ("friend", "pal")], "phrase string, canonical string"))
    assert {r["t"]: r["canonical"] for r in got.collect()} == {f"My {phrase}!": "friend", "friend": "pal", None: ""}


def test_bridges_of_compact_dates(spark):
    unit = "user_id string, face_id string, photo_id string, year_month string, timestamp string, gps_city string, gps_location string"
    row = lambda photo, month, ts: ("u", "a", photo, month, ts, "Oslo", None)
    faces = spark.createDataFrame([row("f1", "2018-08", "20180829T205241Z"), row("f2", "2018-08", "2018-08-29T20:52:41"), row("f3", "2018-08", "20180899T000000Z"), row("f4", "2018-08", "201808291234")], unit)
    texts = spark.createDataFrame([row("t1", "2018-09", "20180903T081500Z"), row("t2", "2018-09", "2018-09-03 08:15:00"), row("t3", "2018-09", "20180920T081500Z"), row("t4", "2018-09", "20180903")], unit)
    got = sorted((r["face_photo"], r["text_photo"], r["bridge"]) for r in bridges(faces, texts).collect())
    assert got == [(f, t, "near_date_city") for f in ("f1", "f2") for t in ("t1", "t2", "t4")]


def test_relation_words_of_any_label(spark, tmp_path):
    entries = [("relation", "mother", ["mom"]), ("relation", "mother-in-law", []), ("relation", "fiancé", None), ("relation", "best friend", ["bff"]), ("relation", "friend", []), ("place", "lobby", [])]
    spark.createDataFrame([(i, *x) for i, x in enumerate(entries)], "entry_id long, entry_kind string, entry_label string, other_labels array<string>").write.parquet(f"{tmp_path}/relation_entries.parquet")
    units = [("1", "Mom and my MOTHER"), ("2", "my mother-in-law"), ("2", "my mother-in-law"), ("3", "mother, mother in law"), ("4", "her fiancé, a best friend in the lobby"), ("5", "a friend of my best friend"), ("6", "smothered"), ("7", None)]
    spark.createDataFrame([("u", *x) for x in units], "user_id string, unit_id string, caption string").write.parquet(f"{tmp_path}/text_units.parquet")
    got = {r["word"]: r["n_units"] for r in search.relation_words(spark, str(tmp_path)).collect()}
    assert got == {"mother": 2, "mother-in-law": 2, "fiancé": 1, "best friend": 2, "friend": 1}


@pytest.mark.parametrize("mode", ["complete", "update"])
def test_streamed_face_counts_are_exact(spark, tmp_path, mode):
    kind = "user_id string, photo_id string, visible_face_ids array<string>"
    rows = [("u", f"p{i}", ["a", "a", "b"] if i % 3 else ["a"]) for i in range(30_011)]
    spark.createDataFrame(rows + rows[:999], kind).write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(rows[:7] + [("u", "new", ["b"])], kind).write.mode("append").parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/p")
    q = face_counts(stream).writeStream.outputMode(mode).format("memory").queryName(f"exact_{mode}").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {r["face_id"]: r["n"] for r in spark.sql(f"select face_id, max(n_photos) as n from exact_{mode} group by face_id").collect()}
    assert got == {"a": 30_011, "b": sum(1 for i in range(30_011) if i % 3) + 1}
