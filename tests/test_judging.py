import json

import pytest
from pyspark.sql import functions as F

from facetrail.functions import claims as C
from facetrail.functions import people as P
from facetrail.operators import inventory as V
from facetrail.operators import judging as J
from facetrail.operators import reports as R
from tests.conftest import rows_of


def test_answers_are_asked_for_again_and_read_out_of_prose(spark):
    def client(prompt):
        if "broken" in prompt:
            return "no"
        if "prose" in prompt:
            return "I think this is a partial match, index 2"
        if "Return only" in prompt:
            return '```json\n{"verdict": "match", "score": 1.0,}\n```'
        return "Sure! Let me think." if "twice" in prompt else 'Here: {"verdict": "match"}'

    def prose(text):
        return {"verdict": "partial"} if "partial" in text else None

    req = spark.createDataFrame([("a", "once"), ("b", "twice"), ("c", "prose"), ("d", "broken"), ("e", " "), ("f", None), ("a", "once")], "key string, prompt string")
    got = {r.key: r for r in J.call_json(req, client, prose).collect()}
    assert (got["a"].ok, got["a"].n_calls, json.loads(got["a"].answer)) == (True, 1, {"verdict": "match"})
    assert (got["b"].ok, got["b"].n_calls, json.loads(got["b"].answer)["score"]) == (True, 2, 1.0)
    assert (got["c"].ok, got["c"].repaired, got["c"].n_calls) == (True, True, 1)
    assert (got["d"].ok, got["d"].n_calls, got["d"].answer) == (False, 3, None)
    assert got["e"].n_calls == got["f"].n_calls == 0 and len(got) == 6
    assert sum(r.n_calls for r in J.call_json(req.coalesce(1), client, budget=2).collect()) == 2


def test_verdicts_in_prose_and_objects_in_wrappings(spark):
    texts = ["It does not match.", "A mismatch, index: -1", "partial; matched_index = 3", "They match", "rematch tomorrow", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r) for r in df.orderBy("i").select(J.value_verdict(F.col("t")), J.matched_index(F.col("t"))).collect()]
    assert got == [("mismatch", None), ("mismatch", -1), ("partial", 3), ("match", None), (None, None), (None, None), (None, None)]
    texts = ["The reasoning is unfaithful", "partially faithful, score: 0.7", "faithful", "score 1.0 faithful", "nothing"]
    v, s = J.faith_verdict(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(v, s).collect()]
    assert got == [("unfaithful", 0.0), ("partial", 0.7), ("faithful", 1.0), ("faithful", 1.0), (None, None)]
    wrapped = ['{"a": 1}', '```json\n{"a": 1}\n```', 'so: {"a": {"b": 2}} done', 'x {"a": 1,} y', "{'a': 1}", "[1]", None, "{broken"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(wrapped)], "i int, t string").orderBy("i").select(J.json_object(F.col("t"))).collect()]
    assert got == [{"a": "1"}, {"a": "1"}, {"a": '{"b":2}'}, {"a": "1"}, None, None, None, None]
    assert [J.read_answer(t) is not None for t in wrapped] == [x is not None for x in got]


def test_best_matches_of_facts(spark):
    t = spark.createDataFrame([("u", 1, "red bicycle rides along harbour"), ("u", 2, "plays piano"), ("u", 3, ""), ("u", 4, None), ("v", 5, "red bicycle")], "user_id string, target_id int, text string")
    f = spark.createDataFrame([("u", 8, "bicycle harbour red"), ("u", 7, "rides a red bicycle by the harbour"), ("u", 9, None), ("w", 1, "red bicycle")], "user_id string, fact_id int, text string")
    got = {r.target_id: (r.fact_id, r.verdict, r.score) for r in J.best_matches(t, f).collect()}
    assert got == {1: (7, "match", 1.0), 2: (None, "mismatch", 0.0), 3: (None, "mismatch", 0.0), 4: (None, "mismatch", 0.0), 5: (None, "mismatch", 0.0)}
    assert J.best_matches(t.where("false"), f).count() == 0


def test_names_and_claims(spark):
    names = {"Ann Lee": (True, True, False), "Kitchen": (False, False, False), "Aunt": (False, False, False), "BIRTHDAY PARTY": (False, False, False), "R2D2": (False, False, True), "Mr Smith": (True, False, False), "Dear Ann": (True, False, False), "": (False, False, False), "Xkcdfgh Bcdfgt": (True, True, True)}
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    got = {r[0]: tuple(r[1:]) for r in df.select("n", P.plausible_name(F.col("n")), P.usable_edge_name(F.col("n")), P.noise_name(F.col("n"))).collect()}
    assert got == names | {None: (False, False, False)}
    owner = lambda n: spark.range(1).select(P.owner_like(F.lit(n), F.lit("Anna Lee"))).first()[0]
    assert [owner(n) for n in ("Anna Lee", "anna", "A. Lee", "Anna Moe", "Bo Lee", "")] == [True, True, True, False, False, False]
    row = spark.range(1).select(C.hedged(F.lit("She may ride")), C.hedged(F.lit("She rides")), C.terms_in(F.lit("Book club and running, rerun"), ("book club", "run", "running")), C.owner_reference(F.lit("My profile")), C.home_like(F.lit("Our House")), C.broad_clothing(F.lit("wears a hat"))).first()
    assert tuple(row) == (True, False, ["book club", "running"], 2.5, True, True)
    terms, channels = C.event_features(F.lit("Mother's Day coffee cups at the office"))
    row = spark.range(1).select(terms, channels).first()
    assert (row[0], row[1]) == (["card", "coffee", "mother", "office"], ["family_home", "meal_social", "professional_legal"])
    got = spark.range(1).select(C.capitalised_entities(F.lit("The Ride with Ann Lee at Book Club Meetup near Ocean Park"))).first()[0]
    assert [(e["surface"], e["entity_type"]) for e in got] == [("Ann Lee", "person"), ("Book Club Meetup", "organization"), ("Ocean Park", "location")]


def test_units_of_photos(spark):
    schema = "user_id string, photo_id string, year_month string, timestamp string, caption string, visible_text array<string>, text_entities array<struct<surface:string,entity_type:string,source:string,confidence:double>>, visible_face_ids array<string>, metadata struct<gps_city:string,gps_location:string,device:string>, ingested_at timestamp"
    import datetime as dt

    at = dt.datetime(2020, 1, 1)
    ent = lambda s, k="person", src="caption": (s, k, src, 0.5)
    rows = [
        ("u", "p1", "2020-01", "", "Aunt Mia at the clinic", None, [ent("Aunt Mia"), ent("Acme  Inc", "organization"), ent("Kitchen")], ["a", "b", "a", None], ("X", None, None), at),
        ("u", "p1", "2020-01", "", "later caption", None, None, ["z"], ("X", None, None), at + dt.timedelta(1)),
        ("u", "p2", "2020-02", "", None, ["Zed"], [ent("Bob Roe", src="visible_text")], ["b"], None, at), ("u", "p3", None, None, None, None, None, None, None, at), ("u", "p4", "2020-02", None, "invitation card", ["Bob Roe"], [ent("Bob Roe", src="visible_text")], ["b"], None, at),
    ]
    photos = spark.createDataFrame(rows, schema)
    got = {r.photo_id: r for r in V.text_units(photos).collect()}
    assert set(got) == {"p1", "p2", "p4"}
    assert got["p1"].person_surfaces == ["Mia"] and got["p1"].relation_terms == ["aunt"] and got["p1"].organization_terms == ["Acme Inc"] and got["p1"].venue_terms == ["kitchen", "clinic"] and got["p1"].has_face
    # read off a casual photo of a face: left out; off an invitation: kept
    assert got["p2"].person_surfaces == [] and got["p4"].person_surfaces == ["Bob Roe"]
    faces = V.face_units(photos, spark.createDataFrame([("u", "a")], "user_id string, owner_face string"))
    assert rows_of(faces.select("photo_id", "face_id", "co_faces", "owner_present")) == [("p1", "a", ["b"], True), ("p1", "b", ["a"], True), ("p2", "b", [], False), ("p4", "b", [], False)]
    assert V.text_units(photos.where("false")).count() == 0 and V.inventory(photos.where("false")).count() == 0


def test_validated_facts_and_runs(spark):
    f = spark.createDataFrame([("u", 1, "She rides along the harbour", ["p"]), ("u", 2, "She rides along  the HARBOUR!", ["p"]), ("u", 3, "She may ride along there", ["p"]), ("u", 4, "Short", ["p"]), ("u", 5, "She sings in the choir", ["q", None]), ("u", 6, None, None), ("v", 7, "She rides along the harbour", ["p"])], "user_id string, fact_id int, text string, photo_ids array<string>")
    known = spark.createDataFrame([("u", "p"), ("v", "p")], "user_id string, photo_id string")
    got = {r.fact_id: r.reason for r in J.checked_facts(f, known).collect()}
    assert got == {1: "accepted", 2: "repeated", 3: "hedged", 4: "too_short", 5: "no_known_photo", 6: "too_short", 7: "accepted"}
    a, b = spark.createDataFrame([("u", "", ["x"]), ("v", "f", [])], "user_id string, owner_face string, persons array<string>"), spark.createDataFrame([("u", "g", ["y"])], "user_id string, owner_face string, facts array<string>")
    assert [tuple(r) for r in R.recomposed(a, b).collect()] == [("u", "g", ["x"], ["y"])]
    users = spark.createDataFrame([("u",), ("v",), ("w",)], "user_id string")
    assert rows_of(R.unfinished(users, users.where("user_id <> 'w'"), users.where("user_id = 'v'"))) == [("v",), ("w",)]


@pytest.mark.parametrize("path,value", [("", 0.0), ("photo 12 shows it", 0.33), ("see photo_0012: harbour rides with anna", 0.66)])
def test_fidelity(spark, path, value):
    got = spark.range(1).select(J.fidelity(F.lit(path), F.lit("harbour rides with anna"), F.lit("Anna Lee"), F.lit("Anna"))).first()[0]
    assert got == value
