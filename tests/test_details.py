import pytest
from pyspark.sql import functions as F

from kestrel.functions import queries as q
from kestrel.operators import details

PEOPLE = {1: "María José", 2: "Ana", 3: "Mario", 4: "Mariana"}


@pytest.mark.parametrize("text, want, rest", [
    ("Ana at the lake", [2], "at the lake"), ("maria jose and Ana's boat", [1, 2], "'s boat"), ("marinero", [], "marinero"), ("mari", [], "mari"), ("mario rossi", [3], "rossi"), ("maría", [], "maría"), ("escritura .pdf", [], "escritura .pdf"), ("with Ana , lake", [2], ", lake"),
])
def test_mentions(text, want, rest):
    found = q.mentions(text, PEOPLE)
    assert [m.person for m in found] == want
    assert q.without_mentions(text, found) == rest


def test_words():
    assert q.plain_words("Ñandú's  café_1") == "nandus cafe 1" and q.plain_words(None) == ""
    assert q.clearly_english("besides a lake") and not q.clearly_english("lago de noche")
    assert q.edit_distance("kitten", "sitting") == 3 and q.meets("anna", "annabel") == 1 and q.meets("ana", "anabel") == 0 and q.meets("marja", "maria") == 1


def test_mention_table(spark):
    m = q.MentionFinder(F.lit("Ana and Mario"), F.create_map(F.lit(2).cast("long"), F.lit("Ana"), F.lit(3).cast("long"), F.lit("Mario")))
    assert {(r.person, r.exact) for r in m.collect()} == {(2, True), (3, True)}


def test_features_and_cards():
    assert len(q.features(None)["features"]) == len(q.FEATURES)
    f = q.features(["ocr", "nonsense"])
    assert f["stages"] == ["dedup", "enrich", "scan", "text"] and f["extractors"] == ["ocr"] and f["ways"] == ["name", "text"] and f["detectors"] == []
    states = [{"kind": "scan", "state": "running", "pending": 3}, {"kind": "enrich", "state": "queued", "pending": 2}, {"kind": "dedup", "state": "blocked", "pending": 1}, {"kind": "text", "state": "blocked", "pending": 1}]
    c = {x["id"]: x for x in q.cards(states, {"scan": "scan", "enrich": "scan", "dedup": "dedup", "text": "text"}, {"dedup": "scan", "text": "dedup"}, {"dedup"})}
    assert c["scan"]["state"] == "running" and c["scan"]["pending"] == 5 and c["dedup"]["next"] and c["text"]["stalled"] and not c["scan"]["stalled"]


def test_person_page(spark, rows):
    faces = spark.createDataFrame([(1, 10, 7, 0.5), (2, 10, 7, 0.9), (3, 11, 8, 0.9)], "id long, file_id long, person_id long, det_score double")
    tags = spark.createDataFrame([(7, "Ana", 10), (7, "Ana", 12), (7, "Ana", 12)], "entity_id long, name string, file_id long")
    assert rows(details.of_person(faces, tags, 7)) == {(10, 2), (12, None)}


def test_sample_and_points(spark, rows):
    a = spark.range(100).repartition(7)
    assert rows(details.sample(a, "id", 9)) == rows(details.sample(a.coalesce(1), "id", 9)) and details.sample(a, "id", 9).count() == 9
    files = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "id long, present long, hidden long")
    geo = spark.createDataFrame([(1, 1.000005, 2.0), (2, 1.0, 1.0)], "file_id long, lat double, lon double")
    members = spark.createDataFrame([(5, 1), (6, 1)], "place_id long, file_id long")
    assert {r.place_id for r in details.place_points(files, geo, members).collect()} == {5, 6}
    assert rows(details.progress(files, files.where("id = 1"))) == {(2, 1)}
