import datetime as dt
import io
import json
import os
import time
import zipfile

from pyspark.sql import functions as F

from kestrel.sources import readers
from kestrel.streaming import events as ev


def zipped(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n.replace("__", "/").replace("_xml", ".xml"), t)
    return b.getvalue()


W = 'xmlns:w="urn:w"'
DOCX = zipped(word__document_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> there</w:t></w:r></w:p><w:p/></w:body></w:document>", word__footer1_xml=f"<w:f {W}><w:p><w:t>Foot</w:t></w:p></w:f>")
PPTX = zipped(ppt__slides__slide10_xml=f"<w:s {W}><w:p><w:t>ten</w:t></w:p></w:s>", ppt__slides__slide2_xml=f"<w:s {W}><w:p><w:t>two</w:t></w:p></w:s>")
XLSX = zipped(xl__sharedStrings_xml=f"<sst {W}><si><t>name</t></si></sst>", xl__worksheets__sheet1_xml='<s><row><c t="s"><v>0</v></c><c><v>4</v></c></row></s>')
ODT = zipped(content_xml='<o xmlns:t="urn:t"><t:p>One <t:span>two</t:span></t:p></o>')


def test_documents():
    read = lambda raw, ext: readers.read_document(raw, ext)
    assert read(DOCX, "docx")[0] == [(None, "Hello there"), (None, "Foot")]
    assert read(PPTX, "pptx")[0] == [(1, "two"), (2, "ten")]
    assert read(XLSX, "xlsx")[0] == [(None, "name\t4")]
    assert read(ODT, "ODT")[0] == [(None, "two")]  # styled runs; bare paragraphs only where there are none
    assert read(zipped(content_xml='<o xmlns:t="urn:t"><t:p>One</t:p><t:p> two </t:p></o>'), "ods")[0] == [(None, "One\ntwo")]
    assert read("é".encode("utf-16"), "txt")[0] == [(None, "é")] and read("é".encode("cp1252"), "txt")[0] == [(None, "é")]
    assert read(b"<html><head><title>x</title></head><body> A <script>b</script><p>C</p></body></html>", "html")[0] == [(None, "A\nC")]
    assert read(json.dumps({"cells": [{"source": ["a", "b"]}, {"source": "c", "outputs": ["no"]}]}).encode(), "ipynb")[0] == [(None, "ab\n\nc")]
    assert read(b"", "txt") == ([], None) and read(None, "txt")[1] == "no content"
    assert read(b"x", "doc")[1].startswith("unsupported") and read(b"x", None)[1].startswith("unsupported") and read(b"nozip", "docx")[1].startswith("unreadable")


def test_walk(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.TXT").write_bytes(b"hello")
    (tmp_path / "a/y.docx").write_bytes(DOCX)
    (tmp_path / ".nomedia").write_bytes(b"")
    (tmp_path / "s.json").write_bytes(b"{}")
    f = readers.walk(spark, str(tmp_path), content=True)
    got = {r["name"]: r for r in f.withColumn("h", readers.fast_hash(F.col("content"), F.col("size"))).collect()}
    assert set(got) == {"x.TXT", "y.docx"} and got["x.TXT"]["ext"] == "txt" and got["x.TXT"]["media_type"] == "document"
    import hashlib

    assert got["x.TXT"]["h"] == hashlib.sha256(b"5hello").hexdigest()
    assert {os.path.basename(r.path): [b.text for b in r.blocks] for r in readers.extract(f).collect()} == {"x.TXT": ["hello"], "y.docx": ["Hello there", "Foot"]}


def test_sidecars(spark, rows):
    v = lambda t: tuple(spark.createDataFrame([(t,)], "t string").select(readers.sidecar(F.col("t")).alias("s")).first()[0])
    assert v('{"photoTakenTime":{"timestamp":"1588327200"},"geoData":{"latitude":0.0,"longitude":0.0},"geoDataExif":{"latitude":1.5,"longitude":-2.0}}') == (1588327200, 1.5, -2.0)
    assert v('{"photoTakenTime":{"timestamp":"1588327200"},"geoData":{"latitude":0.0,"longitude":0.0}}') == (1588327200, None, None) and v("not json") == (None, None, None)
    media = spark.createDataFrame([(1, "d", "a.jpg"), (2, "d", "b(1).jpg"), (3, "d", "c-edited.png"), (4, "d", "a very long name that goes on.jpg"), (5, "e", "a.jpg")], "id long, dir string, name string")
    sides = spark.createDataFrame([("d", "a.jpg.json"), ("d", "a.jpg.supplemental-metadata.json"), ("d", "b.jpg(1).json"), ("d", "c.png.json"), ("d", "a very long name that g.json"), ("d", "a.json")], "dir string, json string")
    assert rows(readers.match_sidecars(media, sides).select("id", "json", "method")) == {(1, "a.jpg.json", "exact"), (2, "b.jpg(1).json", "counter"), (3, "c.png.json", "edited"), (4, "a very long name that g.json", "prefix")}


def events(spark):
    t = dt.datetime(2024, 1, 1)
    m = lambda x: t + dt.timedelta(minutes=x)
    return spark.createDataFrame([(m(0), 1, "view", 1.0), (m(10), 1, "view", 2.0), (m(70), 1, "click", 3.0), (m(71), 2, "view", 4.0)], "ts timestamp, user_id long, event_type string, value double")


def test_windows_stream_like_batch(spark, rows, tmp_path):
    e = events(spark)
    assert {(r.user_id, r.n) for r in ev.sessions(e).collect()} == {(1, 2), (1, 1), (2, 1)}
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    s = ev.stream(spark, str(tmp_path / "in"), e.schema)
    ev.drain(s, lambda df, k: got.extend(df.collect()), str(tmp_path / "cp"))
    assert len(got) == 4
    ev.drain(s, lambda df, k: got.extend(df.collect()), str(tmp_path / "cp"))
    assert len(got) == 4  # nothing is owed any more
    q = ev.tumbling(ev.stream(spark, str(tmp_path / "in"), e.schema, 10), late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("w")) == rows(ev.tumbling(e))


def test_places_drift_across_batches(spark, tmp_path):
    src = tmp_path / "p"
    for k, part in enumerate(([(1, 1, 10.0, 20.0), (1, 2, 10.001, 20.0)], [(1, 3, 10.002, 20.0), (1, 4, 50.0, 20.0), (2, 5, 10.0, 20.0)])):
        spark.createDataFrame(part, "root_id long, id long, lat double, lon double").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1 if not k else 0)
    schema = spark.read.parquet(str(src)).schema
    q = ev.place_updates(ev.stream(spark, str(src), schema)).writeStream.outputMode("append").format("memory").queryName("places").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.root_id, r.id, r.place_id) for r in spark.table("places").collect()} == {(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 5, 1)}
