import pytest
from pyspark.sql import functions as F

from kestrel.functions import numbers as nb
from kestrel.functions import paths as pt
from kestrel.functions.clean import content_hash, epoch_micros, label


def values(spark, data, schema, **cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()]


NAMES = [
    ("IMG_20220514_090957.jpg", "2022-05-14 09:09:57", 0.9), ("WhatsApp Image 2022-05-14 at 09.09.57.jpeg", "2022-05-14 09:09:57", 0.9), ("WP_20180312_12_11_18_Pro.jpg", "2018-03-12 12:11:18", 0.9),
    ("2022-05-14_09-09-57.png", "2022-05-14 09:09:57", 0.9), ("BURST20240213093218240.jpg", "2024-02-13 09:32:18", 0.75), ("2018-14-03-21-07-07.mp4", "2018-03-14 21:07:07", 0.75), ("IMG00243-20120105-1855.jpg", "2012-01-05 18:55:00", 0.65),
    ("25-03-2019_10-20.mp4", "2019-03-25 10:20:00", 0.65), ("05-03-2019_10-20.mp4", "2019-03-05 10:20:00", 0.55), ("IMG-20220514-WA0001.jpg", "2022-05-14 00:00:00", 0.6), ("FB_IMG_1488863651591.jpg", "2017-03-07 05:14:11", 0.6),
    ("2019-25-06.jpg", "2019-06-25 00:00:00", 0.55), ("13.12.2019.jpg", "2019-12-13 00:00:00", 0.55), ("x1488863651591.jpg", "2017-03-07 05:14:11", 0.4), ("scan20220514.pdf", "2022-05-14 00:00:00", 0.4),
    ("20221399.jpg", None, None), ("notes.txt", None, None), ("", None, None), (None, None, None), ("13-13-2019.jpg", None, None), ("18990101.jpg", None, None),
]


def test_filename_dates(spark):
    f = pt.filename_date(F.col("n"))
    got = values(spark, [(n,) for n, _, _ in NAMES], "n string", a=F.date_format(f["at"], "yyyy-MM-dd HH:mm:ss"), c=F.round(f["confidence"], 2))
    assert got == [(a, c) for _, a, c in NAMES]


def test_month_first(spark):
    f = pt.filename_date(F.col("n"), day_first=False)
    assert values(spark, [("05-03-2019.jpg",)], "n string", a=F.date_format(f["at"], "MM-dd")) == [("05-03",)]


def test_paths(spark):
    p = F.col("p")
    got = values(spark, [("a/b\\c.JPG",), (".nomedia",), ("x",), ("a/thumbdata3-1",), ("a/b/y.tar.gz",), ("Thumbs.db",)], "p string", b=pt.basename(p), e=pt.extension(pt.basename(p)), i=pt.ignored(pt.basename(p)))
    assert got == [("c.JPG", "jpg", False), (".nomedia", "", True), ("x", "", False), ("thumbdata3-1", "", True), ("y.tar.gz", "gz", False), ("Thumbs.db", "db", True)]
    assert values(spark, [("jpg",), ("MOV",), ("wav",), ("zip",), ("docx",), (None,), ("q",)], "e string", t=pt.media_type(F.col("e"))) == [("image",), ("video",), ("audio",), ("archive",), ("document",), ("other",), ("other",)]
    assert pt.name_tokens("A b a  c") == ["a", "b", "c"]


def test_sidecar_names(spark):
    got = values(spark, [("IMG(2).jpg",), ("a-edited.png",), ("b.jpg",)], "n string", c=F.transform(pt.sidecar_names(F.col("n")), lambda x: F.concat_ws("|", x["json"], x["method"])))
    assert got[0][0][2:] == ["IMG.jpg(2).json|counter", "IMG.jpg.supplemental-metadata(2).json|counter-suppl"]
    assert got[1][0][2:] == ["a.png.json|edited", "a.png.supplemental-metadata.json|edited-suppl"]
    assert got[2][0] == ["b.jpg.json|exact", "b.jpg.supplemental-metadata.json|supplemental"]
    assert values(spark, [("a.jpg.supplemental-met.json",), ("b(1).json",)], "n string", b=pt.sidecar_base(F.col("n"))) == [("a.jpg",), ("b",)]


def test_clean(spark):
    h = "ab" * 32
    got = values(spark, [(h.upper(),), (f" SHA256:{h} \n",), (h[:-1],), ("pending",), (None,), ("",)], "s string", h=content_hash("s"))
    assert got == [(h,), (h,), (None,), (None,), (None,), (None,)]
    got = values(spark, [(1.5e9,), (1.5e12,), (1.5e15,), (0.0,), (-1.0,), (None,), (float("nan"),), (float("inf"),)], "t double", t=epoch_micros("t"))
    assert got == [(1_500_000_000_000_000,)] * 3 + [(None,)] * 5
    assert values(spark, [(" Low Quality",), ("low-quality",), (None,)], "t string", t=label("t")) == [("LOW_QUALITY",), ("LOW_QUALITY",), (None,)]


def test_numbers(spark):
    box = lambda *v: dict(zip("xywh", map(F.lit, v)))
    a, b = box(0, 0, 10, 10), box(5, 0, 10, 10)
    got = values(spark, [(1,)], "i int", iou=F.round(nb.iou(a, b), 4), o=nb.overlap_fraction(a, b), c=nb.clipped_fraction(box(-5, 0, 10, 10), F.lit(100), F.lit(100)), z=nb.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)),
                 h=F.round(nb.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))), d=nb.hamming(F.lit(5).cast("long"), F.lit(-1).cast("long")), s=nb.quality_score(F.lit(1.0), F.lit(1.0), F.lit(0.0)), t=nb.tier(F.lit(0.1)))
    assert got == [(0.3333, 0.5, 0.5, 0.0, 111195.0, 62, 0.365, "LOW_QUALITY")]
    got = values(spark, [("1.5", "S", "2.5", "west", "x"), ("0", "N", "0", "E", "1"), ("a", "N", "1", "E", "1")], "a string, b string, c string, d string, e string", g=nb.gps_from_exif(*[F.col(c) for c in "abcde"]))
    assert [tuple(r[0]) if r[0] else None for r in got] == [(-1.5, -2.5, None), None, None]
    got = values(spark, [("2020:05:01 10:00:00+02:00", None), ("0000:00:00 00:00:00", "2021:01:01 00:00:00"), (" ", "1980:01:01 00:00:00")], "a string, b string", e=nb.exif_datetime(F.col("a"), F.col("b")))
    assert [(str(r[0][0]), r[0][1]) if r[0] else None for r in got] == [("2020-05-01 10:00:00", 0.9), ("2021-01-01 00:00:00", 0.8), None]
    assert values(spark, [("2020",), ("2020-13",), ("2020-02-31",), ("x",)], "t string", m=nb.manual_date(F.col("t"))) == [("2020",), (None,), ("2020-02-31",), (None,)]
    assert values(spark, [(10.0,), (0.01,), (None,)], "d double", o=nb.video_offsets(F.col("d"), 3)) == [(["00:00:01.500", "00:00:05.000", "00:00:08.500"],), (["00:00:00.000"],), (["00:00:01"],)]
    assert values(spark, [(1588327200,)], "e long", w=nb.wall_clock(F.col("e"), "Europe/Madrid")) == [("2020-05-01T12:00:00",)]


def test_rotation_is_inverse(spark):
    w, h = 100, 50
    for turns, (fx, fy, fw, fh) in {1: (5, 60, 20, 10), 3: (5, 60, 20, 10)}.items():
        got = nb.rotate_back(dict(zip("xywh", map(F.lit, (fx, fy, fw, fh)))), turns, F.lit(w), F.lit(h))
        x, y, bw, bh = spark.range(1).select(*[got[k] for k in "xywh"]).first()
        assert (bw, bh) == (fh, fw) and 0 <= x <= w and 0 <= y <= h


@pytest.mark.parametrize("order, want", [(["exif", "mtime"], "exif"), (["mtime", "exif"], "mtime")])
def test_resolver(spark, order, want):
    c = lambda t, k: F.struct(F.lit(t).alias("at"), F.lit(k).alias("confidence"))
    got = spark.range(1).select(nb.resolve_date({"exif": c("a", 0.9), "mtime": c("b", 0.2)}, order)["source"]).first()[0]
    assert got == want


def test_picture_measures(spark):
    import numpy as np

    from kestrel.functions import images

    rng = np.random.default_rng(0)
    x = rng.uniform(30, 200, (32, 32))
    x = (x + np.roll(x, 1, 0) + np.roll(x, 1, 1)) / 3
    same, other = images.phash_of(x * 1.1 + 5), images.phash_of(rng.uniform(0, 255, (32, 32)))
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert far(images.phash_of(x), same) <= 2 and far(images.phash_of(x), other) > 10
    flat, dark = [100.0] * 16, [0.0, 255.0] * 8
    df = spark.createDataFrame([(1, flat, 4), (2, dark, 4), (3, None, 4), (4, [1.0] * 5, 4), (5, [float(v) for v in x.ravel()], 32)], "id long, grey array<double>, width int")
    got = {r.id: (r.q, r.p) for r in df.select("id", images.face_quality("grey", "width", F.lit(80.0)).alias("q"), images.phash("grey").alias("p")).collect()}
    assert got[1][0].quality == 0.0 and got[1][0].brightness == 100.0 and got[2][0].extreme == 1.0 and got[3][0].focus is None and got[4][0].focus is None
    assert got[5][1] == images.phash_of(x) and got[1][1] is None and 0 < got[5][0].quality < 1
