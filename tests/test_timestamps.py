import datetime as dt
import zoneinfo

import numpy as np
import pytest

from kestrel.operators import timestamps as ts

NONE = -(1 << 62)


def one(text, utc=False, zone=None):
    return int(ts.instants([text], np.array([utc]), [zone])[0])


def ms(*a, zone="UTC"):
    return int(dt.datetime(*a, tzinfo=zoneinfo.ZoneInfo(zone)).timestamp() * 1000)


@pytest.mark.parametrize("text, want", [
    ("2020-05-01T10:00:00Z", ms(2020, 5, 1, 10)), ("20200501T100000z", ms(2020, 5, 1, 10)), ("2020-05-01 10:00:00 UTC", ms(2020, 5, 1, 10)),
    ("2020-05-01T10:00:00.123987+02:00", ms(2020, 5, 1, 8) + 123), ("2020-05-01T10:00:00−03:30", ms(2020, 5, 1, 13, 30)),
    ("2020:05:01 10:00:00+05:30", ms(2020, 5, 1, 4, 30)), ("20200501T100000-0230", ms(2020, 5, 1, 12, 30)), ("20200501T100000+02", ms(2020, 5, 1, 8)),
    ("Fri, 01 May 2020 10:00:00 +0100", ms(2020, 5, 1, 9)), ("May 1, 2020, 1:05:06\u202fPM UTC", ms(2020, 5, 1, 13, 5, 6)),
    ("01.05.2020 10:00:00 CEST", ms(2020, 5, 1, 8)), ("2020-05-01T10:00:00+02:00[Europe/Madrid]", ms(2020, 5, 1, 8)),
    ("1588327200", 1588327200000), ("1588327200.5", 1588327200500), ("1588327200123", 1588327200123), ("1588327200123456", 1588327200123),
])
def test_texts_with_own_zone(text, want):
    assert one(text) == want


@pytest.mark.parametrize("text", [
    "2020-02-30T10:00:00", "2020-13-01 10:00:00", "0000:00:00 00:00:00", "2020-05-01", "unknown", "", "    :  :     :  :  ",
    "03/04/2020 10:00:00", "2020-05-01T25:00:00", "13:00:00 PM", "2020-05-01 13:00:00 PM", "2020-05-01 10:61:00", "2020-05-01 10:00:00 XYZT", "x" * 5000,
])
def test_texts_without_instant(text):
    assert one(text, utc=True) == NONE


def test_day_and_month():
    assert one("25/04/2020 10:00:00", True) == one("04/25/2020 10:00:00 AM", True) == ms(2020, 4, 25, 10)
    assert one("04/04/2020 10:00:00", True) == ms(2020, 4, 4, 10)  # both readings agree
    assert one("03.04.2020 10:00:00", True) == ms(2020, 4, 3, 10)  # dots: day first


def test_clock_changes():
    assert one("2020-03-29 02:30:00", zone="Europe/Berlin") == NONE
    assert one("2020-10-25 02:30:00", zone="Europe/Berlin") == NONE
    assert one("2020-10-25 03:00:00", zone="Europe/Berlin") == ms(2020, 10, 25, 2)
    assert one("2020-04-05 01:45:00", zone="Australia/Lord_Howe") == NONE  # half an hour of summer time
    assert one("2020-05-01 10:00:00", zone="No/Where") == NONE
    assert one("2020-05-01 10:00:00") == NONE


@pytest.mark.parametrize("zone", ["Europe/Madrid", "America/St_Johns", "Australia/Lord_Howe", "Pacific/Auckland", "Asia/Kathmandu", "America/Argentina/Buenos_Aires"])
def test_against_brute_force(zone):
    z, rng = zoneinfo.ZoneInfo(zone), np.random.default_rng(3)
    local = rng.integers(1_262_304_000, 1_767_225_600, 3000)
    begins, _ = ts.zone_table(zone)
    local = np.concatenate([local, (begins[begins > 1_262_304_000][:, None] + rng.integers(-90_000, 90_000, 30)).ravel()])
    utc, once = ts.to_utc(local, zone)
    for v, u, ok in zip(local.tolist(), utc.tolist(), once.tolist()):
        naive = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=v)
        both = {naive.replace(tzinfo=z, fold=f).timestamp() for f in (0, 1)}
        real = {t for t in both if dt.datetime.fromtimestamp(t, z).replace(tzinfo=None) == naive}
        assert ok == (len(real) == 1)
        assert not ok or u == real.pop()


def test_table(spark, rows):
    dates = spark.createDataFrame([
        (1, "2020-07-01 10:00:00", " EXIF", 7), (1, "2020-07-01 10:00:00", " EXIF", 7), (2, "2020-07-01 10:00:00", "Takeout_JSON", 7), (3, None, "mtime", 7), (4, " ", "MTIME ", 7),
        (5, None, "exif", 7), (6, "", "mtime", 7), (7, "2020-07-01 10:00:00", "exif", 7), (8, "2020-07-01 10:00:00", None, 7), (None, "2020-07-01T10:00:00Z", "exif", 7), (9, "2020-07-01T10:00:00Z", None, 7),
    ], "file_id long, best_datetime string, date_source string, root_id int")
    files = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1588327200.1239), (4, 1, 1588327200123.0), (6, 1, -5.0), (7, 2, 1.0), (8, 1, None)], "id long, root_id long, mtime double")
    roots = spark.createDataFrame([(1, "Europe/Madrid"), (2, None)], "root_id long, zone_name string")
    got = rows(ts.utc_instants(dates, files, roots))
    ten = ms(2020, 7, 1, 10)
    assert got == {(1, ten - 7_200_000), (2, ten), (3, 1588327200123), (4, 1588327200123), (8, ten - 7_200_000), (9, ten)}
    assert ts.utc_instants(dates.limit(0), files.limit(0), roots.limit(0)).count() == 0


def test_version():
    assert ts.zone_version()
