"""Mixed timestamp formats and time zones brought to one UTC instant (problem 3).

Texts are reduced to shape masks (digits become 9, letters a). A mask is compiled to a parser once; all texts of a
mask are then parsed together on character matrices, and clock times are converted through zone transition tables.
"""

from __future__ import annotations

import datetime as dt
import importlib.metadata
import re
import zoneinfo
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.clean import epoch_micros

MONTHS = {m: i // 4 + 1 for i, m in enumerate(
    "jan january janvier januar feb february fevrier februar mar march mars marz apr april avril abril "
    "may mai mayo maj jun june juin juni jul july juillet juli aug august aout agosto "
    "sep september septembre sept oct october octobre oktober nov november novembre noviembre dec december decembre dezember".split())}
#: Zone abbreviations with one usual meaning, minutes east of UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180,
    "msk": 180, "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "nst": -210,
    "ndt": -150, "jst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
_DAY = 86_400
_PLAIN = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_SIGNS = str.maketrans({**{chr(c): "-" for c in (0x2010, 0x2011, 0x2013, 0x2212)}, **{chr(c): " " for c in (0xA0, 0x2002, 0x2007, 0x2009, 0x202F, 0x3000)}, **{chr(c): "" for c in (0x200B, 0x200E, 0x200F, 0xFEFF)}})
_ZONE = r"(?: ?(?:(?P<zs>[+-])(?P<zh>99):?(?P<zm>99)?|(?P<za>a{1,4}))(?:\[(?P<zn>[a9/_+-]+)\])?| (?P<zr>a+(?:[/_-]a+)+))?"
_CLOCK = r"(?P<h>99?)[:.](?P<mi>99)(?:[:.](?P<s>99)(?:[.,](?P<f>9{1,9}))?)?(?: ?(?P<ap>aa)(?![a]))?"
_DATES = (
    r"(?P<y>9999)[-:/.](?P<mo>99)[-:/.](?P<d>99)",
    r"(?P<d>99?)\.(?P<mo>99?)\.(?P<y>9999)",
    r"(?P<p>99?)[/-](?P<q>99?)[/-](?P<y>9999)",
    r"(?:a{2,9},? )?(?P<d>99?)\.?[ -](?P<mn>a{3,9})\.?,?[ -](?P<y>9999)",
    r"(?:a{2,9},? )?(?P<mn>a{3,9})\.? (?P<d>99?),? (?P<y>9999)",
)
_LAYOUTS = [re.compile(rf"{d}(?:a|,? +|_){_CLOCK}{_ZONE}") for d in _DATES] + [
    re.compile(rf"(?P<y>9999)(?P<mo>99)(?P<d>99)[a_ -]?(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,]?(?P<f>9{{1,9}}))?{_ZONE}"),
    re.compile(rf"(?P<y>9999)(?P<mo>99)(?P<d>99)[a_ -](?P<h>99)(?P<mi>99){_ZONE}"),
    re.compile(rf"(?P<y>9999)-(?P<mo>99)-(?P<d>99)a(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,](?P<f>9{{1,9}}))?{_ZONE}"),
]
#: Digits of a bare count since 1970 and its unit's part of a millisecond.
_COUNTS = {9: 1e3, 10: 1e3, 11: 1, 12: 1, 13: 1, 15: 1e-3, 16: 1e-3, 18: 1e-6, 19: 1e-6}


def zone_version() -> str:
    """Version of the zone rules that the tables were made from."""
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        for root in zoneinfo.TZPATH:
            try:
                return open(f"{root}/tzdata.zi").readline().split()[-1]
            except OSError:
                continue
    return "system"


#: Tables that a task was given, by zone name.
_GIVEN: dict[str, tuple[np.ndarray, np.ndarray] | None] = {}


def use_tables(version: str, tables: dict[str, tuple[np.ndarray, np.ndarray] | None]) -> None:
    """Take ready tables; machines with other zone rules than those they were made from are refused."""
    if zone_version() != version:
        raise RuntimeError(f"zone rules {zone_version()} here, {version} where the tables were made")
    _GIVEN.update(tables)


def zone_table(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The zone's table, as given to the task or else made here."""
    return _GIVEN[name] if name in _GIVEN else make_table(name)


@lru_cache(maxsize=None)
def make_table(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(UTC seconds at which an offset begins, offsets in seconds) from 1900 to 2100; None for an unknown zone."""
    try:
        z = zoneinfo.ZoneInfo(name)
    except Exception:
        return None
    utc = dt.timezone.utc

    def off(t: int) -> int:
        return int((dt.datetime(1970, 1, 1, tzinfo=utc) + dt.timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())

    at, end = -2_208_988_800, 4_102_444_800
    begins, offsets = [-(1 << 60)], [off(at)]
    while at < end:
        nxt, now = at + 3 * _DAY, offsets[-1]
        if off(nxt) != now:
            lo, hi = at, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if off(mid) == now else (lo, mid)
            begins.append(hi)
            offsets.append(off(hi))
            nxt = hi
        at = nxt
    return np.array(begins), np.array(offsets)


def to_utc(local: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """Clock seconds to UTC seconds, and which of them exist exactly once in the zone."""
    table = zone_table(zone)
    if table is None:
        return local, np.zeros(len(local), bool)
    begins, offsets = table
    ends = np.append(begins[1:], 1 << 60)
    k = np.searchsorted(begins, local, side="right") - 1
    hits, utc = np.zeros(len(local), int), local.copy()
    for j in (k - 1, k, k + 1):
        inside = (j >= 0) & (j < len(begins))
        j = np.clip(j, 0, len(begins) - 1)
        u = local - offsets[j]
        ok = inside & (u >= begins[j]) & (u < ends[j])
        utc = np.where(ok, u, utc)
        hits += ok
    return utc, hits == 1


@lru_cache(maxsize=4096)
def compile_mask(mask: str):
    """The parser of a mask: field name to its slice, or a count's unit, or None."""
    if m := re.fullmatch(r"(9+)(?:[.,](9+))?", mask):
        n = len(m[1])
        if n in _COUNTS and not (m[2] and n > 10):
            return ("count", n, len(m[2] or ""))
    for layout in _LAYOUTS:
        if m := layout.fullmatch(mask):
            return ("clock", {k: m.span(k) for k, v in m.groupdict().items() if v is not None}, None)
    return None


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    v = np.zeros(len(chars), np.int64)
    for i in range(*span):
        v = v * 10 + (chars[:, i].astype(np.int64) - 48)
    return v


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of a calendar date, and whether it exists."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    mm = np.where(ok, m, 1)
    first = (np.where(ok, y, 1970) - 1970).astype("M8[Y]").astype("M8[M]") + (mm - 1)
    length = ((first + 1).astype("M8[D]") - first.astype("M8[D]")).astype(int)
    return first.astype("M8[D]").astype(np.int64) + d - 1, ok & (d <= length)


def _lookup(texts: list[str], span, table: dict[str, int], keep: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    words = [t[span[0]:span[1]].lower() for t in texts]
    got = [table.get(w) for w in words]
    return np.array([0 if g is None else g for g in got], np.int64), np.array([g is not None for g in got], bool)


def instants(texts: list[str | None], own_utc: np.ndarray, zones: list[str | None]) -> np.ndarray:
    """Milliseconds since 1970 of each text as whole numbers; -1 << 62 where it denotes no instant.

    ``own_utc`` marks texts whose zoneless clock times are UTC, ``zones`` names the zone of the others.
    """
    out = np.full(len(texts), -(1 << 62), np.int64)
    by_mask: dict[str, list[int]] = defaultdict(list)
    clean: list[str] = []
    for i, t in enumerate(texts):
        t = t.translate(_SIGNS).strip() if t else ""
        clean.append(t)
        if t:
            by_mask[t.translate(_PLAIN)].append(i)
    for mask, at in by_mask.items():
        parser = compile_mask(mask)
        if parser is None:
            continue
        rows = np.array(at)
        own = [clean[i] for i in at]
        chars = np.array(own, dtype=f"U{len(mask)}").view(np.uint32).reshape(len(own), -1)
        if parser[0] == "count":
            _, n, f = parser
            v = _number(chars, (0, n))
            scale = _COUNTS[n]
            if scale >= 1:
                ms = v * int(scale)
                if f and scale == 1e3:
                    ms = ms + _number(chars, (n + 1, n + 1 + min(f, 3))) * 10 ** (3 - min(f, 3))
            else:
                ms = v // round(1 / scale)
            out[rows] = ms
            continue
        at_ = parser[1]
        ok = np.ones(len(own), bool)
        y = _number(chars, at_["y"])
        if "p" in at_:
            p, q = _number(chars, at_["p"]), _number(chars, at_["q"])
            ok &= ~((p <= 12) & (q <= 12) & (p != q))
            d, mo = np.where(p > 12, p, q), np.where(p > 12, q, p)
        else:
            d = _number(chars, at_["d"])
            if "mn" in at_:
                mo, known = _lookup(own, at_["mn"], MONTHS)
                ok &= known
            else:
                mo = _number(chars, at_["mo"])
        days, real = _days(y, mo, d)
        h, mi = _number(chars, at_["h"]), _number(chars, at_["mi"])
        s = _number(chars, at_["s"]) if "s" in at_ else np.zeros(len(own), np.int64)
        ok &= real & (mi < 60) & (s < 60)
        if "ap" in at_:
            half, known = _lookup(own, at_["ap"], {"am": 0, "pm": 12})
            ok &= known & (h >= 1) & (h <= 12)
            h = h % 12 + half
        ok &= h < 24
        ms = np.zeros(len(own), np.int64)
        if "f" in at_:
            lo, hi = at_["f"]
            hi = min(hi, lo + 3)
            ms = _number(chars, (lo, hi)) * 10 ** (3 - (hi - lo))
        local = days * _DAY + h * 3600 + mi * 60 + s
        utc = local
        if "zs" in at_:
            zh = _number(chars, at_["zh"])
            zm = _number(chars, at_["zm"]) if "zm" in at_ else np.zeros(len(own), np.int64)
            ok &= (zh <= 15) & (zm < 60)
            sign = np.where(chars[:, at_["zs"][0]] == ord("-"), -1, 1)
            utc = local - sign * (zh * 3600 + zm * 60)
        elif "za" in at_:
            off, known = _lookup(own, at_["za"], ABBREVIATIONS)
            ok &= known
            utc = local - off * 60
        else:
            named = at_.get("zn") or at_.get("zr")
            where: dict[str | None, list[int]] = defaultdict(list)
            for j, i in enumerate(at):
                where[own[j][named[0]:named[1]] if named else "UTC" if own_utc[i] else zones[i]].append(j)
            utc = local.copy()
            for zone, js in where.items():
                js = np.array(js)
                if zone is None:
                    ok[js] = False
                elif zone != "UTC":
                    u, once = to_utc(local[js], zone)
                    utc[js] = u
                    ok[js] &= once
        out[rows[ok]] = utc[ok] * 1000 + ms[ok]
    return out


def parser(zones: list[str]):
    """A vectorised function of (text, whether zoneless ones are UTC, zone) to milliseconds. The tables of ``zones`` are made
    once, here, and travel with the function together with the version of the rules."""
    version, tables = zone_version(), {z: make_table(z) for z in zones}

    @F.pandas_udf(T.LongType())
    def instant_ms(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        use_tables(version, tables)
        for text, own_utc, zone in batches:
            v = instants([t if isinstance(t, str) else None for t in text], own_utc.to_numpy(dtype=bool), [z if isinstance(z, str) else None for z in zone])
            yield pd.Series(pd.arrays.IntegerArray(v, v == -(1 << 62)))

    return instant_ms


def utc_instants(dates: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """``(file_id, utc_ms)``: one row per record of ``dates`` that denotes exactly one instant.

    A text with its own zone or offset, or a count since 1970 in any unit, stands for itself (where an offset and
    a zone name disagree, the offset decides). A clock time without zone is UTC if the source is takeout_json
    (case and blanks of the source do not matter), else in the zone of the file's root. A NULL or blank text of
    source mtime means ``files.mtime``, if usable. No row: other blanks, no time of day, impossible dates or
    times, an unknown or missing zone, clock times that the zone skips or has twice, and numeric dates with
    slashes or hyphens whose day and month can change places (``01/02/2020``; dotted ones are day first).
    Finer digits than milliseconds are cut. Repeated rows count once; dates of files that are not in ``files`` have
    no zone and no mtime; NULL file ids, empty tables and extra columns are harmless.
    """
    d = dates.where("file_id IS NOT NULL").groupBy("file_id").agg(F.min(F.struct("best_datetime", "date_source")).alias("d"))
    f = files.where("id IS NOT NULL").groupBy(F.col("id").alias("file_id")).agg(F.min(F.struct("root_id", "mtime")).alias("f"))
    z = roots.where("root_id IS NOT NULL").groupBy("root_id").agg(F.min("zone_name").alias("zone_name"))
    source = F.lower(F.trim("d.date_source"))
    j = d.join(f, "file_id", "left").select("file_id", F.col("d.best_datetime").alias("text"), F.coalesce(source, F.lit("")).alias("source"), F.col("f.root_id").alias("root_id"), F.col("f.mtime").alias("mtime"))
    j = j.join(z, "root_id", "left")
    blank = F.col("text").isNull() | (F.regexp_replace("text", r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]+", "") == "")
    known = zoneinfo.available_timezones()  # bounds the names that are brought here
    names = [r["zone_name"] for r in z.where(F.col("zone_name").isin(sorted(known))).select("zone_name").distinct().collect()]
    parsed = parser(names)(F.when(~blank, F.col("text")), F.col("source") == "takeout_json", "zone_name")
    fallback = F.when(F.col("source") == "mtime", F.floor(epoch_micros("mtime") / 1000).cast("long"))
    return j.select("file_id", F.when(blank, fallback).otherwise(parsed).alias("utc_ms")).where("utc_ms IS NOT NULL")
