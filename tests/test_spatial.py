import numpy as np
import pytest

from kestrel.operators import spatial as sp


def brute(pts, r):
    out = set()
    for i, (a, y, x) in enumerate(pts):
        for b, v, u in pts[i + 1:]:
            if sp.haversine(y, x, v, u) <= r and a != b:
                out.add((min(a, b), max(a, b)))
    return out


def cloud(seed, n=400):
    rng = np.random.default_rng(seed)
    lat = np.concatenate([rng.uniform(-90, 90, n // 4), 48 + rng.normal(0, 0.01, n // 4), np.where(rng.random(n // 4) < 0.5, 89.999, -89.999) + rng.normal(0, 0.0005, n // 4), rng.uniform(-1, 1, n // 4)])
    lon = np.concatenate([rng.uniform(-360, 360, n // 4), 2 + rng.normal(0, 0.01, n // 4), rng.uniform(-180, 180, n // 4), np.where(rng.random(n // 4) < 0.5, 179.999, -179.999) + rng.normal(0, 0.003, n // 4)])
    return [(i + 1, float(y), float(x)) for i, (y, x) in enumerate(zip(np.clip(lat, -90, 90), np.clip(lon, -360, 360)))]


@pytest.mark.parametrize("radius, options", [(300.0, {}), (20_000.0, {"sample": 100, "leaf_sample": 4}), (1000.0, {"leaf_sample": 8, "block": 20}), (5_000_000.0, {})])
def test_against_brute_force(spark, rows, radius, options):
    pts = cloud(int(radius))
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    norm = [(i, y, (x + 180) % 360 - 180) for i, y, x in pts]
    assert rows(sp.near_pairs(df, radius, **options)) == brute(norm, radius)


def test_dirty_and_hot(spark, rows):
    nan, inf = float("nan"), float("inf")
    same = [(i, 10.0, 20.0) for i in range(1, 41)]
    df = spark.createDataFrame(same + same[:5] + [(50, None, 1.0), (51, nan, 1.0), (52, inf, 1.0), (53, 91.0, 0.0), (54, 10.0, 361.0), (None, 10.0, 20.0), (55, 10.0, -340.0)], "id long, lat double, lon double")
    got = rows(sp.near_pairs(df, 1.0, block=7))
    assert got == {(a, b) for a in [*range(1, 41), 55] for b in [*range(1, 41), 55] if a < b}
    assert sp.near_pairs(df.limit(0), 300.0).count() == 0
    assert sp.near_pairs(df.limit(1), 300.0).count() == 0


def test_places(spark, rows):
    p = spark.createDataFrame([(1, 5, 0.0, 0.0, 1), (2, 5, 0.0, 0.0, 1), (3, 1, 10.0, 10.0, 1), (4, 2, 10.0, 10.001, 9), (5, 0, 10.0, 10.0, 1), (6, None, 10.0, 10.0, 1)], "id long, member_count long, lat double, lon double, place_a int")
    assert rows(sp.near_places(p)) == {(3, 4)}


def test_regions(spark, rows):
    ring = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    over = [(-5.0, 175.0), (-5.0, 185.0), (5.0, 185.0), (5.0, 175.0)]
    regs = spark.createDataFrame([(1, ring), (2, ring[:2]), (3, None), (4, over)], "region_id long, ring array<struct<lat: double, lon: double>>")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 0.0, 179.0), (4, 0.0, -179.0), (5, 0.0, -170.0), (6, None, 1.0), (1, 5.0, 5.0)], "id long, lat double, lon double")
    assert rows(sp.containing_region(pts, regs)) == {(1, 1), (3, 4), (4, 4)}
    assert rows(sp.containing_region(pts, regs, block=1)) == {(1, 1), (3, 4), (4, 4)}
    many = spark.range(300).selectExpr("id", "(id % 20) * 0.5 + 0.25 AS lat", "CAST(id / 20 AS INT) * 0.6 + 0.3 AS lon")
    want = {(r.id, 1) for r in many.collect() if 0 <= r.lat < 10 and 0 <= r.lon < 10}
    for options in ({}, {"leaf_sample": 8}, {"leaf_sample": 8, "block": 3}):
        assert rows(sp.containing_region(many, regs, **options)) == want
    assert sp.containing_region(pts.limit(0), regs).count() == 0 and sp.containing_region(pts, regs.limit(0)).count() == 0
