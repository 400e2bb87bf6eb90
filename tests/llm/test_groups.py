import datetime as dt

import numpy as np
import pytest

from kestrel.llm import components as cc
from kestrel.llm import survivor as sv


def brute(edges):
    parent = {v: v for e in edges for v in e}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {(v, top(v)) for v in parent}


def some_edges(seed):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b)) for a, b in rng.integers(1, 150, (110, 2))] + [(i + 1, i) for i in range(500, 590)] + [(700, i) for i in range(701, 790)] + [(900, 900)]


def test_forest():
    e = some_edges(1)
    a, b = np.array(e).T
    n, r = cc.forest(a, b)
    assert set(zip(n.tolist(), r.tolist())) == {(v, t) for v, t in brute(e) if v != t}
    assert len(cc.forest(a[:0], b[:0])[0]) == 0


@pytest.mark.parametrize("per_task", [4_000_000, 40, 3])
def test_components(spark, rows, per_task):
    e = some_edges(2)
    df = spark.createDataFrame([(*x, "x") for x in e] + [(1, None, "x"), (None, 2, "x")], "a long, b long, node string").repartition(9)
    assert rows(cc.components(df, per_task)) == brute(e)
    assert cc.components(df.limit(0)).count() == 0


def test_latest_answer(spark, rows):
    t = lambda d: dt.datetime(2024, 1, d)
    links = [(1, 2, " Same", t(1)), (2, 1, "different", t(2)), (3, 2, "SAME ", t(1)), (4, 3, "same", t(1)), (4, 3, "same", t(1)), (5, 5, "same", t(1)), (6, 99, "same", t(1)), (99, 7, "same", t(1)), (7, 8, "skip", t(1)), (8, 9, "different", t(1)), (9, 8, "same", t(3)), (10, 11, "same", t(1)), (10, 11, "different", t(1)), (12, 13, "same", None), (None, 1, "same", t(1))]
    df = spark.createDataFrame(links, "face_a long, face_b long, kind string, created_at timestamp")
    faces = spark.createDataFrame([(i, "x") for i in [*range(1, 14), 3]], "id long, group_id string")
    assert rows(cc.linked_faces(df, faces)) == {(2, 2), (3, 2), (4, 2), (8, 8), (9, 8), (12, 12), (13, 12)}
    assert cc.linked_faces(df, faces.limit(0)).count() == 0


F = "id long, root_id long, rel_path string, ext string, size long, mtime double, fast_hash string, sha256 string, present long, hidden long, value int"


def test_survivors(spark, rows):
    a, b, c, d = ("a" * 64), ("b" * 64), ("c" * 64), ("d" * 64)
    f = [
        (1, 1, "x", None, 5, 3.0, "h", a, 1, 0, 0), (2, 1, "x", "jpg", 5, 1.0, "h", a.upper(), 1, 0, 0), (3, 2, "x", "jpg", 5, 2000.0, "h", f" sha256:{a}\n", 1, 0, 0), (4, 2, "x", "jpg", 5, 9e9, "h", a, 1, 1, 0), (5, 3, "x", "jpg", 5, 9e9, "h", a, 0, 0, 0),
        (6, 1, "x", "jpg", None, None, None, b, 1, None, 0), (6, 1, "x", "jpg", None, None, None, b, 1, None, 0), (7, 1, "x", "", -1, float("nan"), " ", b, 1, 1, 0),
        (8, 1, "x", "jpg", 1, 1.0, "h", c, 1, 0, 0), (8, 1, "x", "jpg", 1, 1.0, "h", c, 1, 0, 0),
        (9, 1, "x", "jpg", 7, 1.5e12, "h", d, 1, 0, 0), (10, 1, "x", "jpg", 7, 1.5e9, "h", d, 1, 0, 0), (11, 1, "x", "jpg", 7, 1.5e9, "h", "pending", 1, 0, 0), (12, 1, "x", "jpg", 7, 1.5e9, "h", None, 1, 0, 0), (None, 1, "x", "jpg", 7, 1.5e9, "h", d, 1, 0, 0),
    ]
    df = spark.createDataFrame(f, F)
    assert rows(sv.survivors(df)) == {(a, 3, 5), (b, 6, 0), (d, 9, 7)}
    assert sv.survivors(df.limit(0)).count() == 0


def test_disputed_size(spark, rows):
    a = "a" * 64
    df = spark.createDataFrame([(i, i, "x", "jpg", s, 1.0, "h", a, 1, 0, 0) for i, s in enumerate([5, 5, 5, 9], 1)], F)
    assert rows(sv.survivors(df)) == {(a, 1, 5)}


def test_fusion_discounts_copies(spark):
    """Three sources that copy each other's mistakes lose against two independent ones that are right elsewhere."""
    rng = np.random.default_rng(0)
    votes, truth = [], {}
    for i in range(60):
        truth[i] = 100 + i
        for s, wrong in (("good1", 0.05), ("good2", 0.05), ("good3", 0.1)):
            votes.append((i, s, 100 + i if rng.random() > wrong else int(rng.integers(1000, 9999))))
        lie = 5000 + i if rng.random() < 0.45 else 100 + i
        votes += [(i, s, lie) for s in ("copy1", "copy2", "copy3", "copy4")]
    df = spark.createDataFrame(votes + votes[:9] + [(None, "x", 1), (1, "x", None)], "item long, source string, value long")
    got = {r.item: r.value for r in sv.fuse(df, 4).collect()}
    plain = {i: max({v for j, _, v in votes if j == i}, key=lambda v: sum(1 for j, _, w in votes if j == i and w == v)) for i in truth}
    right = lambda g: sum(g[i] == t for i, t in truth.items())
    assert right(got) > right(plain) and right(got) >= 54
    assert sv.fuse(df.limit(0)).count() == 0


def test_fused_size_is_decided_by_what_other_fields_show(spark):
    """Four archives copy one another's wrong extensions; in the end three sound ones outvote them about a size."""
    rng = np.random.default_rng(1)
    f, n = [], 0
    for i in range(60):
        lie = f"bad{i}" if rng.random() < 0.45 else "jpg"
        for root in range(1, 8):
            n += 1
            sound = root <= 3
            ext = (f"own{root}{i}" if rng.random() < 0.07 else "jpg") if sound else lie
            f.append((n, root, "x", ext, (9 if sound else 5) if i == 0 else 7, 1.0e9, "h", f"{i:064x}", 1, 0, 0))
    df = spark.createDataFrame(f, F)
    got = {r.sha256: r for r in sv.records(df, 4).collect()}
    first = f"{0:064x}"
    assert got[first].size == 9 and all(r.size == 7 for k, r in got.items() if k != first) and sum(r.ext == "jpg" for r in got.values()) >= 56
    assert {r.sha256: r.size for r in sv.survivors(df, 4).collect()}[first] == 9
    alone = df.where(f"sha256 = '{first}'")  # without the record of the others the majority wins
    assert sv.survivors(alone, 4).first().size == 5
