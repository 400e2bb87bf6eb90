import numpy as np
import pytest

from kestrel.llm import hnsw, vectors

S = "id long, embedding array<float>"


def people(seed=0, groups=40, width=32, n=900, spread=0.35):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((groups, width))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    which = np.minimum(rng.geometric(0.08, n) - 1, groups - 1)
    x = c[which] + spread * rng.standard_normal((n, width)) / np.sqrt(width)
    return (x * rng.uniform(0.5, 20, (n, 1))).astype(np.float32)


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i + 1, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra), S)


def top_pairs(x, k=5, floor=0.75):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]:
            if s[i, j] >= floor:
                out.add((min(i, j) + 1, max(i, j) + 1))
    return out


def test_graph_recall():
    x = people(1, n=3000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    assert len(g.layers) > 2 and all((a[:, 0] >= 0).mean() > 0.95 for a in g.links[:-1])  # all but the top layer have neighbour arrays
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    for found in (g.neighbours(5, floor=-1.0), g.search(x, 6, floor=-1.0)):
        assert np.mean([len(set(w) & set(f)) / 5 for w, f in zip(want.tolist(), found.tolist())]) > 0.9


@pytest.mark.parametrize("options", [{}, {"per_shard": 200, "spread": 4}, {"per_shard": 300, "spread": 4, "part": 150}])
def test_nearest_against_brute_force(spark, rows, options):
    x = people(2)
    got, want = rows(vectors.near_pairs(frame(spark, x), 32, **options)), top_pairs(x)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_dirty_vectors_and_copies(spark, rows):
    nan = float("nan")
    a, b = [1.0] * 4, [1.0, 1.0, 1.0, 0.5]
    data = [(i, a) for i in range(1, 10)] + [(20, b), (20, b), (30, None), (31, []), (32, [1.0] * 3), (33, [0.0] * 4), (34, [nan, 1.0, 1.0, 1.0]), (35, [float("inf")] * 4), (36, [1.0, None, 1.0, 1.0]), (None, a), (40, [-1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in data], S + ", cos double").select("id", "embedding", "cos")
    want = {(i, j) for i in range(1, 10) for j in range(i + 1, 10) if i <= 5 or (i, j) == (0, 0)} | {(min(i, 6), max(i, 6)) for i in range(1, 6)} | {(i, 20) for i in range(1, 6)}
    assert rows(vectors.near_pairs(df, 4)) == want
    assert vectors.near_pairs(df.limit(0), 4).count() == 0


def cliques(x, floor=0.75):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= floor
    out = set()
    for i in range(len(x)):
        c = np.nonzero(near[i])[0]
        if len(c) >= 3 and all((near[j] == near[i]).all() for j in c):
            out.add((i + 1, int(c[0]) + 1))
    return out


@pytest.mark.parametrize("options", [{}, {"per_shard": 150, "spread": 6, "part": 200}])
def test_clusters_against_brute_force(spark, rows, options):
    x = np.concatenate([people(3, n=500, spread=0.45), people(4, groups=60, n=150, spread=0.2)])
    got, want = rows(vectors.tight_clusters(frame(spark, x), 32, block=16, **options)), cliques(x)
    assert want and got == want


def test_pivots_cover_everything(spark, rows):
    x = people(5, n=400, spread=0.6)
    done, _ = vectors.pivot_clusters(frame(spark, x, [(900, None), (901, [0.0] * 32)]), 32, per_shard=100, spread=3)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = [tuple(r) for r in done.collect()]
    assert sorted(i for i, _, _ in got) == list(range(1, 401))
    assert all(u[i - 1] @ u[p - 1] >= 0.7499 for i, p, _ in got)


def test_describe(spark, rows):
    x = np.array([[1, 0, 0, 0], [0.9, 0.1, 0, 0], [0.9, -0.1, 0, 0], [0, 0, 1, 0]], np.float32)
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, cluster_id long")
    got = {r.cluster_id: (r.members, r.medoid, r.typical) for r in vectors.describe(m, frame(spark, x), 4, 2).collect()}
    assert got == {1: (3, 1, [1, 2]), 4: (1, 4, [4])}


def test_considered(spark):
    f = spark.createDataFrame([(1, 0, "HIGH"), (2, 0, " low-quality"), (3, 1, "HIGH"), (4, 0, None), (5, None, "HIGH")], "id long, not_person long, quality_tier string")
    assert {r.id for r in vectors.considered(f).collect()} == {1, 4}
    assert vectors.tight_clusters(spark.createDataFrame([], S), 4).count() == 0


def test_hot_vectors_are_folded_and_nothing_is_lost(spark, rows):
    """A third of all rows share one vector; only its first records are placed in shards."""
    x = people(6, n=300)
    x = np.concatenate([x, np.repeat(x[:1], 150, 0), np.repeat(x[5:6], 20, 0)])
    df = frame(spark, x)
    s = vectors.Shards(df, 32, 3000, 4, keep=6, hot=15)
    assert len(s.hot_keys) == 2 and sorted(map(len, s.kept)) == [6, 6] and s.twins(df).select("id").distinct().count() == 170 + 2 - 12
    assert rows(vectors.near_pairs(df, 32, hot=15)) == top_pairs(x)
    far = np.eye(32, dtype=np.float32)[:1] * np.ones((120, 1), np.float32)
    y = np.concatenate([people(4, groups=60, n=150, spread=0.2), far])
    assert rows(vectors.tight_clusters(frame(spark, y), 32, hot=15)) == cliques(y) >= {(i, 151) for i in range(151, 271)}


def test_second_level_of_pivots(spark):
    x = people(7, n=2000, groups=200)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = vectors.Shards(frame(spark, x), 32, 10, 4, flat=50)
    flat = vectors.Shards(frame(spark, x), 32, 10, 4)
    assert s.tops is not None and len(s.pivots) == 200
    assert np.mean([len(set(a) & set(b)) / 4 for a, b in zip(s.of(x).tolist(), flat.of(x).tolist())]) > 0.95


def test_members_settle_by_medoid(spark):
    """A vector near two pivots goes to the closer pivot first and then to the closer medoid; both clusters are touched."""
    ang = lambda *deg: np.array([[np.cos(np.radians(d)), np.sin(np.radians(d))] for d in deg], np.float32)
    x = ang(0, 1, 2, 40, 60, 80, 81, 82, 83)  # 40 degrees: 0.766 away
    done = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, 1, 0.766), (5, 5, 1.0), (6, 5, 0.94), (7, 5, 0.93), (8, 5, 0.93), (9, 5, 0.92)], "f long, pivot long, sim double")
    near = spark.createDataFrame([(4, 1, 0.766), (4, 5, 0.94), (1, 1, 1.0), (5, 5, 1.0)], "f long, to long, sim float")
    got = {r.f: r.pivot for r in vectors.settle(frame(spark, x), done, near, 2).collect()}
    assert got[4] == 1 and got[5] == 5  # the second cluster's medoid lies at 81 degrees, further than the first one's
    x = ang(0, 1, 2, 45, 60, 61, 62, 63, 64)
    assert {r.f: r.pivot for r in vectors.settle(frame(spark, x), done, near, 2).collect()}[4] == 5


def test_large_clusters_are_ranked_in_parts(spark, rows):
    x = people(8, n=200, groups=3)
    m = spark.createDataFrame([(i + 1, i % 3) for i in range(200)], "id long, cluster_id long")
    assert rows(vectors.ranked(m, frame(spark, x), 32, 3, block=10)) == rows(vectors.ranked(m, frame(spark, x), 32, 3))
