import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import blocks, browse, clusters, dups, entities, graph, matching, people, search
from kestrel.plans import edits, snapshots

FILE = "id long, root_id long, rel_path string, ext string, size long, mtime double, media_type string, fast_hash string, sha256 string, first_seen string, last_seen string, present long, hidden long"


def file(i, path=None, size=10, sha=None, present=1, hidden=0, kind="image", mtime=1.0, root=1):
    return (i, root, path or f"d/{i}.jpg", "jpg", size, mtime, kind, f"h{i}", sha, "s", "s", present, hidden)


@pytest.fixture
def files(spark):
    a, b = "a" * 64, "b" * 64
    return spark.createDataFrame([file(1, sha=a), file(2, sha=a.upper(), size=40), file(3, sha="sha256:" + a, present=0), file(4, sha=b, kind=None), file(5, sha=b, size=None), file(6), file(6), file(7, sha="")], FILE)


@pytest.fixture
def dates(spark):
    return spark.createDataFrame([(1, "2020-01-02T00:00:00", "exif", 0.9), (4, "2019-05", "manual", 1.0), (4, "2019-05", "manual", 1.0), (7, None, None, None)], "file_id long, best_datetime string, date_source string, date_confidence double")


def test_components_against_brute_force(spark, rows):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    parent = {v: v for e in edges for v in e}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    touched = {v for a, b in edges if a != b for v in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    assert rows(graph.components(df)) == {(v, top(v)) for v in touched}
    assert graph.components(df.limit(0)).count() == 0


def test_groups_and_figures(spark, rows, files, dates):
    f = browse.records(files)
    c = dups.candidates(f, dates)
    g = dups.groups(c)
    m = dups.membership(c, g)
    assert rows(m) == {(2, 1, 2, "canonical"), (1, 1, 2, "identical"), (4, 4, 4, "canonical"), (5, 4, 4, "identical")}
    assert rows(g.select("group_id", "members", "redundant_bytes", "method", "identical", "visual")) == {(1, 2, 10, "exact", 1, 0), (4, 2, 0, "exact", 1, 0)}
    s = dups.summary(g, f).first().asDict()
    assert s == {"groups": 2, "copies": 2, "bytes": 10, "unique_files": 4}
    assert rows(dups.hidden_flags(f, m)) == {(1, 1), (2, 0), (4, 0), (5, 1), (6, 0), (7, 0)}
    parts = dups.breakdown(c).where("match IS NOT NULL AND media_type IS NOT NULL").agg(F.sum("copies"), F.sum("bytes")).first()
    assert tuple(parts) == (s["copies"], s["bytes"])
    empty = f.limit(0)
    assert dups.groups(dups.candidates(empty, dates)).count() == 0
    # Near hashes tie 6 to the first content: its copies are identical or only look alike.
    hashes = spark.createDataFrame([(1, 0), (6, 1), (7, None)], "id long, hash long")
    c = dups.candidates(f, dates, members=dups.group_members(f, hashes))
    g = dups.groups(c)
    assert rows(g.select("group_id", "canonical_id", "members", "identical", "visual", "method")) == {(1, 2, 3, 1, 1, "perceptual"), (4, 4, 2, 1, 0, "exact")}
    assert rows(dups.membership(c, g).where("match_type = 'visual'").select("id")) == {(6,)}
    assert [r.group_id for r in dups.listing(g, match="visual").collect()] == [1]
    assert rows(dups.breakdown(c).where("media_type = 'image'").select("match", "copies")) == {("identical", 2), ("visual", 1), (None, 3)}


def test_near_hashes(spark, rows):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 60)]
    hs = base + [b ^ sum(1 << int(k) for k in rng.choice(64 - 1, n, replace=False)) for b, n in zip(base, [0, 1, 3, 6, 7, 8] * 10)] + [base[0]]
    want = {(min(a, b), max(a, b), bin((a ^ b) & (2**64 - 1)).count("1")) for a in set(hs) for b in set(hs) if a != b}
    got = rows(dups.near_hashes(spark.createDataFrame([(h,) for h in hs] + [(None,)], "hash long")))
    assert got == {w for w in want if w[2] <= 6}


def test_near_texts_take_every_document(spark, rows):
    import hashlib

    from kestrel import catalog

    def simhash(text):
        digits = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in re.findall(r"[^ \t\n\r]+", text or "")]
        h = sum(1 << k for k in range(64) if sum(1 if x >> k & 1 else -1 for x in digits) > 0)
        return (h - 2**64 if h >= 2**63 else h) if digits else None

    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: simhash(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    texts = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id AS id", "text").distinct()
    assert rows(dups.text_hashes(texts)) == set(docs.items())
    hs = sorted({h for h in docs.values() if h is not None})
    want = {(a, b, n) for i, a in enumerate(hs) for b in hs[i + 1:] if (n := ((a ^ b) & (2**64 - 1)).bit_count()) <= 6}
    assert len(hs) > 900 and rows(dups.near_hashes(dups.text_hashes(texts))) == want
    links = {h: sum(h in w[:2] for w in want) for h in hs}
    got = catalog.QUERIES["near_texts"](spark, d).collect()
    assert {(r.id, r.links) for r in got} == {(i, links[h]) for i, h in docs.items() if h is not None}
    of = {r.id: r.class_id for r in got}
    by_hash = {h: i for i, h in docs.items()}
    assert all(of[by_hash[a]] == of[by_hash[b]] for a, b, _ in want)


@pytest.mark.parametrize("block", [dups.BLOCK, 100])
def test_hash_classes_keep_no_pairs(spark, rows, monkeypatch, block):
    """Hashes that are nearly all alike: what is kept follows the hashes, not their pairs, however they are cut into blocks."""
    rng = np.random.default_rng(1)
    close = {(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))}
    chain = {(1 << 63) - 1 - ((1 << 5 * k) - 1) for k in range(4, 9)}
    hs = sorted(close | chain | {-1 - h for h in sorted(close)[:40]} | {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)})
    kept, cut = [], dups.cut
    monkeypatch.setattr(dups, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = dups.hash_classes(spark.createDataFrame([(i, h) for i, h in enumerate(hs)] + [(1000, hs[0]), (0, hs[0]), (1001, None)], "id long, hash long"), **({} if block == dups.BLOCK else {"block": block}))
    near = [[j for j, y in enumerate(hs) if i != j and ((x ^ y) & (2**64 - 1)).bit_count() <= 6] for i, x in enumerate(hs)]
    of = list(range(len(hs)))
    while any(of[i] > of[j] for i, js in enumerate(near) for j in js):
        of = [min([of[i], *(of[j] for j in js)]) for i, js in enumerate(near)]
    assert rows(got) == {(i, of[i], len(js)) for i, js in enumerate(near)} | {(1000, of[0], len(near[0]))}
    most = 7 * len(hs) * (1 if block == dups.BLOCK else 4)
    assert sum(map(len, near)) / 2 > 4 * most / (1 if block == dups.BLOCK else 4) and all(df.count() <= most for df in kept)


def test_visual_groups(spark, rows, files, dates):
    f = browse.records(files).where("id IN (1, 6, 7)")
    h = spark.createDataFrame([(1, 0), (6, 0x3F), (7, -1)], "id long, hash long")
    assert rows(dups.group_members(f, h)) == {(1, 1), (6, 1)}


def test_browse(spark, rows, files, dates):
    f = browse.records(files)
    assert browse.summary(f, dates).first().asDict() == {"files": 6, "bytes": 80, "enriched": 3, "date_min": "2019-05", "date_max": "2020-01-02T00:00:00"}
    assert rows(browse.date_sources(f, dates)) == {("exif", 1), ("manual", 1), ("unknown", 1), ("undated", 3)}
    assert [r.id for r in browse.page(browse.media(f, dates), "newest", 3).orderBy("at").collect()] == [1, 4, 2]
    seen = [r.id for k in range(0, 6, 2) for r in browse.page(browse.media(f, dates), "oldest", 2, k).orderBy("at").collect()]
    assert seen == [4, 1, 2, 5, 6, 7]
    m = browse.media(f, dates, holding=[dates.select("file_id")], lacking=[dates.where("date_source = 'exif'").select("file_id")])
    assert {r.id for r in m.collect()} == {4, 7}
    assert {r.id for r in browse.media(f, dates, period="2019", name="4 JPG").collect()} == {4}
    assert browse.summary(f.limit(0), dates.limit(0)).first()["files"] == 0


def test_entities(spark, rows):
    x = spark.createDataFrame([(1, 1, "cat", 0.9), (2, 1, "dog", 0.95), (3, 1, None, 0.99), (4, 2, "teddy bear", 0.5), (5, 2, "cat", None)], "id long, file_id long, species string, det_score double")
    assert rows(entities.majority_species(x, "file_id")) == {(1, "dog", 1), (2, "teddy bear", 1)}
    assert {r.id for r in entities.gallery(x).collect()} == {1, 2, 3, 5}
    assert rows(entities.best_per(x, "file_id").select("file_id", "id")) == {(1, 3), (2, 4)}
    c = entities.calibration(x, "det_score").first()
    assert c["n"] == 4 and abs(c["std"] - np.std([0.9, 0.95, 0.99, 0.5])) < 1e-12
    side = lambda y, n, p: {"lat": F.lit(y), "lon": F.lit(0.0), "member_count": F.lit(n), "pinned": F.lit(p)}
    lat = lambda a, b: spark.range(1).select(entities.merged_centre(a, b)["lat"]).first()[0]
    assert lat(side(0.0, 1, 0), side(3.0, 2, 0)) == 2.0 and lat(side(0.0, 1, 0), side(3.0, 2, 1)) == 3.0 and lat(side(1.0, 0, 0), side(3.0, 0, 0)) == 1.0


def test_relevance_cut(spark, rows):
    for scores in ([0.150, 0.140, 0.125, 0.080, 0.040], [0.090, 0.084, 0.075, 0.048, 0.024]):
        s = spark.createDataFrame(list(enumerate(scores, 1)), "vec_id long, score double")
        assert {r.vec_id for r in search.cut_relevance(s, 0.0, 0.8).collect()} == {1, 2, 3}
    assert search.cut_relevance(s, 0.5, 0.8).count() == 0


def test_scores(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<float>")
    got = {r.vec_id: round(r.score, 6) for r in search.score(v, [([1.0, 0.0], 0.0), ([0.0, 1.0], 0.1)]).collect()}
    assert got == {1: 1.0, 2: 0.9}


def test_knn_blocks_agree(spark, rows):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    one, many = (rows(search.exact_neighbours(v, 3, -1.0, b).select("a", "b")) for b in (1000, 13))
    assert one == many and len(one) == 180


def test_passages():
    text = ("A sentence here. " * 40 + "\n\n") * 6
    out = search.passages([(1, text), (None, " "), (2, "Last page.")])
    assert [p[0] for p in out] == list(range(len(out))) and all(len(p[3]) <= 1500 for p in out)
    assert out[0][1] == 1 and out[-1][2] == 2 and out[-1][3].endswith("Last page.")
    assert search.passages([]) == [] and search.passages([(None, " \n")]) == []
    solid = search.passages([(None, "x" * 5000)])
    assert "".join(p[3] for p in solid) == "x" * 5000 and max(len(p[3]) for p in solid) == 1500


def test_bm25_and_snippets(spark):
    c = spark.createDataFrame([(1, 1, 0, "Una cámara vieja"), (2, 1, 1, "cámara cámara"), (3, 2, 0, "nothing"), (4, 3, 0, None)], "id long, file_id long, ordinal long, text string")
    hits = search.bm25(c, "CAMARA")
    assert [r.id for r in hits.orderBy("score").collect()] == [2, 1]
    assert [r.id for r in search.best_passages(hits).collect()] == [2]
    assert search.bm25(c, "cam*").count() == 2 and search.bm25(c, "  ").count() == 0
    assert search.snippet("one two three cámara five", "camara", 3, ("[", "]")) == "…two three [cámara]…"
    assert {r.file_id: r.transcript for r in search.transcript(c).collect()}[1] == "Una cámara vieja\n\ncámara cámara"


def test_rules_in_one_picture(spark, rows):
    x = np.array([[1.0, 0], [0.99, 0.14], [0, 1], [0.1, 0.995], [0.7, 0.71]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert clusters.complete_link(x[:4], 0.9).tolist() == [0, 0, 1, 1] and people.average_link(x[:4], 0.9).tolist() == [0, 0, 2, 2]
    assert clusters.suppress(np.array([[0, 0, 10, 10], [1, 0, 10, 10], [50, 50, 5, 5.0]]), np.array([0.8, 0.9, 0.1])) == [1, 2]
    v = spark.createDataFrame([(i, 1, q, [float(z) for z in x[k]]) for i, q, k in ((1, 0.5, 0), (2, 0.9, 1), (3, None, 2))] + [(4, 1, 0.1, None), (5, 2, 0.1, [1.0, 0.0])], "id long, file_id long, quality double, embedding array<double>")
    assert rows(clusters.collapse(v, 2)) == {(2,), (3,), (4,), (5,)}
    f = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (2, 0, 1)], "file_id long, turns int, n int")
    p = spark.createDataFrame([(2, 0, 5.0), (2, 2, 9.0), (3, 0, 5.0), (3, 1, 5.5)], "file_id long, turns int, area double")
    assert rows(clusters.rotation(f, p)) == {(1, 1), (2, 2), (3, 0)}


B = "id long, file_id long, frame_offset double, box_x long, box_y long, box_w long, box_h long"


def test_boxes_found_again(spark, rows):
    old = spark.createDataFrame([(1, 1, None, 0, 0, 10, 10), (2, 1, None, 1, 0, 10, 10), (3, 1, 2.0, 0, 0, 10, 10), (4, 2, None, 0, 0, None, 10)], B)
    new = spark.createDataFrame([(7, 1, None, 1, 0, 10, 10), (8, 1, None, 0, 0, 10, 10), (9, 1, 2.0, 2, 0, 10, 10), (10, 2, None, 0, 0, 9, 10)], B)
    assert rows(matching.found_again(old, new).select("old_id", "new_id")) == {(1, 8), (2, 7), (3, 9)}
    got = matching.migrate(old.withColumn("name", F.concat(F.lit("n"), "id")), new.withColumn("name", F.lit(None).cast("string")), ["name"])
    assert rows(got.select("id", "name")) == {(7, "n2"), (8, "n1"), (9, "n3"), (10, None)}
    assert matching.found_again(old.limit(0), new).count() == 0


def test_matching_equals_taking_pairs_in_order(spark, rows):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)): int(w) for a, b, w in zip(rng.integers(0, 15, 90), rng.integers(0, 15, 90), rng.integers(0, 9, 90))}
    want, left, right = set(), set(), set()
    for w, a, b in sorted(((w, a, b) for (a, b), w in pairs.items()), reverse=True):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, w int")
    assert rows(matching.matched(df, "a", "b", F.struct("w", "a", "b")).select("a", "b")) == want


def test_nearest_blocks_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((70, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    v = blocks.pack(df, 6)
    q, m = v.where("id < 20"), v.where("id >= 20")
    want = {(i, int(j) + 20) for i in range(20) for j in np.argsort(-(u[20:] @ u[i]), kind="stable")[:4]}
    for block in (1000, 9):
        assert {(r.q, r.id) for r in blocks.nearest_of(q, m, 6, 4, block=block).collect()} == want
    g = v.withColumn("group", F.col("id") % 3)
    got = {r.group: np.frombuffer(r.v, np.float32) for r in blocks.means(g, 6).collect()}
    assert all(np.allclose(got[k], (c := u[k::3].mean(0)) / np.linalg.norm(c), atol=1e-5) for k in range(3))


def test_answers_are_folded_in_order(spark, rows):
    g = spark.createDataFrame([(i, i) for i in range(1, 9)], "id long, group long")
    said = [(1, 2, "same", 1), (2, 3, "same", 2), (1, 3, "different", 3), (4, 5, "same", 1), (5, 6, "same", 1), (6, 7, "same", 2), (4, 7, "different", 1), (8, 99, "same", 1)]
    a = spark.createDataFrame(said, "a long, b long, kind string, at int")
    assert rows(people.folded(g, a)) == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4), (7, 7), (8, 8)}
    assert rows(people.folded(g, a.limit(0))) == {(i, i) for i in range(1, 9)}


def test_borders_pass_over_what_must_stay_apart(spark, rows):
    x = np.array([[1.0, 0], [0.99, 0.14], [0, 1], [0.1, 0.995], [0.7, 0.72]], np.float32)
    v = blocks.pack(spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "id long, embedding array<float>"), 2)
    core = spark.createDataFrame([(0, 10), (1, 10), (2, 20), (3, 20)], "id long, group long")
    border = v.where("id = 4")
    assert rows(people.attached(border, core, v, 2, votes=2)) == {(4, 20)}
    cannot = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    assert rows(people.attached(border, core, v, 2, cannot((2, 4)), votes=2)) == {(4, 10)}
    assert rows(people.attached(border, core, v, 2, cannot((2, 4), (4, 0)), votes=2)) == set()


def test_persons_are_rebuilt(spark):
    """Three people, one of them split by tier, answers that join and keep apart, and names given by hand."""
    rng = np.random.default_rng(7)
    c = np.linalg.qr(rng.standard_normal((16, 16)))[0][:4]
    faces = []
    for k in range(40):
        p = k % 4
        v = c[p] + 0.06 * rng.standard_normal(16)
        tier = "HIGH" if k < 28 else ("borderline" if k < 36 else "low_quality")
        faces.append((k + 1, tier, 0, {1: "Ann", 5: "Ann", 9: "Ann", 2: "Bo"}.get(k + 1), [float(z) for z in v]))
    faces += [(100, "HIGH", 0, None, None), (101, "HIGH", 1, None, faces[0][4]), (102, "BORDERLINE", 0, "Zoe", [float(z) for z in rng.standard_normal(16)])]
    df = spark.createDataFrame(faces + faces[:3], "id long, quality_tier string, not_person long, manual_person string, embedding array<float>")
    t = lambda d: dt.datetime(2024, 1, d)
    links = spark.createDataFrame([(3, 4, "same", t(1)), (1, 3, "different", t(1)), (4, 3, "Same ", t(2))], "face_a long, face_b long, kind string, created_at timestamp")
    got = {r.face_id: (r.person_id, r.name) for r in people.persons(df, links, 16).collect()}
    assert {got[i] for i in range(1, 37) if i % 4 == 1} == {(1, "Ann")}
    assert got[2] == (2, "Bo") and got[6][0] == 6  # one shared face carries no name
    assert {got[i][0] for i in range(1, 37) if i % 4 in (3, 0)} == {3}
    assert not {37, 38, 39, 40, 100, 101} & got.keys() and got[102] == (102, "Zoe")
    assert people.persons(df.limit(0), links, 16).count() == 0


def test_absorb_in_order_is_stable():
    pts = [(i, 10 + i * 1e-4, 20.0) for i in range(1, 30)]
    whole, places = clusters.absorb_places(pts, [])
    half, state = clusters.absorb_places(pts[:11], [])
    rest, state = clusters.absorb_places(pts[11:], state)
    assert half + rest == whole and state == places


def test_pets(spark, rows):
    v = lambda *a: [float(z) for z in a]
    d = spark.createDataFrame([(1, "cat", v(1, 0)), (2, "cat", v(1, 0.01)), (3, "dog", v(0, 1)), (4, "dog", v(0.01, 1)), (5, "dog", v(1, 0)), (6, "teddy bear", v(1, 0)), (7, "cat", None), (8, "cat", v(0, 0)), (9, None, v(1, 0))], "id long, species string, embedding array<float>")
    assert rows(clusters.pets(d, 2)) == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_pets_do_not_depend_on_blocks(spark, rows):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12, 8))[rng.integers(0, 12, 600)] + 0.35 * rng.standard_normal((600, 8))
    x[::9] = x[0]
    kind = rng.choice(["cat", "dog"], 600)
    d = spark.createDataFrame([(i, str(k), [float(z) for z in v]) for i, (k, v) in enumerate(zip(kind, x))], "id long, species string, embedding array<double>")
    unit, want = x / np.linalg.norm(x, axis=1, keepdims=True), set()
    for k in ("cat", "dog"):
        groups = []
        for i in np.nonzero(kind == k)[0]:
            fits = [(round(float(s.mean()), 12), g) for g, m in enumerate(groups) if (s := unit[m] @ unit[i]).min() >= 0.75]
            groups[max(fits)[1]].append(i) if fits else groups.append([i])
        want |= {(int(i), int(g[0])) for g in groups if len(g) > 1 for i in g}
    assert rows(clusters.pets(d, 8, block=40)) == rows(clusters.pets(d, 8)) == want


def test_every_place_may_be_the_nearest(spark):
    from kestrel import catalog

    d = "/root/testdata/sf0.01"
    p = {r.id: (r.lat, r.lon) for r in catalog._points(spark, d).collect()}
    ids = np.array(sorted(p))
    lat, lon = np.radians(np.array([p[i] for i in ids])).T
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    m = 2 * 6_371_000 * np.arcsin(np.sqrt(np.minimum(1, h)))
    np.fill_diagonal(m, np.inf)
    want = {int(i): round(float(x), 3) for i, x in zip(ids, m.min(1)) if x <= 20_000}
    got = {r.id: r for r in catalog.QUERIES["nearest_other_place"](spark, d).collect()}
    assert got.keys() == want.keys() and {i % 2 for i in got} == {r.place_id % 2 for r in got.values()} == {0, 1}
    at = {int(i): k for k, i in enumerate(ids)}
    for i, r in got.items():
        assert abs(r.metres - want[i]) < 0.01 and abs(m[at[i], at[r.place_id]] - want[i]) < 0.01


def test_snapshots(spark, rows, files):
    f = browse.records(files)
    walk = spark.createDataFrame([(1, "d/1.jpg", 10, 1.0, "h1"), (1, "d/2.jpg", 41, 2.0, "n2"), (1, "new/a.jpg", 5, 99.5, "na"), (1, "new/b.jpg", 5, 1.0, "nb")], "root_id long, rel_path string, size long, mtime double, fast_hash string")
    todo, late = snapshots.to_read(walk.drop("fast_hash"), f, 100.0)
    assert {r.rel_path for r in todo.collect()} == {"d/2.jpg", "new/b.jpg"} and {r.rel_path for r in late.collect()} == {"new/a.jpg"}
    after = {r.rel_path: r for r in snapshots.rescan(f, walk, "now").collect()}
    assert after["d/1.jpg"].present == 1 and after["d/6.jpg"].present == 0 and after["d/2.jpg"].size == 41 and after["new/a.jpg"].id == 8 and after["new/b.jpg"].id == 9
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert rows(snapshots.upsert(old, new, "k")) == {(1, "a"), (2, "c"), (3, "d")}
    assert snapshots.stage_states({"enrich": 2, "dedup": 1}) == {"scan": "up_to_date", "enrich": "queued", "dedup": "blocked", "places": "up_to_date", "detect": "up_to_date", "semantic": "up_to_date", "text": "up_to_date"}
    assert not snapshots.dedup_owed(snapshots.coverage(f), snapshots.coverage(f)) and snapshots.dedup_owed(snapshots.coverage(f), snapshots.coverage(f.limit(0)))


def test_rewrite_keeps_reviews(spark, rows):
    s = "id long, file_id long, box_x long, box_y long, box_w long, box_h long, manual string"
    old = spark.createDataFrame([(1, 1, 0, 0, 5, 5, "Ana"), (2, 2, 0, 0, 5, 5, None)], s)
    new = spark.createDataFrame([(9, 1, 0, 0, 5, 5, None), (10, 1, 7, 7, 5, 5, None)], s)
    assert rows(snapshots.rewrite(old, new, ["manual"]).select("id", "manual")) == {(2, None), (9, "Ana"), (10, None)}


def test_edits(spark, rows):
    places = spark.createDataFrame([(1, 1, None, 0.0, 0.0, 1, 0), (2, 1, "Home", 3.0, 0.0, 2, 0), (3, 2, None, 0.0, 0.0, 1, 0)], "id long, root_id long, name string, lat double, lon double, member_count long, pinned long")
    members = spark.createDataFrame([(1, 10, "auto"), (2, 11, "auto"), (2, 12, "auto")], "place_id long, file_id long, source string")
    p, m, undo = edits.merge_places(places, members, 1, 2)
    assert rows(p.select("id", "lat", "member_count")) == {(2, 2.0, 3), (3, 0.0, 1)} and {r.place_id for r in m.collect()} == {2}
    p2, m2 = edits.unmerge_place(p, m, undo, spark.createDataFrame([(10,)], "file_id long"))
    assert rows(p2.select("id", "lat", "name")) == rows(places.select("id", "lat", "name")) and rows(m2) == rows(members)
    with pytest.raises(ValueError):
        edits.merge_places(places, members, 1, 3)
    faces = spark.createDataFrame([(1, 5, 7, 0, None, None), (2, 5, 7, 0, None, None), (3, 6, 7, 0, None, None)], "id long, file_id long, person_id long, not_person long, nonhuman_kind string, manual_person string")
    links = spark.createDataFrame([], "face_a long, face_b long, kind string, created_at timestamp")
    left, apart = edits.detach(faces, links, 7, 5, 3, "2026-01-01")
    assert rows(left.select("id", "person_id")) == {(1, None), (2, None), (3, 7)} and rows(apart.select("face_a", "face_b", "kind")) == {(1, 3, "different"), (2, 3, "different")}
    assert {r.nonhuman_kind for r in edits.hide_person(faces, 7, "statue").collect()} == {"statue"}
    with pytest.raises(ValueError):
        edits.hide_person(faces, 7, "nonsense")
    people = spark.createDataFrame([(1, None, 9), (2, "Ana", 1)], "id long, name string, face_count long")
    kept, kids, win = edits.merge(people, faces.withColumn("person_id", F.lit(1).cast("long")), "person_id", 1, 2, ["face_count"])
    assert win == 2 and {r.person_id for r in kids.collect()} == {2} and kept.count() == 1
    tags = edits.tag(edits.tag(spark.createDataFrame([], "entity_id long, name string, file_id long"), 1, "Ana", 5), 1, "Ana", 5)
    assert tags.count() == 1 and rows(edits.repair_tags(tags, people)) == {(2, "Ana", 5)} and edits.untag(tags, 1, 5).count() == 0
    assert rows(edits.recount(people, kids, "person_id", "face_count").select("id", "face_count")) == {(1, 0), (2, 3)}
    assert edits.link(links, 9, 4, "same", "2026-01-01").first()["face_a"] == 4
    assert dt.datetime(2026, 1, 1) == edits.link(links, 9, 4, "same", "2026-01-01").first()["created_at"]
