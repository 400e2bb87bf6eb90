"""Duplicate groups, their canonical copies and figures (G1, G2, J3, J4, J10, N4 on text, W6, A7-A9, A25, F17, O5, P21)."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.clean import content_hash
from kestrel.functions.numbers import hamming
from kestrel.operators.blocks import tie
from kestrel.operators.graph import components
from kestrel.session import cut

#: Most hashes of one band that a task compares with as many others; most edges of which a task keeps a forest.
BLOCK, EDGES = 32_768, 2_000_000


def near_hashes(hashes: DataFrame, most: int = 6, bits: int = 64, agree: int | None = None) -> DataFrame:
    """``(a, b, distance)`` of different 64-bit ``hash`` values at most ``most`` bits apart, a < b.

    Exact by pigeonhole: cut into ``most + agree`` bands, two such hashes agree in ``agree`` bands at least. Each
    choice of ``agree`` bands is a key; its bits follow the number of hashes, so that a key is shared by a few of
    them however many there are (the result does not depend on it). Every hash is taken once, however many files have it; a
    pair is kept under the first bands in which it agrees.
    """
    h = hashes.select("hash").where("hash IS NOT NULL").distinct()
    if agree is None:
        n = max(2, h.count())
        agree = next((a for a in (1, 2, 3) if bits * a / (most + a) >= math.log2(n) - 4), 4)
    bands = most + agree
    ends = [bits * k // bands for k in range(bands + 1)]
    band = lambda c, k: F.shiftrightunsigned(c, ends[k]).bitwiseAND(F.lit((1 << (ends[k + 1] - ends[k])) - 1))
    choices = list(itertools.combinations(range(bands), agree))
    keys = F.array(*[F.xxhash64(*[band(F.col("hash"), k) for k in c]) for c in choices])
    b = h.select("hash", F.posexplode(keys).alias("choice", "key"))
    x, y = b.alias("x"), b.alias("y")
    j = x.join(y, F.expr("x.choice = y.choice AND x.key = y.key AND x.hash < y.hash")).select(F.col("x.hash").alias("a"), F.col("y.hash").alias("b"), F.col("x.choice").alias("choice"))
    j = j.withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= most)
    same = F.filter(F.array(*[F.when(band(F.col("a"), k) == band(F.col("b"), k), k) for k in range(bands)]), lambda v: v.isNotNull())
    first = F.slice(same, 1, agree)
    table = F.array(*[F.array(*[F.lit(k) for k in c]) for c in choices])
    return j.where(F.element_at(table, F.col("choice") + 1) == first).select("a", "b", "distance")


def hash_links(hashes: DataFrame, most: int = 6, bits: int = 64, block: int = BLOCK) -> DataFrame:
    """``(hash, links, top)`` for the different values of ``hashes(hash)`` that have others at most ``most`` bits away.

    Exact by pigeonhole, as ``near_hashes``, but no pair leaves its task: hashes that share one of ``most + 1`` bands are
    compared in one array, a pair counts under the first band that it shares. There are rows of a hash for every band at most (and for
    every two blocks, where more than ``block`` hashes share a band): its ``links`` add up over them, and edges from ``hash``
    to ``top`` connect what near pairs connect. ``hashes`` is read several times. The work is the square of what shares a band.
    """
    bands = most + 1
    ends = [bits * k // bands for k in range(bands + 1)]
    masks = [np.uint64((1 << ends[k + 1]) - (1 << ends[k])) for k in range(bands)]
    keys = F.array(*[F.shiftrightunsigned("hash", ends[k]).bitwiseAND(F.lit((1 << (ends[k + 1] - ends[k])) - 1)) for k in range(bands)])
    b = hashes.select("hash", F.posexplode(keys).alias("band", "key"))
    split = b.groupBy("band", "key").agg(F.ceil(F.count("*") / block).cast("long").alias("parts")).where("parts > 1")
    b = b.join(F.broadcast(split), ["band", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))  # one row for each ``block`` of hashes and band at most
    own, other = F.pmod(F.xxhash64("hash"), "parts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    b = b.withColumn("own", own).withColumn("other", other).select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "hash")
    bins = max(1, hashes.count() * bands // 8192)

    def near(x: np.ndarray, y: np.ndarray, one: bool, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the near pairs whose first shared band is ``band``; of ``one`` array against itself each pair once."""
        size, s = max(65_536, len(y)), 0
        apart, far, good = np.empty(size, np.uint64), np.empty(size, np.uint8), np.empty(size, bool)
        while s < len(x) and (m := len(y) - (skip := s + 1 if one else 0)) > 0:
            e = min(len(x), s + size // m)
            n = (e - s) * m
            np.bitwise_xor(x[s:e, None], y[None, skip:], out=apart[:n].reshape(e - s, m))
            np.less_equal(np.bitwise_count(apart[:n], out=far[:n]), most, out=good[:n])
            at = np.flatnonzero(good[:n])
            for k in range(band):
                at = at[(apart[at] & masks[k]) != 0]
            r = at // m
            r, c = r + s, at - r * m + skip
            if one and e - s > 1:
                once = r < c
                r, c = r[once], c[once]
            if len(r):
                yield r, c
            s = e

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("band", "key", "i", "j", "own", "hash")])
        by = [t.column(c).to_numpy() for c in ("band", "key", "i", "j")]
        own, h = t.column("own").to_numpy(), t.column("hash").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in by], axis=0)]))
        out = []
        for s, e in zip(starts, [*starts[1:], len(h)]):
            x, links, top = h[s:e].view(np.uint64), np.zeros(e - s, np.int64), np.arange(e - s)
            one = by[2][s] == by[3][s]
            n = e - s if one else int((own[s:e] == by[2][s]).sum())
            shift = 0 if one else n
            for r, c in near(x[:n], x[shift:], one, int(by[0][s])):
                links += np.bincount(r, minlength=e - s) + np.bincount(c + shift, minlength=e - s)
                top = tie(top, r, c + shift)
            found = np.flatnonzero(links)
            out.append((h[s:e][found], links[found], h[s:e][top[found]]))
        return pa.table(dict(zip(("hash", "links", "top"), map(np.concatenate, zip(*out)))))

    b = b.withColumn("bin", F.pmod(F.xxhash64("band", "key", "i", "j"), F.lit(bins))).repartition(max(1, bins // 8), "bin")
    return b.groupBy("bin").applyInArrow(run, "hash long, links long, top long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = list(batches)
    a, b = (np.concatenate([x.column(k).to_numpy() for x in t] or [np.empty(0, np.int64)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = tie(np.arange(len(nodes)), at[:len(a)], at[len(a):])
    moved = np.flatnonzero(top != np.arange(len(nodes)))
    for s in range(0, len(moved), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved[s:s + 200_000]]), pa.array(nodes[top[moved[s:s + 200_000]]])], ["a", "b"])


def hash_classes(hashes: DataFrame, most: int = 6, block: int = BLOCK) -> DataFrame:
    """``(id, class_id, links)`` of every row of ``hashes(id, hash)``: its class (connected by hashes at most ``most`` bits
    apart; the smallest id), and to how many other hashes it is that near. A row alone is its own class; NULL hashes give none.
    """
    h = cut(hashes.where("hash IS NOT NULL").select("id", "hash").distinct())
    head = cut(h.groupBy("hash").agg(F.min("id").alias("first")))
    near = cut(hash_links(head.select("hash"), most, block=block))
    edges = near.where("hash <> top").select(F.col("hash").alias("a"), F.col("top").alias("b"))
    tied = components(edges.coalesce(max(1, -(-edges.count() // EDGES))).mapInArrow(_forest, "a long, b long")).withColumnRenamed("node", "hash")
    links = near.groupBy("hash").agg(F.sum("links").alias("links"))
    named = head.join(tied, "hash", "left").join(links, "hash", "left").withColumn("group_id", F.coalesce("group_id", "hash"))
    least = named.groupBy("group_id").agg(F.min("first").alias("class_id"))
    return h.join(named.join(least, "group_id").select("hash", "class_id", "links"), "hash").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def text_hashes(texts: DataFrame) -> DataFrame:
    """``(id, hash)`` of ``texts(id, text)``: 64-bit similarity hash of the words of each text.

    Every word, as often as it occurs, votes for the bits of the first half of its MD5; a bit is set when more than half of the votes
    are for it. Words are what stands between blanks, tabs and line ends, as written. NULL for texts without a word.
    """

    @F.pandas_udf("long")
    def simhash(text: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        flat, ends = [], [0]
        for t in text:
            words = t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if t else ()
            flat += [known.setdefault(w, len(known)) for w in words if w]
            ends.append(len(flat))
        bits = np.unpackbits(np.frombuffer(b"".join([hashlib.md5(w.encode()).digest()[:8] for w in known]), np.uint8)).reshape(-1, 64)
        at, votes = np.array(flat, np.int64), np.zeros((len(text), 64), np.int64)
        for v, first, end in zip(votes, ends, ends[1:]):
            for s in range(first, end, 65_536):
                v += np.add.reduce(bits[at[s:min(end, s + 65_536)]], 0, dtype=np.uint32)
        n = np.diff(ends)
        out = np.packbits(2 * votes > n[:, None], axis=1).view(">i8").ravel().astype(np.int64)
        return pd.Series(pd.arrays.IntegerArray(out, n == 0))

    return texts.select("id", simhash("text").alias("hash"))


def group_members(files: DataFrame, hashes: DataFrame | None = None, most: int = 6) -> DataFrame:
    """``(id, group_id)`` of files with equal contents or near hashes, groups of two or more; ``group_id`` is the smallest id.

    Contents are stars around their smallest file; files of one hash are a star too, and near hashes join stars, so
    the edges grow with files, not with pairs of copies. ``hashes(id, hash)`` is optional.
    """
    f = files.where("present = 1").select("id", content_hash("sha256").alias("c"))
    heads = f.where("c IS NOT NULL").groupBy("c").agg(F.min("id").alias("b"), F.max("id").alias("z")).where("b < z")
    exact = f.join(heads.select("c", "b"), "c").select(F.col("id").alias("a"), "b").where("a <> b")
    if hashes is None:
        tied = exact.select(F.col("a").alias("node"), F.col("b").alias("group_id"))
        return tied.unionByName(heads.select(F.col("b").alias("node"), F.col("b").alias("group_id"))).withColumnRenamed("node", "id").distinct()
    h = hashes.join(f.select("id"), "id", "left_semi").where("hash IS NOT NULL")
    head = h.groupBy("hash").agg(F.min("id").alias("b"))
    star = h.join(head, "hash").select(F.col("id").alias("a"), "b").where("a <> b")
    near = near_hashes(head, most)
    near = near.join(head.select(F.col("hash").alias("a"), F.col("b").alias("p")), "a").join(head.select(F.col("hash").alias("b"), F.col("b").alias("q")), "b").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b"))
    return components(exact.unionByName(star).unionByName(near)).withColumnRenamed("node", "id")


def candidates(files: DataFrame, dates: DataFrame, members: DataFrame | None = None, sidecars: DataFrame | None = None, media: DataFrame | None = None) -> DataFrame:
    """``(group, id, content, media_type, bytes, key)`` of the present files that belong to a group.

    The group is the content, or that of ``members(id, group_id)``. ``key`` orders the members of a group from the best
    (W6): most pixels (``media(file_id, width, height)``), largest, with a sidecar (``sidecars(file_id)``), with a date
    record, with a date, the earliest date, then path and id. Missing tables and values count as none.
    """
    f = files.where("present = 1").select("id", "rel_path", "size", "media_type", content_hash("sha256").alias("content"))
    d = dates.where("file_id IS NOT NULL").groupBy(F.col("file_id").alias("id")).agg(F.min("best_datetime").alias("dt"), F.lit(True).alias("dated"))
    f = f.join(d, "id", "left")
    f = f.join(sidecars.select(F.col("file_id").alias("id"), F.lit(True).alias("side")).distinct(), "id", "left") if sidecars is not None else f.withColumn("side", F.lit(False))
    if media is not None:
        f = f.join(media.groupBy(F.col("file_id").alias("id")).agg(F.max(F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))).alias("pixels")), "id", "left")
    else:
        f = f.withColumn("pixels", F.lit(0))
    f = f.join(members.select("id", "group_id"), "id").withColumn("group", F.col("group_id").cast("string")) if members is not None else f.where("content IS NOT NULL").withColumn("group", F.col("content"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    key = F.struct(
        (-F.coalesce("pixels", F.lit(0))).cast("long").alias("pixels"), (-F.coalesce("size", F.lit(0))).cast("long").alias("size"), no("side").alias("side"), no("dated").alias("dated"),
        F.col("dt").isNull().alias("undated"), F.coalesce("dt", F.lit("")).alias("dt"), F.col("rel_path").alias("path"), F.col("id").alias("id"),
    )
    return f.select("group", "id", "content", "media_type", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("bytes"), key.alias("key"))


def _parts(c: DataFrame) -> DataFrame:
    """Groups folded to their contents and media types: partial sums before the shuffle, so no group is ever together."""
    return c.groupBy("group", "content", "media_type").agg(F.min("key").alias("key"), F.min("id").alias("lo"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def groups(c: DataFrame) -> DataFrame:
    """One row per group of two or more candidates: ``(group, group_id, canonical_id, canonical_content, members,
    redundant_bytes, identical, visual, method)`` (G2, A25). ``identical`` and ``visual`` count the copies that have the
    canonical's content and those that don't. One scan, one aggregation in two steps, no window."""
    p = _parts(c).groupBy("group", "content").agg(F.min("key").alias("key"), F.min("lo").alias("lo"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    g = p.groupBy("group").agg(
        F.min("key").alias("key"), F.min_by("content", "key").alias("canonical_content"), F.min_by("n", "key").alias("same"), F.min("lo").alias("group_id"), F.sum("n").alias("members"), F.sum("bytes").alias("bytes"),
        (F.count("*") == 1).alias("one"),
    ).where("members > 1")
    identical = F.when(F.col("canonical_content").isNotNull(), F.col("same") - 1).otherwise(0)
    return g.select(
        "group", "group_id", F.col("key.id").alias("canonical_id"), "canonical_content", "members", (F.col("bytes") - F.greatest(-F.col("key.size"), F.lit(0))).alias("redundant_bytes"),
        identical.alias("identical"), (F.col("members") - 1 - identical).alias("visual"), F.when(F.col("one") & F.col("canonical_content").isNotNull(), "exact").otherwise("perceptual").alias("method"),
    )


def membership(c: DataFrame, grouped: DataFrame) -> DataFrame:
    """``(id, group_id, canonical_id, match_type)`` of every member: canonical, identical or visual."""
    g = grouped.select("group", "group_id", "canonical_id", "canonical_content")
    kind = F.when(F.col("id") == F.col("canonical_id"), "canonical").when(F.col("content") == F.col("canonical_content"), "identical").otherwise("visual")
    return c.select("group", "id", "content").join(g, "group").select("id", "group_id", "canonical_id", kind.alias("match_type"))


def hidden_flags(files: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, hidden)`` of every present file: 1 for the copies behind a canonical one."""
    copies = members.where("match_type <> 'canonical'").select("id", F.lit(1).alias("behind"))
    return files.where("present = 1").select("id").distinct().join(copies, "id", "left").select("id", F.coalesce("behind", F.lit(0)).alias("hidden"))


def summary(grouped: DataFrame, files: DataFrame) -> DataFrame:
    """Groups, copies behind canonical ones, their bytes, and files of one kind."""
    n = files.where("present = 1").agg(F.countDistinct("id").alias("files"))
    g = grouped.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("copies"), F.coalesce(F.sum("redundant_bytes"), F.lit(0)).alias("bytes"))
    return g.crossJoin(n).select("groups", "copies", "bytes", (F.col("files") - F.col("copies")).alias("unique_files"))  # one row each


def breakdown(c: DataFrame) -> DataFrame:
    """Copies and bytes by match and media type, and rolled up to each (A8). NULL media types are other."""
    p = cut(_parts(c))
    g = p.groupBy("group").agg(F.min("key").alias("best"), F.min_by("content", "key").alias("canonical_content"), F.sum("n").alias("members")).where("members > 1")
    own = (F.col("key") == F.col("best")).cast("long")  # the canonical is in this part
    m = p.join(g, "group").select(
        F.when(F.col("content") == F.col("canonical_content"), "identical").otherwise("visual").alias("match"), F.coalesce("media_type", F.lit("other")).alias("media_type"),
        (F.col("n") - own).alias("n"), (F.col("bytes") - own * F.greatest(-F.col("best.size"), F.lit(0))).alias("bytes"),
    ).where("n > 0")
    return m.cube("match", "media_type").agg(F.sum("n").alias("copies"), F.sum("bytes").alias("bytes"))


def pending(files: DataFrame, runs: DataFrame, root: int | None = None) -> DataFrame:
    """``(pending)``: present files that the last runs (``runs(root_id, covered_files)``) have not covered, 0 at least."""
    f, r = (files, runs) if root is None else (files.where(F.col("root_id") == root), runs.where(F.col("root_id") == root))
    n, m = f.where("present = 1").agg(F.count("*").alias("n")), r.agg(F.coalesce(F.sum("covered_files"), F.lit(0)).alias("m"))
    return n.crossJoin(m).select(F.greatest(F.lit(0), F.col("n") - F.col("m")).alias("pending"))  # one row each


LISTINGS = {"bytes": ["-redundant_bytes", "group_id"], "most": ["-members", "group_id"], "fewest": ["members", "group_id"]}


def listing(grouped: DataFrame, sort: str = "bytes", limit: int = 50, offset: int = 0, match: str | None = None) -> DataFrame:
    """A page of groups in one of three orders, the group last (O5); with ``match`` (identical or visual) only groups that hold
    such a copy (F17)."""
    if match:
        grouped = grouped.where(F.col(match) > 0)
    order = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in LISTINGS[sort]]
    return grouped.orderBy(*order).offset(offset).limit(limit)
