"""Ranking by vectors and by words, and passages."""

from __future__ import annotations

import bisect
import itertools
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kestrel.functions.numbers import dot, norm
from kestrel.operators.blocks import nearest_of, pack, self_nearest

#: Constants of BM25 and least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


# --- Vectors ---------------------------------------------------------------------------------------------------


def _lit(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def score(vectors: DataFrame, queries: list[tuple[list[float], float]], centre: list[float] | None = None, text_centre: list[float] | None = None) -> DataFrame:
    """``(vec_id, score)``: cosine to the best of a few query vectors, each less its penalty (V1, V2).

    With centres, vectors are taken from the archive's and queries from the text's, which closes the gap between the
    two. Vectors of another width or of length zero have no score.
    """
    width = len(queries[0][0])
    v = vectors.where(F.size("embedding") == width)
    x = F.transform(F.arrays_zip(F.col("embedding"), _lit(centre)), lambda p: p["embedding"].cast("double") - p["1"]) if centre else F.col("embedding")
    v = v.select("vec_id", x.alias("x")).withColumn("n", norm(F.col("x"))).where("n > 0")
    best = []
    for q, penalty in queries:
        q = [a - b for a, b in zip(q, text_centre)] if text_centre else q
        length = sum(a * a for a in q) ** 0.5
        if length > 0:
            best.append(dot(F.col("x"), _lit([a / length for a in q])) / F.col("n") - F.lit(penalty))
    if not best:
        return v.select("vec_id", F.lit(0.0).alias("score")).where("false")
    return v.select("vec_id", (F.greatest(*best) if len(best) > 1 else best[0]).alias("score"))


def cut_relevance(scored: DataFrame, least: float, relative: float) -> DataFrame:
    """Scores over an absolute floor, then over a share of the best one where that is positive.

    The best score is one row, joined as such: no window gathers all rows in one task.
    """
    kept = scored.where(F.col("score") >= least)
    best = kept.agg(F.max("score").alias("best"))
    return kept.crossJoin(F.broadcast(best)).where((F.col("best") <= 0) | (F.col("score") >= relative * F.col("best"))).drop("best")


def similar(vectors: DataFrame, vec_id: int, query: list[float], k: int = 8) -> DataFrame:
    """The ``k`` vectors nearest to one that is stored, itself left out."""
    return score(vectors.where(F.col("vec_id") != vec_id), [(query, 0.0)]).orderBy(F.desc("score"), "vec_id").limit(k)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Mean unit vector of each group at length one: ``(by, centroid, members)`` (A21). Sums are partial before the shuffle."""
    n = norm(F.col("embedding"))
    v = vectors.select(by, F.transform("embedding", lambda x: x.cast("double") / n).alias("u"))
    m = v.select(by, F.posexplode("u")).groupBy(by, "pos").agg(F.avg("col").alias("m"), F.count("*").alias("n"))
    c = m.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"), F.max("n").alias("members")).select(by, F.col("c.m").alias("c"), "members")
    return c.select(by, F.transform("c", lambda x: x / (norm(F.col("c")) + 1e-9)).alias("centroid"), "members")


def centroid_pairs(cents: DataFrame, by: str, answered: DataFrame | None = None, least: float = 0.45) -> DataFrame:
    """Pairs of groups whose centroids are alike and about which no answer ``(a, b)`` exists.

    Compared in blocks of 512 groups a side, so that neither side is sent to all tasks.
    """
    n = max(1, cents.count() // 512 + 1)
    c = cents.select(F.col(by).alias("id"), "centroid").withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = c.withColumn("other", other).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "centroid")

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        a, b = pdf[pdf.own == key[0]], pdf[pdf.own == key[1]]
        s = np.stack(a.centroid.to_numpy()) @ np.stack(b.centroid.to_numpy()).T if len(a) and len(b) else np.zeros((len(a), len(b)))
        r, c = np.nonzero(s >= least)
        out = pd.DataFrame({"a": a.id.to_numpy()[r], "b": b.id.to_numpy()[c], "score": s[r, c]})
        return out[out.a < out.b] if key[0] == key[1] else pd.DataFrame({"a": out[["a", "b"]].min(axis=1), "b": out[["a", "b"]].max(axis=1), "score": out.score})

    pairs = rows.groupBy("i", "j").applyInPandas(block, "a long, b long, score double")
    return pairs.join(answered.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti") if answered is not None else pairs


def exact_neighbours(vectors: DataFrame, k: int = 5, least: float = 0.75, block: int = 16_384) -> DataFrame:
    """``(a, b, score)``: the ``k`` nearest of every vector by block products (V4); see ``blocks``."""
    width = vectors.where("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()
    if width is None:
        return vectors.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), F.lit(0.0).alias("score")).where("false")
    v = pack(vectors.select(F.col("vec_id").alias("id"), "embedding"), width["n"])
    return self_nearest(v, width["n"], k, least, block).select(F.col("q").alias("a"), F.col("id").alias("b"), "score")


def nearest_members(queries: DataFrame, members: DataFrame, width: int, k: int, least: float = -1.0) -> DataFrame:
    """``(q, id, score)``: of ``members(id, embedding)`` the ``k`` nearest to every one of ``queries(id, embedding)``."""
    return nearest_of(pack(queries, width), pack(members, width), width, k, least)


def mutual(neighbours: DataFrame) -> DataFrame:
    """Pairs that are among each other's neighbours, a < b."""
    back = neighbours.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return neighbours.join(back, ["a", "b"], "left_semi").where("a < b").select("a", "b")


# --- Words -----------------------------------------------------------------------------------------------------

_MARKS = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿšžåăąćčďęěğłńňőřśşťţůűźż"
_BARE = "aaaaaaaeeeeeiiiiioooooouuuuuncyyszaaaccdeegłnnorssttuuzz"


def bare(c: Column) -> Column:
    """Lower case without the diacritics of Latin letters, composed or combining."""
    return F.regexp_replace(F.translate(F.lower(c), _MARKS, _BARE), r"\p{Mn}+", "")


def terms(c: Column) -> Column:
    return F.regexp_extract_all(bare(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str) -> list[tuple[str, bool]]:
    """(term, whether its beginning is enough) of a typed query; all must occur."""
    return [(m.group(1), bool(m.group(2))) for m in re.finditer(r"([^\W_]+)(\*?)", query.lower())]


def bm25(passages: DataFrame, query: str) -> DataFrame:
    """``(id, file_id, ordinal, score)`` of the passages that hold all terms; a smaller score is better.

    Statistics are over all passages, before any filter. The text is scanned once into term counts and a length; nothing
    but matching passages is shuffled, and the corpus figures are a single row.
    """
    asked = query_terms(query)
    if not asked:
        return passages.select("id", "file_id", "ordinal", F.lit(0.0).alias("score")).where("false")
    t = passages.select("id", "file_id", "ordinal", terms(F.coalesce("text", F.lit(""))).alias("t"))
    plain = lambda w: "".join(_BARE[_MARKS.index(ch)] if ch in _MARKS else ch for ch in w)

    def count(w: str, prefix: bool) -> Column:
        w = plain(w)
        return F.size(F.filter("t", (lambda x: x.startswith(w)) if prefix else (lambda x: x == w)))

    c = t.select("id", "file_id", "ordinal", F.size("t").alias("len"), *[count(w, p).alias(f"f{k}") for k, (w, p) in enumerate(asked)])
    total = c.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(asked))])
    hits = c.where(" AND ".join(f"f{k} > 0" for k in range(len(asked)))).crossJoin(F.broadcast(total))
    parts = []
    for k in range(len(asked)):
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5)))
        parts.append(idf * F.col(f"f{k}") * (K1 + 1) / (F.col(f"f{k}") + K1 * (1 - B + B * F.col("len") / F.col("mean"))))
    return hits.select("id", "file_id", "ordinal", (-sum(parts[1:], parts[0])).alias("score"))


def postings(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The word index as two tables to be kept: ``(term, id, tf)`` and ``(id, file_id, ordinal, len)`` (X2). One scan of the text;
    a row for each passage and term."""
    t = passages.select("id", "file_id", "ordinal", terms(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf")), t.select("id", "file_id", "ordinal", F.size("t").alias("len"))


def bm25_index(index: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """``bm25`` over kept ``postings``: reads the query's terms only (an index written by term is pruned to them)."""
    asked = query_terms(query)
    if not asked:
        return lengths.select("id", "file_id", "ordinal", F.lit(0.0).alias("score")).where("false")
    plain = lambda w: "".join(_BARE[_MARKS.index(ch)] if ch in _MARKS else ch for ch in w)
    is_ = [F.col("term").startswith(plain(w)) if p else F.col("term") == plain(w) for w, p in asked]
    hit = index.where(reduce(lambda a, b: a | b, is_))
    per = hit.groupBy("id").agg(*[F.sum(F.when(c, F.col("tf")).otherwise(0)).alias(f"f{k}") for k, c in enumerate(is_)])
    df = per.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(asked))])
    total = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    hits = per.where(" AND ".join(f"f{k} > 0" for k in range(len(asked)))).join(lengths, "id").crossJoin(F.broadcast(df)).crossJoin(F.broadcast(total))
    score = [F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5))) * F.col(f"f{k}") * (K1 + 1) / (F.col(f"f{k}") + K1 * (1 - B + B * F.col("len") / F.col("mean"))) for k in range(len(asked))]
    return hits.select("id", "file_id", "ordinal", (-reduce(lambda a, b: a + b, score)).alias("score"))


def snippets(hits: DataFrame, passages: DataFrame, query: str, marks: tuple[str, str] = ("\x02", "\x03")) -> DataFrame:
    """``hits`` with the ``snippet`` of their passage."""

    @F.pandas_udf("string")
    def cut_out(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippet(t or "", query, marks=marks))

    return hits.join(passages.select("id", "text"), "id").withColumn("snippet", cut_out("text")).drop("text")


def text_page(passages: DataFrame, files: DataFrame, dates: DataFrame, query: str, sort: str = "relevance", limit: int = 120, offset: int = 0) -> DataFrame:
    """A page of a text search end to end: the best passage of each visible file with its snippet, and the ``total`` of files
    (X5, J18, O2)."""
    from kestrel.operators.details import ranked_hits

    best = best_passages(bm25(passages, query))
    rows = ranked_hits(best, files, dates, sort)
    total = best.join(files.where("present = 1 AND hidden = 0").select(F.col("id").alias("file_id")), "file_id", "left_semi").agg(F.countDistinct("file_id").alias("total"))
    return snippets(rows.offset(offset).limit(min(limit, 500)), passages, query).crossJoin(F.broadcast(total))


def best_passages(ranked: DataFrame) -> DataFrame:
    """The best passage of each file: score, then place in the file."""
    w = Window.partitionBy("file_id").orderBy("score", "ordinal")
    return ranked.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def snippet(text: str, query: str, most: int = 12, marks: tuple[str, str] = ("\x02", "\x03"), gap: str = "…") -> str:
    """The window of at most twelve words with most different terms, the first of equal ones, with the hits marked."""
    import unicodedata

    flat = lambda w: "".join(ch for ch in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(ch))
    asked = [(flat(w), p) for w, p in query_terms(query)]
    spans = [(m.start(), m.end(), flat(m.group())) for m in re.finditer(r"[^\W_]+", text or "")]
    hit = [next((k for k, (w, p) in enumerate(asked) if (t.startswith(w) if p else t == w)), None) for _, _, t in spans]
    if not spans:
        return ""
    start = max(range(max(1, len(spans) - most + 1)), key=lambda s: (len({h for h in hit[s:s + most] if h is not None}), -s))
    end, out, at = min(len(spans), start + most), [], spans[start][0]
    for k in range(start, end):
        a, b, _ = spans[k]
        out += [text[at:a], marks[0] + text[a:b] + marks[1] if hit[k] is not None else text[a:b]]
        at = b
    return (gap if start else "") + "".join(out) + (gap if end < len(spans) else "")


def transcript(chunks: DataFrame) -> DataFrame:
    """``(file_id, transcript)``: the passages of each file in order, an empty line between.

    A file's text is one value by definition; passages repeated exactly count once.
    """
    c = chunks.where("id IS NOT NULL").dropDuplicates(["id"]).where("text IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "id", "text")))
    return c.groupBy("file_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("transcript"))


# --- Passages --------------------------------------------------------------------------------------------------

#: Where a passage may end, the best kind first, and the least share of the target it may have.
_ENDS = (re.compile(r"\n\s*\n"), re.compile("[.!?;:]['\"’”)\\]]?\\s"), re.compile(r"\s"))
_LEAST = 0.75
PASSAGE = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("page_first", T.IntegerType()), T.StructField("page_last", T.IntegerType()), T.StructField("text", T.StringType())]))


def _boundaries(text: str) -> list[list[int]]:
    """Where a passage may end, sorted, for each kind of end."""
    return [[m.end() for m in kind.finditer(text)] for kind in _ENDS]


def _between(ends: list[int], low: int, high: int, last: bool) -> int | None:
    """The last (or first) of the sorted ``ends`` over ``low``, up to ``high``."""
    i, j = bisect.bisect_right(ends, low), bisect.bisect_right(ends, high)
    return None if i == j else ends[j - 1 if last else i]


def passages(blocks: list[tuple[int | None, str]], target: int = 1200, overlap: int = 200, cap: int = 1500) -> list[tuple[int, int | None, int | None, str]]:
    """(ordinal, first page, last page, text) of the overlapping passages of a file's (page, text) blocks.

    A passage ends at the last paragraph end that leaves it between three quarters of ``target`` and ``target``
    characters, or at the first one after up to ``cap``; failing that at a sentence, then any white space, then at the
    cap. The next one begins ``overlap`` characters back, at a word. All ends are found once; each passage is a few
    searches among them.
    """
    kept = [(p, t) for p, t in blocks if t and t.strip()]
    text = "\n\n".join(t for _, t in kept)
    first = list(itertools.accumulate((len(t) + 2 for _, t in kept), initial=0))
    kinds, size, begin, out = _boundaries(text), len(text), 0, []
    blanks = [m.start() for m in re.finditer(" ", text)]
    while begin < size:
        end = size
        if size - begin > cap:
            tries = (_between(e, begin + low, begin + high, last) for e in kinds for low, high, last in ((int(target * _LEAST), target, True), (target, cap, False)))
            end = next((e for e in tries if e), begin + cap)
        if body := text[begin:end].strip():
            pages = [kept[k][0] for k in range(bisect.bisect_right(first, begin) - 1, bisect.bisect_left(first, end, 0, len(kept))) if kept[k][0] is not None]
            out.append((len(out), min(pages, default=None), max(pages, default=None), body))
        if end == size:
            break
        word = _between(blanks, max(end - overlap, begin + 1) - 1, end - 1, False)
        begin = end if word is None else word + 1
    return out


@F.pandas_udf(PASSAGE)
def passage_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("ordinal", "page_first", "page_last", "text"), p)) for p in passages([(None, t)])] if t else [])


def chunk(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Passages of every document, whole texts; blank ones have none."""
    return docs.select(key, F.explode(passage_udf(F.coalesce("text", F.lit("")))).alias("p")).select(key, "p.*")
