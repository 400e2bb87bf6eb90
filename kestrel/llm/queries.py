"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.components import linked_faces
from kestrel.llm.leakage import leaked
from kestrel.llm.lookalike import LOOKALIKES, canonical_text, same_look
from kestrel.llm.pages import clean_pages, scan_faults
from kestrel.llm.survivor import records, survivors
from kestrel.llm.tokens import decode_corpus, encode_corpus
from kestrel.llm.vectors import considered, describe, near_pairs, tight_clusters
from kestrel.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = [
        near_pairs(table(spark, d, name, "id", "embedding"), width).select(F.lit(kind).alias("kind"), "id_a", "id_b")
        for kind, name, width in (("face", "faces", 128), ("animal", "animal_detections", 96))
    ]
    return out[0].unionByName(out[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    faces = considered(table(spark, d, "faces", "id", "embedding", "quality_tier", "not_person"))
    return tight_clusters(faces.select("id", "embedding"), 128).select(F.col("id").alias("face_id"), "cluster_id")


def p2_people(spark: SparkSession, d: str) -> DataFrame:
    """Each person with its number of faces and most typical faces."""
    faces = considered(table(spark, d, "faces", "id", "embedding", "quality_tier", "not_person")).select("id", "embedding")
    return describe(tight_clusters(faces, 128), faces, 128)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_faults(table(spark, d, "doc_chunk_fts"), table(spark, d, "doc_text"), table(spark, d, "documents", "text"))


def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    """The scanned chunks as clean paragraphs."""
    return clean_pages(table(spark, d, "doc_chunk_fts"), table(spark, d, "doc_text"), table(spark, d, "documents", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_faces(table(spark, d, "face_links"), table(spark, d, "faces", "id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(table(spark, d, "files"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each content, with every field fused."""
    return records(table(spark, d, "files"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text again from its ids."""
    return decode_corpus(p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look(table(spark, d, "documents", "doc_id", "text"))


def p10_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its canonical spelling."""
    return canonical_text(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "canonical")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_people, p4_found, p4_pages, p6_found, p7_found, p7_records, p8_ids, p8_text, p9_found, p10_found, p10_text)}

_USABLE = "len(embedding) = 128 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

_ONE = {k: v for k, v in LOOKALIKES.items() if len(v) == 1} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_WORDS = (
    "regexp_extract_all(lower(nfc_normalize(replace(replace(replace(replace(replace(translate(regexp_replace(text, '[\\x{ad}\\x{200b}-\\x{200f}\\x{2060}-\\x{2064}\\x{feff}\\x{fe00}-\\x{fe0f}\\x{34f}\\x{61c}\\x{202a}-\\x{202e}]', '', 'g'), "
    f"'{''.join(_ONE).replace(chr(39), chr(39) * 2)}', '{''.join(_ONE.values()).replace(chr(39), chr(39) * 2)}'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬁ', 'fi'), 'ﬂ', 'fl'))), '[\\p{{L}}\\p{{N}}]+')"
)

SQL: dict[str, str] = {
    "p9_found": f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT doc_id, array_to_string(w[k:k + 9], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d)),
ir AS (SELECT item_id, array_to_string(w[k:k + 9], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)""",
    "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_found": f"""
WITH f AS (SELECT DISTINCT id, embedding FROM faces WHERE not_person = 0
           AND (quality_tier IS NULL OR upper(regexp_replace(trim(quality_tier), '[ _-]+', '_', 'g')) <> 'LOW_QUALITY') AND {_USABLE}),
n AS (SELECT a.id AS id, list_sort(list(b.id)) AS around FROM f a JOIN f b ON list_cosine_similarity(a.embedding, b.embedding) >= 0.75 GROUP BY a.id)
SELECT unnest(ids) AS face_id, around[1] AS cluster_id FROM (SELECT around, list(id) AS ids FROM n GROUP BY around HAVING count(*) = len(around) AND count(*) >= 3)""",
    "p2_people": f"""
WITH f AS (SELECT DISTINCT id, embedding FROM faces WHERE not_person = 0
           AND (quality_tier IS NULL OR upper(regexp_replace(trim(quality_tier), '[ _-]+', '_', 'g')) <> 'LOW_QUALITY') AND {_USABLE}),
n AS (SELECT a.id AS id, list_sort(list(b.id)) AS around FROM f a JOIN f b ON list_cosine_similarity(a.embedding, b.embedding) >= 0.75 GROUP BY a.id),
c AS (SELECT unnest(ids) AS id, around[1] AS cluster_id FROM (SELECT around, list(id) AS ids FROM n GROUP BY around HAVING count(*) = len(around) AND count(*) >= 3)),
x AS (SELECT cluster_id, id, generate_subscripts(e, 1) AS pos, unnest(e) / sqrt(list_dot_product(e, e)) AS v FROM (SELECT cluster_id, id, embedding::double[] AS e FROM c JOIN f USING (id))),
m AS (SELECT cluster_id, list(s ORDER BY pos) AS m FROM (SELECT cluster_id, pos, sum(v) AS s FROM x GROUP BY ALL) GROUP BY 1),
r AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(list_cosine_similarity(embedding::double[], m), 6) DESC, id) AS r FROM c JOIN f USING (id) JOIN m USING (cluster_id))
SELECT cluster_id, count(*) AS members, min(id) FILTER (r = 1) AS medoid, list(id ORDER BY r) FILTER (r <= 3) AS typical FROM r GROUP BY 1""",
    "p6_found": """
WITH RECURSIVE latest AS (
  SELECT least(face_a, face_b) AS a, greatest(face_a, face_b) AS b,
         arg_max(lower(trim(kind)), row(created_at, CASE lower(trim(kind)) WHEN 'different' THEN 2 WHEN 'same' THEN 1 ELSE 0 END)) AS kind
  FROM face_links WHERE face_a <> face_b GROUP BY ALL),
e AS (SELECT a, b FROM latest WHERE kind = 'same' AND a IN (SELECT id FROM faces) AND b IN (SELECT id FROM faces)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT r.n, x.b FROM reach r JOIN both_ways x ON r.m = x.a)
SELECT n AS face_id, min(m) AS group_id FROM reach GROUP BY n""",
    "p7_found": r"""
WITH f AS (SELECT *, regexp_replace(lower(regexp_replace(sha256, '\s+', '', 'g')), '^(sha-?256[:=]|0x)', '') AS c FROM files WHERE present = 1),
g AS (SELECT c AS sha256, id, CASE WHEN size > 0 THEN size ELSE 0 END AS size, CASE WHEN hidden = 0 THEN 0 ELSE 1 END AS h,
             (ext IS NOT NULL AND trim(ext) <> '')::int + (coalesce(size, 0) > 0)::int + (fast_hash IS NOT NULL AND trim(fast_hash) <> '')::int AS n,
             CASE WHEN mtime > 0 AND NOT isnan(mtime) AND mtime < 1e17 THEN CASE WHEN mtime < 1e11 THEN round(mtime * 1e6) WHEN mtime < 1e14 THEN round(mtime * 1e3) ELSE mtime END ELSE -1 END AS m
      FROM f WHERE regexp_matches(c, '^[0-9a-f]{64}$'))
SELECT sha256, (array_agg(id ORDER BY h, n DESC, m DESC, id))[1] AS file_id, max(size)::bigint AS size
FROM g GROUP BY sha256 HAVING count(DISTINCT id) > 1""",
}
