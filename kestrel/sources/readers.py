"""File walks and readers of documents (S1-S4, S10, S11, S13, S15-S22, S26, S27, F18, F21, J9). Readers are plain functions applied in Arrow batches."""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.paths import basename, extension, ignored, media_type

#: Extensions by reader, elements that are never shown, legacy formats that are refused.
FLAT, MARKUP, NOTEBOOK, OFFICE = {"txt", "md", "csv", "log"}, {"html", "htm", "mhtml", "xhtml"}, {"ipynb"}, {"docx", "pptx", "xlsx", "odt", "ods", "odp"}
MUTE = {"script", "style", "head", "noscript", "template"}
LEGACY = {"doc", "xls", "ppt"}
SAMPLE = 65_536
BLOCKS = T.StructType([T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())]))), T.StructField("error", T.StringType())])


def walk(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files under a folder that are not ignored: path, name, ext, media_type, size, mtime (and content).

    Without ``content`` only the listing is read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    f = f.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), *(["content"] if content else []))
    f = f.withColumn("name", basename(F.col("path"))).where(~ignored(F.col("name"))).withColumn("ext", extension(F.col("name")))
    return f.withColumn("media_type", media_type(F.col("ext")))


def fast_hash(content: Column, size: Column) -> Column:
    """SHA-256 of the size and both ends of a file, the second only beyond two samples."""
    tail = F.when(size > 2 * SAMPLE, F.expr(f"substring(content, -{SAMPLE}, {SAMPLE})")).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.encode(size.cast("string"), "utf-8"), F.substring(content, 1, SAMPLE), tail), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def decode(raw: bytes) -> str:
    """Text of bytes: by their byte order mark, else UTF-8, else Windows-1252 with replacement."""
    marks = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
    for mark, name in marks:
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


class _Shown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.mute, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.mute += tag in MUTE

    def handle_endtag(self, tag):
        if tag in MUTE and self.mute:
            self.mute -= 1

    def handle_data(self, data):
        if not self.mute and data.strip():
            self.parts.append(data.strip())


def markup_text(text: str) -> str:
    """What a browser would show, a line for each piece of text."""
    p = _Shown()
    p.feed(text)
    p.close()
    return "\n".join(p.parts)


def notebook_text(text: str) -> str:
    """Sources of a notebook's cells, without outputs."""
    cells = json.loads(text).get("cells", [])
    parts = ["".join(c.get("source", "")) if isinstance(c.get("source"), list) else c.get("source", "") for c in cells]
    return "\n\n".join(p for p in parts if p.strip())


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


#: Parts of each kind of office file in reading order: pattern of the part's name, whether each is a page of its own, the
#: elements that end a line, those whose text is shown, the element of a cell.
PARTS = {
    "docx": [(r"word/document\.xml", False, {"p"}, {"t"}, None), (r"word/(?:header|footer)\d*\.xml", False, {"p"}, {"t"}, None)],
    "pptx": [(r"ppt/slides/slide(\d+)\.xml", True, {"p"}, {"t"}, None)],
    "xlsx": [(r"xl/worksheets/sheet(\d+)\.xml", False, {"row"}, {"v", "t"}, "c")],
}


def part_lines(data: bytes, ends: set[str], shown: set[str], cell: str | None = None, strings: list[str] = ()) -> list[str]:
    """Lines of one XML part, read as a stream: shown text gathers until its cell or line ends. Cells of type ``s`` name a
    shared string; blank cells and lines are left out."""
    lines, row, piece = [], [], []
    for _, e in ElementTree.iterparse(io.BytesIO(data)):
        tag = _local(e)
        if tag in shown:
            piece.append(e.text or "")
        elif tag == "tab":
            piece.append("\t")
        elif tag == cell or tag in ends:
            text, piece = "".join(piece), []
            if tag == cell and e.get("t") == "s" and text.isdigit() and int(text) < len(strings):
                text = strings[int(text)]
            if text.strip():
                row.append(text)
            if tag in ends and row:
                lines.append("\t".join(row))
                row = []
    return lines


def office_blocks(z: zipfile.ZipFile, ext: str) -> list[tuple[int | None, str]]:
    """Blocks of a zipped office file: the body, then headers and footers (S18); a page for each slide (S19); the rows of each
    sheet (S20); or, of an open document, its styled runs, where there are none its bare paragraphs (S21)."""
    names, out = z.namelist(), []
    if ext not in PARTS:
        data = z.read("content.xml")
        lines = part_lines(data, {"p"}, {"span"}) or [t for e in ElementTree.fromstring(data).iter() if _local(e) == "p" and (t := (e.text or "").strip())]
        return [(None, "\n".join(lines))] if lines else []
    strings: list[str] = []
    if "xl/sharedStrings.xml" in names:
        strings = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    for shape, paged, ends, shown, cell in PARTS[ext]:
        own = [(int(m[1]) if m.groups() else 0, n) for n in names if (m := re.fullmatch(shape, n))]
        for k, (_, n) in enumerate(sorted(own), 1):
            if lines := part_lines(z.read(n), ends, shown, cell, strings):
                out.append((k if paged else None, "\n".join(lines)))
    return out


def read_document(raw: bytes | None, ext: str | None, most: int = 50_000_000) -> tuple[list[tuple[int | None, str]], str | None]:
    """(blocks, error) of one file by its extension."""
    ext = (ext or "").lower()
    if ext in LEGACY:
        return [], f"unsupported legacy format .{ext}"
    if ext not in FLAT | MARKUP | NOTEBOOK | OFFICE:
        return [], f"unsupported format .{ext}"
    if raw is None:
        return [], "no content"
    if len(raw) > most:
        return [], "media exceeds the size limit"
    try:
        if ext in OFFICE:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                blocks = office_blocks(z, ext)
        else:
            text = decode(raw)
            text = markup_text(text) if ext in MARKUP else notebook_text(text) if ext in NOTEBOOK else text
            blocks = [(None, text)] if text.strip() else []
        return blocks, None
    except Exception as e:  # an unreadable file is a result, not a failure of the job
        return [], f"unreadable: {type(e).__name__}"


@F.pandas_udf(BLOCKS)
def document_udf(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
    rows = [read_document(c, e) for c, e in zip(content, ext)]
    return pd.DataFrame({"blocks": [[{"page": p, "text": t} for p, t in b] for b, _ in rows], "error": [e for _, e in rows]})


def extract(files: DataFrame) -> DataFrame:
    """``(path, ext, blocks, error)`` of files with their content."""
    return files.withColumn("x", document_udf("content", "ext")).select("path", "ext", "x.blocks", "x.error")


def eligible(ext: Column, wanted: set[str] = frozenset({"documents"})) -> Column:
    """Whether a reader of the wanted kinds takes an extension."""
    exts = (FLAT | MARKUP | NOTEBOOK | OFFICE | {"pdf"} if "documents" in wanted else set()) | ({"jpg", "jpeg", "png", "tif", "tiff", "heic", "webp", "pdf"} if "ocr" in wanted else set())
    return F.lower(ext).isin(sorted(exts))


def looks_scanned(chars: Column, cover: Column) -> Column:
    """Whether a page is a picture of text."""
    return (chars < 40) & (cover >= 0.5)


def sidecar(text: Column) -> Column:
    """``struct<taken_time, lat, lon>`` of a sidecar's JSON; 0/0 is no place, the second place stands in."""
    v = F.call_function("try_parse_json", text)
    get = lambda p, t: F.call_function("try_variant_get", v, F.lit(p), F.lit(t))

    def place(p: str) -> Column:
        la, lo = get(f"$.{p}.latitude", "double"), get(f"$.{p}.longitude", "double")
        return F.when(la.isNotNull() & lo.isNotNull() & ~((la == 0) & (lo == 0)), F.struct(la.alias("lat"), lo.alias("lon")))

    g = F.coalesce(place("geoData"), place("geoDataExif"))
    return F.struct(get("$.photoTakenTime.timestamp", "string").try_cast("long").alias("taken_time"), g["lat"].alias("lat"), g["lon"].alias("lon"))


def match_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``(id, json, method, confidence)``: the sidecar of each file of a folder.

    Candidates by the rules of names first, the best rule winning; else the one sidecar whose base the file's name begins
    with, at least 20 characters or all of it. ``media(id, dir, name)``, ``sidecars(dir, json)``.
    """
    from pyspark.sql.window import Window

    from kestrel.functions.paths import sidecar_base, sidecar_names

    c = media.withColumn("c", F.explode(sidecar_names(F.col("name")))).select("id", "dir", "c.json", "c.method", "c.confidence", "c.rank")
    ruled = c.join(sidecars.select("dir", "json"), ["dir", "json"])
    best = ruled.groupBy("id").agg(F.min_by(F.struct("json", "method", "confidence"), "rank").alias("m")).select("id", "m.*")
    rest = media.join(best.select("id"), "id", "left_anti")
    base = sidecars.select("dir", "json", sidecar_base(F.col("json")).alias("base")).where("length(base) > 0")
    # Prefixes long enough to count, so that the join is by equality: the whole name or 20 characters and more.
    cut = F.explode(F.transform(F.sequence(F.least(F.lit(20), F.length("name")), F.length("name")), lambda n: F.substring(F.col("name"), 1, n)))
    p = rest.where("length(name) > 0").withColumn("base", cut).join(base, ["dir", "base"])
    p = p.withColumn("n", F.count("*").over(Window.partitionBy("id"))).where("n = 1")
    return best.unionByName(p.select("id", "json", F.lit("prefix").alias("method"), F.lit(0.7).alias("confidence")))
