"""Visually identical text with different characters (problem 10).

Canonical spellings are held in a trie, by their look. A word is read by a weighted edit automaton over that trie in
which swapping look-alikes and skipping ignorable characters cost nothing and nothing else is allowed; a letter that
looks like several others has an arc for each, so the trie decides which one was meant. Of the spellings it reaches
the most frequent is the canonical one. Words that reach none, and signs, are normalised by the fold table.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut

#: Most spellings kept in the trie (the most frequent of words that occur in several spellings); the table handles the
#: rest, and differs only for letters of several looks. Documents of a class in one part of the join of its pairs.
VOCABULARY, PART = 200_000, 4096

#: Letters and signs that share a shape, each with its prototype.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "α": "a", "υ": "u", "κ": "k", "γ": "y", "ϲ": "c", "ϳ": "j", "χ": "x", "μ": "µ",
    # Armenian, Latin
    "օ": "o", "Օ": "O", "ս": "u", "Ս": "U", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "L", "ꞵ": "β",
    # Signs
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "⁃": "-", "˗": "-",
    "‘": "'", "’": "'", "‛": "'", "′": "'", "ʼ": "'", "ʹ": "'", "ˈ": "'", "“": '"', "”": '"', "‟": '"', "″": '"',
    "…": "...", "‚": ",", "∶": ":", "։": ":", "؛": ";", "⁄": "/", "∕": "/", "∗": "*", "‹": "<", "›": ">", "·": "•", "∙": "•", "⋅": "•",
}
#: Letters that look like several others; the first is what the table takes.
AMBIGUOUS = {"Ӏ": "Il", "ӏ": "lI", "ǀ": "lI", "∣": "lI", "׀": "lI", "ⵏ": "lI", "ן": "lI"}
#: Letters joined in one code point, beside those whose decomposition says so.
JOINED = range(0xFB00, 0xFB18)
JOINED_LATIN = {0x0132, 0x0133, 0x01C7, 0x01C8, 0x01C9, 0x01CA, 0x01CB, 0x01CC, 0x01C4, 0x01C5, 0x01C6, 0x01F1, 0x01F2, 0x01F3}


def _ignorable(c: str) -> bool:
    o = ord(c)
    return (unicodedata.category(c) == "Cf" and o not in (0x0600, 0x0601, 0x06DD)) or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F or 0xE0100 <= o <= 0xE01EF


@lru_cache(maxsize=65_536)
def fold_char(c: str) -> str:
    """Prototype of one character: "" for ignorable ones, a blank for any space, decomposed accents kept."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in AMBIGUOUS:
        return AMBIGUOUS[c][0]
    if _ignorable(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith(("<wide>", "<narrow>", "<font>")) or ord(c) in JOINED or ord(c) in JOINED_LATIN:
        parts = d.split()[1:] if d.startswith("<") else d.split()
        return "".join(fold_char(chr(int(x, 16))) for x in parts)
    n = unicodedata.normalize("NFD", c)
    return n if n == c else "".join(fold_char(x) for x in n)


class _Table(dict):
    def __missing__(self, o: int) -> str:
        v = self[o] = fold_char(chr(o))
        return v


TABLE = _Table()


def fold(text: str) -> str:
    """Prototype string by table: equal for texts that look the same, whatever the vocabulary."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(TABLE))


def looks(c: str) -> tuple[str, ...]:
    """What one character may be meant as, decomposed: its arcs in the automaton."""
    return tuple(AMBIGUOUS[c]) if c in AMBIGUOUS else (unicodedata.normalize("NFD", TABLE[ord(c)]),)


def coarse(word: str) -> str:
    """A look that all spellings share which the automaton can take for each other."""
    return fold(word).replace("I", "l")


#: A word: letters with marks and whatever may stand unseen between them. The same in Python and on the JVM.
WORD_CLASS = r"[\p{Lu}\p{Ll}\p{Lt}\p{Lo}\p{M}\p{Nl}\p{Cf}͏∣׀]+"
_WORD = regex.compile(WORD_CLASS)
_PURE = regex.compile(r"(?:[A-Za-zÀ-ɏ]+|[Ѐ-ӿ]+|[Ͱ-Ͽ]+)")


class Vocabulary:
    """Trie of canonical spellings, by their looks, and the zero-cost automaton over it."""

    __slots__ = ("root", "memo", "moved")

    def __init__(self, words: list[tuple[str, int]]):
        self.root: dict = {}
        self.memo: dict[str, str] = {}
        for w, n in words:
            node = self.root
            for c in unicodedata.normalize("NFD", fold(w)):
                node = node.setdefault(c, {})
            if "" not in node or node[""] < (n, w):
                node[""] = (n, w)
        # Plain ASCII words whose canonical spelling is another one: all that an ASCII text can change by.
        self.moved = {f: c for w, _ in words if (f := fold(w)).isascii() and (c := self.read(f)) != f}

    def read(self, word: str) -> str:
        """Canonical spelling of a word; words of one look give one result."""
        got = self.memo.get(word)
        if got is None:
            got = self.memo[word] = self._read(word)
        return got

    def _read(self, word: str) -> str:
        states = [self.root]
        for c in unicodedata.normalize("NFD", "".join(c for c in word if TABLE[ord(c)])):
            after = []
            for node in states:
                for look in looks(c):
                    at = node
                    for x in look:
                        at = at.get(x)
                        if at is None:
                            break
                    else:
                        after.append(at)
            states = after
            if not states:
                break
        best = max((node[""] for node in states if "" in node), default=None)
        return best[1] if best else fold(word)


def canonical(text: str, vocabulary: Vocabulary) -> str:
    """``text`` with every word in its canonical spelling, signs and spaces by the table: texts that look the same to a
    reader give the same result."""
    if text.isascii():
        moved = vocabulary.moved
        return _WORD.sub(lambda m: moved.get(m.group(), m.group()), text) if moved else text
    out, at = [], 0
    for m in _WORD.finditer(text):
        out.append(text[at:m.start()].translate(TABLE))
        out.append(vocabulary.read(m.group()))
        at = m.end()
    out.append(text[at:].translate(TABLE))
    return unicodedata.normalize("NFC", "".join(out))


def vocabulary_words(docs: DataFrame, size: int = VOCABULARY) -> list[tuple[str, int]]:
    """Spellings to choose from: pure ones (one script, no ignorables, no compatibility forms) of words that the corpus
    writes in several ways. Words are counted over all documents; only words with a look-alike spelling are brought
    here, ``size`` of them at most."""
    word = F.explode(F.regexp_extract_all("text", F.lit(WORD_CLASS), F.lit(0))).alias("w")
    counts = docs.where("text IS NOT NULL").select(word).groupBy("w").agg(F.count("*").alias("n"))

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = batch.column(0).to_pylist()
            folds = [fold(w) for w in ws]
            odd = [w != f or not AMBIGUOUS.keys().isdisjoint(w) for w, f in zip(ws, folds)]
            pure = [_PURE.fullmatch(w) is not None and AMBIGUOUS.keys().isdisjoint(w) for w in ws]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.replace("I", "l") for f in folds], pa.string()), pa.array(odd), pa.array(pure)], ["w", "n", "look", "odd", "pure"])

    seen = counts.mapInArrow(see, "w string, n long, look string, odd boolean, pure boolean")
    mixed = seen.groupBy("look").agg(F.count("*").alias("k"), F.max("odd").alias("odd")).where("k > 1 AND odd").select("look")
    top = seen.where("pure").join(mixed, "look", "left_semi").orderBy(F.desc("n"), "w").limit(size).collect()
    return [(r["w"], r["n"]) for r in top]


def keyed(docs: DataFrame, words: list[tuple[str, int]]) -> DataFrame:
    """``(doc_id, look, own)``: 128-bit hashes of the canonical and of the stored text; none for invisible texts. Equality of
    looks is decided by the canonical text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = Vocabulary(words)
        for batch in batches:
            ids, look, own = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = canonical(t, voc)
                if c.strip():
                    ids.append(i)
                    look.append(hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    own.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if len(voc.memo) > 500_000:
                voc.memo.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(look, pa.binary()), pa.array(own, pa.binary())], ["doc_id", "look", "own"])

    return docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, look binary, own binary")


def look_classes(docs: DataFrame, words: list[tuple[str, int]]) -> DataFrame:
    """One row per document whose look is stored in several ways: ``(doc_id, class_id, spelling_id, members)``.

    ``class_id`` is the smallest document of the look, ``spelling_id`` of the very same string, ``members`` counts the
    documents of the class. Linear in the input whatever the number of copies; aggregation is partial before the shuffle.
    """
    k = cut(keyed(docs, words).distinct())  # 40 bytes a document; read twice below
    spell = k.groupBy("look", "own").agg(F.min("doc_id").alias("spelling_id"), F.count("*").alias("n"))
    mixed = spell.groupBy("look").agg(F.min("spelling_id").alias("class_id"), F.sum("n").alias("members"), F.count("*").alias("s")).where("s > 1").drop("s")
    named = spell.drop("n").join(mixed, "look")
    return k.join(named, ["look", "own"]).select("doc_id", "class_id", "spelling_id", "members")


def same_look(docs: DataFrame, size: int = VOCABULARY, part: int = PART) -> DataFrame:
    """``(doc_a, doc_b)``, a < b: documents that look the same to a reader but are different strings.

    Width of forms, composed or combining accents, invisible characters, kinds of space and hyphen, joined letters
    and like-shaped letters or signs are no difference; an accent present or absent, case, digits, raised figures
    and wording are. NULL texts and texts without visible characters are no cases; equal strings give no pair;
    repeated rows count once; an empty table gives no rows; extra columns are ignored. Class rows come first
    (``look_classes``); pairs are listed from them with classes of more than ``part`` documents split into parts, so that no
    task lists a large class alone.
    """
    words = vocabulary_words(docs, size)
    c = cut(look_classes(docs, words)).withColumn("parts", F.ceil(F.col("members") / part).cast("int"))
    a = c.withColumn("p", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("a")
    b = c.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).alias("b")
    j = a.join(b, F.expr("a.class_id = b.class_id AND a.p = b.p AND a.spelling_id <> b.spelling_id AND a.doc_id < b.doc_id"))
    return j.select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"))


def canonical_text(docs: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """``docs`` with ``canonical``: every text in one consistent form (NULL stays NULL, blanks stay blank)."""
    words = vocabulary_words(docs, size)
    holder: list[Vocabulary] = []

    @F.pandas_udf("string")
    def run(texts):
        if not holder:
            holder.append(Vocabulary(words))
        return texts.map(lambda t: None if t is None else canonical(t, holder[0]))

    return docs.withColumn("canonical", run("text"))
