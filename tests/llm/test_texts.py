import base64
import os
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kestrel.llm import leakage, lookalike, pages, tokens

PATH = f"{tokens.tokenizer_dir()}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(PATH), reason="no public vocabulary here")


# --- Tokens -------------------------------------------------------------------------------------------------


def reference():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab eth\n'1оф京😀-=", max_size=200)))
def test_tokens_equal_reference(text):
    a, e = tokens.automaton(PATH), _REF.setdefault("e", None) or _REF.update(e=reference()) or _REF["e"]
    text = text.encode("utf-8", "replace").decode()
    ids = a.encode(text)
    assert ids == e.encode_ordinary(text) and a.decode(ids) == text


_REF: dict = {}


@needs_vocabulary
def test_table_holds_what_the_gadgets_leave():
    import random

    a, r = tokens.automaton(PATH), random.Random(3)
    some = r.sample(sorted(a.label), 400)
    pairs = [(x, y) for x in some for y in some] + [p for g in r.sample(sorted(a.gadgets), 2000) for p in (g, g[::-1])]
    assert all(a.arc(x, y) == a._open(x, y, 1 << 40) for x, y in pairs)
    assert not any(a.arc(x, y) for x, y in a.gadgets)
    assert all(p < q for first, end in a.row.values() for p, q in zip(a.cut_to[first:end], a.cut_from[first + 1:end]))


@needs_vocabulary
def test_token_table(spark):
    long = "word " * 50_000 + "a" * 20_000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "<|endoftext|> hello", 0), (3, "<|endoftext|> hello", 0), (4, long, 0)], "doc_id long, text string, ids int")
    got = tokens.encode_corpus(df)
    by = {r.doc_id: r.ids for r in got.collect()}
    e = reference()
    assert got.count() == 5 and by[1] == by[2] == [] and by[3] == e.encode_ordinary("<|endoftext|> hello") and by[4] == e.encode_ordinary(long)
    assert {r.doc_id: r.text for r in tokens.decode_corpus(got).collect()}[4] == long
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# --- Look-alikes --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("a, b", [("café", "café"), ("paper", "раper"), ("ｆｕｌｌ １２", "full 12"), ("ﬁn", "fin"), ("a\u200bb\u00ad", "ab"), ("a\u00a0b", "a\u3000b"), ("x‑y", "x-y"), ("Kelvin", "Kelvin"), ("й", "й"), ("…", "..."), ("о́", "ó")])
def test_same_look(a, b):
    assert lookalike.fold(a) == lookalike.fold(b)


@pytest.mark.parametrize("a, b", [("café", "cafe"), ("A", "a"), ("m²", "m2"), ("1", "l"), ("0", "O"), ("a b", "ab"), ("x—y", "x-y"), ("the", "thе end")])
def test_other_look(a, b):
    assert lookalike.fold(a) != lookalike.fold(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_fold_is_stable(text):
    f = lookalike.fold(text)
    assert lookalike.fold(f) == f
    assert lookalike.fold(unicodedata.normalize("NFD", text)) == f


def test_vocabulary_reads_through_look_alikes():
    v = lookalike.Vocabulary([("paper", 9), ("сад", 5), ("cад", 1)])
    assert v.read("раpe\u200br") == "paper" and v.read("сад") == "сад" and v.read("ｑｑ") == "qq"
    assert lookalike.canonical("раper\u00a0 x", v) == "paper  x"


def test_automaton_decides_letters_of_several_looks(spark, rows):
    """The trie reads a bar-shaped letter as l or I by the word; the table alone has one reading and loses pairs."""
    texts = ["a light INDEX", "a Ӏight ӀNDEX", "a ӏight ӏNDEX"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    assert rows(lookalike.same_look(d)) == {(1, 2), (1, 3), (2, 3)}
    assert len({lookalike.fold(t) for t in texts}) == 3 == len({lookalike.canonical(t, lookalike.Vocabulary([])) for t in texts})


def test_large_class_is_split(spark, rows):
    d = spark.createDataFrame([(i, "pa" + "\u200b" * (i % 3) + "per") for i in range(40)], "doc_id long, text string")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 != b % 3}
    assert rows(lookalike.same_look(d, part=4)) == want == rows(lookalike.same_look(d))


def test_pairs(spark, rows):
    d = spark.createDataFrame([(1, "the paper", 0), (2, "the раper", 0), (3, "the paper", 0), (4, "the Paper", 0), (5, None, 0), (6, "", 0), (7, "\u200b ", 0), (8, " ", 0), (9, "the pa\u200bper", 0), (2, "the раper", 0)], "doc_id long, text string, look int")
    assert rows(lookalike.same_look(d)) == {(1, 2), (2, 3), (1, 9), (2, 9), (3, 9)}
    assert lookalike.same_look(d.limit(0)).count() == 0
    got = {r.doc_id: r.canonical for r in lookalike.canonical_text(d).collect()}
    assert got[1] == got[2] == got[9] == "the paper" and got[5] is None


# --- Leaks --------------------------------------------------------------------------------------------------

ITEM = "If the vineyard is crowded then Rurrumo must answer whether Baluifield or Belaxo received the afternoon of 1986. Which drawer did Fenmbetta mention?"


def test_leaks(spark, rows):
    ten = "then Rurrumo must answer whether Baluifield or Belaxo received the"
    docs = [(1, f"Before. THEN rurrumo; must\nanswer — whether Baluifield (or) Belaxo received the! After", 0), (2, f"x {ten.rsplit(' ', 1)[0]} y", 0), (3, ten.replace("a", "а"), 0), (4, "lorem " * 3000 + ITEM + " ipsum" * 3000, 0), (5, None, 0), (6, "", 0), (7, "received Belaxo or the answer must whether Rurrumo then Baluifield", 0), (1, f"Before. {ten}", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, "too short to leak"), (12, None), (13, "Which other drawer did nobody ever mention in all of the long years since then?")], "item_id long, text string")
    assert rows(leakage.leaked(d, items)) == {(1, 10), (3, 10), (4, 10)}
    assert rows(leakage.leaked(d, items, item_chars=10)) == {(1, 10), (3, 10), (4, 10)}
    assert leakage.leaked(d.limit(0), items).count() == 0 and leakage.leaked(d, items.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=3, max_size=14), min_size=1, max_size=12), st.lists(st.sampled_from("abcdefghz"), max_size=40))
def test_retrieval_loses_nothing(items, doc):
    index = leakage.ItemIndex([(k, " ".join(w)) for k, w in enumerate(items)], run=3)
    grams = {tuple(doc[s:s + 3]) for s in range(len(doc) - 2)}
    want = {k for k, w in enumerate(items) if any(tuple(w[s:s + 3]) in grams for s in range(len(w) - 2))}
    assert set(index.leaks(" ".join(doc))) == want


# --- Scanned pages ------------------------------------------------------------------------------------------

TITLE = "Orchard Lorounova Print"
CLEAN = ["There is half a page about the narrow shoebox that somebody developed", "The light at the lighthouse made each umbrella look careful and well-lit", "carried the photograph slowly"]


def test_page_marks():
    marks = {"— 12 —": 12, "[3]": 3, "7.": 7, "298": 298, "Page 14": 14, "Seite 2": 2, "- 1 -": 1, "iv": 4, "xii": 12}
    assert {t: pages.page_mark(t)[1] for t in marks} == marks
    assert all(pages.page_mark(t) is None for t in ("in 1962.", "a", "word", "12 copies", "", "civilian"))


def chunk_table(spark):
    one = "\n".join([TITLE, "", "There is half a pagc about the narrow shoe-", "box that somebody developed.", "", "1962", "", "The light at the liqhthouse made each umbrella look well-", "lit and carcful. It was car¬", "— 1 —"])
    two = "\n".join(["Orchord Lorounova Print   — 2 —", "", "ried slowly. The pre- and post-war lists, the photo\u00ad", "", "— 3 —", TITLE, "graph of an umbrella.", "— 4 —"])
    rows = [(1, 5, 0, 1, 1, one), (1, 5, 0, 1, 1, one), (2, 5, 1, 2, 4, two), (3, 6, 0, None, None, "Half a page.\n1\n" + TITLE), (4, 7, 0, None, None, None), (5, 8, 0, None, None, one), (6, 9, None, None, None, "")]
    return spark.createDataFrame(rows, "id long, file_id long, ordinal long, page_first long, page_last long, text string")


def texts_table(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    return spark.createDataFrame([(5, "plain", None, t(1)), (5, "pdf-ocr", 0.7, t(2)), (6, "plain", None, t(2)), (7, "ocr", 0.5, t(1)), (9, "ocr", 0.5, None)], "file_id long, extractor string, confidence double, extracted_at timestamp")


def test_faults(spark, rows):
    corpus = spark.createDataFrame([(t,) for t in CLEAN * 60], "text string")
    got = rows(pages.scan_faults(chunk_table(spark), texts_table(spark), corpus, pairs=1))
    assert got == {
        (1, 1, "running", ""), (1, 3, "misread", "page"), (1, 3, "hyphen", "shoebox"), (1, 8, "misread", "lighthouse"), (1, 8, "hyphen", "well-lit"), (1, 9, "misread", "careful"), (1, 10, "page_number", ""),
        (2, 1, "running", ""), (2, 1, "misread", "orchard"), (2, 3, "hyphen", "photograph"), (2, 5, "page_number", ""), (2, 6, "running", ""), (2, 8, "page_number", ""),
    }
    empty = chunk_table(spark).limit(0)
    assert pages.scan_faults(empty, texts_table(spark)).count() == 0


def test_paragraphs(spark):
    corpus = spark.createDataFrame([(t,) for t in CLEAN * 60], "text string")
    got = {r.chunk_id: r.text for r in pages.clean_pages(chunk_table(spark), texts_table(spark), corpus, pairs=1).collect()}
    assert got[1].startswith("There is half a page about the narrow shoebox that somebody developed.\n\n1962") and "lighthouse" in got[1] and "well-lit and careful." in got[1]
    assert got[2].endswith("the photograph of an umbrella.") and "Orch" not in got[2] and got[6] == ""


def test_context_decides_what_a_line_is():
    """Capitalised words without an end, said once: a running title beside a page number, text inside a paragraph, though
    the features of the line are the same and alone speak for a title."""
    m = pages.LineModel()
    text, title, number = (0, 0, 0, 2, 2), (0, 1, 0, 2, 2), (2, 4, 0, 2, 2)
    assert m.label([text, text, None, number, title, None, text])[3:5] == [pages.NUMBER, pages.RUNNING]
    assert m.label([text, text, text, title, text, text])[3] == pages.BODY
    assert max(range(4), key=m._cost(title).__getitem__) == pages.RUNNING


def test_confusions_are_learned(spark):
    words = ["calendar", "umbrella", "suitcase", "thunderstorm", "lighthouse", "photograph", "negative", "musician"]
    counts = spark.createDataFrame([(w, 100) for w in words] + [("pagcd", 1)], "word string, n long")
    seen = [w.replace("e", "c", 1) for w in words if "e" in w] + [w.replace("m", "rn", 1) for w in words if "m" in w] + ["zzzzz", "1962"]
    got = pages.learn_confusions(spark.createDataFrame([(w,) for w in seen], "word string"), counts, 2)
    assert {(r, s) for r, s, _ in got} == {("e", "c"), ("m", "rn")} and all(0 < w <= 1 for *_, w in got)
    assert pages.learn_confusions(counts.select("word").limit(0), counts) == []


def test_every_confusion_is_learned(spark):
    """Many confusions that each have their pairs and share: none of them is left out."""
    import hashlib

    letters = "abcdefghijklmnopqrstuvwxyz"
    code = lambda r, s, k: hashlib.md5(f"{r}{s}{k}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:14]
    made = [(r, s, code(r, s, k)) for r in letters for s in letters if r != s for k in range(2)]
    counts = spark.createDataFrame([(c[:7] + r + c[7:], 100) for r, _, c in made], "word string, n long")
    got = pages.learn_confusions(spark.createDataFrame([(c[:7] + s + c[7:],) for _, s, c in made], "word string"), counts)
    assert {(r, s) for r, s, _ in got} == {(r, s) for r in letters for s in letters if r != s} and len(got) == 650
    assert all(pages.candidates("qqq" + s, got)["qqq" + r][0] == 1 for r, s, _ in got)


def test_blocks_see_their_neighbours(spark, rows, monkeypatch):
    """A file longer than a block: titles and numbers are known as such by the chunks around."""
    chunks = [(k, 5, k, k, k, f"Orchard Lorounova\nThe light at the lighthouse number {k}.\n{k + 1}") for k in range(40)]
    df = spark.createDataFrame(chunks, "id long, file_id long, ordinal long, page_first long, page_last long, text string")
    whole = rows(pages.scan_faults(df, texts_table(spark)))
    assert {(c, k) for c, _, k, _ in whole} == {(c, k) for c in range(40) for k in ("running", "page_number")}
    monkeypatch.setattr(pages, "CHUNKS", 4)
    monkeypatch.setattr(pages, "CONTEXT", 2)
    assert rows(pages.scan_faults(df, texts_table(spark))) == whole


def test_character_model_prefers_likely_names(spark):
    words = spark.createDataFrame([(w, 1) for w in ("norinosund", "norinoville", "torisund", "koriville", "orinomouth", "sundville", "a1")], "word string, n long")
    names = pages.Names(pages.name_grams(words))
    assert names.score("norisund") > names.score("norlsund") + 2
    conf = [("m", "rn", 1.0), ("e", "c", 0.5)]
    assert pages.candidates("rnaleta", conf)["maleta"] == (1, 1.0) and pages.candidates("pagc", conf)["page"] == (1, 0.5) and pages.candidates("rnagc", conf)["mage"] == (2, 0.5)
