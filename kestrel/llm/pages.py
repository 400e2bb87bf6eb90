"""Noise in text from scanned pages (problem 4).

The lines of a file are labelled by a hidden Markov model (body, running title, page number, break). What it observes
of a line are several layout features (what number it holds and whether that counts on, how it is capitalised and
ended, whether the file says it again, where on the page it stands, whether the text before it stopped), each with a
distribution of its own in every state; these and the transitions are re-estimated on the files themselves. Words broken
across lines are joined over the furniture between, and misread words are restored by a noisy channel: confusions that
are learned by aligning unknown words with frequent ones, against word counts of all clean text, and a character model
for names that no clean text has. Paragraphs are then reassembled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut

BODY, RUNNING, NUMBER, BREAK = range(4)

#: Words that follow a hanging hyphen ("pre- and post-war") without continuing the word.
LINKING = {"and", "or", "y", "e", "o", "u", "und", "oder", "et", "ou", "bis", "to", "a", "и", "или"}
#: Files are read in blocks of so many chunks, with so many of their neighbours on either side as context, about so many
#: chunks in a group; files the line model is fitted on; gain in log likelihood that lets the character model change an
#: unknown word.
CHUNKS, CONTEXT, GROUPED, FIT_FILES, GAIN = 64, 16, 256, 400, 6.0
#: Learning confusions: least letters and count of the frequent word, least pairs of words that show a confusion and least
#: share of all pairs.
LETTERS, FREQUENT, PAIRS, SHARE = 5, 20, 2, 0.0004

_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_HYPHEN = "-¬\u00ad‐‑"
_TAIL = re.compile(rf"([^\W_]+(?:-[^\W_]+)*)([{_HYPHEN}])\s*$")
_PAGE = re.compile(r"(?P<a>[-—–(\[])?\s?(?P<n>\d{1,5}|[ivxlc]{1,7}|[IVXLC]{1,7})\s?(?P<b>[-—–)\].])?")
_WORD_PAGE = re.compile(r"[^\W\d_]{1,8}\.?\s(?P<n>\d{1,5})")


def _roman(s: str) -> int:
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s.lower()]
    return sum(-x if x < max(v[k:]) else x for k, x in enumerate(v))


def page_mark(s: str) -> tuple[str, int] | None:
    """(style, number) of a text that may be only a page number: bare, between signs, or after one short word."""
    if m := _WORD_PAGE.fullmatch(s):
        return "word", int(m["n"])
    m = _PAGE.fullmatch(s)
    if not m:
        return None
    n, before, after = m["n"], m["a"] or "", m["b"] or ""
    if n.isdigit():
        return before + "9" + after, int(n)
    return None if after == "." else (before + "i" + after, _roman(n))


_GAP = re.compile(r"\s{2,}|\t|\s[|·•]\s")
_NO_TITLE = ".,;:!?»\"" + _HYPHEN


_LABEL = re.compile(r"[^\W\d_]\S*: .*\S")


def title_parts(s: str) -> tuple[str, tuple[str, int] | None] | None:
    """(title, page mark) of a line that is shaped like a running title, with or without a page number beside it."""
    parts, mark = [s], None
    if _GAP.search(s):
        parts = [p for p in _GAP.split(s) if p]
    elif s[-1] in _NO_TITLE or s.count(" ") > 6:
        return None
    if len(parts) == 2:
        a, b = page_mark(parts[0]), page_mark(parts[1])
        if bool(a) == bool(b):
            return None
        mark, parts = a or b, [parts[1] if a else parts[0]]
    if len(parts) != 1:
        return None
    t = parts[0].strip()
    w = t.split()
    if not 1 <= len(w) <= 7 or t[-1] in _NO_TITLE or re.search(r"[.,;!?]\s", t) or not (t[0].isupper() or t[0].isdigit()):
        return None
    named = _LABEL.fullmatch(t) is not None
    raised = sum(x[0].isupper() or x[0].isdigit() for x in w)
    if named or (len(w) >= 2 and raised == len(w) and any(c.isalpha() for c in t)):
        return t, mark
    return None


def alike(lines: dict[int, str]) -> dict[str, list[int]]:
    """Lines grouped by what they say: equal but for case and signs, or differing in a fifth of their letters at most."""
    groups: dict[str, list[int]] = defaultdict(list)
    for k, t in lines.items():
        groups[re.sub(r"\W+", " ", t.lower()).strip()].append(k)
    by_len: dict[tuple[int, int], list[str]] = defaultdict(list)
    for key in sorted(groups, key=lambda x: (-len(groups[x]), x)):
        size, n = key.count(" "), len(key)
        host = next((h for d in (0, 1, -1, 2, -2, 3, -3) for h in by_len[size, n + d] if SequenceMatcher(None, h, key, autojunk=False).ratio() >= 0.8), None) if n >= 8 else None
        if host is None:
            by_len[size, n].append(key)
        else:
            groups[host] += groups.pop(key)
    return groups


def _chain(marks: list[tuple[int, str, int]]) -> set[int]:
    """Lines of page numbers that count up: for each style the longest run of marks that rise by small steps."""
    best: set[int] = set()
    for style in {s for _, s, _ in marks}:
        own = [(k, n) for k, s, n in marks if s == style]
        length, back = [1] * len(own), [-1] * len(own)
        for j in range(len(own)):
            for i in range(max(0, j - 12), j):
                if 1 <= own[j][1] - own[i][1] <= j - i + 1 and length[i] + 1 > length[j]:
                    length[j], back[j] = length[i] + 1, i
        if own:
            j = max(range(len(own)), key=lambda j: length[j])
            run = set()
            while j >= 0:
                run.add(own[j][0])
                j = back[j]
            if len(run) >= 2:
                best |= run
    return best


#: Features of a line and how many values each has.
#: number: none; bare, between signs, after a word, each first where it doesn't count on and then where it does; bare with four
#: or more digits where it doesn't count on.
#: shape: prose; capitalised words without an end; the same beside a page number; a label and what it names; one word; other short.
#: again: said once, more often. edge: first or last of the chunk, next to those, elsewhere.
#: flow: after a blank line or none, after a line that ends its sentence, after one that doesn't.
SIZES = {"number": 8, "shape": 6, "again": 2, "edge": 3, "flow": 3}


def observe(chunks: list[str]) -> tuple[list[tuple[int, int, str]], list[tuple[int, ...] | None]]:
    """Lines (chunk, line number, text) of a file's chunks in order, and the features of each, None for blank ones."""
    lines, edge = [], {}
    for c, text in enumerate(chunks):
        own = text.split("\n")
        full = [k for k, s in enumerate(own) if s.strip()]
        base = len(lines)
        for place, k in enumerate(full):
            edge[base + k] = min(place, len(full) - 1 - place, 2)
        lines += [(c, k + 1, s) for k, s in enumerate(own)]
    marks, titles, number = [], {}, {}
    for k, (_, _, s) in enumerate(lines):
        t = s.strip()
        if not t:
            continue
        if m := page_mark(t):
            marks.append((k, *m))
            number[k] = 3 if m[0] == "word" else 2 if m[0][0] in "-—–[(" else 1
        elif p := title_parts(t):
            titles[k] = p
    again = {k for v in alike({k: t for k, (t, _) in titles.items()}).values() if len(v) > 1 for k in v}
    marks += [(k, *m) for k, (_, m) in titles.items() if m]
    marks.sort()
    chain = _chain(marks)
    seen = []
    for k, (c, _, s) in enumerate(lines):
        t = s.strip()
        if not t:
            seen.append(None)
            continue
        words = t.split()
        if k in titles:
            shape = 2 if titles[k][1] else 3 if _LABEL.fullmatch(titles[k][0]) else 1
        else:
            shape = 4 if len(words) == 1 else 5 if len(words) < 4 else 0
        before = lines[k - 1][2].rstrip() if k and lines[k - 1][0] == c else ""
        flow = 0 if not before or edge.get(k) == 0 and k - 1 not in edge else 1 if before[-1] in ".!?:»\"" else 2
        n = number.get(k, 0)
        held = 2 * n - (k not in chain) if n else 0
        seen.append((7 if held == 1 and sum(map(str.isdigit, t)) > 3 else held, shape, int(k in again), edge[k], flow))
    return lines, seen


class LineModel:
    """Hidden Markov model of lines whose states emit several features at once.

    The prior says what the states mean; fitting re-estimates every table by Viterbi training with the prior as
    pseudo-counts. Blank lines are breaks, and breaks are blank.
    """

    PRIOR = {
        #           none  bare  bare+  sign  sign+  word  word+ year
        "number": [[0.98, 5e-3, 1e-4, 2e-4, 1e-4, 4e-3, 5e-4, 8e-3], [0.996, 5e-4, 5e-4, 5e-4, 5e-4, 1e-3, 1e-3, 1e-4], [1e-4, 0.06, 0.45, 0.07, 0.27, 0.02, 0.13, 2e-4]],
        #          prose title  +mark label  one   short
        "shape": [[0.93, 4e-3, 5e-5, 3e-3, 0.02, 0.043], [2e-4, 0.53, 0.37, 0.09, 5e-4, 1e-3], [1e-4, 1e-4, 1e-4, 1e-4, 0.45, 0.55]],
        "again": [[0.998, 2e-3], [0.25, 0.75], [0.998, 2e-3]],
        "edge": [[0.08, 0.08, 0.84], [0.50, 0.10, 0.40], [0.50, 0.10, 0.40]],
        "flow": [[0.20, 0.25, 0.55], [0.55, 0.20, 0.25], [0.55, 0.20, 0.25]],
    }
    #        body  running number break
    MOVE = [[0.80, 0.03, 0.03, 0.14], [0.45, 0.02, 0.18, 0.35], [0.40, 0.25, 0.02, 0.33], [0.85, 0.07, 0.07, 0.01]]
    START = [0.55, 0.2, 0.2, 0.05]

    def __init__(self):
        self._set({f: np.array(t) for f, t in self.PRIOR.items()}, np.array(self.MOVE))
        self.start = np.log(np.array(self.START))

    def _set(self, emit: dict[str, np.ndarray], move: np.ndarray) -> None:
        self.emit = [np.log(t / t.sum(1, keepdims=True)) for t in emit.values()]
        self.move = np.log(move / move.sum(1, keepdims=True))
        self.memo: dict = {}

    def _cost(self, o: tuple[int, ...] | None) -> list[float]:
        got = self.memo.get(o)
        if got is None:
            got = self.memo[o] = [-1e9, -1e9, -1e9, 0.0] if o is None else [*sum(t[:, v] for t, v in zip(self.emit, o)).tolist(), -1e9]
        return got

    def label(self, seen: list[tuple[int, ...] | None]) -> list[int]:
        """The most probable states of a sequence of lines."""
        if not seen:
            return []
        move = self.move.T.tolist()
        v, back = [a + b for a, b in zip(self.start.tolist(), self._cost(seen[0]))], []
        for o in seen[1:]:
            now, best = [], []
            for m, e in zip(move, self._cost(o)):
                reach = [a + b for a, b in zip(v, m)]
                top = max(reach)
                now.append(top + e)
                best.append(reach.index(top))
            back.append(best)
            v = now
        path = [v.index(max(v))]
        for b in reversed(back):
            path.append(b[path[-1]])
        return path[::-1]

    def fit(self, sequences: list[list], rounds: int = 4, weight: float = 200.0) -> LineModel:
        for _ in range(rounds):
            emit = {f: weight * np.array(t) for f, t in self.PRIOR.items()}
            move = weight * np.array(self.MOVE)
            for seen in sequences:
                path = self.label(seen)
                np.add.at(move, (path[:-1], path[1:]), 1)
                at = np.array([(s, *o) for s, o in zip(path, seen) if o is not None], int).reshape(-1, 1 + len(emit))
                for f, t in enumerate(emit.values()):
                    np.add.at(t, (at[:, 0], at[:, f + 1]), 1)
            self._set(emit, move)
        return self


class Names:
    """Character 4-gram model, for words that no clean text has. ``grams``: how often two to four characters in a row begin
    or continue the different words (``name_grams``)."""

    def __init__(self, grams: dict[str, int]):
        self.grams, self.heads = grams, Counter()
        for g, n in grams.items():
            self.heads[g[:-1]] += n

    def score(self, w: str) -> float:
        s, total = f"\x02\x02{w}\x03", 0.0
        for k in range(2, len(s)):
            p = 1 / 60
            for n in (1, 2, 3):
                if k >= n:
                    h = self.heads.get(s[k - n:k], 0)
                    p = (self.grams.get(s[k - n:k + 1], 0) + 4 * p) / (h + 4)
            total += math.log(p)
        return total


def name_grams(counts: DataFrame) -> dict[str, int]:
    """Counts of character sequences over all words of ``counts(word)`` without digits; their number is bounded by the alphabet."""
    s = counts.where(~F.col("word").rlike(r"\p{Nd}")).select(F.concat(F.lit("\x02\x02"), "word", F.lit("\x03")).alias("s"))
    g = s.select("s", F.explode(F.sequence(F.lit(3), F.length("s"))).alias("k")).select(F.explode(F.array(*[F.expr(f"CASE WHEN k > {n} THEN substring(s, k - {n}, {n + 1}) END") for n in (1, 2, 3)])).alias("g"))
    return {r["g"]: r["n"] for r in g.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n")).collect()}


def learn_confusions(types: DataFrame, counts: DataFrame, pairs: int = PAIRS) -> list[tuple[str, str, float]]:
    """``(right, seen, weight)``: how scans misread, from the words that no clean text has.

    Every such word of ``types(word)`` is aligned with the frequent words of ``counts(word, n)`` that equal it but for one
    place of one or two letters on either side; the most frequent of them is taken for what was written. Differences that
    ``pairs`` words or more show, and a ``SHARE`` of all, are confusions, every one of them (no more than ``1 / SHARE`` can have
    that share); a weight of 1 is a fiftieth of all pairs or more.
    """
    def holes(df: DataFrame) -> DataFrame:
        w = df.where(F.length("word") >= LETTERS).select("*", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("l")).where("i + l <= length(word) + 1")
        return w.select("*", F.expr("xxhash64(substring(word, 1, i - 1), substring(word, i + l))").alias("key"), F.expr("substring(word, i, l)").alias("mid")).drop("i", "l")

    rare = holes(types.where(~F.col("word").rlike(r"^\p{Nd}+$")).join(counts.select("word"), "word", "left_anti")).select("word", "key", F.col("mid").alias("seen"))
    often = holes(counts.where((F.col("n") >= FREQUENT) & ~F.col("word").rlike(r"[\p{Nd}-]"))).select("n", "key", F.col("mid").alias("right"), F.col("word").alias("fixed"))
    both = rare.join(often, "key").where("NOT contains(`right`, seen) AND NOT contains(seen, `right`)")
    both = both.where("length(`right`) = 1 OR length(seen) = 1 OR (left(`right`, 1) <> left(seen, 1) AND right(`right`, 1) <> right(seen, 1))")
    one = both.groupBy("word").agg(F.max(F.struct("n", "fixed", "right", "seen")).alias("b"))
    found = cut(one.groupBy("b.right", "b.seen").agg(F.count("*").alias("k")))  # read twice
    total = found.agg(F.sum("k")).first()[0] or 0
    top = found.where((F.col("k") >= pairs) & (F.col("k") >= SHARE * total)).orderBy(F.desc("k"), "right", "seen").collect()
    return [(r["right"], r["seen"], min(1.0, 50 * r["k"] / total)) for r in top]


def by_seen(confusions: list[tuple[str, str, float]]) -> dict[str, list[tuple[str, float]]]:
    """``(right, weight)`` of all confusions by what is seen."""
    out: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for right, seen, weight in confusions:
        out[seen].append((right, weight))
    return dict(out)


def candidates(word: str, confusions: list[tuple[str, str, float]] | dict[str, list[tuple[str, float]]], edits: int = 2) -> dict[str, tuple[int, float]]:
    """Words that a scan may have misread as ``word``: the number of misread places and their weight. ``confusions`` as learned, or
    ``by_seen``."""
    seen = confusions if isinstance(confusions, dict) else by_seen(confusions)
    lengths = sorted({len(x) for x in seen})
    out, last = {}, {word: 1.0}
    for depth in range(1, edits + 1):
        new: dict[str, float] = {}
        for w, p in last.items():
            for at in range(len(w)):
                for n in lengths:
                    for right, weight in seen.get(w[at:at + n], ()) if at + n <= len(w) else ():
                        x = w[:at] + right + w[at + n:]
                        if x != word and x not in out and new.get(x, 0) < p * weight:
                            new[x] = p * weight
        out |= {x: (depth, p) for x, p in new.items()}
        last = new
    return out


def _read_blocks(model: LineModel):
    """Rows of the blocks of files in one group: (chunk_id, line_no, what, word, style). ``what``: running, page_number, token,
    break."""

    def run(t: pa.Table) -> pa.Table:
        by: dict[tuple, list[tuple]] = defaultdict(list)
        for f, k, *chunk in zip(*(t.column(c).to_pylist() for c in ("file_id", "block", "ordinal", "id", "text", "own"))):
            by[f, k].append(tuple(chunk))
        out = [x for chunks in by.values() for x in read(sorted(chunks))]
        cols = list(zip(*out)) or [()] * 5
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("chunk_id", "line_no", "what", "word", "style"), cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))})

    def read(chunks: list[tuple]) -> list[tuple]:
        ids, own = [c[1] for c in chunks], {c[1] for c in chunks if c[3]}
        lines, seen = observe([c[2] for c in chunks])
        labels = model.label(seen)
        out = []
        body = [k for k in range(len(lines)) if labels[k] == BODY and lines[k][2].strip()]
        after = dict(zip(body, body[1:]))
        skip_first: set[int] = set()
        titles: dict[int, str] = {}
        for k, (c, no, s) in enumerate(lines):
            if labels[k] == NUMBER:
                out.append((ids[c], no, "page_number", "", ""))
            elif labels[k] == RUNNING:
                out.append((ids[c], no, "running", "", ""))
                p = title_parts(s.strip())
                titles[k] = p[0] if p else s
        for same in alike(titles).values():  # the other pages tell how a title is spelled
            split = {k: [w.lower() for w in _WORD.findall(titles[k])] for k in same}
            for k in same:
                for j, w in enumerate(split[k]):
                    votes = Counter(x[j] for x in split.values() if len(x) == len(split[k]))
                    top, n = max(votes.items(), key=lambda v: (v[1], v[0]))
                    c, no, _ = lines[k]
                    if top != w and n > votes[w]:
                        out.append((ids[c], no, "misread", top, ""))
                    elif n == 1:
                        out.append((ids[c], no, "token", w, ""))
        for k in body:
            c, no, s = lines[k]
            words = [(m.start(), m.group().lower()) for m in _WORD.finditer(s)]
            if k in skip_first and words:
                words = words[1:]
            end = s.split()[-1]
            tail = _TAIL.search(end) if end[-1] in _HYPHEN else None
            if tail:
                nxt = after.get(k)
                if words and words[-1][0] >= len(s.rstrip()) - len(end) + tail.start(1):
                    words = words[:-1]
                if nxt is not None and lines[nxt][0] == c and (m := re.match(r"\s*([^\W_]+(?:-[^\W_]+)*)", lines[nxt][2])):
                    right = m.group(1).lower()
                    hanging = tail.group(2) == "-" and right in LINKING
                    if hanging:
                        out.append((ids[c], no, "token", tail.group(1).lower(), ""))
                    else:
                        out.append((ids[c], no, "break", f"{tail.group(1).lower()}\t{right}", tail.group(2)))
                        skip_first.add(nxt)
                elif nxt is not None and lines[nxt][0] != c:
                    skip_first.add(nxt)
            out += [(ids[c], no, "token", w, "") for _, w in words]
        return [x for x in out if x[0] in own]

    return run


def _current(texts: DataFrame) -> DataFrame:
    """The current reading of every file (the latest ``extracted_at``; of equal ones the larger confidence)."""
    return texts.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("extracted_at", "confidence", "extractor")).alias("t")).select("file_id", F.lower(F.trim("t.extractor")).alias("extractor"))


def _chunks(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    c = chunks.where("id IS NOT NULL AND text IS NOT NULL").select("id", "file_id", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "text").dropDuplicates(["id"])
    return c.join(_current(texts), "file_id", "left").withColumn("scanned", F.coalesce(F.col("extractor").isin("ocr", "pdf-ocr"), F.lit(False)))


def _words_of(df: DataFrame) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}]+(?:-[\p{L}\p{Nd}]+)*"), F.lit(0))).alias("word")
    return df.select(words).groupBy("word").agg(F.count("*").alias("n"))


def fit_lines(scanned: DataFrame, files: int = FIT_FILES) -> LineModel:
    """The line model, fitted on a bounded sample: the first ``CHUNKS`` chunks of ``files`` files, by hash."""
    some = scanned.groupBy("file_id").agg(F.max(F.struct(F.xxhash64("file_id"))).alias("h")).orderBy("h").limit(files).select("file_id")
    rows = scanned.where(F.col("ordinal") < CHUNKS).join(F.broadcast(some), "file_id").select("file_id", "ordinal", "text").toPandas()
    return LineModel().fit([observe(g.sort_values("ordinal")["text"].tolist())[1] for _, g in rows.groupby("file_id")])


def _lines_read(c: DataFrame) -> DataFrame:
    """Lines of scanned files, read in blocks of ``CHUNKS`` chunks; a block also sees ``CONTEXT`` chunks on either side."""
    scanned = c.where("scanned")
    model = fit_lines(scanned)
    home, at = F.floor(F.col("ordinal") / CHUNKS), F.pmod(F.col("ordinal"), F.lit(CHUNKS))
    near = F.array(home, F.when(at < CONTEXT, home - 1), F.when(at >= CHUNKS - CONTEXT, home + 1))
    block = scanned.withColumn("block", F.explode(F.array_compact(near))).withColumn("own", F.col("block") == home)
    # Blocks share groups of some hundred chunks, so that there are few of them.
    group = F.pmod(F.xxhash64("file_id", "block"), F.lit(max(1, scanned.count() // GROUPED))).alias("group")
    return block.select("file_id", "block", "ordinal", "id", "text", "own", group).groupBy("group").applyInArrow(_read_blocks(model), "chunk_id long, line_no int, what string, word string, style string")


def corrections(types: DataFrame, counts: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """``(word, fixed)`` for the words of ``types(word)`` that are misread.

    A word is misread if clean text lacks it, or has it 500 times less than the candidate; the candidate that clean text
    has most often wins, a rarer confusion or a second misread place (a factor of 50) telling against it, ties by
    spelling. Words without a known candidate fall back to the character model, which changes them only for a clear gain.
    Words much longer than any clean one have no known candidate.
    """
    known = types.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")).where(F.length("word") > 1).where(~F.col("word").rlike(r"^\d+$"))
    confusions = by_seen(learn_confusions(types, counts, pairs))
    names = Names(name_grams(counts))
    longest = (counts.agg(F.max(F.length("word"))).first()[0] or 0) + 2

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, n in zip(pdf["word"], pdf["n"]):
                if len(w) > longest:
                    continue
                c = candidates(w, confusions)
                for x, (cost, weight) in c.items():
                    out.append((w, int(n), x, cost, weight, 0.0))
                if not n and len(w) > 4 and not re.fullmatch(r"\d+\D{0,3}|[ivxlc]+", w):
                    base = names.score(w)
                    best = max(((names.score(x) - 2.0 * cost + math.log(weight), x) for x, (cost, weight) in c.items() if not any(ch.isdigit() for ch in x)), default=None)
                    if best and (best[0] - base >= GAIN or any(ch.isdigit() for ch in w)):
                        out.append((w, 0, best[1], 9, 0.0, best[0]))
            yield pd.DataFrame(out, columns=["word", "own", "fixed", "cost", "channel", "gain"])

    p = known.mapInPandas(propose, "word string, own long, fixed string, cost int, channel double, gain double")
    j = p.join(counts.withColumnRenamed("word", "fixed"), "fixed", "left")
    weight = F.when(F.col("cost") < 9, F.col("n") * F.col("channel") / F.pow(F.lit(50.0), F.col("cost") - 1)).otherwise(0.0)
    j = j.where((F.col("cost") == 9) | (F.col("n").isNotNull() & (weight >= 500 * F.col("own")))).withColumn("weight", weight)
    return j.groupBy("word").agg(F.max_by("fixed", F.struct("weight", "gain", "fixed")).alias("fixed"))


def scan_faults(chunks: DataFrame, texts: DataFrame, corpus: DataFrame | None = None, pairs: int = PAIRS) -> DataFrame:
    """``(chunk_id, line_no, kind, word)``: the faults of every line of scanned files.

    Scanned are files whose current ``doc_text`` row has the extractor ocr or pdf-ocr. Kinds: ``hyphen`` (a word broken
    at the end of the line and continued in the same chunk, over blank lines and furniture; ``word`` is the whole),
    ``misread`` (``word`` is the right one), ``running`` and ``page_number`` (``word`` is empty). Words are in lower case
    without outer punctuation, each once per line. ``line_no`` counts all lines from 1. ``corpus(text)`` is further clean
    text to count words in; ``pairs`` is for ``learn_confusions``. NULL texts, repeated rows, files without reading and empty
    tables give no rows; files of any length are read whole, in blocks of ``CHUNKS`` chunks that see ``CONTEXT`` more on
    either side (titles that repeat and numbers that count on at a greater distance only are not seen as such).
    """
    r, fixed = _faults(chunks, texts, corpus, pairs)
    marks = r.where("what IN ('running', 'page_number', 'misread')").select("chunk_id", "line_no", F.col("what").alias("kind"), "word")
    miss = r.where("what = 'token'").join(fixed, "word").select("chunk_id", "line_no", F.lit("misread").alias("kind"), F.col("fixed").alias("word"))
    broken = r.where("what = 'break'").select("chunk_id", "line_no", F.lit("hyphen").alias("kind"), F.coalesce("whole", "word").alias("word"))
    return marks.unionByName(miss).unionByName(broken).distinct()


def _faults(chunks: DataFrame, texts: DataFrame, corpus: DataFrame | None, pairs: int) -> tuple[DataFrame, DataFrame]:
    c = cut(_chunks(chunks, texts))
    read = cut(_lines_read(c))
    counts = _words_of(c.where("NOT scanned AND extractor IS NOT NULL"))
    if corpus is not None:
        counts = counts.unionByName(_words_of(corpus.where("text IS NOT NULL"))).groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    parts = F.split("word", "\t")
    b = read.where("what = 'break'").withColumn("joined", F.concat(parts[0], parts[1])).withColumn("dashed", F.concat(parts[0], F.lit("-"), parts[1]))
    types = read.where("what = 'token'").select("word").unionByName(b.select(F.col("joined").alias("word"))).distinct()
    fixed = cut(corrections(types, counts, pairs))
    b = b.join(counts.select(F.col("word").alias("joined"), F.col("n").alias("nj")), "joined", "left").join(counts.select(F.col("word").alias("dashed"), F.col("n").alias("nd")), "dashed", "left")
    b = b.join(fixed.select(F.col("word").alias("joined"), F.col("fixed")), "joined", "left")
    whole = F.when(F.coalesce("nd", F.lit(0)) > F.coalesce("nj", F.lit(0)), F.col("dashed")).otherwise(F.coalesce("fixed", "joined"))
    b = b.select("chunk_id", "line_no", "what", "word", "style", whole.alias("whole"))
    rest = read.where("what <> 'break'").withColumn("whole", F.lit(None).cast("string"))
    return b.unionByName(rest), fixed


def clean_pages(chunks: DataFrame, texts: DataFrame, corpus: DataFrame | None = None, pairs: int = PAIRS) -> DataFrame:
    """``(chunk_id, text)``: scanned chunks as continuous paragraphs of right words, without page furniture.

    Lines of a paragraph are joined by blanks, paragraphs by an empty line; a break across furniture does not end a
    paragraph in the middle of a sentence.
    """
    f = scan_faults(chunks, texts, corpus, pairs)
    per = f.groupBy("chunk_id").agg(F.collect_list(F.struct("line_no", "kind", "word")).alias("faults"))  # bounded by the chunk
    c = _chunks(chunks, texts).where("scanned").select(F.col("id").alias("chunk_id"), "text").join(per, "chunk_id", "left")

    @F.pandas_udf("string")
    def mend(text: pd.Series, faults: pd.Series) -> pd.Series:
        return pd.Series([reassemble(t, [] if f is None else [(x["line_no"], x["kind"], x["word"]) for x in f]) for t, f in zip(text, faults)])

    return c.select("chunk_id", mend("text", "faults").alias("text"))


def reassemble(text: str, faults: list[tuple[int, str, str]]) -> str:
    by: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for no, kind, word in faults:
        by[no].append((kind, word))
    paragraphs, now, take, gap = [], [], None, False
    for no, line in enumerate(text.split("\n"), 1):
        kinds = dict(by[no])
        if "running" in kinds or "page_number" in kinds:
            continue
        if not line.strip():
            gap = True
            continue
        words = line.split()
        if take:
            rest = re.sub(r"^[^\W_]+(?:-[^\W_]+)*", "", words[0]) if words else ""
            now[-1] = take + rest
            words, take, gap = words[1:], None, False
        if gap and now and now[-1][-1:] in ".!?\"»:":
            paragraphs.append(" ".join(now))
            now = []
        gap = False
        cores = [m.group().lower() if (m := _WORD.search(w)) else "" for w in words]
        for good in (w for k, w in by[no] if k == "misread"):  # stands where the line has what is most like it
            if good in cores:
                continue
            likeness = [SequenceMatcher(None, good, c, autojunk=False).ratio() for c in cores]
            j = max(range(len(words)), key=lambda j: likeness[j], default=None)
            if j is not None and likeness[j] >= 0.5:
                m = _WORD.search(words[j])
                words[j] = words[j][:m.start()] + (good.capitalize() if m.group()[:1].isupper() else good) + words[j][m.end():]
                cores[j] = good
        if "hyphen" in kinds and words:
            m = re.search(r"[^\W_]+(?:-[^\W_]+)*\W*$", words[-1])
            head = words[-1][:m.start()] if m else ""
            upper = bool(m) and m.group()[:1].isupper()
            take = head + (kinds["hyphen"].capitalize() if upper else kinds["hyphen"])
        now += words
    if now:
        paragraphs.append(" ".join(now))
    return "\n\n".join(paragraphs)
