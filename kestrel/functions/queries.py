"""Typed queries: words, names of people in them, language, and feature sets."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import functions as F

#: Words that only English has in short queries.
ENGLISH = {
    "the", "this", "that", "these", "those", "is", "are", "was", "were", "with", "without", "beside", "besides", "near", "by", "at", "of",
    "and", "or", "from", "to", "in", "on", "under", "over", "between", "inside", "outside", "during",
}
_NAME = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")


def plain_words(text: str | None) -> str:
    """Lower-case letters and digits without marks and apostrophes, single blanks between."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).lower()
    return " ".join(re.findall(r"[^\W_]+", re.sub(r"[’']", "", bare)))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance (N16); in tables use ``levenshtein``."""
    if len(a) < len(b):
        a, b = b, a
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(now[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
        last = now
    return last[-1]


def meets(typed: str, name: str) -> int:
    """How a typed word meets a word of a name: 2 equal, 1 its beginning (4 letters or more) or one slip (5 or more), 0 not."""
    if typed == name:
        return 2
    if len(typed) >= 4 and name.startswith(typed):
        return 1
    return int(len(typed) >= 5 and abs(len(typed) - len(name)) <= 1 and edit_distance(typed, name) <= 1)


@dataclass(frozen=True)
class Mention:
    person: int
    start: int
    end: int
    exact: bool


def mentions(query: str, people: dict[int, str]) -> list[Mention]:
    """People named in a query, from left to right.

    At each word the longest name counts, of equal ones the one with most equal words; when two are as good the text is left
    alone. A possessive ending is not part of the name.
    """
    typed = []
    for m in _NAME.finditer(query):
        bare = re.sub(r"[’']s$", "", m.group(), flags=re.I)
        typed.append((m.start(), m.start() + len(bare), plain_words(bare)))
    names = {p: plain_words(n).split() for p, n in people.items()}
    out, k = [], 0
    while k < len(typed):
        found = []
        for p, words in names.items():
            grades = [meets(t[2], w) for t, w in zip(typed[k:], words)]
            if words and len(grades) == len(words) and all(grades):
                found.append((len(words), grades.count(2), p))
        found.sort(reverse=True)
        if found and (len(found) == 1 or found[0][:2] != found[1][:2]):
            n, same, p = found[0]
            out.append(Mention(p, typed[k][0], typed[k + n - 1][1], same == n))
            k += n
        else:
            k += 1
    return out


def without_mentions(query: str, found: list[Mention]) -> str:
    """The query with the names lifted out and the gaps closed."""
    keep, at = [], 0
    for m in found:
        keep.append(query[at:m.start])
        at = m.end
    text = re.sub(r"\s+", " ", " ".join([*keep, query[at:]]))
    text = re.sub(r"^\s*[’']s\b\s*", "", text, flags=re.I)
    text = re.sub(r"^\s*(?:and|with|y|con)\b\s*", "", text, flags=re.I)
    return re.sub(r"\s+([,.;!?])(?=\s|$)", r"\1", text).strip()


def clearly_english(text: str) -> bool:
    """Whether a query needs no translation."""
    return not ENGLISH.isdisjoint(plain_words(text).split())


@F.udtf(returnType="person: long, start: int, end: int, exact: boolean")
class MentionFinder:
    """``mentions`` as a table function over (query, map of people)."""

    def eval(self, query: str, people: dict):
        for m in mentions(query or "", dict(people or {})):
            yield m.person, m.start, m.end, m.exact


#: Features with the stages, detectors and readers that they switch on; the first three are always there.
FEATURES = {
    "catalogue": {"stages": ["scan"], "required": True}, "dates": {"stages": ["enrich"], "required": True}, "duplicates": {"stages": ["dedup"], "required": True},
    "places": {"stages": ["places"]}, "people": {"stages": ["detect"], "detector": "faces"}, "pets": {"stages": ["detect"], "detector": "animals"},
    "semantic": {"stages": ["semantic"], "way": "description"}, "documents": {"stages": ["text"], "extractor": "documents", "way": "text"}, "ocr": {"stages": ["text"], "extractor": "ocr", "way": "text"},
}


def features(chosen: list[str] | None) -> dict[str, list[str]]:
    """What a choice of features switches on (R15, R16): None is all, required ones are always on, unknown ones are dropped."""
    on = [f for f, v in FEATURES.items() if chosen is None or v.get("required") or f in chosen]
    get = lambda k: sorted({FEATURES[f][k] for f in on if k in FEATURES[f]})
    return {"features": on, "stages": sorted({s for f in on for s in FEATURES[f]["stages"]}), "detectors": get("detector"), "extractors": get("extractor"), "ways": ["name", *get("way")]}


_RANK = ["up_to_date", "unavailable", "queued", "blocked", "error", "running"]


def cards(states: list[dict], card_of: dict[str, str], waits: dict[str, str], paused: set[str] = frozenset()) -> list[dict]:
    """Stages rolled up to cards in order of dependency (T16): worst state, summed backlog, pauses handed down the chain."""
    out: dict[str, dict] = {}
    for s in states:
        c = out.setdefault(card_of[s["kind"]], {"state": "up_to_date", "pending": 0})
        c["state"] = max(c["state"], s["state"], key=_RANK.index)
        c["pending"] += s.get("pending") or 0
    for name, c in out.items():
        before = out.get(waits.get(name, ""), {})
        c["paused"] = name in paused
        c["stalled"] = c["paused"] or before.get("stalled", False)
        c["next"] = c["state"] == "blocked" and before.get("state") == "running"
    return [{"id": k, **v} for k, v in out.items()]
