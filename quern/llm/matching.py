"""Mapping freely typed values to the closest entry of a reference list, with unmatched values reported.

Distinct values are normalised, candidates come from an inverted index of character n-grams of all names and
codes of the list, and are scored by cosine with damped inverse document frequencies as weights. A value is accepted
above a threshold and with a margin before the next entry. Where several entries lie within the margin, the edit
distance decides among them, if one of them alone has the fewest edits; nothing is accepted below the threshold. All
entries that share an n-gram with a value are scored, however many they are.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "UNMATCHED"
#: Least cosine of an accepted name or code, and least lead over the best other entry.
THRESHOLD = 0.5
CODE_THRESHOLD = 0.5
MARGIN = 0.08
#: Most edits, for a text's length, with which a near tie is decided.
EDITS = ((3, 0), (5, 1), (9, 2), (10**9, 3))
CODE_EDITS = 1
#: Exponent of the inverse document frequency of a gram: rare letters of a slip of the pen would outweigh all that is
#: right. Words count in full by theirs, as a word that many names have says little.
RARITY = 0.25
#: More reference names than this are not shipped to the workers.
MAX_NAMES = 200_000

#: Abbreviations of words in names.
ABBREVIATIONS = {
    "rep": "republic", "fed": "federal", "utd": "united", "st": "saint", "is": "islands", "isl": "islands", "isls": "islands", "dem": "democratic",
    "n": "north", "s": "south", "e": "east", "w": "west", "terr": "territory", "prov": "provinces", "kgdm": "kingdom", "comm": "commonwealth",
}
#: Digits typed for letters.
DIGITS = str.maketrans("01345", "oleas")
#: Letters without a decomposition.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "þ": "th"})
#: Words that say nothing about which entry is meant.
EMPTY_WORDS = {"the", "of", "and"}
#: What is typed where no entry is meant.
NO_ENTRY = {"NA", "NONE", "NULL", "NIL", "NAN", "TBD", "TBC", "UNKNOWN", "NOTSTATED", "SEENOTE"}

#: What opens the name of a remainder or a sum, which is no entry.
_REMAINDER = re.compile(r"\s*(?:all\s+)?(?:others?|rest|remaining|remainder|(?:grand\s+|sub-?\s*)?totals?)\b", re.IGNORECASE)
_NOTE = re.compile(r"\[\s*\d+\s*\]|[*†‡§¶?]|[¹²³⁰-⁹]|\(\s*(?:tbc|the|\d+)\s*\)|\s[-–—]\s*total\s*$|,\s*the\s*$", re.IGNORECASE)
_FORMER = re.compile(r"[(\[]\s*(?:formerly|former|ex|previously|now)\b[\s\-:]*([^)\]]+)[)\]]", re.IGNORECASE)
_INITIALS = re.compile(r"\b(?:[a-z]\.){2,}")
_WORD = re.compile(r"[a-z0-9]+")


def fold(text: str) -> str:
    """Compatibility forms unified, accents and case removed."""
    t = unicodedata.normalize("NFKD", _NOTE.sub(" ", text))
    return "".join(c for c in t if not unicodedata.combining(c)).casefold().translate(PLAIN)


def words(text: str) -> list[str]:
    """Words of a name: apostrophes joined, digits inside words read as letters, abbreviations spelled out."""
    t = re.sub(r"['’`ʼ]", "", fold(text)).replace("&", " and ")
    t = _INITIALS.sub(" ", t) if _INITIALS.sub("", t).strip(" .,") else t
    out = []
    for w in _WORD.findall(t):
        if any(c.isalpha() for c in w):
            w = w.translate(DIGITS)
        out.append(ABBREVIATIONS.get(w, w))
    return [w for w in out if w not in EMPTY_WORDS] or out


def code_of(text: str) -> str:
    """A value read as a code: letters and digits alone, in capitals, without what follows a slash."""
    return re.sub(r"[^A-Z0-9]", "", unicodedata.normalize("NFKC", _NOTE.sub("", text)).split("/")[0].upper())


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours; above ``most`` the search stops."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def word_grams(ws: Sequence[str], telling: Callable[[str], float] = lambda w: 1.0) -> dict[str, float]:
    """Letters, bigrams and trigrams of each word with its edges, and pairs with a gap; the order of words doesn't matter.

    A gram counts as the root of its number in a word, times what the word tells (``telling``).
    """
    out: dict[str, float] = defaultdict(float)
    for w in ws:
        p = f"^{w}$"
        grams = Counter(w)
        grams.update(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1))
        grams.update(f"{p[i]}_{p[i + 2]}" for i in range(len(p) - 2))
        much = telling(w)
        for g, k in grams.items():
            out[g] += much * k**0.5
    return out


def code_grams(code: str) -> dict[str, float]:
    """Letters, their places from either end, neighbours in any order, and the length: one slip leaves most of them."""
    p, n = f"^{code}$", len(code)
    found = Counter([*code, *[f"{i}{c}" for i, c in enumerate(code)], *[f"-{n - i}{c}" for i, c in enumerate(code)], *["<" + "".join(sorted(p[i : i + 2])) for i in range(len(p) - 1)], f"=={n}"])
    return {g: k**0.5 for g, k in found.items()}


@dataclass(frozen=True)
class Match:
    entity: str
    score: float
    margin: float


class Grams:
    """Inverted index of the n-grams of texts; single letters, whose lists would hold nearly all texts, only score."""

    def __init__(self, entries: Sequence[tuple[str, str]], grams: Callable[[str], dict[str, float]]) -> None:
        self.entries, self.grams = entries, grams
        numbers: dict[str, int] = {}
        self.entity = np.array([numbers.setdefault(e, len(numbers)) for e, _ in entries], dtype=np.int64)
        found = [grams(t) for _, t in entries]
        df = Counter(g for c in found for g in c)
        self.n = max(1, len(found))
        self.weight = {g: self._rarity(k) for g, k in df.items()}
        self.letters = {g: i for i, g in enumerate(sorted(g for g in df if len(g) == 1))}
        self.singles = np.zeros((len(found), len(self.letters)), dtype=np.float32)
        norm = np.ones(len(found))
        lists: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        for i, c in enumerate(found):
            weighted = {g: k * self.weight[g] for g, k in c.items()}
            norm[i] = np.sqrt(sum(w * w for w in weighted.values())) or 1.0
            for g, w in weighted.items():
                if len(g) == 1:
                    self.singles[i, self.letters[g]] = w / norm[i]
                else:
                    lists[g][0].append(i)
                    lists[g][1].append(w / norm[i])
        self.lists = {g: (np.array(at, dtype=np.int64), np.array(w)) for g, (at, w) in lists.items()}

    def _rarity(self, df: int) -> float:
        return float(np.log(1 + self.n / df)) ** RARITY

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries that share a gram with the text, and their cosines; no other entry is touched."""
        weighted = {g: k * self.weight.get(g, self._rarity(1)) for g, k in self.grams(text).items()}
        norm = np.sqrt(sum(w * w for w in weighted.values())) or 1.0
        met = [(self.lists[g], w) for g, w in weighted.items() if g in self.lists]
        if not met:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        places, where = np.unique(np.concatenate([at for (at, _), _ in met]), return_inverse=True)
        cosine = np.bincount(where, np.concatenate([own * w for (_, own), w in met]), len(places))
        letters = np.zeros(len(self.letters))
        for g, w in weighted.items():
            if g in self.letters:
                letters[self.letters[g]] = w
        return places, (cosine + self.singles[places] @ letters) / norm

    def best(self, text: str, threshold: float, allowed: int) -> Match | None:
        """The entry above the threshold with the margin; of near ties the only one with the fewest edits, up to ``allowed``."""
        places, cosine = self.scores(text)
        if not len(places) or cosine.max() < threshold:
            return None
        first = int(places[cosine.argmax()])
        top = float(cosine.max())
        others = cosine[self.entity[places] != self.entity[first]]
        second = float(others.max()) if len(others) else 0.0
        if top - second >= MARGIN:
            return Match(self.entries[first][0], top, top - second)
        edits: dict[str, tuple[int, bool]] = {}
        for i in places[(cosine > top - MARGIN) & (cosine >= threshold)]:
            entity, own = self.entries[i]
            # a letter is sooner mistyped than left out or doubled
            key = (edit_distance(text, own, allowed), len(own) != len(text))
            edits[entity] = min(key, edits.get(entity, key))
        least = min(edits.values())
        close = [e for e, k in edits.items() if k == least]
        if least[0] > allowed or len(close) > 1:
            return None
        at = cosine[np.array([self.entries[i][0] == close[0] for i in places])].max()
        return Match(close[0], float(at), top - second)


class Index:
    """All names and codes of the list: exact forms, and grams of the names and of the codes of three letters or more."""

    def __init__(self, names: Sequence[tuple[str, str]], codes: Sequence[tuple[str, str]]) -> None:
        named = [(e, " ".join(words(n))) for n, e in names if n and words(n)]
        coded = [(e, code_of(c)) for c, e in codes if c and code_of(c)]
        self.exact: dict[tuple[str, bool], set[str]] = defaultdict(set)
        for entries, is_code in ((named, False), (coded, True)):
            for e, t in entries:
                self.exact[(" ".join(sorted(t.split())), is_code)].add(e)
        having = Counter(w for _, t in named for w in set(t.split()))
        most = math.log(1 + max(1, len(named)))
        self.names = Grams(named, lambda t: word_grams(t.split(), lambda w: math.log(1 + max(1, len(named)) / having.get(w, 1)) / most))
        self.codes = Grams([(e, t) for e, t in coded if len(t) > 2], code_grams)

    def as_name(self, text: str) -> Match | None:
        ws = words(text)
        if not ws:
            return None
        hit = self.exact.get((" ".join(sorted(ws)), False), set())
        if len(hit) == 1:
            return Match(next(iter(hit)), 1.0, 1.0)
        joined = " ".join(ws)
        return self.names.best(joined, THRESHOLD, next(k for length, k in EDITS if len(joined) <= length))

    def as_code(self, text: str, near: bool = True) -> Match | None:
        """The entry with this code, or (``near``) the one whose code is a slip away."""
        code = code_of(text)
        if not code:
            return None
        hit = self.exact.get((code, True), set())
        if len(hit) == 1:
            return Match(next(iter(hit)), 1.0, 1.0)
        if not near or len(code) < 3 or len(code) > 5:
            return None
        return self.codes.best(code, CODE_THRESHOLD, CODE_EDITS)

    def match(self, text: str, codes_first: bool) -> Match:
        """The entry that a value means; a placeholder, a remainder or sum, a repeated sign or a number alone means none."""
        letters = re.sub(r"[^A-Z]", "", fold(text).upper())
        if _REMAINDER.match(text) and (" ".join(sorted(words(text))), False) not in self.exact:
            return Match(UNMATCHED, 0.0, 0.0)
        if letters in NO_ENTRY or (len(set(letters)) < 2 and (code_of(text), True) not in self.exact):
            return Match(UNMATCHED, 0.0, 0.0)
        former = _FORMER.search(text)
        plain = _FORMER.sub(" ", text) if former else text
        if codes_first:
            m = self.as_code(plain) or self.as_name(plain)
        else:
            m = self.as_name(plain) or self.as_code(plain, near=False)
        if m is not None:
            return m
        if former and (m := self.as_name(former.group(1))) is not None:
            return m
        return Match(UNMATCHED, 0.0, 0.0)


_INDEXES: dict[str, Index] = {}


def match_values(values: DataFrame, column: str, names: Sequence[tuple[str, str]], codes: Sequence[tuple[str, str]], *, codes_first: bool = False) -> DataFrame:
    """``column`` of a table of distinct values with matched, score and margin; 'UNMATCHED' where no entry is meant.

    Null values are left out; blank ones are unmatched. With an empty list all are unmatched.
    ``codes_first`` tries a value as a code before it is tried as a name. Values are few bytes and much work each, so
    they are spread over as many tasks as the cluster has cores, whatever their size.
    """
    if len(names) + len(codes) > MAX_NAMES:
        raise ValueError(f"the reference list has over {MAX_NAMES} names and codes")
    listed = (tuple(names), tuple(codes))
    key = hashlib.sha256(repr(listed).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _INDEXES:  # once for each process of a worker
            _INDEXES.clear()
            _INDEXES[key] = Index(*listed)
        index = _INDEXES[key]
        for batch in batches:
            found = [index.match(v, codes_first) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m.entity for m in found], pa.string()), pa.array([m.score for m in found], pa.float64()), pa.array([m.margin for m in found], pa.float64())],
                names=[column, "matched", "score", "margin"],
            )

    spread = values.select(column).where(F.col(column).isNotNull()).repartition(values.sparkSession.sparkContext.defaultParallelism, column)
    return spread.mapInArrow(run, f"`{column}` string, matched string, score double, margin double")
