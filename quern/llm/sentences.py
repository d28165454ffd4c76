"""Sentence boundaries across languages and scripts.

Whether a period ends a sentence is decided from the document itself: a word that stands before a period and a
lower-case word elsewhere is an abbreviation, and so is one whose periods stand before numbers; a word that occurs in
lower case elsewhere is no proper name, a capitalised one inside a sentence is. Where the document is silent, counts
over the whole corpus answer the same questions, and which words report speech and which announce an ordinal number.
Short lists of abbreviations and verbs are a prior, asked after both. Other scripts follow the rules of their own
terminators; scripts without terminators are parted at their spaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import cut

# Terminators, closing and opening marks, and what seldom or never ends a sentence.
TERMINATORS = ".!?…。！？｡．؟۔।॥։።፧᙮;‽⸮"
FULL = "。！？｡．؟۔।॥։።፧᙮⸮"
PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "“": "”", "‘": "’", "„": "“"}
BRACKETS = "(（[【《〈"
OPENERS = "\"'“‘«「『„‚(（[【《〈¿¡‹"
CLOSERS = "\"'”’»」』“)）]】》〉›"
#: Abbreviations asked about only where neither the document nor the corpus says anything; the second ones are words
#: of their own as well and count before numbers alone.
PRIOR = {
    "mr", "mrs", "ms", "mx", "dr", "prof", "st", "gov", "sen", "rev", "hon", "amb", "col", "gen", "capt", "sgt", "cmdr", "sr", "jr", "sra", "srta", "dra", "mme", "mlle", "frl", "dipl", "д-р", "проф", "акад", "г-н", "г-жа", "δρ",
    "nr", "num", "núm", "pp", "pág", "págs", "para", "paras", "vol", "vols", "chap", "figs", "sect", "cf", "docs", "eds", "approx", "ca", "vs", "dept", "inc", "ltd", "univ", "bzw", "ggf", "inkl", "vgl", "mio", "mrd",
    "ст", "пп", "гл", "рис", "см", "табл", "млн", "млрд", "тыс", "руб", "άρθρ", "σελ", "παρ",
    "jan", "feb", "sept", "oct", "nov", "dec", "janv", "févr", "juil", "okt", "dez", "янв", "авг", "сент", "окт", "нояб", "дек",
}
PRIOR_BEFORE_NUMBERS = {"no", "nos", "art", "arts", "abs", "ch", "cap", "fig", "sec", "doc", "ed", "al", "ex", "apr", "mar", "jun", "jul", "aug", "sep"}
#: Words before an ordinal, asked about likewise.
PRIOR_ORDINALS = {"am", "der", "die", "das", "dem", "den", "des", "im", "vom", "zum", "zur", "bis", "seit"}
REPORTING = re.compile(
    r"\b(?:said|says|asked|asks|warned|warns|replied|added|told|tells|declared|stated|answered|insisted|argued|announced|explained|concluded|remarked|noted|shouted|cried|wrote|observed|continued|"
    r"sagte|fragte|erklärte|antwortete|warnte|betonte|meinte|rief|dijo|preguntó|respondió|afirmó|añadió|declaró|dit|demanda|répondit|déclaré|déclara|affirmé|ajouté|répondu|"
    r"сказал|сказала|спросил|ответил|заявил|добавил|είπε|ρώτησε|απάντησε|δήλωσε)\b",
    re.IGNORECASE,
)
_REPORTING_UNSPACED = re.compile(r"[说說道问問答称表示告诉指出喊]")
_QUOTATIVE = re.compile(r"(?:と|って|という|라고|이라고|라는|하고|고\s|라며)")
_HINDI_REPORT = re.compile(r"(?:ने\s+)?(?:कहा|पूछा|बताया)")
CONJUNCTIONS = {"and", "but", "or", "yet", "so", "nor", "und", "aber", "et", "mais", "y", "pero", "и", "но"}
ROMAN = re.compile(r"[ivxlcIVXLC]{1,5}\Z")

_BLANK = re.compile(r"\r?\n[^\S\n]*\r?\n\s*")
_MARK = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values()) + '"') + "]")
_THAI = "฀-๏๚-๿຀-໏က-႟ក-៟"
_CAND = re.compile(r"[" + re.escape(TERMINATORS) + r"]+|፡፡")
#: Where capitals count, a period before a lower-case letter or inside a number ends nothing; the scan leaves it out.
_CAND_CASED = re.compile(r"(?:[" + re.escape(TERMINATORS.replace(".", "")) + r"]|\.(?![a-z0-9]|\s[a-z]))[" + re.escape(TERMINATORS) + r"]*|፡፡")
_CAND_SPACED = re.compile(r"[" + re.escape(TERMINATORS) + r"]+|፡፡|(?<=[" + _THAI + r"])\s+(?=[^\W\d_]|[" + re.escape(OPENERS) + r"]|\d+[^\S\n]?(?![" + _THAI + r"])[^\W\d_])")
_HAS_SPACED = re.compile("[" + _THAI + "]")
_LINE_NUMBER = re.compile(r"(?:\A|\n)[^\S\n]*\(?(\d{1,4})[.)][^\S\n]+(?=\S)")
_VISIBLE = re.compile(r"\S")
TOKEN_STOPS = frozenset("(（[「『«“\"‘„—–/،,:»”")
_TIME = re.compile(r"(?:[^\W\d_a-z][^\s.!?]*\s+|(?:and|the|of)\s+|\([^)]*\)\s*){1,7}time\b")
_JOINED = re.compile("[-'’]")
_LAST_WORD = re.compile(r"(?<!\w)[^\W\d_]+\Z")
_PERIOD = re.compile(r"\.(?:(\s+)(\S?)|[,;:])")
_NEAR_QUOTE = re.compile(r"[:：,，]\s*[\"“«「„『](?=\w)|[.!?。！？][\"”」»』]\s?(?=\w)")
#: Periods inside sentences; those before a capital of the commonest alphabet, most of all, are left out.
_INSIDE = re.compile(r"\.(?:(\s+)([^\sA-Z])|[,;:])")
_WORD = re.compile(r"[^\W\d_]+")
_IDEOGRAPH = re.compile(r"[぀-ヿ㐀-鿿]")
_EDGES = "".join(sorted(set(OPENERS + CLOSERS + ",;:.!?")))


def _uncased(c: str) -> bool:
    return c.isalpha() and not c.islower() and not c.isupper() and not c.istitle()


def _unspaced(c: str) -> bool:
    """Scripts written without spaces between words."""
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "฀" <= c <= "໿" or "豈" <= c <= "﫿" or "က" <= c <= "႟" or "ក" <= c <= "៿"


def _same_length_lower(text: str) -> str:
    """Lower case without moving any character: those that become several stay."""
    made = text.lower()
    return made if len(made) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


@dataclass(frozen=True)
class Corpus:
    """What the whole corpus shows: abbreviations as they are written, words that are common although they may begin
    with a capital, words after which a number with a period is an ordinal, and words that report speech."""

    abbreviations: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    ordinals: frozenset[str] = frozenset()
    reporting: frozenset[str] = frozenset()


class Splitter:
    """Splits documents, by their own evidence, then by that of the ``corpus``, then by the lists (``prior``)."""

    def __init__(self, corpus: Corpus = Corpus(), prior: bool = True) -> None:
        self.corpus = corpus
        self.folded = frozenset(w.lower() for w in corpus.abbreviations)
        self.prior, self.numbered = (PRIOR, PRIOR_BEFORE_NUMBERS) if prior else (frozenset(), frozenset())
        self.ordinals = corpus.ordinals or (PRIOR_ORDINALS if prior else frozenset())
        self.verbs = REPORTING if prior else None

    # -- what the document says ----------------------------------------------------------------------------

    def _learn(self, text: str) -> None:
        self.text = text
        self.here: set[str] | None = None
        self.known: dict[str, bool] = {}
        self.small: dict[str, bool] = {}
        self.cased_document = self.cased = text != text.lower() and text != text.upper()
        self.danda = "।" in text
        self.verjaket = "։" in text

    def _evidence(self) -> set[str]:
        """Words of the document, folded, that stand in any case before a period inside a sentence.

        A lower-case word or a comma after one such period is enough. Numbers may begin a sentence: they are evidence
        if they follow two of the word's periods or more and each of them.
        """
        text = self.text
        found: set[str] = set()
        numbers: Counter = Counter()
        for m in _INSIDE.finditer(text):
            after = m.group(2)
            if after is None or after.islower() or after.isdigit() and "\n" not in m.group(1):
                word = _LAST_WORD.search(text, max(0, m.start() - 40), m.start())
                if word is None:
                    continue
                if after is None or after.islower():
                    found.add(word.group().lower())
                else:
                    numbers[word.group().lower()] += 1
        if numbers:
            open_ = [w for w, n in numbers.items() if n > 1 and w not in found and w not in self.folded]
            lower = _same_length_lower(text) if open_ else ""
            found.update(w for w in open_ if len(re.findall(rf"(?<!\w){re.escape(w)}\.\s", lower)) == numbers[w])
        return found

    def _abbreviation(self, token: str, number: bool = False) -> bool:
        """By the document, else by the corpus, else by the prior lists; ``number`` tells whether one follows."""
        low = token.lower()
        if token in self.corpus.abbreviations:  # any of the three is enough, so the nearest is asked first
            return True
        if not self.cased:
            return low in self.folded or low in self.prior or number and low in self.numbered
        if self.here is None:
            self.here = self._evidence()
        return low in self.here or low in self.prior or number and low in self.numbered

    def _common(self, word: str) -> bool:
        """Whether a capital is only that of a sentence: the word occurs in lower case in the document, or, where it
        has no capital inside a sentence there either, mostly in the corpus."""
        low = word.lower()
        if (small := self.small.get(low)) is None:
            text, at, small = self.text, 0, False
            while not small and (at := text.find(low, at)) >= 0:
                end = at + len(low)
                small = low.islower() and not (at and text[at - 1].isalpha()) and not text[end : end + 1].isalpha()
                at = end
            self.small[low] = small
        if small:
            return True
        return low in self.corpus.common and not self._named(word)

    def _named(self, word: str) -> bool:
        """The word stands with its capital between lower-case words of the document."""
        if (known := self.known.get(word)) is None:
            text, at, known = self.text, 0, False
            while not known and (at := text.find(word, at)) >= 0:
                end = at + len(word)
                known = at > 1 and text[at - 1] == " " and (text[at - 2].islower() or text[at - 2] == ",") and not text[end : end + 1].isalnum()
                at = end
            self.known[word] = known
        return known

    # -- paragraphs ----------------------------------------------------------------------------------------

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of every sentence, in order, without the white space around it."""
        if not text or text.isspace():
            return []
        self._learn(text)
        out: list[tuple[int, int]] = []
        at = 0
        for m in _BLANK.finditer(text):
            self._paragraph(at, m.start(), out)
            at = m.end()
        self._paragraph(at, len(text), out)
        return out

    def _pairs(self, low: int, high: int) -> list[tuple[int, int]]:
        """Matched quotes and brackets of a paragraph, by their opening marks; unmatched ones are ignored."""
        text = self.text
        stack: list[tuple[str, int]] = []
        found: list[tuple[int, int]] = []
        for m in _MARK.finditer(text, low, high):
            c, i = m.group(), m.start()
            before = text[i - 1] if i > low else " "
            after = text[i + 1] if i + 1 < high else " "
            if c == "’" and before.isalnum() and after.isalpha():
                continue
            wanted = [p for p, _ in stack]
            if c == '"':
                closing = '"' in wanted and not (before.isspace() and not after.isspace())
                if not closing and (after.isspace() or i + 1 >= high):
                    continue
            elif c == "“":
                closing = "“" in wanted and not (before.isspace() and after.isalnum())
            else:
                closing = c in ")）]】》〉」』»”’"
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == c:
                        found.append((stack[k][1], i))
                        del stack[k:]
                        break
            elif c == '"':
                stack.append(('"', i))
            elif c in PAIRS:
                stack.append((PAIRS[c], i))
        found.sort()
        return found

    def _paragraph(self, low: int, high: int, out: list[tuple[int, int]]) -> None:
        text = self.text
        first = _VISIBLE.search(text, low, high)
        if first is None:
            return
        low = first.start()
        while text[high - 1].isspace():
            high -= 1
        part = text[low:high]
        self.cased = self.cased_document and part != part.lower() and part != part.upper()
        cuts = self._line_numbers(low, high)
        pairs = self._pairs(low, high)
        closes = {b: a for a, b in pairs}
        candidates = _CAND_SPACED if _HAS_SPACED.search(text, low, high) else _CAND_CASED if self.cased else _CAND
        current, active, next_pair, next_cut = low, [], 0, 0
        for m in candidates.finditer(text, low, high):
            a, b = m.span()
            while next_cut < len(cuts) and cuts[next_cut] <= a:
                current = self._emit(current, cuts[next_cut], out)
                next_cut += 1
            if a < current:
                continue
            if pairs:
                while next_pair < len(pairs) and pairs[next_pair][0] < a:
                    active.append(pairs[next_pair])
                    next_pair += 1
                active = [p for p in active if p[1] >= a]
            if b - a == 1 and not active and text[a] == "." and b + 1 < high and text[b] == " " and text[b + 1].isupper() and self.cased and not self.verjaket:
                # the plain case: an ordinary word in lower case, a period, a space and a capital
                token = text[max(current, text.rfind(" ", current, a) + 1) : a]
                if len(token) > 1 and token.isalpha() and token.islower() and not self._abbreviation(token):
                    out.append((current, b))
                    current = b + 1
                    continue
            if text[a].isspace():
                if not active and self._spaced_boundary(a):
                    current = self._emit(current, a, out)
                continue
            # closing marks belong to the sentence; French ones may stand off by a space
            k, opened = b, None
            while k < high:
                c = text[k]
                if k in closes and closes[k] < a:
                    opened = closes[k] if opened is None else min(opened, closes[k])
                    k += 1
                elif c in "\"”’」』)）]】" and k not in closes and not (c == '"' and k + 1 < high and not text[k + 1].isspace()):
                    k += 1
                elif closes and c.isspace() and (q := self._after_space(k, high)) in closes and closes[q] < a and text[q] == "»":
                    k = q
                else:
                    break
            if active and max(p[1] for p in active) >= k:
                continue
            if self._ends(current, a, b, k, high, opened, next_cut < len(cuts) and cuts[next_cut] or None):
                current = self._emit(current, k, out)
        for cut in cuts[next_cut:]:
            current = self._emit(current, cut, out)
        self._emit(current, high, out)

    def _after_space(self, k: int, high: int) -> int:
        while k < high and self.text[k].isspace():
            k += 1
        return k

    def _line_numbers(self, low: int, high: int) -> list[int]:
        """Starts of the lines of a numbered list after its first; each number follows the one before."""
        found, expected = [], None
        for m in _LINE_NUMBER.finditer(self.text, low, high):
            at = m.start(1) - (self.text[m.start(1) - 1] == "(")
            number = int(m.group(1))
            if expected is None and at == low or number == expected:
                if expected is not None:
                    found.append(at)
                expected = number + 1
        return found

    def _emit(self, low: int, high: int, out: list[tuple[int, int]]) -> int:
        text = self.text
        end = high
        while end > low and text[end - 1].isspace():
            end -= 1
        if end > low:
            out.append((low, end))
        while high < len(text) and text[high].isspace():
            high += 1
        return high

    # -- decisions -----------------------------------------------------------------------------------------

    def _spaced_boundary(self, a: int) -> bool:
        return not self.text[a - 1].isdigit()

    def _ends(self, current: int, a: int, b: int, k: int, high: int, opened: int | None, cut: int | None) -> bool:
        """Whether the sentence from ``current`` ends at k, after the terminators [a, b) and their closing marks."""
        text, run = self.text, self.text[a:b]
        self.current = current
        j = k
        while j < high and text[j].isspace():
            j += 1
        if j >= high or cut == j:
            return True
        gap, c = j > k, text[j]
        if ";" in run and not run.strip(";"):
            before = text[a - 1] if a else " "
            if not ("Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿"):
                return False
        if c in ",،;:)）]】」』”»" or c in "—–" or c == "-" and (not gap or "\n" not in text[k:j]):
            return False
        f = j
        while f < high and (text[f] in OPENERS or text[f].isspace()):
            f += 1
        lead = text[f] if f < high else ""
        if opened is not None and text[opened] in BRACKETS:
            # a remark in brackets inside a sentence goes on; a sentence in brackets ends with them
            return opened == current
        if opened is not None and (opened == current or not text[current:opened].strip(OPENERS + " ")):
            return self._quote_ends(j, high, gap, lead, text[opened])
        if opened is not None and _QUOTATIVE.match(text, k):
            return False
        if self.cased and lead.islower():
            return False
        last = run[-1]
        if last in FULL or run == "፡፡":
            return True
        if last in "!?;‽":
            return gap or lead.isupper() or _uncased(lead) or c in OPENERS
        if last == "…" or len(run) > 1 and run.endswith(".."):
            word = _WORD.match(text, f)
            if word and word.group().lower() in CONJUNCTIONS and not (self.cased and lead.isupper()):
                return False
            return gap or lead.isupper() or _uncased(lead)
        if not gap:
            return opened is not None or self._lost_space(a, j, lead)
        return self._period_ends(current, a, j, f, lead)

    def _quote_ends(self, j: int, high: int, gap: bool, lead: str, mark: str) -> bool:
        """Whether a sentence that a quotation opened ends with it, or goes on with the words that report it.

        Lower-case letters and quotative particles go on. Else the words up to the next terminator are asked for one that
        the corpus knows to report speech, then whether a name does something there: a title or a word that is never
        common, followed by words in lower case.
        """
        text = self.text
        if self.cased and lead.islower():
            return False
        if _QUOTATIVE.match(text, j):
            return False
        if lead and _unspaced(lead):
            stop = _CAND.search(text, j, high)
            clause = text[j : stop.start() if stop else high]
            return not (any(c in self.corpus.reporting for c in clause) or self.verbs is not None and _REPORTING_UNSPACED.search(clause))
        if not gap and lead.isalpha() and _uncased(lead):
            return False
        # a title or an initial doesn't end the reporting clause
        words: list[str] = []
        at = j
        while at < high:
            while at < high and text[at].isspace():
                at += 1
            end = at
            while end < high and not text[end].isspace():
                end += 1
            word = text[at:end].rstrip("\"”»’'")
            words.append(word)
            at = end
            if word[-1:] and word[-1] in TERMINATORS and not (word[-1] == "." and (len(word) == 2 or self._abbreviation(word[:-1]))):
                break
        if any(w.strip(_EDGES).lower() in self.corpus.reporting for w in words):
            return False
        if self.cased and len(words) > 1:
            first = words[0]
            named = first[-1] == "." and self._abbreviation(first[:-1]) or first[-1].isalpha() and lead.isupper() and not self._common(first)
            if named and any(w.islower() for w in words[1:4]):
                return False
        window = " ".join(words)
        return self.verbs is None or not (self.verbs.search(window) or _HINDI_REPORT.search(window))

    def _lost_space(self, a: int, j: int, lead: str) -> bool:
        """A period with no space after it ends a sentence between a word and a capitalised one, or between scripts."""
        text = self.text
        before = text[a - 1] if a else ""
        if text[j] in "\"“«「『(（¿¡":
            return before.isdigit() or before.isalpha() and (a < 2 or text[a - 2].isalpha())
        if not text[j].isalpha():
            return False
        if _uncased(lead):
            return before.isalpha() or before.isdigit() and len(self._token(a)) < a - self.current or _unspaced(lead) and not before.isdigit()
        if not lead.isupper() or not self.cased:
            return False
        following = _WORD.match(text, j)
        token = self._token(a)
        if len(following.group()) < 2 and text[j + 1 : j + 2] == "." and (token.islower() and token.isalpha() and len(token) > 2 or token.isdigit() or before in CLOSERS):
            return True  # a sentence that starts with an initial
        if len(following.group()) < 2 and not (j + 1 < len(text) and text[j + 1].isspace()) and text[j + 1 : j + 2] not in ("'", "’", "-"):
            return False
        if following.group().isupper() and len(following.group()) > 1:
            return False
        if "." in token and token.replace(".", "").isalpha():
            if token.islower():
                return len(token.split(".")[-1]) == 1 and self._common(following.group())
            return self._common(following.group())
        if self._abbreviation(token):
            return False
        return before.isdigit() or before.isalpha() and len(token) >= 2 or before in CLOSERS + "%"

    def _token(self, a: int) -> str:
        """The word or number before position a, with the periods inside it."""
        text, low = self.text, max(self.current, a - 40)
        i = a
        while i > low and (c := text[i - 1]) not in TOKEN_STOPS and not c.isspace():
            i -= 1
        return text[i:a]

    def _period_ends(self, current: int, a: int, j: int, f: int, lead: str) -> bool:
        text = self.text
        token = self._token(a)
        start = a - len(token)
        word = token.lower()
        if start <= current or not text[current:start].strip("(（[\"“«„‘ "):
            if token.isdigit() and len(token) <= 4 or len(token) == 1 or ROMAN.match(token) and token.isupper():
                return False  # an enumerator, or an initial
            if "." in token and token.replace(".", "").isupper() and len(token) <= 5:
                return False
        if not token:
            return True
        if token.isdigit():
            if len(token) <= 2 and lead.isupper():
                previous = self._token(start - 1) if start > 0 else ""
                if previous and previous.lower() in self.ordinals and not self._follows_common(f):
                    return False
            return True
        if "." in token and not token[0].isdigit():
            if token.isupper():
                return True
            if word in ("a.m", "p.m"):  # a zone may follow
                return not _TIME.match(text, j)
            if lead.isdigit() or self.cased and lead.isupper():
                return "\n" in text[a:j] and lead.isdigit() or self._follows_common(f)
            return not lead.isdigit()
        last = token[-1]
        if "ऀ" <= last <= "ॿ":
            return not self.danda and len(token) > 3
        if "԰" <= last <= "֏" and self.verjaket:
            return False
        if len(token) == 1 and token.isalpha():
            if _uncased(token):
                return True
            return self._follows_common(f) and not (token.isupper() and self._initial_before(start))
        number = lead.isdigit()
        if self._abbreviation(token, number) or not token.isalpha() and self._abbreviation(_JOINED.split(token)[-1], number):
            return self.cased and lead.isalpha() and self._follows_common(f)
        return True

    def _initial_before(self, start: int) -> bool:
        """Another initial or a title stands before this one, so a surname follows."""
        before = self.text[max(0, start - 6) : start].rstrip()
        return before.endswith(".")

    def _follows_common(self, f: int) -> bool:
        """The word at f begins a sentence: it is common, and no initial."""
        m = _WORD.match(self.text, f)
        return bool(m) and (not self.cased or self._common(m.group()) and not (m.end() - f == 1 and self.text[m.end() : m.end() + 1] == "."))


# -- corpus counts ---------------------------------------------------------------------------------------------

#: Evidence asked for: places at least, share of a word's periods inside a sentence, share of a capitalised word's
#: occurrences that have a period (twice the places for each letter over four), most of an abbreviation's periods that
#: end a paragraph, share of lower-case occurrences of a
#: common word, places of ordinals, share of a reporting word's occurrences beside quotations.
MIN_USES = 5
INSIDE = 0.3
WITH_PERIOD = 0.95
ENDED = 0.01
COMMON = 0.25
ORDINALS = 20
BESIDE = 0.1
#: Words rarer than this share of all words are left to the evidence of their documents, so that what is sent to the
#: workers has at most a million words of each kind, whatever the size of the corpus.
RARE = 1e-6

_COUNTS = ("uses", "inside", "ended", "number", "final", "quoted", "total")


def word_counts(df: DataFrame, text_column: str) -> DataFrame:
    """Per word as it is written: ``uses`` (before a period), ``inside`` (before a period inside a sentence), ``ended``
    (before a period at the end of a paragraph), ``number`` (before a short number with a period) and how many of those
    ``final`` (before no letter), ``quoted`` (beside a quotation) and ``total``. Characters of unspaced scripts count as words where they stand beside quotations.

    Texts in one case don't tell where sentences begin and are left out. Every batch counts all its words, so the
    counts don't depend on batches; they are summed before the shuffle.
    """
    schema = "word string, " + ", ".join(f"{c} long" for c in _COUNTS)

    def count(text: str, made: dict[str, Counter]) -> None:
        uses, inside, ended, number, final, quoted = (made[c] for c in _COUNTS[:6])
        for m in _PERIOD.finditer(text):
            a = m.start()
            low = max(text.rfind(" ", max(0, a - 40), a), text.rfind("\n", max(0, a - 40), a)) + 1
            token, follower = text[low:a], m.group(2)
            if not token.isalpha():
                token = token.strip(_EDGES)
                if token.isdigit() and len(token) < 3 and follower is not None:
                    before = text[max(0, low - 40) : low].split()
                    if before and before[-1].isalpha():
                        number[before[-1].lower()] += 1
                        if not follower.isalpha() or m.group(1).count("\n") > 1:
                            final[before[-1].lower()] += 1
                    continue
                if not token.isalpha():
                    continue
            uses[token] += 1
            if follower is None or follower.islower() or follower.isdigit() and not _uncased(token[0]):
                inside[token] += 1
            elif not follower or m.group(1).count("\n") > 1:
                ended[token] += 1
        for m in _NEAR_QUOTE.finditer(text):
            if m.group()[0] in ":：,，":
                word = _LAST_WORD.search(text[max(0, m.start() - 40) : m.start()].rstrip())
            else:
                word = _WORD.match(text, m.end())
                if word and not word.group().islower() and not _uncased(word.group()[0]):
                    continue
            if word:
                last = word.group()[-1]
                quoted[last if _unspaced(last) else word.group().lower()] += 1
        made["total"].update(_WORD.findall(text))
        made["total"].update(_IDEOGRAPH.findall(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, Counter] = {c: Counter() for c in _COUNTS}
            part, size = [], 0
            for t in batch.column(0).to_pylist():
                if t and t != t.lower() and t != t.upper() or t and _IDEOGRAPH.search(t):
                    part.append(t)
                    size += len(t)
                if size > 1 << 20:
                    # a few texts at a time, parted by blank lines
                    count("\n\n".join(part), made)
                    part, size = [], 0
            count("\n\n".join(part), made)
            words = list(set().union(*made.values()))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([made[c][w] for w in words], pa.int64()) for c in _COUNTS]], names=["word", *_COUNTS])

    parts = df.select(text_column).where(F.col(text_column).isNotNull()).mapInArrow(run, schema)
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def corpus_evidence(df: DataFrame, text_column: str) -> Corpus:
    """What the counts over all texts show. The same shares decide at every size; see RARE for the bound."""
    counts = cut(word_counts(df, text_column))
    word, low = F.col("word"), F.lower("word")
    uses, inside, total = F.col("uses"), F.col("inside"), F.col("total")
    capital = (F.left(word, F.lit(1)) != F.lower(F.left(word, F.lit(1)))) & ((F.char_length(word) == 1) | (word != F.upper(word)))
    places = MIN_USES * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.char_length(word) - 4))
    marked = (inside >= MIN_USES) & (inside >= INSIDE * uses) | capital & (uses >= places) & (uses >= WITH_PERIOD * total)
    abbreviations = marked & (F.col("ended") <= ENDED * uses)
    every = counts.agg(F.coalesce(F.sum("total"), F.lit(0))).head()[0]
    listed = counts.where(F.greatest("uses", "number", "quoted") >= RARE * every)
    kinds = listed.select(
        word, abbreviations.alias("a"), ((F.col("number") >= ORDINALS) & (F.col("final") <= 0.01 * F.col("number"))).alias("o"), ((F.col("quoted") >= MIN_USES) & (F.col("quoted") >= BESIDE * total)).alias("q")
    ).where("a or o or q")
    found = kinds.collect()
    forms = counts.groupBy(low.alias("word")).agg(F.sum(F.when(word == low, total)).alias("small"), F.sum(F.when(word != low, total)).alias("large"))
    usual = forms.where((F.col("small") >= MIN_USES) & (F.col("large") >= MIN_USES) & (F.col("large") >= RARE * every) & (F.col("small") >= COMMON * (F.col("small") + F.col("large"))))
    common = frozenset(r[0] for r in usual.select("word").collect())
    return Corpus(frozenset(r["word"] for r in found if r["a"]), common, frozenset(r["word"] for r in found if r["o"]), frozenset(r["word"] for r in found if r["q"]))


def split_sentences(df: DataFrame, id_column: str, text_column: str, corpus: Corpus, *, texts: bool = True) -> DataFrame:
    """One row per sentence: the id, sent_no from 1, sent_start, sent_end (code points, end exclusive) and (``texts``) sentence.

    Null, empty and blank texts give no row. Repeated documents are split one by one. Nothing is shuffled.
    """
    fields = [T.StructField(id_column, df.schema[id_column].dataType)] + [T.StructField(n, T.IntegerType()) for n in ("sent_no", "sent_start", "sent_end")]
    fields += [T.StructField("sentence", T.StringType())] if texts else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(corpus)
        for batch in batches:
            source: list[int] = []
            number: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            parts: list[str] = []
            for r, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                spans = splitter.spans(text)
                source += [r] * len(spans)
                number += range(1, len(spans) + 1)
                starts += [s for s, _ in spans]
                ends += [e for _, e in spans]
                if texts:
                    parts += [text[s:e] for s, e in spans]
            columns = [batch.column(0).take(pa.array(source, pa.int32())), *[pa.array(x, pa.int32()) for x in (number, starts, ends)]]
            if texts:
                columns.append(pa.array(parts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(F.col(id_column), F.col(text_column)).where(F.col(text_column).isNotNull()).mapInArrow(run, T.StructType(fields))
