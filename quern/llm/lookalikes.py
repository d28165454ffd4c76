"""One consistent form for text that looks the same but differs in its characters.

A transducer is compiled once per process from rules, a small table and the confusable letters that Unicode publishes,
and checked for conflicts. Its keys have one code point or several: letters with their marks, whatever script the
letter is of, half-width letters with their voice marks, conjoining syllables. It is applied in one pass over the
grapheme clusters of each text, the longest key first; clusters met before are answered from its memory.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts that print like a Latin letter; they go before what Unicode publishes.
LOOKALIKES = {
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һհ", "i": "і", "j": "ј", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "р", "q": "ԛ",
    "s": "ѕ", "u": "ս", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ",
    "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
}
#: Hyphens that print like the hyphen-minus.
HYPHENS = "‐‑"
#: Format characters that are visible, against the rule for their category.
VISIBLE_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢"
#: Characters outside that category that print nothing.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
#: Decompositions that change width or joining but not the letters.
SAME_LETTERS = ("<wide>", "<narrow>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Runs of clusters that are remembered by a process; beyond, they are computed again.
REMEMBERED = 200_000

_RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
_CLUSTER = regex.compile(r"\X")


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Letters that Unicode publishes as confusable with one Latin letter (from the ICU library that comes with Spark).

    Only cased letters of another script and of the same case count, as case makes a visible difference. If several
    letters of a script would become the same letter, none does, as they differ from each other.
    """
    points = [p for p in range(0x80, 0x20000) if unicodedata.category(chr(p)) in ("Lu", "Ll") and not unicodedata.decomposition(chr(p)) and "LATIN" not in unicodedata.name(chr(p), "LATIN")]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = string.ascii_letters
    skeletons = checker.getSkeleton("\n".join([*letters, *map(chr, points)])).split("\n")
    own: dict[str, list[str]] = defaultdict(list)
    for letter, skeleton in zip(letters, skeletons):
        own[skeleton].append(letter)
    claims: dict[tuple[str, str], list[str]] = defaultdict(list)
    for p, skeleton in zip(points, skeletons[len(letters) :]):
        ch = chr(p)
        same_case = [x for x in own.get(skeleton, ()) if x.isupper() == ch.isupper()]
        if len(same_case) == 1:
            claims[unicodedata.name(ch).split()[0], same_case[0]].append(ch)
    return {found[0]: letter for (_, letter), found in claims.items() if len(found) == 1}


class Rules:
    """The compiled mapping, conflict-checked: no result is mapped further, and rules never disagree.

    ``single`` maps code points, ``keys`` code points and sequences of them as they stand in decomposed text, and
    ``active`` finds the characters that may change or join with others; text without them is its own form.
    """

    def __init__(self, confusable: Mapping[str, str]) -> None:
        single: dict[str, str] = {}

        def add(key: str, to: str) -> None:
            if single.setdefault(key, to) != to:
                raise ValueError(f"conflicting rules for U+{ord(key):04X}")

        taken: dict[tuple[str, str], str] = {}
        for latin, others in LOOKALIKES.items():
            for other in others:
                add(other, latin)
                taken[unicodedata.name(other).split()[0], latin] = other
        for h in HYPHENS:
            add(h, "-")
        for ch in INVISIBLE:
            add(ch, "")
        fixed = set(single)
        for other, latin in confusable.items():
            if other not in fixed and (unicodedata.name(other).split()[0], latin) not in taken:
                add(other, latin)
        composites: list[str] = []
        for point in range(0x80, 0x110000):
            ch = chr(point)
            if ch in fixed:
                continue
            kind = unicodedata.category(ch)
            if kind == "Zs":
                add(ch, " ")
            elif kind == "Cf" and ch not in VISIBLE_FORMATS or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
                add(ch, "")
            elif 0xAC00 <= point <= 0xD7A3:
                composites.append(ch)
            elif parts := unicodedata.decomposition(ch):
                tag = parts.split(" ", 1)[0]
                if tag[0] != "<":
                    composites.append(ch)
                    continue
                plain = unicodedata.normalize("NFKD", ch)
                letters = tag == "<compat>" and kind[0] == "L" and len(plain) > 1 and all(unicodedata.category(x)[0] in "LM" for x in plain) and "ʼ" not in plain
                if tag in SAME_LETTERS or letters:
                    if " " not in plain or tag in ("<wide>", "<narrow>"):
                        add(ch, "".join(single.get(x, x) for x in plain))
        self.single = single
        self.keys = dict(single)
        # letters with marks: by their decomposition, with the letter or mark itself or any that is mapped to it
        alike: dict[str, list[str]] = defaultdict(list)
        for other, to in single.items():
            if len(to) == 1:
                alike[to].append(other)
        changed = []
        for ch in composites:
            key = unicodedata.normalize("NFD", ch)
            to = unicodedata.normalize("NFC", "".join(single.get(x, x) for x in key))
            variants = [""]
            for x in key:
                variants = [v + y for v in variants for y in (x, *alike.get(x, ()))]
            for v in variants:
                if self.keys.setdefault(v, to) != to:
                    raise ValueError(f"conflicting rules for {[hex(ord(x)) for x in v]}")
            if to != ch:
                changed.append(ch)
        self.longest = max(map(len, self.keys))
        for key, to in self.keys.items():
            if any(x in single for x in unicodedata.normalize("NFD", to)):
                raise ValueError(f"the result of {[hex(ord(x)) for x in key]} is itself mapped")
        joining = "\u1160-\u11ff\ud7b0-\ud7ff"
        marks = "".join(chr(p) for p in range(0x300, 0x10000) if unicodedata.category(chr(p))[0] == "M")
        # beyond the first plane one range, as a pattern looks up a set of the first plane alone
        first_plane = "".join(x for x in [*single, *changed] if x < "\U00010000")
        self.active = re.compile("[" + joining + re.escape(first_plane + marks) + "\U00010000-\U0010ffff]")


@lru_cache(maxsize=2)
def compiled(confusable: tuple[tuple[str, str], ...] = ()) -> Rules:
    """The rules, made once per process for each table of confusable letters."""
    return Rules(dict(confusable))


class Transducer:
    """Maps a text to its consistent form; the form of a form is itself."""

    def __init__(self, confusable: Mapping[str, str] | None = None) -> None:
        self.rules = compiled(tuple(sorted((confusable or {}).items())))
        self.memory: dict[str, str] = {}

    def cluster(self, cluster: str) -> str:
        """A grapheme cluster: what is invisible is dropped, then the longest keys are replaced, until none is left."""
        single, keys, longest = self.rules.single, self.rules.keys, self.rules.longest
        while True:
            parts = unicodedata.normalize("NFD", "".join(x for x in unicodedata.normalize("NFD", cluster) if single.get(x) != ""))
            out, i = [], 0
            while i < len(parts):
                for k in range(min(longest, len(parts) - i), 0, -1):
                    if (to := keys.get(parts[i : i + k])) is not None:
                        out.append(to)
                        break
                else:
                    out.append(parts[i])
                i += k
            made = "".join(out)
            if made == cluster:
                return made
            cluster = made

    def run(self, run: str) -> str:
        """A run of clusters."""
        if (known := self.memory.get(run)) is not None:
            return known
        if self.rules.active.search(run) is None:
            return run
        out, visible = run, ""
        while out != visible:  # what is dropped may bring clusters together, and what is parted may be several
            visible, out = out, "".join(map(self.cluster, _CLUSTER.findall(out)))
        if len(self.memory) < REMEMBERED and len(run) <= 64:
            self.memory[run] = out
        return out

    def __call__(self, text: str) -> str:
        if text.isascii() or self.rules.active.search(text) is None:
            return text
        return _RUN.sub(lambda m: self.run(m.group()), text)


def consistent_form(df: DataFrame, id_column: str, text_column: str, *, texts: bool = True, confusable: Mapping[str, str] | None = None) -> DataFrame:
    """The id, (``texts``) consistent_text, and 128-bit digests of the consistent and the stored text.

    Null texts keep null forms and digests; the empty text is its own form. Nothing is shuffled. ``confusable`` goes
    in place of the letters that Unicode publishes.
    """
    letters = dict(confusable_letters(df.sparkSession) if confusable is None else confusable)
    fields = [T.StructField(id_column, df.schema[id_column].dataType)]
    fields += ([T.StructField("consistent_text", T.StringType())] if texts else []) + [T.StructField("form", T.BinaryType()), T.StructField("stored", T.BinaryType())]

    def digest(text: str | None) -> bytes | None:
        return None if text is None else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transduce = Transducer(letters)
        for batch in batches:
            texts_in = batch.column(1).to_pylist()
            forms = [None if t is None else transduce(t) for t in texts_in]
            stored = [digest(t) for t in texts_in]
            columns = [batch.column(0)] + ([pa.array(forms, pa.string())] if texts else [])
            columns += [pa.array([s if f is t or f == t else digest(f) for f, t, s in zip(forms, texts_in, stored)], pa.binary()), pa.array(stored, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, T.StructType(fields))


def equal_looking_pairs(forms: DataFrame, id_column: str, names: tuple[str, str]) -> DataFrame:
    """Pairs of ids, the smaller first, whose texts share a form but are stored differently.

    Distinct stored texts of a form are paired first, and only those pairs meet the rows that hold them, so
    copies of one text are never compared with each other, however many there are.
    """
    rows = forms.where("form is not null").select(id_column, "form", "stored")
    # one row per form and stored text; forms with a single stored text, nearly all, end here
    variants = rows.groupBy("form", "stored").agg(F.count(F.lit(1)).alias("copies"))
    several = variants.groupBy("form").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select("form")
    varied = variants.join(several, "form").select("form", "stored")
    pairs = varied.select("form", F.col("stored").alias("s1")).join(varied.select("form", F.col("stored").alias("s2")), "form").where("s1 < s2").select("s1", "s2")
    one = rows.select(F.col(id_column).alias("i1"), F.col("stored").alias("s1"))
    two = rows.select(F.col(id_column).alias("i2"), F.col("stored").alias("s2"))
    met = pairs.join(one, "s1").join(two, "s2")
    return met.select(F.least("i1", "i2").alias(names[0]), F.greatest("i1", "i2").alias(names[1]))
