"""Text features as column expressions; only normal forms of Unicode leave the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Term dictionaries for topic salience.
DICTIONARIES: dict[str, tuple[str, ...]] = {
    "trust_dialogue_salience": ("trust", "trustworthy", "dialogue", "consensus", "reconciliation", "mutual understanding", "common ground", "peaceful coexistence", "good faith"),
    "trust_erosion": ("lack of trust", "absence of trust", "loss of trust", "erosion of trust", "decline of trust", "distrust", "mistrust", "trust deficit", "crisis of confidence"),
    "cooperation_partnership": (
        "cooperation", "co-operation", "cooperate", "cooperates", "cooperating", "cooperative", "collaboration", "collaborate", "collaborative", "partnership", "partnerships", "solidarity",
        "collective action", "shared responsibility",
    ),
    "security_threat_salience": (
        "threat", "threats", "threaten", "threatened", "aggression", "conflict", "conflicts", "armed conflict", "war", "wars", "warfare", "military", "militarization", "militarisation", "weapon",
        "weapons", "arms race", "invasion", "attack", "attacks", "terrorism", "terrorist", "violence", "violent", "hostility", "occupation", "genocide", "armed forces",
    ),
    "multilateral_substantive": (
        "un charter", "charter of the united nations", "security council", "international law", "rule of law", "multilateral", "multilateralism", "peacekeeping", "international criminal court",
        "international court of justice", "world bank", "international monetary fund", "world trade organization", "world trade organisation", "world health organization",
        "world health organisation", "global governance",
    ),
    "un_genre_mentions": ("united nations", "general assembly"),
    "transformation_change": (
        "transform", "transforms", "transformation", "transformative", "transition", "transitions", "innovation", "innovative", "digitalization", "digitalisation", "artificial intelligence",
        "modernization", "modernisation", "adaptation", "resilience", "green transition", "energy transition", "climate transition", "structural change",
    ),
    "reform_salience": ("reform", "reforms", "reformed", "reforming"),
}
DICTIONARY_VERSION = "milestone-1-v1"
#: "trust" is no mention of trust before these.
TRUST_EXCEPT = r"(?!\s+(?:that|funds?|territor(?:y|ies))(?![\p{L}\p{N}_]))"
# Words of the chair before and after a speech, cut from the speeches of one year.
INTRO = r"(?is)^.{0,900}?\b(?:invite|invited)\s+(?:him|her|his excellency|her excellency|his majesty|her majesty)\s+to\s+(?:address|speak before)\s+(?:the\s+)?assembly\s*[.!?]\s*"
OUTRO = r"(?is)\b(?:and\s+)?on behalf of (?:the\s+)?(?:general\s+)?assembly\s*,?\s*i\s+(?:wish to\s+)?thank\b"
BOILERPLATE_YEAR = 2025
OUTRO_REACH = 1500
# Groups of posts, tried in this order on the normalised post.
POST_GROUPS = (
    ("head_of_government", r"\b(prime minister|head of government|chancellor)\b"),
    ("head_of_state", r"\b(president|king|queen|emir|amir|prince|head of state)\b"),
    ("foreign_minister", r"\b(foreign affairs|external affairs|foreign minister)\b"),
    ("representative", r"\b(representative|delegation|ambassador)\b"),
)
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:[-’'][\p{L}\p{Nl}\p{No}]+)*"
SPACE = r"[\s\p{Z}\u001c-\u001f\u0085]+"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"))


def normalise_name(c: Column) -> Column:
    """ASCII letters and digits in lower case, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(_ascii(c)), "[^a-z0-9]+", " "))


def occurrences(c: Column, what: str) -> Column:
    return (F.char_length(c) - F.char_length(F.replace(c, F.lit(what), F.lit("")))) / F.lit(len(what))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean_speech(df: DataFrame, text: str, year: str) -> DataFrame:
    """Adds speech_clean, what was removed, and counts of byte-order marks, soft hyphens and replacement characters.

    Null texts become empty ones. The chair's words are cut in BOILERPLATE_YEAR alone, the closing ones only
    where they begin in the last OUTRO_REACH characters.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("bom_count", occurrences(raw, "﻿").cast("int")).withColumn("soft_hyphen_count", occurrences(raw, "­").cast("int")).withColumn("replacement_character_count", occurrences(raw, "�").cast("int"))
    joined = F.replace(F.replace(nfkc(raw), F.lit("﻿"), F.lit("")), F.lit("­"), F.lit(""))
    joined = F.regexp_replace(F.regexp_replace(joined, "\r\n?", "\n"), r"-[ \t]*\n[ \t]*", "-")
    out = out.withColumn("__t", joined)
    chair = F.col(year) == BOILERPLATE_YEAR
    intro = F.when(chair, F.char_length(F.regexp_extract("__t", INTRO, 0))).otherwise(0)
    out = out.withColumn("__intro", intro).withColumn("__t", F.expr("substring(__t, __intro + 1)"))
    tail = F.expr(f"substring(__t, greatest(0, char_length(__t) - {OUTRO_REACH}) + 1)")
    at = F.when(chair, F.regexp_instr(tail, F.lit(OUTRO))).otherwise(0)
    out = out.withColumn("__o", at).withColumn("__keep", F.expr(f"CASE WHEN __o > 0 THEN greatest(0, char_length(__t) - {OUTRO_REACH}) + __o - 1 ELSE char_length(__t) END"))
    out = out.withColumn("removed_characters", F.col("__intro") + F.char_length("__t") - F.col("__keep"))
    out = out.withColumn("intro_removed", F.col("__intro") > 0).withColumn("outro_removed", F.col("__o") > 0)
    out = out.withColumn("speech_clean", collapse_space(F.expr("substring(__t, 1, __keep)")))
    return out.drop("__t", "__intro", "__o", "__keep")


def word_count(c: Column) -> Column:
    """Words of letters with inner hyphens and apostrophes, in any script."""
    return F.regexp_count(F.lower(c), F.lit(WORD))


def dictionary_pattern(terms: Sequence[str]) -> str:
    r"""Terms as a Java pattern for text in lower case: longest first, \s+ for spaces, whole words.

    The first letters are looked at before anything else, as most places of a text end there.
    """
    parts = []
    for term in sorted(set(terms), key=lambda t: (-len(t), t)):
        escaped = r"\s+".join(re.sub(r"([^\w])", r"\\\1", w) for w in term.lower().split(" "))
        parts.append(escaped + (TRUST_EXCEPT if term == "trust" else ""))
    first = "".join(sorted({t[0].lower() for t in terms}))
    return rf"(?=[{first}])(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(parts)})(?![\p{{L}}\p{{N}}_])"


def dictionary_count(c: Column, category: str) -> Column:
    return F.regexp_count(F.lower(c), F.lit(dictionary_pattern(DICTIONARIES[category])))


def per_thousand(count: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, F.lit(1000.0) * count / tokens)


def repaired(c: Column, repairs: dict[str, str]) -> Column:
    """Trimmed text, with cells known to be corrupted replaced by what they stood for; null stays null."""
    own = F.create_map(*[F.lit(x) for kv in repairs.items() for x in kv])
    return F.coalesce(F.try_element_at(own, F.trim(c)), F.trim(c)) if repairs else F.trim(c)


def post_group(c: Column) -> Column:
    """The first group whose words occur in the post; 'unknown' for null or blank, else 'other'."""
    name = normalise_name(c)
    out = F.when(c.isNull() | (F.trim(c) == ""), "unknown")
    for group, pattern in POST_GROUPS:
        out = out.when(name.rlike(pattern), group)
    return out.otherwise("other")


def simple_sentences(c: Column) -> Column:
    """Array of stretches between . ! or ? and white space."""
    return F.split(c, r"(?<=[.!?])\s+")


def basic_clean(c: Column) -> Column:
    """Lower-case ASCII letters and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z\s]", " "), r"\s+", " "))


def content_words(c: Column, stopwords: Sequence[str], longer_than: int = 2) -> Column:
    """Words of a cleaned text without stopwords and short words."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(F.split(basic_clean(c), " "), lambda w: (F.length(w) > longer_than) & ~F.array_contains(stop, w))


def context_review(df: DataFrame, text: str, key: str, strata: Sequence[str], *, categories: Sequence[str] = tuple(DICTIONARIES), per_cell: int = 4, seed: str = "c1", length: int = 600) -> DataFrame:
    """Sentences with a term of each category, ``per_cell`` for each category and stratum, by seeded hash.

    Result: category, the strata, the key, sentence_no, term (the first found), context and pick.
    """
    from quern.operators.windows import hash_sample

    rows = df.where(F.col(text).isNotNull()).select(key, *strata, F.posexplode(simple_sentences(F.col(text))).alias("sentence_no", "sentence"))
    terms = [F.struct(F.lit(c).alias("category"), F.regexp_substr(F.lower("sentence"), F.lit(dictionary_pattern(DICTIONARIES[c]))).alias("term")) for c in categories]
    found = rows.withColumn("__t", F.explode(F.filter(F.array(*terms), lambda t: t["term"].isNotNull()))).select(
        "__t.category", *strata, key, "sentence_no", "__t.term", F.left("sentence", F.lit(length)).alias("context")
    )
    return hash_sample(found, ["category", *strata], F.concat_ws(":", F.col(key).cast("string"), F.col("sentence_no").cast("string")), per_cell, seed)
