"""Queries on texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Function words of English for the content-word query.
STOPWORDS = ("the", "and", "that", "with", "for", "was", "this", "from", "are", "its", "not", "has", "have", "but", "our", "which", "all")
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:[-’''][\p{L}\p{Nl}\p{No}]+)*"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _speeches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "speeches")


@query(rf"SELECT speech_id, CAST(len(regexp_extract_all(lower(speech_clean), '{WORD}')) AS INTEGER) AS tokens FROM speeches")
def text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _speeches(spark, folder).select("speech_id", text.word_count(F.col("speech_clean")).alias("tokens"))


#: For an engine without look-arounds: "trust" before the words that except it is spoilt first.
_MASKED = r"regexp_replace(lower({c}), '(^|[^\p{{L}}\p{{N}}_])trust(\s+(?:that|funds?|territor(?:y|ies))(?:$|[^\p{{L}}\p{{N}}_]))', '\1tru_st\2', 'g')"


def _terms(category: str) -> list[str]:
    return sorted(set(text.DICTIONARIES[category]), key=lambda t: (-len(t), t))


def _sql_count(category: str) -> str:
    """Counts without look-arounds: everything but letters, digits and underscores is doubled, so that neighbouring terms share no mark."""
    pattern = "|".join(t.replace("-", r"\-\-").replace(" ", r"\s+") for t in _terms(category))
    masked = _MASKED.format(c="speech_clean")
    return rf"len(regexp_extract_all(regexp_replace(' ' || {masked} || ' ', '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '[^\p{{L}}\p{{N}}_](?:{pattern})[^\p{{L}}\p{{N}}_]'))"


@query("SELECT speech_id, " + ", ".join(f"CAST({_sql_count(c)} AS INTEGER) AS {c}" for c in text.DICTIONARIES) + " FROM speeches WHERE speech_clean IS NOT NULL")
def text_dict_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of all eight dictionaries in every speech."""
    rows = _speeches(spark, folder).where("speech_clean is not null")
    return rows.select("speech_id", *[text.dictionary_count(F.col("speech_clean"), c).alias(c) for c in text.DICTIONARIES])


@query("SELECT speech_id, tokens, " + ", ".join(f"n_{c} AS dict_{c}_count, CASE WHEN tokens > 0 THEN round(1000.0 * n_{c} / tokens, 6) END AS dict_{c}_per_1k" for c in text.DICTIONARIES) + f", '{text.DICTIONARY_VERSION}' AS dictionary_version FROM (SELECT speech_id, CAST(len(regexp_extract_all(lower(speech_clean), '{WORD}')) AS INTEGER) AS tokens, "
       + ", ".join(f"CAST({_sql_count(c)} AS INTEGER) AS n_{c}" for c in text.DICTIONARIES) + " FROM speeches WHERE speech_clean IS NOT NULL)")
def text_dict_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of all dictionaries per thousand words."""
    c = F.col("speech_clean")
    rows = _speeches(spark, folder).where("speech_clean is not null").withColumn("tokens", text.word_count(c))
    counted = rows.select("speech_id", "tokens", *[text.dictionary_count(c, k).alias(f"dict_{k}_count") for k in text.DICTIONARIES])
    rates = [F.round(text.per_thousand(F.col(f"dict_{k}_count"), F.col("tokens")), 6).alias(f"dict_{k}_per_1k") for k in text.DICTIONARIES]
    return counted.select("*", *rates, F.lit(text.DICTIONARY_VERSION).alias("dictionary_version"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM documents")
def text_basic_clean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.basic_clean(F.col("text")).alias("cleaned"))


@query(r"""SELECT doc_id, CAST(len(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in STOPWORDS) + r"""))) AS INTEGER) AS words FROM documents WHERE text IS NOT NULL""")
def text_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", F.size(text.content_words(F.col("text"), STOPWORDS)).alias("words"))


@query(r"""SELECT speech_id, CAST(len(regexp_extract_all(speech_clean, '[.!?]\s+')) + 1 AS INTEGER) AS sentences FROM speeches WHERE speech_clean IS NOT NULL""")
def text_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = _speeches(spark, folder).where("speech_clean is not null")
    return rows.select("speech_id", F.size(text.simple_sentences(F.col("speech_clean"))).alias("sentences"))


@query("SELECT speech_id, sha256(speech_clean) AS text_hash FROM speeches")
def text_sha256(spark: SparkSession, folder: str) -> DataFrame:
    return _speeches(spark, folder).select("speech_id", F.sha2("speech_clean", 256).alias("text_hash"))


@query(r"""SELECT speech_id, CAST(length(t) - length(replace(t, chr(65279), '')) AS INTEGER) AS bom_count, CAST(length(t) - length(replace(t, chr(173), '')) AS INTEGER) AS soft_hyphen_count,
CAST(length(t) - length(replace(t, chr(65533), '')) AS INTEGER) AS replacement_character_count FROM (SELECT speech_id, coalesce(speech_clean, '') AS t FROM speeches)""")
def text_clean_flags(spark: SparkSession, folder: str) -> DataFrame:
    out = text.clean_speech(_speeches(spark, folder).select("speech_id", F.col("speech_clean").alias("raw"), "year"), "raw", "year")
    return out.select("speech_id", "bom_count", "soft_hyphen_count", "replacement_character_count")


def text_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned speeches with what was removed."""
    out = text.clean_speech(_speeches(spark, folder).select("speech_id", F.col("speech_clean").alias("raw"), "year"), "raw", "year")
    return out.drop("raw")


@query("SELECT score_id, json_extract_string(payload, '$.entity_id') AS entity_id, CAST(json_extract(payload, '$.chunk_count') AS INTEGER) AS chunk_count, CAST(json_extract(payload, '$.token_coverage') AS DOUBLE) AS token_coverage FROM scores WHERE payload IS NOT NULL AND json_valid(payload)")
def json_payload(spark: SparkSession, folder: str) -> DataFrame:
    from quern.operators.reshape import payload

    rows = table(spark, folder, "scores").select("score_id", payload(F.col("payload")).alias("p")).where("p.text_hash is not null or p.chunks is not null")
    return rows.select("score_id", "p.entity_id", "p.chunk_count", "p.token_coverage")


_FIRST = ", ".join(
    rf"regexp_extract({_MASKED.format(c='sentence')}, '(?:^|[^\p{{L}}\p{{N}}_])(" + "|".join(t.replace("-", r"\-").replace(" ", r"\s+") for t in _terms(c)) + r")(?:$|[^\p{L}\p{N}_])', 1)"
    for c in text.DICTIONARIES
)


@query(r"""WITH s AS (SELECT speech_id, CASE WHEN year > 1989 AND year <= 2001 THEN '1990-2001' WHEN year > 2001 AND year <= 2013 THEN '2002-2013' WHEN year > 2013 AND year <= 2025 THEN '2014-2025' END AS period, generate_subscripts(a, 1) - 1 AS sentence_no, unnest(a) AS sentence FROM
(SELECT speech_id, year, string_split_regex(regexp_replace(speech_clean, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM speeches WHERE speech_clean IS NOT NULL)),
m AS (SELECT speech_id, period, sentence_no, sentence, unnest([""" + ", ".join(f"'{c}'" for c in text.DICTIONARIES) + "]) AS category, unnest([" + _FIRST + """]) AS term FROM s WHERE period IS NOT NULL),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY category, period ORDER BY md5('c1' || speech_id || ':' || sentence_no)) AS INTEGER) AS pick FROM m WHERE term <> '')
SELECT category, period, speech_id, CAST(sentence_no AS INTEGER) AS sentence_no, term, left(sentence, 600) AS context, pick FROM p WHERE pick <= 4""")
def text_context_review(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with a term of each dictionary, four for each dictionary and period, by seeded hash."""
    from quern.operators.reshape import right_closed

    rows = _speeches(spark, folder).withColumn("period", right_closed(F.col("year"), [1989, 2001, 2013, 2025], ["1990-2001", "2002-2013", "2014-2025"])).where("period is not null")
    return text.context_review(rows, "speech_clean", "speech_id", ["period"])


def _sql_compatible(column: str) -> str:
    """Compatibility forms by rule: characters with one plain character are translated, those with several replaced."""
    one, many = [], []
    for p in [*range(0xA0, 0x250), *range(0x2000, 0x2190), *range(0x3000, 0x3001), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)]:
        parts = unicodedata.decomposition(chr(p))
        if parts.startswith("<"):
            plain = unicodedata.normalize("NFKD", chr(p))
            (one if len(plain) == 1 else many).append((p, plain))
    quoted = lambda t: " || ".join(f"chr({ord(x)})" for x in t)
    out = f"translate({column}, {quoted([chr(p) for p, _ in one])}, {quoted([t for _, t in one])})"
    for p, t in many:
        out = f"replace({out}, chr({p}), {quoted(t)})"
    return out


@query(rf"""SELECT source_name, trim(regexp_replace(lower(regexp_replace(strip_accents(plain), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS normalised
FROM (SELECT source_name, {_sql_compatible("source_name")} AS plain FROM (SELECT source_name FROM ucdp_country_crosswalk UNION SELECT source_name FROM sipri_country_crosswalk))""")
def text_normalise_name(spark: SparkSession, folder: str) -> DataFrame:
    """Every name of both crosswalks in its ASCII form; a null name stays null."""
    names = [table(spark, folder, t).select("source_name") for t in ("ucdp_country_crosswalk", "sipri_country_crosswalk")]
    rows = names[0].unionByName(names[1]).distinct()
    return rows.select("source_name", text.normalise_name(F.col("source_name")).alias("normalised"))


@query("SELECT year, CAST(count(*) AS BIGINT) AS n_rows, quantile_cont(CAST(speech_token_count AS DOUBLE), 0.5) AS median, quantile_cont(CAST(speech_token_count AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(speech_token_count AS DOUBLE), 0.75) AS q75 FROM speeches WHERE speech_token_count IS NOT NULL GROUP BY 1")
def text_length_by_year(spark: SparkSession, folder: str) -> DataFrame:
    from quern.operators.ordered import exact_quantiles

    rows = _speeches(spark, folder).select("year", F.col("speech_token_count").cast("double").alias("n_tokens"))
    return exact_quantiles(rows, ["year"], "n_tokens", {"q25": 0.25, "median": 0.5, "q75": 0.75}).withColumnRenamed("n", "n_rows")


_INTRO_SQL = text.INTRO.replace("'", "''")
_SPACE_SQL = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
_CLEANED = rf"""WITH raw AS (SELECT speech_id, year, coalesce(speech_clean, '') AS t FROM speeches),
form AS (SELECT *, regexp_replace(regexp_replace(replace(replace(nfc_normalize({_sql_compatible("nfc_normalize(t)")}), chr(65279), ''), chr(173), ''), '\r\n?', chr(10), 'g'), '-[ \t]*\n[ \t]*', '-', 'g') AS f FROM raw),
intro AS (SELECT *, CASE WHEN year = {text.BOILERPLATE_YEAR} THEN length(regexp_extract(f, '{_INTRO_SQL}', 0)) ELSE 0 END AS i FROM form),
body AS (SELECT *, substring(f, i + 1) AS b FROM intro),
tail AS (SELECT *, greatest(0, length(b) - {text.OUTRO_REACH}) AS skipped, CASE WHEN year = {text.BOILERPLATE_YEAR} THEN string_split_regex(substring(b, greatest(0, length(b) - {text.OUTRO_REACH}) + 1), '{text.OUTRO}') END AS parts FROM body),
kept AS (SELECT *, CASE WHEN len(parts) > 1 THEN skipped + length(parts[1]) ELSE length(b) END AS keep FROM tail)
SELECT speech_id, year, CAST(length(t) - length(replace(t, chr(65279), '')) AS INTEGER) AS bom_count, CAST(length(t) - length(replace(t, chr(173), '')) AS INTEGER) AS soft_hyphen_count, CAST(length(t) - length(replace(t, chr(65533), '')) AS INTEGER) AS replacement_character_count,
CAST(i + length(b) - keep AS INTEGER) AS removed_characters, i > 0 AS intro_removed, coalesce(len(parts) > 1, false) AS outro_removed, trim(regexp_replace(left(b, keep), '{_SPACE_SQL}', ' ', 'g')) AS speech_clean FROM kept"""
text_cleaned = query(_CLEANED)(text_cleaned)


#: Chunks in SQL: tokens with the white space behind them, whose lengths add up to places; the end of each chunk is
#: looked up from the running maximum of the sentence ends, one chunk after another.
_SPACES = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_SCORED = rf"""WITH RECURSIVE t AS (SELECT speech_id, speech_clean AS txt, regexp_extract_all(speech_clean, '(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]){_SPACES}*') AS a, length(regexp_extract(speech_clean, '^{_SPACES}*', 0)) AS lead FROM speeches WHERE length(speech_clean) > 0),
p AS (SELECT speech_id, lead, generate_subscripts(a, 1) AS k, unnest(a) AS piece, len(a) AS n FROM t),
q AS (SELECT *, length(regexp_replace(piece, '{_SPACES}+$', '')) AS w, lead + coalesce(sum(length(piece)) OVER (PARTITION BY speech_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, lag(piece) OVER (PARTITION BY speech_id ORDER BY k) AS before FROM p),
r AS (SELECT *, max(CASE WHEN (length(piece) > w OR k = n) AND (left(piece, 1) IN ('.', '!', '?') OR w = 1 AND left(piece, 1) IN ('"', '”', '’', chr(39)) AND before IN ('.', '!', '?')) THEN k ELSE 0 END) OVER (PARTITION BY speech_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS near FROM q),
c(speech_id, i, a, b) AS (SELECT speech_id, -1, 0, 0 FROM t WHERE len(t.a) > 0 UNION ALL SELECT c.speech_id, c.i + 1, c.b, CASE WHEN c.b + 480 >= r.n THEN r.n WHEN r.near >= c.b + 240 THEN r.near ELSE c.b + 480 END FROM c JOIN r ON r.speech_id = c.speech_id AND r.k = least(c.b + 480, r.n) WHERE c.b < r.n),
d AS (SELECT c.speech_id, c.i AS chunk_no, c.a AS start_token, c.b AS end_token, x.s AS start_char, y.s + y.w AS end_char, t.txt FROM c JOIN r x ON x.speech_id = c.speech_id AND x.k = c.a + 1 JOIN r y ON y.speech_id = c.speech_id AND y.k = c.b JOIN t ON t.speech_id = c.speech_id WHERE c.i >= 0),
e AS (SELECT *, substring(txt, CAST(start_char + 1 AS BIGINT), CAST(end_char - start_char AS BIGINT)) AS chunk FROM d)
SELECT speech_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(start_token AS INTEGER) AS start_token, CAST(end_token AS INTEGER) AS end_token, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, CAST(end_token - start_token AS INTEGER) AS tokens,
""" + ", ".join(f"round(1 / (1 + exp(-(4 * CAST('0x' || substr(md5('[CLS] ' || chunk || ' [SEP] {label} [SEP]'), 1, 8) AS BIGINT) / 4294967295.0 - 2))), 9) AS {label}" for label in ("trust", "threat")) + " FROM e"


@query(_SCORED)
def text_score_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts in chunks of at most 480 tokens, each scored against two labels in batches by the stand-in."""
    from quern.streaming.scoring import score_chunks

    out = score_chunks(_speeches(spark, folder), ["speech_id"], "speech_clean")
    return out.withColumns({c: F.round(c, 9) for c in ("trust", "threat")})


_WHOLE = rf"""WITH t AS (SELECT speech_id, speech_clean AS txt, regexp_extract_all(speech_clean, '(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]){_SPACES}*') AS a, length(regexp_extract(speech_clean, '^{_SPACES}*', 0)) AS lead FROM speeches WHERE length(speech_clean) > 0),
f AS (SELECT speech_id, len(a) AS n, regexp_replace(array_to_string(a[1:508], ''), '{_SPACES}+$', '') AS premise FROM t WHERE len(a) > 0)
SELECT speech_id, CAST(n AS INTEGER) AS text_tokens, CAST(least(n, 508) AS INTEGER) AS tokens, """ + ", ".join(f"round(1 / (1 + exp(-(4 * CAST('0x' || substr(md5('[CLS] ' || premise || ' [SEP] {label} [SEP]'), 1, 8) AS BIGINT) / 4294967295.0 - 2))), 9) AS {label}" for label in ("trust", "threat")) + " FROM f"


@query(_WHOLE)
def text_score_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts in one pair each, cut where the model's 512 tokens end; the tokens that had a say stand beside all."""
    from quern.streaming.scoring import score_chunks

    out = score_chunks(_speeches(spark, folder), ["speech_id"], "speech_clean", whole=True)
    return out.select("speech_id", F.col("end_token").alias("text_tokens"), "tokens", *[F.round(c, 9).alias(c) for c in ("trust", "threat")])
