"""Queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import lookalikes, matching, mixing, packing, sentences, splitting, tokens
from quern.llm import percentiles as pct
from quern.session import cut, table

# --- percentiles -------------------------------------------------------------------------------------------

#: Share of values by which a published percentile may miss its rank.
TOLERANCE = 0.07
FEATURES = ("trust_score", "threat_score", "milex_share_gdp_t", "speech_token_count")
NATURAL_KEY = ("run_id", "entity_id", "year", "passage_no")
#: Transitions by (state, next state), in the order of their codes.
TRANSITIONS = ("continued_peace", "onset", "cessation", "continued_conflict")
RUNS_PER_BLOCK = 7
#: Published values that are left to the exact count and sent to all executors; more of them are joined by shuffle.
MAX_OPEN = 50_000

_GROUPS = (
    pct.Grouping("annual_score_trends", ("run_id", "year"), ("trust_score", "threat_score")),
    pct.Grouping("transition_feature_summaries", ("run_id", "transition_code"), FEATURES),
)


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    """modelling_rows with invalid values as null and the transition as a code from 0 to 3."""
    rows = table(spark, folder, "modelling_rows")

    def valid(name: str) -> Column:
        c = F.col(name).cast("double")
        ok = ~F.isnan(c)
        if name in ("trust_score", "threat_score"):
            ok = ok & c.between(0, 1)
        return F.when(ok, c).alias(name)

    state, following = F.col("conflict_active_t"), F.col("conflict_active_t1")
    code = F.when(state.isin(0, 1) & following.isin(0, 1), (2 * state + following).cast("long"))
    return rows.select(*NATURAL_KEY, code.alias("transition_code"), *[valid(f) for f in FEATURES])


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """Published percentiles, one per row, with the keys of their summaries."""
    trends = table(spark, folder, "annual_score_trends")
    changes = table(spark, folder, "transition_feature_summaries")
    code = F.array_position(F.array(*map(F.lit, TRANSITIONS)), F.col("transition")) - 1
    parts = [
        trends.select(F.lit("annual_score_trends").alias("kind"), F.col("run_id").cast("long").alias("key0"), F.col("year").cast("long").alias("key1"), F.lit(feature).alias("feature"),
                      F.col("trend_id").alias("summary_id"), F.lit(field).alias("field_name"), F.col(field).alias("published"), F.lit(p).alias("p"))
        for field, feature, p in (("trust_median", "trust_score", 0.5), ("threat_q75", "threat_score", 0.75))
    ]
    parts.append(
        changes.select(F.lit("transition_feature_summaries").alias("kind"), F.col("run_id").cast("long").alias("key0"), code.cast("long").alias("key1"), "feature",
                       "summary_id", F.lit("median").alias("field_name"), F.col("median").alias("published"), F.lit(0.5).alias("p"))
    )
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where(F.col("published").isNotNull() & ~F.isnan("published") & F.col("key0").isNotNull() & F.col("key1").isNotNull())


def _wrong(below: Column, upto: Column, n: Column) -> Column:
    return (below / n > F.col("p") + TOLERANCE) | (upto / n < F.col("p") - TOLERANCE)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Published percentiles that are wrong.

    The rank bounds of the group's summary decide all but the few values whose bounds straddle the limit;
    those are counted exactly, reading only the groups concerned.
    """
    summaries = pct.grouped_summaries(_passages(spark, folder), _GROUPS, NATURAL_KEY)
    keys = ["kind", "key0", "key1", "feature"]
    bounds = pct.rank_bounds(summaries.join(_published(spark, folder), keys), "published")
    n = F.col("n")
    sure = (F.col("below_lo") / n > F.col("p") + TOLERANCE) | (F.col("upto_hi") / n < F.col("p") - TOLERANCE)
    maybe = (F.col("below_hi") / n > F.col("p") + TOLERANCE) | (F.col("upto_lo") / n < F.col("p") - TOLERANCE)
    judged = cut(bounds.where(maybe).select(*keys, "summary_id", "field_name", "published", "p", sure.alias("sure")))
    names = [F.col("kind").alias("summary_table"), "summary_id", "field_name"]
    doubtful = judged.where("not sure")
    open_values = doubtful.count()
    if not open_values:
        return judged.select(*names)
    if open_values <= MAX_OPEN:
        doubtful = F.broadcast(doubtful)

    # exact counts for what is left open
    rows = _passages(spark, folder)
    groups = F.array(
        F.struct(F.lit("annual_score_trends").alias("kind"), F.col("year").cast("long").alias("key1")),
        F.struct(F.lit("transition_feature_summaries").alias("kind"), F.col("transition_code").alias("key1")),
    )
    runs = doubtful.select(F.col("key0").alias("run_id")).distinct()
    once = rows.join(F.broadcast(runs) if open_values <= MAX_OPEN else runs, "run_id", "left_semi").dropDuplicates(list(NATURAL_KEY))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    long = once.withColumn("g", F.explode(groups)).withColumn("x", F.explode(pairs))
    long = long.select(F.col("g.kind").alias("kind"), F.col("run_id").alias("key0"), F.col("g.key1").alias("key1"), F.col("x.feature").alias("feature"), F.col("x.value").alias("value")).where("value is not null")
    exact = (
        long.join(doubtful, keys)
        .groupBy("kind", "summary_id", "field_name", "p")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < F.col("published")).alias("below"), F.count_if(F.col("value") <= F.col("published")).alias("upto"))
        .where(_wrong(F.col("below"), F.col("upto"), F.col("n")))
    )
    return judged.where("sure").select(*names).unionByName(exact.select(*names))


_QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles of every run and year and of every run and transition, with the rank error of each group."""
    out = pct.with_quantiles(pct.grouped_summaries(_passages(spark, folder), _GROUPS, NATURAL_KEY), _QUARTILES)
    return out.withColumnsRenamed({"kind": "summary_table", "key0": "run_id", "key1": "group_key"})


def p3_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles of blocks of runs, merged from the summaries of single runs without reading the rows again."""
    daily = pct.grouped_summaries(_passages(spark, folder), _GROUPS, NATURAL_KEY, pct.EPSILON / 2)
    blocks = daily.withColumn("leaf", F.expr(f"key0 % {RUNS_PER_BLOCK}").cast("int")).withColumn("key0", F.expr(f"key0 div {RUNS_PER_BLOCK}"))
    out = pct.merge_summaries(blocks, ["kind", "key0", "key1", "feature"], RUNS_PER_BLOCK, pct.EPSILON)
    return pct.with_quantiles(out, _QUARTILES).withColumnsRenamed({"kind": "summary_table", "key0": "run_block", "key1": "group_key"})


_P3 = """
WITH once AS (
  SELECT DISTINCT ON (run_id, entity_id, year, passage_no) run_id, year,
         CASE WHEN conflict_active_t = 0 AND conflict_active_t1 = 0 THEN 'continued_peace' WHEN conflict_active_t = 0 AND conflict_active_t1 = 1 THEN 'onset'
              WHEN conflict_active_t = 1 AND conflict_active_t1 = 0 THEN 'cessation' WHEN conflict_active_t = 1 AND conflict_active_t1 = 1 THEN 'continued_conflict' END AS transition,
         CASE WHEN NOT isnan(trust_score) AND trust_score BETWEEN 0 AND 1 THEN trust_score END AS trust_score,
         CASE WHEN NOT isnan(threat_score) AND threat_score BETWEEN 0 AND 1 THEN threat_score END AS threat_score,
         CASE WHEN NOT isnan(milex_share_gdp_t) THEN milex_share_gdp_t END AS milex_share_gdp_t, CAST(speech_token_count AS DOUBLE) AS speech_token_count
  FROM modelling_rows
), long AS (
  SELECT run_id, CAST(year AS VARCHAR) AS key1, 'trust_score' AS feature, trust_score AS v FROM once UNION ALL
  SELECT run_id, CAST(year AS VARCHAR), 'threat_score', threat_score FROM once UNION ALL
  SELECT run_id, transition, 'trust_score', trust_score FROM once UNION ALL SELECT run_id, transition, 'threat_score', threat_score FROM once UNION ALL
  SELECT run_id, transition, 'milex_share_gdp_t', milex_share_gdp_t FROM once UNION ALL SELECT run_id, transition, 'speech_token_count', speech_token_count FROM once
), pub AS (
  SELECT 'annual_score_trends' AS summary_table, trend_id AS summary_id, 'trust_median' AS field_name, run_id, CAST(year AS VARCHAR) AS key1, 'trust_score' AS feature, trust_median AS x, 0.5 AS p FROM annual_score_trends UNION ALL
  SELECT 'annual_score_trends', trend_id, 'threat_q75', run_id, CAST(year AS VARCHAR), 'threat_score', threat_q75, 0.75 FROM annual_score_trends UNION ALL
  SELECT 'transition_feature_summaries', summary_id, 'median', run_id, transition, feature, median, 0.5 FROM transition_feature_summaries
)
SELECT summary_table, summary_id, field_name FROM pub JOIN long USING (run_id, key1, feature) WHERE x IS NOT NULL AND v IS NOT NULL
GROUP BY summary_table, summary_id, field_name, x, p
HAVING count(*) FILTER (v < x) / CAST(count(*) AS DOUBLE) > CAST(p AS DOUBLE) + 0.07 OR count(*) FILTER (v <= x) / CAST(count(*) AS DOUBLE) < CAST(p AS DOUBLE) - 0.07
"""


# --- splitting ---------------------------------------------------------------------------------------------

#: Table, id, text, limit in code points, and kind of boundaries.
OVERSIZED = (("speeches", "speech_id", "speech_clean", 4000, "sentences"), ("scores", "score_id", "payload", 2000, "chunks"))
OVERLAP = 200


def _pieces(spark: SparkSession, folder: str, texts: bool) -> DataFrame:
    out = None
    for name, key, text, limit, kind in OVERSIZED:
        made = splitting.split_oversized(table(spark, folder, name), key, text, limit=limit, overlap=OVERLAP, kind=kind, texts=texts)
        made = made.withColumnRenamed(key, "item_id").select(F.lit(name).alias("item_table"), "*")
        out = made if out is None else out.unionByName(made)
    return out


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items over the limit and whether they could be cut at natural boundaries alone."""
    return _pieces(spark, folder, texts=False).where("piece_no = 1").select("item_table", "item_id", "cut_kind")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all items over the limit, with their texts."""
    return _pieces(spark, folder, texts=True)


_P1 = r"""
SELECT item_table, item_id, CASE WHEN list_max(list_transform(string_split(marked, chr(1)), lambda x: length(x))) > size_limit THEN 'forced' ELSE 'natural' END AS cut_kind FROM (
  SELECT 'speeches' AS item_table, speech_id AS item_id, 4000 AS size_limit, regexp_replace(speech_clean, '([.!?]["''”’»]?)(\s)', '\1' || chr(1) || '\2', 'g') AS marked FROM speeches WHERE length(speech_clean) > 4000
  UNION ALL SELECT 'scores', score_id, 2000, regexp_replace(payload, '(\{\s*"start_token")', chr(1) || '\1', 'g') FROM scores WHERE length(payload) > 2000)
"""


# --- text that looks the same ------------------------------------------------------------------------------


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of speeches that look the same but are stored in different characters."""
    forms = cut(lookalikes.consistent_form(table(spark, folder, "speeches"), "speech_id", "speech_clean", texts=False))
    return lookalikes.equal_looking_pairs(forms, "speech_id", ("speech_id_a", "speech_id_b"))


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every speech in its consistent form; equal values of ``form`` mark speeches that look the same."""
    out = lookalikes.consistent_form(table(spark, folder, "speeches"), "speech_id", "speech_clean")
    return out.select("speech_id", "consistent_text", F.hex("form").alias("form"), (F.col("form") != F.col("stored")).alias("changed"))


def _printed_alike(column: str) -> str:
    """SQL for the form of a text, from character categories and decompositions: blanks, hyphens, widths, joining forms and
    look-alikes are translated, format characters dropped, and what is left is composed."""
    alike = {x: latin for latin, others in lookalikes.LOOKALIKES.items() for x in others} | {"\u2010": "-", "\u2011": "-"}
    several = []
    for p in range(0x80, 0x10000):
        ch, parts = chr(p), unicodedata.decomposition(chr(p))
        if unicodedata.category(ch) == "Zs":
            alike[ch] = " "
        elif parts.split(" ")[0] in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>"):
            plain = unicodedata.normalize("NFKC", ch)
            if len(plain) == 1:
                alike[ch] = plain
        elif 0xFB00 <= p <= 0xFB06:
            several.append((p, unicodedata.normalize("NFKC", ch)))
    listed = lambda chars: "'" + "".join("''" if c == "'" else c for c in chars) + "'"
    out = f"translate(nfc_normalize({column}), {listed(alike)}, {listed(alike.values())})"
    for p, plain in several:
        out = f"replace({out}, chr({p}), '{plain}')"
    return rf"nfc_normalize(regexp_replace({out}, '[\p{{Cf}}\x{{34f}}\x{{fe00}}-\x{{fe0f}}]', '', 'g'))"


_P5 = f"""WITH f AS (SELECT speech_id, speech_clean AS t, {_printed_alike("speech_clean")} AS form FROM speeches WHERE speech_clean IS NOT NULL)
SELECT a.speech_id AS speech_id_a, b.speech_id AS speech_id_b FROM f a JOIN f b ON a.form = b.form AND a.speech_id < b.speech_id AND a.t <> b.t"""


# --- typed values ------------------------------------------------------------------------------------------

#: Crosswalk, field, reference column that holds the exact values, and whether values are codes first.
TYPED = (
    ("ucdp_country_crosswalk", "source_name", "country_name", False),
    ("sipri_country_crosswalk", "source_name", "country_name", False),
    ("sipri_country_crosswalk", "entity_id", "entity_id", True),
)


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "region_income_snapshot").select("entity_id", "iso2", "country_name", "official_name", "former_name").where("entity_id is not null").limit(matching.MAX_NAMES + 1).collect()
    names = [(r[k], r[0]) for r in entries for k in (2, 3, 4) if r[k]]
    codes = [(r[k], r[0]) for r in entries for k in (0, 1) if r[k]]
    exact = {"country_name": sorted({r[2] for r in entries if r[2]}), "entity_id": sorted({r[0] for r in entries})}
    out = None
    for name, field, column, as_code in TYPED:
        rows = table(spark, folder, name).select("entry_id", F.col(field).alias("value"))
        # the list is bounded by MAX_NAMES, which match_values checks
        known = F.broadcast(spark.createDataFrame([(v,) for v in exact[column]], "value string"))
        rows = rows.where(F.col("value").rlike("[^\\s\u00a0]")).join(known, "value", "left_anti")
        # values are matched once each, and the answer is joined to the rows that hold it
        found = matching.match_values(rows.select("value").distinct(), "value", names, codes, codes_first=as_code)
        made = rows.join(found, "value").select(F.lit(name).alias("crosswalk"), F.lit(field).alias("field_name"), "entry_id", "value", F.col("matched").alias("entity_id"), "score", "margin")
        out = made if out is None else out.unionByName(made)
    return out


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed value that is not an exact entry, with the entity it means or as unmatched."""
    return _matched(spark, folder).select("crosswalk", "field_name", "entry_id", "entity_id")


def p6_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no entry, with the number of rows that hold them."""
    return _matched(spark, folder).where(F.col("entity_id") == matching.UNMATCHED).groupBy("crosswalk", "field_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


# --- containers and mixes ----------------------------------------------------------------------------------


def _sizes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents with their number of tokens; kept in the shared folder, as the tokenizer is the dear part."""
    return cut(tokens.with_token_counts(table(spark, folder, "documents").select("doc_id", *columns, "text"), "text"))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The contents of all containers, and the plan of each specification."""
    specs = table(spark, folder, "pack_specs").select("spec_id", "spec_name", "capacity_tokens").dropna()
    items, plans = packing.pack(_sizes(spark, folder), "doc_id", "n_tokens", [r[2] for r in specs.orderBy("spec_id").collect()])
    planned = [(c, p.containers, p.bound, p.pattern_share, p.gap) for c, p in plans.items()]
    listed = spark.createDataFrame(planned, "capacity_tokens int, containers long, lower_bound long, pattern_share double, lp_gap double")
    items = items.withColumnRenamed("capacity", "capacity_tokens")
    # specifications of one capacity share its containers; the list has a row for each specification
    rows = items.join(F.broadcast(specs.select("spec_id", "capacity_tokens")), "capacity_tokens")
    return rows.select("spec_id", "capacity_tokens", "container", "doc_id", "part_no", "start_token", "n_tokens"), specs.join(listed, "capacity_tokens")


def p7_contents(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of every part of one that exceeds the capacity."""
    return _packed(spark, folder)[0]


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every container with its number of items and its fill."""
    rows = p7_contents(spark, folder).groupBy("spec_id", "capacity_tokens", "container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used_tokens"))
    return rows.withColumn("fill", F.col("used_tokens") / F.col("capacity_tokens"))


def p7_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, their lower bound, the share of tokens placed by patterns, the gap of the fractions, and the fill for each capacity."""
    rows, planned = _packed(spark, folder)
    used = rows.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used_tokens"))
    return planned.join(used, "spec_id").withColumn("fill", F.col("used_tokens") / F.col("capacity_tokens") / F.col("containers"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, list[mixing.Target], dict[str, int]]:
    listed = table(spark, folder, "mix_targets").where("mix_id is not null and source is not null").limit(mixing.MAX_TARGETS + 1).collect()
    targets = [mixing.Target(r["mix_id"], r["source"], r["target_share"] or 0.0, 1 if r["max_repeats"] is None else r["max_repeats"]) for r in listed]
    selected, available = mixing.mix_sources(_sizes(spark, folder, "source"), targets, id_column="doc_id", source_column="source", size_column="n_tokens")
    return selected, targets, available


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of every mix and how often each is used."""
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source of every mix."""
    selected, targets, available = _mixed(spark, folder)
    rows = [(t.mix, t.source, t.share, t.repeats, available.get(t.source, 0)) for t in targets]
    wanted = spark.createDataFrame(rows, "mix_id string, source string, target_share double, max_repeats int, available_tokens long")
    got = selected.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    out = wanted.join(got, ["mix_id", "source"], "left").fillna(0, ["documents", "copies", "most_copies", "tokens"])
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    return out.join(whole, "mix_id", "left").withColumn("reached_share", F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)))


# --- sentences ---------------------------------------------------------------------------------------------


def _sentences(spark: SparkSession, folder: str, texts: bool) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    corpus = sentences.corpus_evidence(documents, "text")
    return sentences.split_sentences(documents, "doc_id", "text", corpus, texts=texts)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The end of every sentence of every document."""
    return _sentences(spark, folder, texts=False).select("doc_id", "sent_end")


def p9_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document in order, with their positions."""
    return _sentences(spark, folder, texts=True)


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p3_found": p3_found, "p3_percentiles": p3_percentiles, "p3_combined": p3_combined, "p5_found": p5_found, "p5_forms": p5_forms, "p6_found": p6_found, "p6_unmatched": p6_unmatched, "p7_contents": p7_contents, "p7_containers": p7_containers, "p7_summary": p7_summary, "p8_selection": p8_selection, "p8_shares": p8_shares, "p9_found": p9_found, "p9_sentences": p9_sentences}
ORACLE = {"p1_found": _P1, "p3_found": _P3, "p5_found": _P5}
