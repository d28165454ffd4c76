import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import entity, text
from quern.operators import model, ordered, quality, relational, reshape, stats, windows
from quern.operators.relational import ContractError


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_joins_check_their_cardinality(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    two = spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    assert relational.join_checked(one, two, ["k"], validate="one_to_many").count() == 3
    with pytest.raises(ContractError):
        relational.join_checked(one, two, ["k"])
    with pytest.raises(ContractError):
        relational.join_checked(two, two.withColumnRenamed("y", "z"), ["k"], validate="many_to_one")


def test_missing_is_zero_only_where_eligible(spark):
    df = spark.createDataFrame([(None, True), (None, False), (3, True)], "x int, ok boolean")
    assert [r[0] for r in df.select(relational.filled("x", F.col("ok"))).collect()] == [0, None, 3]


def test_text_set_and_completion(spark):
    df = spark.createDataFrame([(1, " b"), (1, "a "), (1, "b"), (1, None), (2, " "), (2, None)], "k int, x string")
    assert rows(df.groupBy("k").agg(relational.text_set("x"))) == [(1, "a | b"), (2, None)]
    grid = relational.completed(spark.createDataFrame([("x", 1, 5)], "a string, b int, n int"), spark.createDataFrame([("x",), ("y",)], "a string"), {"b": [1, 2]}, {"n": 0})
    assert rows(grid) == [("x", 1, 5), ("x", 2, 0), ("y", 1, 0), ("y", 2, 0)]


def test_lag_and_look_back_follow_the_calendar(spark):
    panel = spark.createDataFrame([("A", 2000), ("A", 2002), ("A", 2006), ("B", 2000)], "e string, y int")
    war = spark.createDataFrame([("A", 1995, 1), ("A", 2001, 1), ("A", 2001, 1), ("A", 2003, 1)], "e string, y int, active int")
    assert rows(relational.at_lag(panel, war.distinct(), "e", "y", 1, {"active": "next"})) == [("A", 2000, 1), ("A", 2002, 1), ("A", 2006, None), ("B", 2000, None)]
    assert rows(windows.look_back(panel, war, "e", "y")) == [("A", 2000, 1), ("A", 2002, 1), ("A", 2006, 2), ("B", 2000, 0)]


def test_ranks_quantiles_and_ecdf(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=997), 1)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("h", None), (None, 2.0)], "k string, v double")
    q = {r.k: r for r in ordered.exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    assert np.allclose([q["g"].a, q["g"].b, q["g"].c], np.quantile(values, [0.25, 0.5, 0.9]))
    assert (q["h"].n, q["h"].b) == (1, 1.0) and set(q) == {"g", "h"}
    ranks = {r.v: r.rank for r in ordered.average_ranks(df.where("k = 'g'"), [], "v").collect()}
    for v in (-1.0, 0.0, 0.5):
        assert ranks[v] == (values < v).sum() + ((values == v).sum() + 1) / 2
    shares = {r.v: r.share for r in ordered.ecdf(df, ["k"], "v").where("k = 'g'").collect()}
    assert math.isclose(shares[0.0], (values <= 0).mean())
    assert ordered.exact_quantiles(df.limit(0), ["k"], "v", {"a": 0.5}).count() == 0


def test_hash_sample_is_stable(spark):
    df = spark.range(500).withColumn("s", F.col("id") % 3)
    one = windows.hash_sample(df, ["s"], F.col("id").cast("string"), 5, "x")
    assert one.count() == 15 and rows(one) == rows(windows.hash_sample(df.repartition(7), ["s"], F.col("id").cast("string"), 5, "x"))


def test_balanced_sample(spark):
    rows = [(c, u, f"r{u % 3}") for c in ("a", "b", "c", "d") for u in range(6)] + [("e", 0, "r0"), (None, 1, "r1")]
    df = spark.createDataFrame(rows, "cell string, unit int, region string")
    picks = windows.balanced_sample(df, ["cell"], "unit", "region", "s")
    assert picks == windows.balanced_sample(df.repartition(5), ["cell"], "unit", "region", "s")
    units = [p[1] for p in picks]
    assert len(units) == len(set(units)) and [p[0] for p in picks[:5]] in (["a", "b", "c", "d", "e"], [None, "a", "b", "c", "d"])
    assert len({p[2] for p in picks if p[0] in ("a", "b", "c")}) == 3 or picks[0][0] is None


def test_reshape(spark):
    df = spark.createDataFrame([(1, 1.0, None)], "k int, a double, b double")
    assert rows(reshape.long_form(df, ["k"], ["a", "b"], "n", "v")) == [(1, "a", 1.0), (1, "b", None)]
    assert reshape.long_form(df, ["k"], ["a", "b"], "n", "v", keep_null=False).count() == 1
    years = spark.createDataFrame([(1989,), (1990,), (2001,), (2002,), (2025,), (2026,), (None,)], "y int")
    assert [r[0] for r in years.select(reshape.right_closed(F.col("y"), [1989, 2001, 2025], ["a", "b"])).collect()] == [None, "a", "a", "b", "b", None, None]


def test_clean_speech(spark):
    body = "﻿Mr. Chair, co­operation is pos-\n sible.\r\n  　 Thank you. "
    df = spark.createDataFrame([(1, body, 1990), (2, "I invite him to address the Assembly. Hello there. On behalf of the General Assembly, I wish to thank the speaker.", 2025), (3, None, 2025), (4, "I invite him to address the assembly. X", 2024)], "id int, t string, y int")
    out = {r.id: r for r in text.clean_speech(df, "t", "y").collect()}
    assert out[1].speech_clean == "Mr. Chair, cooperation is pos-sible. Thank you." and (out[1].bom_count, out[1].soft_hyphen_count) == (1, 1)
    assert out[2].speech_clean == "Hello there." and out[2].intro_removed and out[2].outro_removed
    assert out[3].speech_clean == "" and out[3].removed_characters == 0
    assert out[4].speech_clean.startswith("I invite") and not out[4].intro_removed


def test_words_dictionaries_and_posts(spark):
    df = spark.createDataFrame([("We trust you. Trust that, trust funds; TRUST-worthy. Co-operation and mutual \n understanding; it’s état-major 12",)], "t string")
    r = df.select(text.word_count(F.col("t")), text.dictionary_count(F.col("t"), "trust_dialogue_salience"), text.dictionary_count(F.col("t"), "cooperation_partnership")).head()
    assert tuple(r) == (14, 3, 1)
    posts = spark.createDataFrame([("Vice-President",), ("Prime Minister and President",), ("Minister for Foreign Affairs",), ("Représentative",), (" ",), (None,), ("Clerk",)], "p string")
    assert [r[0] for r in posts.select(text.post_group(F.col("p"))).collect()] == ["head_of_state", "head_of_government", "foreign_minister", "representative", "unknown", "unknown", "other"]


def test_entity_status(spark):
    df = spark.createDataFrame([("PSE", "observer_state", True), ("VAT", "observer_state", True), ("EU", None, False), ("SUN", None, False), ("ABC", None, True), ("ZZZ", None, False), ("X", "other", True)], "e string, r string, l boolean")
    got = [r[0] for r in df.select(entity.entity_status(F.col("e"), F.col("r"), F.col("l"))).collect()]
    assert got == ["sensitivity_observer", "excluded_observer_no_sipri", "excluded_non_state", "excluded_historical", "main_un_member", "unresolved_iso", "excluded_historical"]


def test_t_test_p_value():
    assert math.isclose(stats.two_sided_p(2.0, 10), 0.0733880, abs_tol=1e-6)
    assert math.isclose(stats.two_sided_p(1.959964, 1e6), 0.05, abs_tol=1e-5)
    assert stats.two_sided_p(0.0, 5) == 1.0 and math.isnan(stats.two_sided_p(float("nan"), 5))


def test_constant_and_empty_input(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 5.0)], "g int, x double, y double")
    assert stats.pearson(df, ["x", "y"]).head().correlation is None and stats.spearman(df, "x", "y").head().correlation is None
    assert stats.cohens_d(df, "g", "x").head().cohens_d is None and stats.t_test(df, "g", "x").head().t is None
    empty = df.limit(0)
    assert stats.t_test(empty, "g", "x").head().n0 == 0 and stats.box_stats(empty, ["g"], "x").count() == 0
    assert stats.pearson(empty, ["x", "y"]).head().correlation is None
    assert math.isclose(stats.pearson(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 9.0)], "x double, y double"), ["x", "y"]).head().correlation, np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1])


def test_bootstrap_against_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(f"e{i % 12}", "onset" if rng.random() < 0.3 else "continued_peace", float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(data, "entity_id string, transition string, x double")
    weights = stats.multinomial_weights(spark, {e for e, _, _ in data}, "entity_id", 200, 7)
    out = stats.cluster_bootstrap(df, weights, entity="entity_id", group="transition", contrasts=[("continued_peace", "onset")], features=["x"], replicates=200).head()
    listed = sorted({e for e, _, _ in data})
    w = np.random.default_rng(7).multinomial(12, np.repeat(1 / 12, 12), size=200)
    s, n = np.zeros((12, 2)), np.zeros((12, 2))
    for e, t, x in data:
        s[listed.index(e), int(t == "onset")] += x
        n[listed.index(e), int(t == "onset")] += 1
    d = (w @ s)[:, 1] / (w @ n)[:, 1] - (w @ s)[:, 0] / (w @ n)[:, 0]
    assert np.allclose([out.ci_low, out.ci_high], np.quantile(d, [0.025, 0.975])) and out.status == "ok"


def test_status_ladder(spark):
    weights = spark.createDataFrame([(i, "a", 1) for i in range(5)], "replicate long, entity_id string, weight long")
    df = spark.createDataFrame([("a", "onset", 1.0), ("a", "continued_peace", 1.0)], "entity_id string, transition string, x double")
    out = stats.cluster_bootstrap(df, weights, entity="entity_id", group="transition", contrasts=[("continued_peace", "onset")], features=["x"], replicates=5).head()
    assert out.status == "insufficient_group_support" and out.ci_low is None


def test_metrics_with_ties(spark):
    rng = np.random.default_rng(5)
    score, target = np.round(rng.random(400), 1), (rng.random(400) < 0.3).astype(int)
    df = spark.createDataFrame([("p", float(a), int(b)) for a, b in zip(score, target)] + [("q", 0.5, 0)], "period string, score double, target int")
    out = {r.period: r for r in model.metrics(df, ["period"]).collect()}
    ap, recall = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        hit = score >= t
        r = target[hit].sum() / target.sum()
        ap, recall = ap + (r - recall) * target[hit].mean(), r
    pos, neg = score[target == 1], score[target == 0]
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert np.allclose([out["p"].average_precision, out["p"].roc_auc, out["p"].brier], [ap, auc, np.mean((score - target) ** 2)])
    assert out["q"].average_precision is None and out["q"].roc_auc is None


def test_logit_against_newton(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2)) * [1, 5] + [0, 3]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] + 0.2 * x[:, 1])))).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, target double")
    fitted = model.fit_logit(df, ["a", "b"], "target")
    z = np.c_[np.ones(300), (x - x.mean(0)) / x.std(0)]
    beta, penalty = np.zeros(3), np.diag([0.0, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ beta)
    c = fitted.coefficients()
    assert np.allclose([c["intercept"], c["a"], c["b"]], beta, atol=1e-4)
    assert "score" in model.predict(fitted, df).columns


def test_fingerprint_depends_on_rows_alone(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("B", 2, None), ("B", 2, "y")], "e string, y int, t string")
    one = quality.corpus_fingerprint(df, ["e", "y"], "t").head()[0]
    assert one == quality.corpus_fingerprint(df.repartition(3).orderBy(F.desc("t")), ["e", "y"], "t").head()[0]
    for other in (df.limit(2), df.unionByName(df.limit(1)), df.withColumn("y", F.col("y") + 1)):
        assert one != quality.corpus_fingerprint(other, ["e", "y"], "t").head()[0]
    assert len(quality.corpus_fingerprint(df.limit(0), ["e", "y"], "t").head()[0]) == 64


def test_rules_are_enforced_in_order(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    with pytest.raises(ContractError, match="null: 1"):
        quality.enforce(df, {"fine": F.lit(False), "null": F.col("x").isNull(), "negative": F.col("x") < 0})
    with pytest.raises(ContractError):
        quality.require_columns(df, ["x", "y"])
    with pytest.raises(ContractError):
        quality.require_range(df, "x", 0, 5)


def test_all_names_are_normalised(spark, tmp_path):
    import re
    import unicodedata

    from __spark_entry__ import queries

    ucdp = ["Côte d’Ivoire", "Cote\u0301 d'Ivoire", "\uff26\uff52\uff41\uff4e\uff43\uff45", "South\u00a0Sudan", "Chad\u2020", "Peru\u00b2", "Plain", None]
    sipri = ["\ufb01ji", "Türkiye\u2021", "Plain"]
    for name, values in (("ucdp", ucdp), ("sipri", sipri)):
        spark.createDataFrame([(v,) for v in values], "source_name string").write.parquet(f"{tmp_path}/{name}_country_crosswalk.parquet")
    got = [tuple(r) for r in queries()["text_normalise_name"](spark, str(tmp_path)).collect()]
    plain = {v: None if v is None else re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().casefold()).strip() for v in ucdp + sipri}
    assert len(got) == len(plain) and dict(got) == plain


def test_update_keeps_all_rows(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(1, 1995, 50, "EHR"), (2, 1995, 50, "HRE"), (3, 1995, 8050, "EHR"), (4, 1996, 51, "EHR"), (5, 1995, 50, "FRA"), (6, 1995, 50, None), (7, None, 50, "HRE")]
    spark.createDataFrame(rows, "speaker_row_id int, year int, session int, iso_code string").write.parquet(f"{tmp_path}/speakers_by_session.parquet")
    got = queries()["conditional_update_all"](spark, str(tmp_path)).orderBy("speaker_row_id").collect()
    assert [r.iso_code for r in got] == ["HRE", "EHR", "HRE", "EHR", "FRA", None, "HRE"] and [tuple(r)[:3] for r in got] == [r[:3] for r in rows]


def test_payloads_with_a_bad_chunk_have_no_mean(spark, tmp_path):
    import json

    from __spark_entry__ import queries

    def payload(*chunks):
        return json.dumps({"chunks": [{"start_char": 0, "end_char": 1, "tokens": n, "trust": a, "threat": b} for n, a, b in chunks]})

    rows = [(1, payload((1, 0.2, 0.4), (3, 0.6, 0.8))), (2, payload((1, 0.2, 0.4), (3, 1.6, 0.8))), (3, payload((0, 0.2, 0.4))), (4, payload((2, None, 0.4)))]
    spark.createDataFrame(rows, "score_id long, payload string").write.parquet(f"{tmp_path}/scores.parquet")
    got = queries()["weighted_mean_payloads"](spark, str(tmp_path)).orderBy("score_id").collect()
    assert [(r.status, r.n_chunks, r.n_bad_chunks) for r in got] == [("scored", 2, 0), ("bad_chunk", 2, 1), ("bad_chunk", 1, 1), ("bad_chunk", 1, 1)]
    assert abs(got[0].trust - 0.5) < 1e-9 and all(r.trust is None and r.threat is None and r.tokens_scored is None for r in got[1:])
