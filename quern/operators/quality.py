"""Checks of tables and score caches; each gives a table of findings or raises in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import ContractError


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def require_range(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """Raises if a value lies outside; nulls are allowed."""
    row = df.agg(F.min(column), F.max(column)).head()
    if row[0] is not None and (row[0] < low or row[1] > high):
        raise ContractError(f"{column} runs from {row[0]} to {row[1]}, not within {low} and {high}")
    return df


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, counted in one pass: rule, n_rows."""
    counts = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    listed = ", ".join(f"{chr(39)}{name}{chr(39)}, r{i}" for i, name in enumerate(rules))
    return counts.select(F.expr(f"stack({len(rules)}, {listed}) as (rule, n_rows)"))


def enforce(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Raises ContractError with the first rule, in the order given, that a row breaks."""
    found = {r[0]: r[1] for r in violations(df, rules).collect()}
    for rule in rules:
        if found[rule]:
            raise ContractError(f"{rule}: {found[rule]} rows")
    return df


def score_rules(spec_hash: str) -> dict[str, Column]:
    """Rules for a cached score joined with the hash that its text has now, in the order they are enforced."""
    c = F.col
    bad = lambda e: F.coalesce(e, F.lit(True))
    return {
        "missing": c("text_hash").isNull(),
        "stale": c("text_hash").isNotNull() & bad(c("expected_hash") != c("text_hash")),
        "wrong_specification": c("text_hash").isNotNull() & bad(c("spec_hash") != spec_hash),
        "incomplete_coverage": c("text_hash").isNotNull() & bad(c("token_coverage") != 1),
        "token_counts_differ": c("text_hash").isNotNull() & bad(c("tokens_scored") != c("model_token_count")),
        "score_out_of_range": c("text_hash").isNotNull() & bad(~(c("trust_score").between(0, 1) & c("threat_score").between(0, 1))),
    }


def expected_hashes(speeches: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    return speeches.select(*keys, F.sha2(F.col(text), 256).alias("expected_hash"))


def corpus_fingerprint(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row with the SHA-256 of the corpus: of the eight sums, over all rows, of 32-bit parts of the rows' hashes.

    The sums are those of a multiset, so they are formed in parallel and in any order, and only they leave the
    executors. A row's hash covers its keys and the hash of its text; null and empty texts count as the same.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 256)
    hashed = df.select(row.alias("__h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return hashed.agg(F.sha2(F.concat_ws(",", *parts), 256).alias("fingerprint"))
