"""Joins, set operations and aggregates of entity-year panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data break a rule that an operator was asked to enforce."""


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    """Raises ContractError if a key occurs twice; one aggregate with map-side combine."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ContractError(f"{what}: key {twice[0].asDict()} is not unique")
    return df


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "one_to_one") -> DataFrame:
    """Equi-join whose cardinality is checked: one_to_one, many_to_one, one_to_many or many_to_many."""
    if validate.startswith("one_"):
        assert_unique(left, on, "left side")
    if validate.endswith("_one"):
        assert_unique(right, on, "right side")
    return left.join(right, list(on), how)


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def domain_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values that only one side has: value, side ('new' in a, 'missing' from a)."""
    one, two = (x.select(F.col(column).alias("value")).where("value is not null").distinct() for x in (a, b))
    return one.subtract(two).withColumn("side", F.lit("new")).unionByName(two.subtract(one).withColumn("side", F.lit("missing")))


def valid_in(rows: DataFrame, rules: DataFrame, *, name: str, year: str, rule_name: str, row_id: str) -> DataFrame:
    """Time-valid lookup: rules with the row's name whose [valid_from, valid_to] holds its year.

    Gives n_matches and the least and greatest entity_id found; rows without a rule keep nulls and count 0. Rules of one
    name and range are counted before they meet the rows, so a name that many rules have doesn't multiply them. The
    equality on the name carries the join; the years are checked on the way.
    """
    r = rules.groupBy(F.col(rule_name).alias("__name"), "valid_from", "valid_to").agg(F.count(F.lit(1)).alias("__n"), F.min("entity_id").alias("__low"), F.max("entity_id").alias("__high"))
    met = rows.join(r, (rows[name] == r["__name"]) & rows[year].between(r["valid_from"], r["valid_to"]), "left")
    return met.groupBy(row_id).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_matches"), F.min("__low").alias("least_entity"), F.max("__high").alias("greatest_entity"))


def with_ordinal(df: DataFrame, column: str, levels: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Adds the place of a value in a given list of levels, from 0; values outside the list have none and sort last."""
    at = F.array_position(F.array(*[F.lit(v) for v in levels]).cast("array<string>"), F.col(column).cast("string")) - 1
    return df.withColumn(name, F.when(at >= 0, at.cast("int")))


def first_appearance(df: DataFrame, column: str, order: str) -> DataFrame:
    """The distinct values of a column with their places (from 0) by the least ``order`` of each; nulls are no value.

    The values are levels of a category, a short list, which is ranked in one task after aggregation.
    """
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("__first"))
    return first.select(column, (F.row_number().over(Window.orderBy("__first", column)) - 1).alias("ordinal"))


def at_lag(rows: DataFrame, source: DataFrame, key: str, year: str, lag: int, columns: dict[str, str]) -> DataFrame:
    """Values of ``source`` at exactly year + lag, never those of the next row at hand."""
    s = source.select(F.col(key), (F.col(year) - lag).alias(year), *[F.col(a).alias(b) for a, b in columns.items()])
    return rows.join(s, [key, year], "left")


def completed(df: DataFrame, entities: DataFrame, levels: dict[str, Sequence[object]], fill: dict[str, object]) -> DataFrame:
    """Every row of ``entities`` with every combination of the listed levels, with ``fill`` where ``df`` has no row.

    The levels are given, so the grid is made by exploding literals, not by a join.
    """
    grid = entities
    for name, values in levels.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df, grid.columns, "left").fillna(fill)


def text_set(column: str, separator: str = " | ") -> Column:
    """Distinct non-blank values, trimmed, sorted and joined; null if there are none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(F.col(column)), F.lit("")))), separator), F.lit(""))


def in_samples(df: DataFrame, samples: dict[str, Column]) -> DataFrame:
    """One row per sample that a row belongs to; overlapping samples are aggregated in one pass."""
    members = F.array(*[F.when(c, F.lit(n)) for n, c in samples.items()])
    return df.withColumn("sample", F.explode(F.filter(members, lambda x: x.isNotNull())))


def filled(column: str, eligible: Column, value: object = 0) -> Column:
    """Missing becomes ``value`` on eligible rows alone; elsewhere it stays missing."""
    return F.when(eligible, F.coalesce(F.col(column), F.lit(value))).otherwise(F.col(column))


def typed(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Selected columns under new names and types; a value that doesn't fit raises."""
    return df.select(*[F.col(f"`{old}`").cast(kind).alias(new) for old, (new, kind) in columns.items()])


def corrected(df: DataFrame, corrections: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``column`` replaced by the correction for the row's keys as they came, so corrections never act on one another.

    Raises unless each correction meets exactly one row. ``corrections`` has the keys and ``corrected``.
    """
    hits = corrections.join(df.select(*keys, F.lit(1).alias("__hit")), list(keys), "left").groupBy(*keys).agg(F.count("__hit").alias("n"))
    wrong = hits.where("n <> 1").limit(1).collect()
    if wrong:
        raise ContractError(f"the correction {wrong[0].asDict()} meets {wrong[0]['n']} rows")
    assert_unique(corrections, keys, "corrections")
    out = df.join(corrections.select(*keys, F.col("corrected").alias("__new")), list(keys), "left")
    return out.withColumn(column, F.coalesce("__new", column)).drop("__new").select(*df.columns)


def same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, if a join has neither lost nor added rows."""
    a, b = before.count(), after.count()
    if a != b:
        raise ContractError(f"{b} rows after the join, {a} before")
    return after


def same_domain(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """``df``, if both sides have the same values; else raises with what is new and what is missing."""
    found = domain_difference(df, listed, column).limit(40).collect()
    if found:
        new, missing = (sorted(r["value"] for r in found if r["side"] == s) for s in ("new", "missing"))
        raise ContractError(f"{column}: new {new}, missing {missing}")
    return df


def exactly_one(df: DataFrame, matches: DataFrame, row_id: str) -> DataFrame:
    """The entity of rows that a time-valid lookup matched once; raises for any other number of matches."""
    wrong = matches.where("n_matches <> 1").limit(5).collect()
    if wrong:
        raise ContractError(f"rows matched {[r['n_matches'] for r in wrong]} times: {[r[row_id] for r in wrong]}")
    return df.join(matches.select(row_id, F.col("least_entity").alias("entity_id")), row_id)
