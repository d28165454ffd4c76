"""Windows over entity-year panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows; counted before the shuffle, so a hot key costs nothing."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def next_row(column: str, key: str, year: str) -> Column:
    """The value of the next row at hand, whatever its year."""
    return F.lead(column).over(Window.partitionBy(key).orderBy(year))


def rolling_mean(df: DataFrame, column: str, year: str, half: int = 1) -> Column:
    """Centred mean of a small yearly table, over the rows at hand."""
    return F.avg(column).over(Window.orderBy(year).rowsBetween(-half, half))


def look_back(rows: DataFrame, events: DataFrame, key: str, year: str, years: int = 5, name: str = "past") -> DataFrame:
    """Number of distinct event years in the calendar years t - years .. t - 1; gaps count as none.

    Events carry the history even where ``rows`` has no row. Both sides are reduced to one row per key and year
    before one window over their union: a range frame looks at years, not at rows.
    """
    one = rows.select(F.col(key), F.col(year), F.lit(0).alias("__e"), F.lit(1).alias("__r")).distinct()
    two = events.select(F.col(key), F.col(year), F.lit(1).alias("__e"), F.lit(0).alias("__r")).distinct()
    both = one.unionByName(two).groupBy(key, year).agg(F.max("__e").alias("__e"), F.max("__r").alias("__r"))
    frame = Window.partitionBy(key).orderBy(year).rangeBetween(-years, -1)
    past = both.withColumn(name, F.coalesce(F.sum("__e").over(frame), F.lit(0))).where("__r = 1").select(key, year, name)
    return rows.join(past, [key, year])


def observed_years(year: str, start: str, years: int = 5) -> Column:
    """How many of the years before t lie at or after the start of the identity."""
    return F.greatest(F.lit(0), F.least(F.lit(years), F.col(year) - F.col(start)))


def hash_sample(df: DataFrame, strata: Sequence[str], key: Column, n: int, seed: str) -> DataFrame:
    """The n rows of each stratum with the least seeded hashes: the same rows on any partitioning.

    Each stratum is cut to n rows in 64 salted parts before its parts meet.
    """
    hashed = df.withColumn("__h", F.md5(F.concat(F.lit(seed), key)))
    salted = hashed.withColumn("__s", F.conv(F.substring("__h", 31, 2), 16, 10).cast("int") % 64)
    first = salted.withColumn("__n", F.row_number().over(Window.partitionBy(*strata, "__s").orderBy("__h"))).where(F.col("__n") <= n)
    last = first.withColumn("__n", F.row_number().over(Window.partitionBy(*strata).orderBy("__h"))).where(F.col("__n") <= n)
    return last.drop("__h", "__s").withColumnRenamed("__n", "pick")


def balanced_sample(candidates: DataFrame, cells: Sequence[str], unit: str, region: str, seed: str) -> list[tuple]:
    """One row per cell in order: no unit twice, and from the region used least so far.

    Sequential by definition, with one step per cell. A step can only be barred from the units of the steps before,
    so as many candidates per cell and region as there are cells, by seeded hash, decide as all of them would; they
    are found in one pass, and no more reach the driver. Null regions and units are no candidates.
    """
    n_cells = candidates.select(*cells).distinct().count()
    hashed = candidates.select(*cells, unit, region).dropna(subset=[unit, region]).distinct().withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(unit).cast("string"))))
    first = Window.partitionBy(*cells, region).orderBy("__h", unit)
    few = hashed.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= n_cells)
    offers: dict[tuple, list] = {}
    for r in few.collect():
        offers.setdefault(tuple(r[c] for c in cells), []).append((r["__h"], r[unit], r[region]))
    out: list[tuple] = []
    used_units: set = set()
    used: dict[str, int] = {}
    for cell in sorted(offers, key=lambda c: tuple((v is not None, v) for v in c)):
        open_ = [o for o in offers[cell] if o[1] not in used_units]
        if not open_:
            continue
        least = min(used.get(o[2], 0) for o in open_)
        _, pick, where = min(o for o in open_ if used.get(o[2], 0) == least)
        out.append((*cell, pick, where))
        used_units.add(pick)
        used[where] = used.get(where, 0) + 1
    return out
