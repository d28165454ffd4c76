"""Percentiles of very large columns per group, with bounded rank error and mergeable summaries.

A summary is a sorted list of tuples (value, gap, slack): the running sum of the gaps is the least rank
the value can have, and adding the slack gives the greatest. Summaries are made deterministically from
sorted values, merged by adding the rank intervals of neighbours, and compressed as far as the permitted
uncertainty allows. The rank error of any summary is read off its own intervals, so it stays known through
every merge, of partitions as well as of days.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut

#: Rank error (share of the group's values) that a merged summary may have.
EPSILON = 0.01
#: Rows of one group that are summarised by one task; larger groups are salted.
ROWS_PER_TASK = 4_000_000
#: Large groups that are sent to all tasks; more of them are joined by shuffle.
MAX_LARGE = 200_000
#: Values held before they are condensed.
BUFFERED = 1_000_000
#: Summaries merged by one task at each level of the hierarchy.
FAN_IN = 32

TUPLES = "n long, vals array<double>, gaps array<long>, slacks array<long>"


@dataclass
class Summary:
    v: np.ndarray
    g: np.ndarray
    d: np.ndarray

    @property
    def n(self) -> int:
        return int(self.g.sum() + self.d[-1]) if len(self.g) else 0

    @property
    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        low = np.cumsum(self.g)
        return low, low + self.d

    @staticmethod
    def of(values: np.ndarray, eps: float) -> Summary:
        """From raw values: every k-th order statistic, the least and the greatest, at their exact ranks."""
        v = np.sort(values[~np.isnan(values)])
        n = len(v)
        if not n:
            return Summary(v, np.empty(0, np.int64), np.empty(0, np.int64))
        k = max(1, int(2 * eps * n))
        at = np.unique(np.concatenate((np.arange(0, n, k), [n - 1])))
        return Summary(v[at], np.diff(at, prepend=-1).astype(np.int64), np.zeros(len(at), np.int64))

    def merge(self, other: Summary) -> Summary:
        if not len(self.v) or not len(other.v):
            return self if len(self.v) else other
        (al, ah), (bl, bh) = self.ranks, other.ranks

        def add(v, low, high, ov, olow, ohigh, on, side):
            before = np.searchsorted(ov, v, side)  # how many of the other's tuples go before each of ours
            plus_low = np.where(before > 0, olow[np.maximum(before - 1, 0)], 0)
            plus_high = np.where(before < len(ov), ohigh[np.minimum(before, len(ov) - 1)] - 1, on)
            return low + plus_low, high + plus_high

        l1, h1 = add(self.v, al, ah, other.v, bl, bh, other.n, "left")
        l2, h2 = add(other.v, bl, bh, self.v, al, ah, self.n, "right")
        v, low, high = np.concatenate((self.v, other.v)), np.concatenate((l1, l2)), np.concatenate((h1, h2))
        order = np.lexsort((high, low, v))
        v, low, high = v[order], np.maximum.accumulate(low[order]), np.minimum.accumulate(high[order][::-1])[::-1]
        return Summary(v, np.diff(low, prepend=0), high - low)

    def compress(self, eps: float) -> Summary:
        """Drop tuples while the rank interval between neighbours stays within 2 * eps * n; both ends stay."""
        n, size = self.n, len(self.v)
        if size <= 2 or size <= 1 / (2 * eps):
            return self
        low, high = self.ranks
        allowed = max(1, int(2 * eps * n))
        keep, last = [0], 0
        while last < size - 1:
            nxt = int(np.searchsorted(high, low[last] + allowed, "right")) - 1
            last = min(size - 1, max(last + 1, nxt))
            keep.append(last)
        k = np.array(keep)
        return Summary(self.v[k], np.diff(low[k], prepend=0), (high - low)[k])

    def error(self) -> float:
        """Greatest rank error of any quantile, as a share of the values."""
        if len(self.v) < 2:
            return 0.0
        low, high = self.ranks
        return float((high[1:] - low[:-1]).max()) / 2 / self.n

    def quantile(self, p: float) -> float | None:
        """The stored value whose rank interval is centred closest to rank p * n."""
        if not len(self.v):
            return None
        low, high = self.ranks
        target = min(max(p * self.n + 0.5, 1), self.n)
        return float(self.v[int(np.argmin(np.maximum(target - low, high - target)))])

    def counts(self, x: float) -> tuple[int, int, int, int]:
        """Least and greatest number of values below x, and at or below x."""
        low, high = self.ranks

        def bounds(i: int) -> tuple[int, int]:
            return (int(low[i - 1]) if i else 0), (int(high[i]) - 1 if i < len(low) else self.n)

        return bounds(int(np.searchsorted(self.v, x, "left"))) + bounds(int(np.searchsorted(self.v, x, "right")))


@dataclass(frozen=True)
class Grouping:
    """A kind of group: integer key columns and the value columns summarised in it."""

    kind: str
    keys: tuple[str, ...]
    features: tuple[str, ...]


def _segments(keys: list[np.ndarray]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    order = np.lexsort(keys[::-1])
    sorted_keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    at = np.append(np.flatnonzero(new), len(order))
    for a, b in zip(at[:-1], at[1:]):
        yield tuple(int(k[a]) for k in sorted_keys), order[a:b]


def leaf_summaries(df: DataFrame, groupings: Sequence[Grouping], lead: str, eps: float) -> DataFrame:
    """Summaries per partition; ``df`` is sorted by ``lead`` within its partitions, the first key of each grouping.

    Rows with a null in a grouping's keys are outside that grouping. Null and NaN values are left out.
    A group is handed on when ``lead`` moves past it, so a task holds the groups of one ``lead`` value.
    """
    width = max(len(g.keys) for g in groupings)
    key_names = [f"key{i}" for i in range(width)]
    schema = f"kind string, {', '.join(f'{k} long' for k in key_names)}, feature string, leaf int, {TUPLES}"
    wanted = list(groupings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        leaf = TaskContext.get().partitionId()
        raw: dict[tuple, list[np.ndarray]] = {}
        done: dict[tuple, Summary] = {}
        held, current = 0, None

        def condense() -> None:
            for k, parts in raw.items():
                s = Summary.of(np.concatenate(parts), eps)
                done[k] = done[k].merge(s).compress(eps) if k in done else s
            raw.clear()

        def flush(before: int | None) -> pa.RecordBatch | None:
            condense()
            out = [k for k in done if before is None or k[1][0] < before]
            rows = [(k, done.pop(k)) for k in out]
            rows = [(k, s) for k, s in rows if s.n]
            if not rows:
                return None
            cols = {"kind": [k[0] for k, _ in rows]}
            for i, name in enumerate(key_names):
                cols[name] = pa.array([k[1][i] if i < len(k[1]) else None for k, _ in rows], pa.int64())
            cols |= {"feature": [k[2] for k, _ in rows], "leaf": pa.array([leaf] * len(rows), pa.int32()), "n": [s.n for _, s in rows]}
            return pa.RecordBatch.from_pydict(cols | _arrays([s for _, s in rows]))

        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            first = cols[lead].to_numpy(zero_copy_only=False)
            for g in wanted:
                valid = np.ones(batch.num_rows, bool)
                for k in g.keys:
                    valid &= ~cols[k].is_null().to_numpy(zero_copy_only=False)
                at = np.flatnonzero(valid)
                keys = [cols[k].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[at] for k in g.keys]
                values = {f: cols[f].cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)[at] for f in g.features}
                for key, rows in _segments(keys):
                    for f in g.features:
                        v = values[f][rows]
                        v = v[~np.isnan(v)]
                        if len(v):
                            raw.setdefault((g.kind, key, f), []).append(v)
                            held += len(v)
            top = None if not batch.num_rows or np.isnan(first.astype(float)).any() else int(first[-1])
            if top is not None and current is not None and top > current or held > BUFFERED:
                held = 0
                if (out := flush(top if top is not None else -(2**62))) is not None:
                    yield out
            current = top if top is not None else current
        if (out := flush(None)) is not None:
            yield out

    return df.mapInArrow(run, schema)


def _arrays(parts: list[Summary]) -> dict[str, pa.Array]:
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(s.v) for s in parts]))).astype(np.int32))
    flat = lambda xs, t: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(xs), t))
    return {"vals": flat([s.v for s in parts], pa.float64()), "gaps": flat([s.g for s in parts], pa.int64()), "slacks": flat([s.d for s in parts], pa.int64())}


def _summary(batch: pa.RecordBatch, i: int) -> Summary:
    get = lambda name, t: np.asarray(batch.column(name)[i].values).astype(t)
    return Summary(get("vals", np.float64), get("gaps", np.int64), get("slacks", np.int64))


def merge_summaries(df: DataFrame, keys: Sequence[str], leaves: int, eps: float = EPSILON) -> DataFrame:
    """One summary per key, with its rank error. ``leaf`` numbers the parts; FAN_IN of them meet at each level."""
    levels, span = [], 1
    while span < leaves:
        span *= FAN_IN
        levels.append(span)
    for i, span in enumerate(levels or [FAN_IN]):
        last = span == (levels or [FAN_IN])[-1]
        permitted = eps * (0.5 + 0.5 * (i + 1) / max(1, len(levels)))
        df = _merge_level(df.withColumn("leaf", F.lit(0) if last else F.expr(f"leaf div {span}").cast("int")), [*keys, "leaf"], permitted)
    return df.drop("leaf")


def _merge_level(df: DataFrame, keys: list[str], eps: float) -> DataFrame:
    df = df.select(*keys, "n", "vals", "gaps", "slacks")
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + f", {TUPLES}, rank_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close() -> Summary:
            todo = parts
            while len(todo) > 1:  # pairs of pairs: summaries of like size meet
                todo = [todo[i].merge(todo[i + 1]) if i + 1 < len(todo) else todo[i] for i in range(0, len(todo), 2)]
            return todo[0].compress(eps) if len(parts) > 1 else todo[0]

        def emit(rows: list[tuple[tuple, Summary]]) -> pa.RecordBatch:
            cols = {k: pa.array([r[0][i] for r in rows], types[i]) for i, k in enumerate(keys)}
            cols |= {"n": pa.array([s.n for _, s in rows], pa.int64())} | _arrays([s for _, s in rows])
            return pa.RecordBatch.from_pydict(cols | {"rank_error": pa.array([s.error() for _, s in rows], pa.float64())})

        types, rows = [], []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            ids = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            for i, k in enumerate(ids):
                if k != key and parts:
                    rows.append((key, close()))
                    parts = []
                key = k
                parts.append(_summary(batch, i))
            if len(rows) >= 256:
                yield emit(rows)
                rows = []
        if parts:
            rows.append((key, close()))
        if rows:
            yield emit(rows)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def distinct_rows(df: DataFrame, natural_key: Sequence[str], group: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each natural key once, hash-partitioned and sorted by ``group``, large groups salted over several tasks.

    ``group`` is part of the natural key, so copies meet without a second exchange. The salt of a group grows
    with its number of rows, which a narrow pre-aggregated count gives; most groups need none.
    """
    rest = [k for k in natural_key if k not in group]
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > rows_per_task)
    large = cut(large.select(*[F.col(k).alias(f"__{k}") for k in group], F.ceil(F.col("__rows") / rows_per_task).alias("__parts")))
    n_large = large.count()
    if n_large:
        # at most one of them for every rows_per_task rows; sent to all tasks while they are few
        on = [df[k].eqNullSafe(large[f"__{k}"]) for k in group]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        salted = df.join(F.broadcast(large) if n_large <= MAX_LARGE else large, condition, "left").drop(*[f"__{k}" for k in group])
        salted = salted.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.coalesce("__parts", F.lit(1)))).drop("__parts")
        return salted.repartition(*group, "__salt").dropDuplicates([*natural_key, "__salt"]).sortWithinPartitions(*group)
    return df.repartition(*group).dropDuplicates(list(natural_key)).sortWithinPartitions(*group)


def grouped_summaries(df: DataFrame, groupings: Sequence[Grouping], natural_key: Sequence[str], eps: float = EPSILON) -> DataFrame:
    """Merged summaries of all groupings: kind, key0.., feature, n, vals, gaps, slacks, rank_error.

    The first key of every grouping is the same column, part of the natural key. Copies of a natural key count
    once. Groups without a valid value are absent; an empty table gives no row. The rank error of a quantile is
    at most ``eps`` of the group's values. Values are taken as they come; filter invalid ones to null before.
    """
    lead = groupings[0].keys[0]
    group = [lead, *[k for k in groupings[0].keys[1:] if k in natural_key]]
    kept = list(dict.fromkeys([*natural_key, *(k for g in groupings for k in g.keys), *(f for g in groupings for f in g.features)]))
    rows = distinct_rows(df.select(*kept), natural_key, group)
    leaves = leaf_summaries(rows, groupings, lead, eps / 2)
    keys = ["kind", *[f"key{i}" for i in range(max(len(g.keys) for g in groupings))], "feature"]
    return merge_summaries(leaves, keys, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), eps)


def with_quantiles(df: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Adds one column per named probability to a table of summaries and drops the tuples."""
    names = list(probabilities)

    @F.pandas_udf(f"struct<{', '.join(f'{n}: double' for n in names)}>")
    def take(v: pd.Series, g: pd.Series, d: pd.Series) -> pd.DataFrame:
        made = [Summary(np.asarray(a, float), np.asarray(b, np.int64), np.asarray(c, np.int64)) for a, b, c in zip(v, g, d)]
        return pd.DataFrame({n: [s.quantile(probabilities[n]) for s in made] for n in names}, columns=names)

    out = df.withColumn("__q", take("vals", "gaps", "slacks"))
    return out.select(*[c for c in out.columns if c not in ("vals", "gaps", "slacks", "__q")], *[F.col(f"__q.{n}").alias(n) for n in names])


def rank_bounds(df: DataFrame, published: str) -> DataFrame:
    """Adds below_lo, below_hi, upto_lo, upto_hi: bounds of the number of values below, and at or below, ``published``."""

    @F.pandas_udf("struct<below_lo: long, below_hi: long, upto_lo: long, upto_hi: long>")
    def bound(v: pd.Series, g: pd.Series, d: pd.Series, x: pd.Series) -> pd.DataFrame:
        rows = [Summary(np.asarray(a, float), np.asarray(b, np.int64), np.asarray(c, np.int64)).counts(y) for a, b, c, y in zip(v, g, d, x)]
        return pd.DataFrame(rows, columns=["below_lo", "below_hi", "upto_lo", "upto_hi"])

    out = df.withColumn("__b", bound("vals", "gaps", "slacks", published))
    return out.select(*[c for c in df.columns if c not in ("vals", "gaps", "slacks")], "__b.*")
