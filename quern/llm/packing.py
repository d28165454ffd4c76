"""Filling fixed-capacity containers with items of varying length, with as little unused space as possible.

The number of containers is planned on the histogram of the lengths, which the capacity bounds whatever the number
of items: the configuration linear program is solved by multiplicative weights until the gap to the dual bound closes,
each round pricing patterns of all lengths with a knapsack dynamic program; the fractions are rounded, what they leave
is priced again by the last weights, and only what no pattern near the best holds is placed by best fit, longest first,
into the space left and into new containers. Items then find their container by their
rank among the items of the same length, which is numbered without sorting a length in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut

#: Rounds of multiplicative weights at least allowed, and for each distinct length; the rounds end sooner, when the gap closes.
ROUNDS = 160
ROUNDS_PER_LENGTH = 2
#: Exponent of the weights (over the root of the round), the gap between fractional solution and dual bound at which the
#: rounds end, and the share of the best value by which a pattern may miss it where none reaches it.
STEP = 0.05
GAP = 0.01
#: Exponent where a step function bounds better than the total length, so that the weights have far to go.
FAR_STEP = 0.5
#: Part of the best step function in the first weights, the rest being the lengths themselves; rounds without a smaller
#: gap after which the rounds end.
STEPPED = 0.9
STALLED = 40
NEAR = 0.005
EXACT = 1e-9
#: Gap and share of a second solution, which is made where the first one, rounded, takes more containers than best fit.
FINE_GAP = 0.004
FINE_NEAR = 0.0005
#: Rounds after which patterns of the best value come before those near it.
WIDE = 8
#: Largest capacity for which the plan is made; it bounds the histogram, the plan and the work on the driver.
MAX_CAPACITY = 65_536


@dataclass
class Group:
    """Containers filled alike."""

    copies: int
    content: Counter
    room: int


def knapsack(size: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest value within every capacity of at most ``most`` items of each length: bounded knapsack by dynamic
    programming, with the items of a length in bundles of powers of two, each bundle one operation over all capacities."""
    best = np.zeros(capacity + 1)
    for s, v, m in zip(size.tolist(), value.tolist(), np.minimum(most, capacity // size).astype(np.int64).tolist()):
        bundle = 1
        while m > 0:
            k = min(bundle, m)
            np.maximum(best[k * s :], best[: capacity + 1 - k * s] + k * v, out=best[k * s :])
            m -= k
            bundle *= 2
    return best


def _through(i: int, size: np.ndarray, value: np.ndarray, best: np.ndarray, upto: np.ndarray, have: np.ndarray, wanted: np.ndarray, near: float) -> dict[int, int] | None:
    """A pattern with length ``i`` whose value is within ``near`` of the best, of no more items than there are (``have``).

    ``upto`` is the number of lengths that fit into each capacity. Of the lengths that keep the value within ``near``, the most wanted is taken each time. None, if there is no such
    pattern on the way taken.
    """
    capacity = len(best) - 1
    c = capacity - int(size[i])
    slack = near - (best[capacity] - best[c] - value[i])
    if slack < 0:
        return None
    pattern = {i: 1}
    usable = np.where(have >= 1, wanted, -np.inf)
    usable[i] = -np.inf if have[i] <= 1 else usable[i]
    while True:
        k = int(upto[c])
        if not k:
            return pattern if best[c] <= slack else None
        loss = best[c] - best[c - size[:k]] - value[:k]
        fit = np.where(loss <= slack, usable[:k], -np.inf)
        j = int(fit.argmax())
        if fit[j] == -np.inf:
            return pattern if best[c] <= slack else None
        slack -= max(0.0, float(loss[j]))
        pattern[j] = pattern.get(j, 0) + 1
        if pattern[j] >= have[j]:
            usable[j] = -np.inf
        c -= int(size[j])


def step_bound(size: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The greatest lower bound of the number of containers by a step function, and its dual values.

    For each e up to half the capacity: an item that leaves less than e beside it counts as a container, one under e as
    nothing, any other by its length; no container holds more than one by that measure.
    """
    share = size / capacity
    best, values = float((counts * share).sum()), share
    for e in range(1, capacity // 2 + 1):
        v = np.where(size > capacity - e, 1.0, np.where(size < e, 0.0, share))
        if (found := float((counts * v).sum())) > best:
            best, values = found, v
    return best, values


@dataclass
class Fractions:
    """A fractional solution: patterns (places of lengths) with their number, the dual values, both sides' bounds."""

    patterns: dict[tuple, float]
    value: np.ndarray
    lower: float
    upper: float
    rounds: int


def fractions(size: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, gap: float = GAP, close: float = NEAR) -> Fractions:
    """The configuration program by multiplicative weights, until the gap is closed.

    In each round the lengths that wait are served, those with least coverage first, by patterns whose value is near
    the greatest, which the bounded knapsack over all lengths gives; what is served more than others weighs less afterwards.
    """
    least, stepped = step_bound(size, counts, capacity)
    start = STEPPED * stepped + (1 - STEPPED) * size / capacity
    step = STEP if least <= (1 + EXACT) * float((counts * size).sum() / capacity) else FAR_STEP
    value, covered = start.copy(), np.zeros(len(size))
    upto = np.searchsorted(size, np.arange(capacity + 1), "right")
    made: dict[tuple, float] = {}
    total, lower, upper, kept, done, smallest, since = 0.0, least, np.inf, value, 0, np.inf, 0
    for r in range(1, rounds + 1):
        done = r
        best = knapsack(size, value, counts, capacity)
        bound = float((counts * value).sum() / best[capacity])
        if bound > lower:
            lower, kept = bound, value
        near = max(close, 1.5 * (1 - bound / lower)) * best[capacity]
        for i in np.argsort(covered - size * 1e-9, kind="stable"):
            while covered[i] < r - 1e-9:
                wanted = r + 1 - covered
                pattern = _through(int(i), size, value, best, upto, counts, wanted, EXACT) if r > WIDE else None
                reach = near
                while pattern is None:  # few items of each length may leave no pattern near the best
                    pattern = _through(int(i), size, value, best, upto, counts, wanted, reach)
                    reach *= 2
                index, uses = np.array(list(pattern)), np.array(list(pattern.values()), dtype=np.float64)
                # as often as the least of its lengths allows, but so that this one or half of a round is done
                times = float((counts[index] * np.maximum(r - covered[index], 0.25) / uses).min())
                covered[index] += times * uses / counts[index]
                key = tuple(sorted(pattern.items()))
                made[key] = made.get(key, 0.0) + times
                total += times
        if covered.min() > 0:
            upper = min(upper, total / float(covered.min()))
        if upper <= max(lower * (1 + gap), np.ceil(lower - 1e-9)):
            break
        smallest, since = (upper / lower, 0) if upper / lower < 1 + 0.99 * (smallest - 1) else (smallest, since + 1)
        if since >= STALLED:
            break
        value = start * np.exp(-step / np.sqrt(r) * (covered - r))
    scale = 1 / float(covered.min()) if len(covered) and covered.min() > 0 else 1 / max(1, done)
    return Fractions({k: x * scale for k, x in made.items()}, kept, lower, upper, done)


@dataclass
class Solved:
    """Groups, the lower bound of their number, the length that patterns place, and the gap and rounds of the fractions."""

    groups: list[Group]
    bound: int
    tokens_by_patterns: int
    gap: float
    rounds: int


def solved(histogram: dict[int, int], capacity: int, rounds: int | None = None) -> Solved:
    """``solve`` with its account of how much the patterns place and how far the fractions are from the bound."""
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"the capacity must be between 1 and {MAX_CAPACITY}")
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("an item is longer than the capacity, or has no length")
    size = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in size], dtype=np.float64)
    if not len(size):
        return Solved([], 0, 0, 0.0, 0)
    most = max(ROUNDS, ROUNDS_PER_LENGTH * len(size)) if rounds is None else rounds
    found = fractions(size, counts, capacity, most)
    bounds = [int(-(-int((counts * size).sum()) // capacity)), int(np.ceil(found.lower - 1e-6))]
    for dual in ((2 * size > capacity).astype(float), 1.0 / (capacity // size)):
        worth = float(knapsack(size, dual, counts, capacity)[capacity])
        bounds.append(int(np.ceil(float((counts * dual).sum()) / worth - 1e-6)) if worth > 0 else 0)
    # the fractions are rounded to the nearest, with what is left priced again, or down; if best fit alone takes fewer
    # containers, they are made finer, and if that does not help, best fit it is: no plan is worse
    plain = _best_fit([], Counter(histogram), capacity)
    fewest = sum(g.copies for g in plain)
    made: list[tuple[int, list[Group], int, Fractions]] = []
    for fine in (False, True):
        solution = fractions(size, counts, capacity, most, FINE_GAP, FINE_NEAR) if fine else found
        for nearest in (True, False):
            groups, left = _rounded(solution, size, histogram, capacity, nearest)
            tokens = sum(g.copies * (capacity - g.room) for g in groups)
            groups = _best_fit(groups, Counter({int(x): int(n) for x, n in zip(size, left) if n}), capacity)
            made.append((sum(g.copies for g in groups), groups, tokens, solution))
            if made[-1][0] <= fewest:
                break
        if made[-1][0] <= fewest:
            break
    made.append((fewest, plain, 0, found))
    _, groups, tokens, solution = min(made, key=lambda x: x[0])
    return Solved(groups, max(bounds), tokens, solution.upper / solution.lower - 1 if solution.lower else np.inf, solution.rounds)


def _rounded(found: Fractions, size: np.ndarray, histogram: dict[int, int], capacity: int, nearest: bool) -> tuple[list[Group], np.ndarray]:
    """Whole containers from the fractions, and how many items of each length are left."""
    counts = np.array([histogram[int(x)] for x in size], dtype=np.float64)
    left = counts.astype(np.int64)
    groups: list[Group] = []

    def commit(pattern: dict[int, int], most: int) -> int:
        copies = min([most, *(int(left[i]) // k for i, k in pattern.items())])
        if copies > 0:
            content = Counter({int(size[i]): k for i, k in pattern.items()})
            groups.append(Group(copies, content, capacity - sum(x * k for x, k in content.items())))
            for i, k in pattern.items():
                left[i] -= copies * k
        return copies

    # whole parts first, then one more of those with the greatest parts, as long as their items are there
    order = sorted(found.patterns.items(), key=lambda x: (-(x[1] % 1), x[0]))
    for key, x in order:
        commit(dict(key), int(x))
    if not nearest:
        return groups, left
    for key, x in order:
        if x % 1 >= 0.5:
            commit(dict(key), 1)
    # what is left is priced again, by its own lengths, until no pattern near the best is left
    near = EXACT
    while left.any():
        open_ = np.flatnonzero(left)
        mine, worth = size[open_], found.value[open_]
        best = knapsack(mine, worth, left[open_], capacity)
        upto = np.searchsorted(mine, np.arange(capacity + 1), "right")
        again = False
        for i in range(len(open_) - 1, -1, -1):
            while left[open_[i]] > 0:
                have = left[open_]
                pattern = _through(i, mine, worth, best, upto, have, have / counts[open_], near * best[capacity])
                if pattern is None:
                    break
                again = True
                commit({int(open_[j]): k for j, k in pattern.items()}, max(1, int(min(have[j] // k for j, k in pattern.items()) // 2)))
        if not again and near == NEAR:
            break
        near = near if again else NEAR
    return groups, left


def solve(histogram: dict[int, int], capacity: int, rounds: int | None = None) -> tuple[list[Group], int]:
    """Groups of containers that hold all items of the histogram, and a lower bound of their number.

    The bound is the greatest of the total length over the capacity, the value of a step function or of the weights of a
    round as a solution of the dual program, the number of items over half the capacity, and what each length would take by itself.
    """
    made = solved(histogram, capacity, rounds)
    return made.groups, made.bound


def _best_fit(groups: list[Group], rest: Counter, capacity: int) -> list[Group]:
    """Places what remains, longest first, where it fits tightest; works on groups, not on single items."""
    made = list(groups)
    rooms: list[tuple[int, int]] = sorted((g.room, i) for i, g in enumerate(made) if g.room > 0)
    for length in sorted(rest, reverse=True):
        todo = rest[length]
        while todo > 0:
            k = bisect_left(rooms, (length, -1))
            if k == len(rooms):
                each = capacity // length
                whole, tail = divmod(todo, each)
                for copies, uses in ((whole, each), (1 if tail else 0, tail)):
                    if copies:
                        made.append(Group(copies, Counter({length: uses}), capacity - uses * length))
                        if made[-1].room:
                            insort(rooms, (made[-1].room, len(made) - 1))
                break
            room, i = rooms.pop(k)
            g = made[i]
            fits = min(room // length, max(1, todo // g.copies))
            served = min(g.copies, todo // fits if fits <= todo else 1)
            served = max(1, served)
            if served < g.copies:  # the others stay as they are
                made.append(Group(g.copies - served, Counter(g.content), room))
                insort(rooms, (room, len(made) - 1))
                g.copies = served
            g.content[length] += fits
            g.room = room - fits * length
            todo -= fits * served
            if g.room:
                insort(rooms, (g.room, i))
    return made


@dataclass
class Plan:
    """For each length, sorted: runs of ranks with the first container and the number of containers they go round."""

    length: np.ndarray
    start: np.ndarray
    base: np.ndarray
    copies: np.ndarray
    containers: int
    bound: int
    pattern_share: float
    gap: float


def plan(histogram: dict[int, int], capacity: int, rounds: int | None = None) -> Plan:
    """The plan, with the share of all length that patterns place (1 of nothing) and the gap of the fractional solution."""
    found = solved(histogram, capacity, rounds)
    groups, bound = found.groups, found.bound
    rows: list[tuple[int, int, int, int]] = []
    taken: Counter = Counter()
    base = 0
    for g in groups:
        for length, uses in g.content.items():
            rows.append((length, taken[length], base, g.copies))
            taken[length] += uses * g.copies
        base += g.copies
    if any(taken[x] != n for x, n in histogram.items()):
        raise AssertionError("the plan does not hold every item")
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    total = sum(x * n for x, n in histogram.items())
    return Plan(*columns, containers=base, bound=bound, pattern_share=found.tokens_by_patterns / total if total else 1.0, gap=found.gap)


def items_of(sizes: DataFrame, id_column: str, size_column: str, capacities: Sequence[int]) -> DataFrame:
    """One row per capacity and item: documents of up to the capacity whole, longer ones in parts of the capacity and a last one."""
    listed = F.array(*[F.lit(int(c)) for c in capacities]) if capacities else F.array().cast("array<int>")
    whole = sizes.where(F.col(size_column) > 0).select(F.col(id_column), F.col(size_column).alias("__n"), F.explode(listed).alias("capacity"))
    out = whole.select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__n") / F.col("capacity")).cast("int"))).alias("part_no"))
    start = ((F.col("part_no") - 1) * F.col("capacity")).cast("int")
    return out.select("capacity", id_column, "part_no", start.alias("start_token"), F.least("capacity", F.col("__n") - start).cast("int").alias("n_tokens"))


def pack(sizes: DataFrame, id_column: str, size_column: str, capacities: Sequence[int], rounds: int | None = None) -> tuple[DataFrame, dict[int, Plan]]:
    """Every item with its container for each capacity: capacity, the id, part_no, start_token, n_tokens, container (from 0).

    Only items longer than a capacity are divided. Null and zero sizes need no container and give no row; an
    empty table gives none. Repeated ids are packed one by one. The plans on the driver are bounded by the capacities.
    All capacities are counted, ranked and placed in one pass.
    """
    capacities = sorted(set(capacities))
    if any(not 0 < c <= MAX_CAPACITY for c in capacities):
        raise ValueError(f"the capacity must be between 1 and {MAX_CAPACITY}")
    items = items_of(sizes, id_column, size_column, capacities)

    # rank among the items of one length: numbered within buckets of the length, offset by the buckets before
    buckets = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    bucketed = items.withColumn("__b", F.pmod(F.xxhash64(id_column, "part_no"), F.lit(buckets)).cast("int"))
    length = ["capacity", "n_tokens"]
    per = cut(bucketed.groupBy(*length, "__b").agg(F.count(F.lit(1)).alias("__c")))
    histograms: dict[int, dict[int, int]] = {c: {} for c in capacities}
    for c, n, k in per.groupBy(*length).agg(F.sum("__c")).collect():
        histograms[c][n] = k
    plans = {c: plan(h, c, rounds) for c, h in histograms.items()}
    before = F.sum("__c").over(Window.partitionBy(*length).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select(*length, "__b", F.coalesce(before, F.lit(0)).alias("__o"))
    within = F.row_number().over(Window.partitionBy(*length, "__b").orderBy(id_column, "part_no"))
    ranked = bucketed.withColumn("__w", within - 1).join(offsets, [*length, "__b"]).withColumn("__r", F.col("__w") + F.col("__o"))
    ranked = ranked.select("capacity", id_column, "part_no", "start_token", "n_tokens", F.col("__r").cast("long").alias("__r"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "__r") + ", container long"
    # runs of all plans, sorted by capacity, length and first rank; one search finds the run of an item
    columns = {n: np.concatenate([getattr(plans[c], n) for c in capacities]) if capacities else np.zeros(0, np.int64) for n in ("length", "start", "base", "copies")}
    group = np.concatenate([c * (MAX_CAPACITY + 1) + plans[c].length for c in capacities]) if capacities else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, first = np.unique(group, return_index=True)
        last = np.append(first[1:], len(group))
        start, base, copies = columns["start"], columns["base"], columns["copies"]
        reach = int(start.max()) + 1 if len(start) else 1
        key = np.repeat(np.arange(len(groups)), last - first) * (reach + 1) + start
        for batch in batches:
            c, n, r = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("capacity", "n_tokens", "__r"))
            which = np.searchsorted(groups, c * (MAX_CAPACITY + 1) + n)
            run = np.searchsorted(key, which * (reach + 1) + np.minimum(r, reach), "right") - 1
            container = base[run] + (r - start[run]) % copies[run]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "__r"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(container, pa.int64())], names=[x for x in batch.schema.names if x != "__r"] + ["container"])

    return ranked.mapInArrow(place, schema), plans
