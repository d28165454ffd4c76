"""Mixing sources to target weights, with a cap on repeats, by Pareto order sampling.

Each document of a source gets an expected number of copies; its whole part is certain, the rest is the inclusion
probability of a Pareto sample: documents are ranked by their random odds over their inclusion odds, and the
first ones are taken, as many as the source's tokens call for. The cut in the ranking is found from a histogram of
the ranks, so no source is ever sorted in one task. Behind the cut the ranking goes on with the documents that still
fit, so the tokens are met although documents are not divided.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut

#: Expected copies grow with this power of a document's size.
SIZE_POWER = 0.25
SEED = 20260925
#: Sizes up to EXACT tokens have bins of their own; beyond, a bin is 1/STEPS of a factor e wide.
EXACT, STEPS = 1024, 256
#: The same for very many sources, so that the plan on the driver stays within MAX_PLAN rows.
COARSE_EXACT, COARSE_STEPS = 64, 16
MAX_PLAN = 1_000_000
#: Larger plans than this are joined by shuffle, not sent to all executors.
MAX_SENT = 200_000
#: Bins of the ranking, from 0 to 1 in the odds' share.
RANKS = 1 << 16
#: Most rows of the list of targets.
MAX_TARGETS = 10_000


def size_bin(tokens: Column, exact: int = EXACT, steps: int = STEPS) -> Column:
    return F.when(tokens <= exact, tokens).otherwise(exact + 1 + F.floor(steps * F.log(tokens / exact))).cast("int")


def _size_of(bin_: int, exact: int = EXACT, steps: int = STEPS) -> float:
    return float(bin_) if bin_ <= exact else exact * math.exp((bin_ - exact - 0.5) / steps)


@dataclass(frozen=True)
class Target:
    mix: str
    source: str
    share: float
    repeats: int


def expected_copies(bins: dict[int, int], repeats: int, tokens: float, power: float = SIZE_POWER, exact: int = EXACT, steps: int = STEPS) -> dict[int, float]:
    """Copies of a document by its size bin, at most ``repeats``, that make up ``tokens``; ``bins`` has the tokens of each bin."""
    weight = {b: _size_of(b, exact, steps) ** power for b in bins}
    total = lambda k: sum(n * min(repeats, k * weight[b]) for b, n in bins.items())
    low, high = 0.0, repeats / min(weight.values())
    if total(high) <= tokens:
        return dict.fromkeys(bins, float(repeats))
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < tokens else (low, mid)
    return {b: min(float(repeats), high * weight[b]) for b in bins}


def budgets(targets: Sequence[Target], available: dict[str, int], total: float | None = None) -> dict[tuple[str, str], float]:
    """Tokens wanted of each source of each mix.

    Sources without documents can give nothing; the others keep their proportions. Without a ``total`` a mix is
    as large as the repeats allow at exact proportions; with one, sources give what they can up to their cap.
    """
    out: dict[tuple[str, str], float] = {}
    for mix in {t.mix for t in targets}:
        own = [t for t in targets if t.mix == mix and t.share > 0 and available.get(t.source, 0) > 0 and t.repeats > 0]
        whole = sum(t.share for t in own)
        if not own:
            continue
        limit = min(t.repeats * available[t.source] * whole / t.share for t in own)
        size = limit if total is None else total
        for t in own:
            out[mix, t.source] = min(size * t.share / whole, float(t.repeats * available[t.source]))
    return out


def mix_sources(
    sizes: DataFrame, targets: Sequence[Target], *, id_column: str, source_column: str, size_column: str, total: float | None = None, power: float = SIZE_POWER, seed: int = SEED
) -> tuple[DataFrame, dict[str, int]]:
    """Selected documents with their copies: mix_id, source, the id, n_tokens, copies; and the tokens that each source has.

    Documents with a null source or without tokens are in no mix; empty tables give none. A source listed twice in
    a mix is an error. Ids are taken to be unique. The tokens taken of a source miss its budget by about its
    shortest documents, or by what its repeats cannot give.
    """
    if len(targets) > MAX_TARGETS:
        raise ValueError(f"over {MAX_TARGETS} targets")
    if len({(t.mix, t.source) for t in targets}) != len(targets):
        raise ValueError("a source is listed twice in a mix")
    spark = sizes.sparkSession
    n = F.col(size_column)
    rows = sizes.where(F.col(source_column).isNotNull() & (n > 0)).select(F.col(id_column).alias("__id"), F.col(source_column).alias("source"), n.cast("int").alias("n_tokens"))
    listed = sorted({t.source for t in targets})
    rows = rows.join(F.broadcast(spark.createDataFrame([(x,) for x in listed], "source string")), "source", "left_semi")
    times = {x: sum(t.source == x for t in targets) for x in listed}
    found: list = []
    for exact, steps in ((EXACT, STEPS), (COARSE_EXACT, COARSE_STEPS)):
        documents = rows.withColumn("__bin", size_bin(F.col("n_tokens"), exact, steps))
        # one row more than the bound is asked for, so that no larger table reaches the driver
        found = documents.groupBy("source", "__bin").agg(F.sum("n_tokens")).limit(MAX_PLAN + 1).collect()
        if sum(times[r[0]] for r in found) <= MAX_PLAN and len(found) <= MAX_PLAN:
            break
    else:
        raise ValueError(f"the mixes have over {MAX_PLAN} sources and sizes; mix fewer at a time")
    bins: dict[str, dict[int, int]] = {}
    for source, b, tokens in found:
        bins.setdefault(source, {})[b] = tokens
    available = {s: sum(x.values()) for s, x in bins.items()}
    wanted = budgets(targets, available, total)
    repeats = {(t.mix, t.source): t.repeats for t in targets}
    planned, rests = [], []
    for (mix, source), tokens in sorted(wanted.items()):
        copies = expected_copies(bins[source], repeats[mix, source], tokens, power, exact, steps)
        certain = 0
        for b, k in copies.items():
            whole = int(k + 1e-9)
            part = max(0.0, k - whole)
            certain += whole * bins[source][b]
            planned.append((mix, source, b, whole, part if part > 1e-9 else 0.0))
        rests.append((mix, source, float(tokens - certain)))
    plan = spark.createDataFrame(planned, "mix_id string, source string, __bin int, __whole int, __part double")
    rest = spark.createDataFrame(rests, "mix_id string, source string, __rest double")

    # the plan has a row for each mix, source and size bin, whatever the number of documents
    offered = documents.join(F.broadcast(plan) if len(planned) <= MAX_SENT else plan, ["source", "__bin"])
    random = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "__id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    odds = random / (1 - random) / (F.col("__part") / (1 - F.col("__part")))
    offered = offered.withColumn("__rank", F.when(F.col("__part") > 0, odds / (1 + odds)))
    offered = offered.withColumn("__slot", F.least(F.lit(RANKS - 1), F.floor(F.col("__rank") * RANKS)).cast("int"))
    group = ["mix_id", "source"]
    slots = offered.where("__slot is not null").groupBy(*group, "__slot").agg(F.sum("n_tokens").alias("__t"))
    running = F.sum("__t").over(Window.partitionBy(*group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.withColumn("__before", F.coalesce(running, F.lit(0))).join(F.broadcast(rest), group)
    edge = slots.where((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("__t") > F.col("__rest")))
    edge = edge.select(*group, F.col("__slot").alias("__edge"), F.col("__before"), F.col("__rest"))
    # one row for each mix and source; without an edge all partial documents are taken
    judged = offered.join(F.broadcast(edge), group, "left")
    clear = judged.where(F.col("__slot").isNull() | F.col("__edge").isNull() | (F.col("__slot") != F.col("__edge")))
    clear = clear.withColumn("__more", F.when(F.col("__slot").isNull(), 0).when(F.col("__edge").isNull() | (F.col("__slot") < F.col("__edge")), 1).otherwise(0))
    close = judged.where(F.col("__slot") == F.col("__edge"))
    upto = F.sum("n_tokens").over(Window.partitionBy(*group).orderBy("__rank", "__id").rowsBetween(Window.unboundedPreceding, 0))
    close = close.withColumn("__more", (F.col("__before") + upto <= F.col("__rest")).cast("int"))
    narrow = [*group, "__id", "n_tokens", "__bin", "__rank", "__whole", "__more"]
    ranked = cut(clear.select(*narrow).unionByName(close.select(*narrow)))
    extra = _last_documents(ranked, dict(((m, s), r) for m, s, r in rests))
    added = spark.createDataFrame(extra, f"mix_id string, source string, __id {dict(ranked.dtypes)['__id']}, __extra int")
    out = ranked.join(F.broadcast(added), [*group, "__id"], "left").withColumn("copies", (F.col("__whole") + F.greatest("__more", F.coalesce("__extra", F.lit(0)))).cast("int"))
    return out.where("copies > 0").select(*group, F.col("__id").alias(id_column), "n_tokens", "copies"), available


def _last_documents(ranked: DataFrame, wanted: dict[tuple[str, str], float]) -> list[tuple]:
    """Documents behind the cut that still fit, in the order of their ranks.

    The document at the cut would leave a gap of its own size. The ranking goes on from there: each document that fits
    into the gap is taken; at last one more, or one in place of another, if that brings the tokens nearer. The candidates are the best-ranked one
    of each size bin, whatever the number of documents, so at most one more document of each size and source than the
    sample has is taken.
    """
    group = ["mix_id", "source"]
    taken = {(r[0], r[1]): r[2] or 0 for r in ranked.groupBy(*group).agg(F.sum(F.col("n_tokens") * F.col("__more"))).collect()}
    gaps = [(m, s, w - taken.get((m, s), 0)) for (m, s), w in wanted.items()]
    gaps = [(m, s, g) for m, s, g in gaps if g >= 1]
    if not gaps:
        return []
    open_ = ranked.sparkSession.createDataFrame(gaps, "mix_id string, source string, __gap double")
    left = ranked.where((F.col("__more") == 0) & F.col("__rank").isNotNull()).join(F.broadcast(open_), group).where(F.col("n_tokens") <= 2 * F.col("__gap"))
    # no more groups than the plan has rows
    found: dict[tuple[str, str], list[tuple]] = {}
    for r in left.groupBy(*group, "__bin").agg(F.min(F.struct("__rank", "__id", "n_tokens")).alias("x")).collect():
        found.setdefault((r[0], r[1]), []).append(tuple(r["x"]))
    out = []
    for mix, source, gap in gaps:
        fit, over = [], []
        for _, document, size in sorted(found.get((mix, source), ())):
            if size <= gap:
                fit.append((size, document))
                gap -= size
            else:
                over.append((size, document))
        # one more document, or one in place of another, if that comes nearer
        ways = [(abs(gap), -1, -1)] + [(abs(gap - size), -1, j) for j, (size, _) in enumerate(over)]
        ways += [(abs(gap + own - size), i, j) for i, (own, _) in enumerate(fit) for j, (size, _) in enumerate(over)]
        _, i, j = min(ways)
        chosen = [d for k, (_, d) in enumerate(fit) if k != i] + ([over[j][1]] if j >= 0 else [])
        out += [(mix, source, document, 1) for document in chosen]
    return out
