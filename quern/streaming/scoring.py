"""Scoring of texts in chunks, resumable: what is cached is skipped, what has changed is refused."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.relational import ContractError

BUDGET = 480
#: Most tokens of a pair with its three marks.
PAIR_BUDGET = 512
#: Pairs that a scorer gets at once.
BATCH = 64
_TOKEN = re.compile(r"\w+|[^\w\s]", re.UNICODE)
_TERMINAL, _CLOSING = np.array([ord(c) for c in ".!?"]), np.array([ord(c) for c in "\"”’'"])


def token_spans(text: str) -> list[tuple[int, int]]:
    """Words and single marks with their places; stands in where no model's tokenizer is given."""
    return [m.span() for m in _TOKEN.finditer(text)]


def closing_tokens(text: str, offsets: np.ndarray) -> np.ndarray:
    """For each token whether a sentence ends with it: a terminal mark, or a closing mark right after one, before white space or the end."""
    if not len(offsets):
        return np.zeros(0, dtype=bool)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    start, end = offsets[:, 0], offsets[:, 1]
    last = code[end - 1]
    mark = np.isin(last, _TERMINAL)
    after_mark = np.zeros(len(code) + 1, dtype=bool)
    after_mark[end[mark]] = True
    out = mark | np.isin(last, _CLOSING) & (end - start == 1) & after_mark[start]
    for k in np.flatnonzero(out).tolist():
        out[k] = end[k] == len(text) or text[end[k]].isspace()
    return out


def chunks_of(text: str, spans: Sequence[tuple[int, int]], budget: int = BUDGET) -> np.ndarray:
    """Rows of start_token, end_token, start_char, end_char: the tokens parted without overlap or loss.

    A chunk ends with the last sentence that ends in the latter half of its budget, else at the budget. The nearest
    sentence end up to each token is known beforehand as a running maximum, so a chunk is one look-up.
    """
    if budget < 1:
        raise ValueError("a chunk needs a token at least")
    offsets = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
    n = len(offsets)
    nearest = np.maximum.accumulate(np.where(closing_tokens(text, offsets), np.arange(1, n + 1), 0)) if n else offsets[:, 0]
    bounds = [0]
    while (at := bounds[-1]) < n:
        full = at + budget
        bounds.append(n if full >= n else max(full if nearest[full - 1] < at + max(1, budget // 2) else int(nearest[full - 1]), at + 1))
    first, last = np.array(bounds[:-1], dtype=np.int64), np.array(bounds[1:], dtype=np.int64)
    return np.stack([first, last, offsets[first, 0], offsets[last - 1, 1]], axis=1) if n else np.zeros((0, 4), dtype=np.int64)


# -- pairs and their scorer --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pair:
    """A premise and a hypothesis in the form that an inference model takes."""

    text: str
    tokens: int


def pair_of(premise: str, hypothesis: str, most: int = PAIR_BUDGET, cut: bool = False, sizes: tuple[int, int] | None = None) -> Pair:
    """[CLS] premise [SEP] hypothesis [SEP], of ``most`` tokens at most; ``sizes`` are the tokens of both, if they are known.

    A longer pair raises, or (``cut``) loses the end of its premise, as a model does that is given whole texts.
    """
    first, second = sizes or (len(token_spans(premise)), len(token_spans(hypothesis)))
    room = most - second - 3
    if first > room:
        if not cut or room < 0:
            raise ContractError(f"a pair of {first + second + 3} tokens, {most} allowed")
        premise, first = (premise[: token_spans(premise)[room - 1][1]] if room else ""), room
    return Pair(f"[CLS] {premise} [SEP] {hypothesis} [SEP]", first + second + 3)


#: Takes pairs and gives a row of logits for each, that of entailment first.
Scorer = Callable[[Sequence[Pair]], np.ndarray]


def stand_in() -> Scorer:
    """A deterministic scorer where no model is at hand: the first logit is in [-2, 2] by the hash of the pair, the other 0."""

    def score(pairs: Sequence[Pair]) -> np.ndarray:
        part = np.array([int(hashlib.md5(p.text.encode()).hexdigest()[:8], 16) for p in pairs], dtype=np.float64) / 0xFFFFFFFF
        return np.stack([4 * part - 2, np.zeros(len(pairs))], axis=1)

    return score


def entailment(logits: np.ndarray) -> np.ndarray:
    """The share of the first class by softmax."""
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted[:, 0] / shifted.sum(axis=1)


_SCORERS: dict[str, Scorer] = {}


def score_chunks(
    df: DataFrame, keys: Sequence[str], text: str, *, labels: Sequence[str] = ("trust", "threat"), budget: int = BUDGET, load: Callable[[], Scorer] = stand_in, batch: int = BATCH, whole: bool = False
) -> DataFrame:
    """One row per chunk: the keys, chunk_no, places, tokens and a score per label. Null and empty texts give no row.

    ``load`` makes the scorer, once for each process of a worker; it gets ``batch`` pairs of chunk and label at a time,
    across texts. ``whole`` scores each text as one chunk, cut at what a pair can hold: its tail has no say then, which
    its ``tokens`` show (those that were scored).
    """
    name = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = ["chunk_no", "start_token", "end_token", "start_char", "end_char", "tokens"]
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{n} int" for n in names], *[f"{x} double" for x in labels]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:
            _SCORERS[name] = load()
        scorer = _SCORERS[name]
        sizes = [len(token_spans(x)) for x in labels]
        for found in batches:
            of: list[int] = []
            places: list[tuple[int, ...]] = []
            pairs: list[Pair] = []
            for r, t in enumerate(found.column(len(keys)).to_pylist()):
                spans = token_spans(t)
                for i, (a, b, c, d) in enumerate(chunks_of(t, spans, max(1, len(spans)) if whole else budget).tolist()):
                    made = [pair_of(t[c:d], x, cut=whole, sizes=(b - a, k)) for x, k in zip(labels, sizes)]
                    held = min(b - a, *[p.tokens - 3 - k for p, k in zip(made, sizes)])
                    of.append(r)
                    places.append((i, a, b, c, d, held))
                    pairs += made
            scores = np.concatenate([entailment(scorer(pairs[i : i + batch])) for i in range(0, len(pairs), batch)]) if pairs else np.zeros(0)
            columns = [found.column(i).take(pa.array(of, pa.int32())) for i in range(len(keys))]
            columns += [pa.array([p[i] for p in places], pa.int32()) for i in range(len(names))]
            columns += [pa.array(scores[i :: len(labels)], pa.float64()) for i in range(len(labels))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *names, *labels])

    return df.select(*keys, text).where(F.length(text) > 0).mapInArrow(run, schema)


def weighted_scores(chunks: DataFrame, keys: Sequence[str], scores: Sequence[str], weight: str = "tokens") -> DataFrame:
    """Means weighted by tokens, with the number of chunks and their least, median and most tokens.

    A weight that is not positive, or a score not in [0, 1], raises when the result is made.
    """
    w = F.col(weight)
    wrong = F.coalesce(w <= 0, F.lit(True))
    for s in scores:
        wrong = wrong | ~F.coalesce(F.col(s).between(0, 1), F.lit(False))
    checked = F.when(wrong, F.raise_error("a weight is not positive, or a score not in [0, 1]").cast("double")).otherwise(w)
    total = F.sum(checked)
    return chunks.groupBy(*keys).agg(
        *[(F.sum(F.col(s) * w) / total).alias(s) for s in scores],
        F.count(F.lit(1)).alias("chunk_count"), F.min(w).alias("chunk_tokens_min"), F.percentile(w, F.lit(0.5)).alias("chunk_tokens_median"), F.max(w).alias("chunk_tokens_max"), F.sum(w).alias("tokens_scored"),
    )


# -- the cache ---------------------------------------------------------------------------------------------------


def pending(inputs: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs that the cache does not have."""
    return inputs.join(cache.select(*keys).distinct(), list(keys), "left_anti")


def stale(inputs: DataFrame, cache: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Cached keys whose text has another hash now."""
    return inputs.select(*keys, F.sha2(text, 256).alias("expected_hash")).join(cache.select(*keys, "text_hash"), list(keys)).where("expected_hash != text_hash")


def open_cache(spark: SparkSession, path: str, spec_hash: str) -> DataFrame | None:
    """The cache at ``path``, None where there is none yet.

    Only its absence counts as empty: a cache that cannot be read, or was made to another specification, raises, so that
    nothing is scored again or appended beside it.
    """
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(file) or not any(s.getPath().getName()[0] not in "_." for s in system.listStatus(file)):
        return None
    cache = spark.read.parquet(path)
    other = cache.where(~F.col("spec_hash").eqNullSafe(spec_hash)).limit(1).collect()
    if other:
        raise ContractError(f"{path} was made to the specification {other[0]['spec_hash']}, not {spec_hash}; use another path")
    return cache


def to_score(inputs: DataFrame, cache: DataFrame | None, keys: Sequence[str], text: str) -> DataFrame:
    """The inputs that are left to score; raises where a cached text has changed."""
    if cache is None:
        return inputs
    if not stale(inputs, cache, keys, text).isEmpty():
        raise ContractError("a cached text has changed")
    return pending(inputs, cache, keys)


def scored(inputs: DataFrame, keys: Sequence[str], text: str, spec_hash: str, **options) -> DataFrame:
    """The rows of a cache: means of the chunks of each text, with the hashes of text and specification."""
    made = weighted_scores(score_chunks(inputs, keys, text, **options), keys, ["trust", "threat"])
    hashes = inputs.select(*keys, F.sha2(text, 256).alias("text_hash"))
    return made.join(hashes, list(keys)).withColumn("spec_hash", F.lit(spec_hash))


def score_stream(spark: SparkSession, source: str, schema: str, cache: str, checkpoint: str, *, keys: Sequence[str], text: str, spec_hash: str, **options):
    """Scores new files of a folder and appends to the cache, once for each batch; a restart goes on where it stopped.

    Batches are checked against the cache first: keys that it has are left out, changed texts, another specification
    and a cache that cannot be read raise before anything is appended.
    """

    def one(batch: DataFrame, _: int) -> None:
        todo = to_score(batch.dropDuplicates(list(keys)), open_cache(spark, cache, spec_hash), keys, text)
        scored(todo, keys, text, spec_hash, **options).write.mode("append").parquet(cache)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def single_writer(path: str):
    """Holds a lock file, so that one process at a time appends to a cache; raises if another holds it.

    It guards processes that see one file system with locks; across hosts on an object store a table format with
    commits has to take its place.
    """
    import fcntl

    with open(path, "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise ContractError(f"another process holds {path}") from e
        yield
